"""Columns of events and of the read-model, and the fixed vocabulary of event types."""

from __future__ import annotations

#: One event of a log; payload is kept as JSON text and parsed where it is read.
EVENT = "id string, seq long, type string, actor string, device_id string, ts_device long, payload string, prev_hash string, hash string, origin_seq long, origin_device string, server_time long, signature string, countersignatures array<struct<deviceId:string,signatureHex:string>>"

#: Event types, what a transition leads to, and states that an entry may be appended in.
GENESIS = "GENESIS"
ENTRY, ADD, REMOVE, UNDO = "entry", "tally.add", "tally.remove", "undo.compensate"
TRANSITIONS = {"entry.resolved": "RESOLVED_ONLINE", "entry.failed": "FAILED", "entry.expired": "EXPIRED"}
HIDE, SHOW = "tombstone.hide", "tombstone.show"
APPEND_STATES = ["DRAFT", "RECORDED"]
DOMAIN = [ENTRY, ADD, REMOVE]
