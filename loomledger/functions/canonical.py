"""Canonical text and hash of an event."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = ["id", "seq", "type", "actor", "device_id", "ts_device", "payload", "prev_hash"]


def quoted(text: Column) -> Column:
    """A JSON string literal, or null's literal."""
    inside = F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    return F.when(text.isNull(), "null").otherwise(inside)


def canonical(e: dict[str, Column]) -> Column:
    """The bytes that are hashed: fixed key order, payload keys sorted at every depth (as Spark's variants print them)."""
    parts = [
        F.lit('{"id":'), quoted(e["id"]), F.lit(',"seq":'), e["seq"].cast("string"), F.lit(',"type":'), quoted(e["type"]),
        F.lit(',"actor":'), quoted(e["actor"]), F.lit(',"device_id":'), quoted(e["device_id"]),
        F.lit(',"ts_device":'), e["ts_device"].cast("string"), F.lit(',"payload":'), sorted_json(e["payload"]),
        F.lit(',"prev_hash":'), quoted(e["prev_hash"]), F.lit("}"),
    ]
    return F.concat(*parts)


#: Payloads whose text Spark's variants would print otherwise: exponents, digits as keys, escapes, or doubled keys (which do not parse).
_ODD = r'(?<=[\d.])[eE][+-]?\d|"\d+"\s*:|\\|[\x{2028}\x{2029}\x{10000}-\x{10FFFF}]|\.\d{15,}|\.\d*0[,}\]\s]|\d{17,}|-0[,}\]\s]'


def sorted_json(payload: Column) -> Column:
    """A payload's JSON with sorted keys. The few odd texts take the Python rules, all others stay in the JVM."""
    parsed = F.try_parse_json(payload)
    odd = F.when(payload.rlike(_ODD) | parsed.isNull(), payload)
    by_rules = F.udf(lambda text: None if text is None else canonical_json(text), T.StringType(), useArrow=True)
    return F.when(odd.isNotNull(), by_rules(odd)).otherwise(F.to_json(parsed))


def number_json(x: float | int | bool | None) -> str:
    """A number as ECMAScript prints it."""
    if isinstance(x, int):
        x = float(x) if abs(x) > 1 << 53 else x
    if isinstance(x, int):
        return str(x)
    digits, _, exponent = repr(x).partition("e")
    if x == int(x) and abs(x) < 1e21:  # the shortest digits that name it, then zeros
        return ("-" if x < 0 else "") + digits.lstrip("-").replace(".", "").ljust(int(exponent) + 1, "0") if exponent else str(int(x))
    if not exponent:
        return digits
    n = int(exponent)
    if -7 < n < 0:
        return f"{x:.{len(digits.replace('.', '').lstrip('-')) - 1 - n}f}"
    return f"{digits.removesuffix('.0')}e{'+' if n > 0 else '-'}{abs(n)}"


def _value(x) -> str:
    if isinstance(x, dict):
        keys = sorted(x, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        index = [k for k in keys if k.isdigit() and str(int(k)) == k and int(k) < 2**32 - 1]
        rest = [k for k in keys if k not in set(index)]
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_value(x[k])}" for k in sorted(index, key=int) + rest) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(_value, x)) + "]"
    if x is None or isinstance(x, bool):
        return json.dumps(x)
    return number_json(x) if isinstance(x, int | float) else json.dumps(x, ensure_ascii=False)


def canonical_json(text: str) -> str | None:
    """Key-sorted JSON by ECMAScript's rules, the last of doubled keys; None if it is no JSON."""
    try:
        return _value(json.loads(text))
    except (ValueError, RecursionError):
        return None


def hash_of(event: dict, payload: str | None = None) -> str:
    """Hash of one event, for the sequential parts: appending and tests. payload: its sorted JSON, where that is known."""
    text = json.dumps
    head = ",".join(f'"{k}":{payload or canonical_json(event[k]) if k == "payload" else text(event.get(k), ensure_ascii=False)}' for k in FIELDS)
    return hashlib.sha256(f"{{{head}}}".encode()).hexdigest()


def event_hash(columns: dict[str, Column] | None = None) -> Column:
    return F.sha2(canonical(columns or {k: F.col(k) for k in FIELDS}), 256)
