"""Which device a store belongs to, and cursors kept beside it as key and value."""

from __future__ import annotations

import uuid


class DeviceMismatch(ValueError):
    """A store opened under another id than the one it was explicitly given."""


def adopt(meta: dict[str, str], device_id: str | None = None) -> tuple[str, dict[str, str]]:
    """(device id, new meta). An id once given explicitly is final; one given by chance yields to the first explicit one."""
    stored, final = meta.get("device.id"), meta.get("device.explicit") == "1"
    if stored and device_id and device_id != stored and final:
        raise DeviceMismatch(f"ERR_DEVICE_MISMATCH: explicit deviceId '{device_id}' != stored '{stored}'")
    chosen = device_id or stored or str(uuid.uuid4())
    if chosen == stored:
        return chosen, meta
    return chosen, meta | {"device.id": chosen, "device.explicit": "1" if device_id else "0"}


def cursor(meta: dict[str, str], key: str) -> int:
    """A stored cursor, 0 where there is none."""
    return int(meta.get(key, 0))
