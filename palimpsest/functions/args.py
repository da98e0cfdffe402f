"""Coercion of request parameters, on the driver: what a feed or listing call may be given as text or number."""

from __future__ import annotations

import json
from typing import Any

UNSET = object()


def since_value(raw: Any, current: int) -> int:
    """A feed position: a number, digits, or ``now`` for the current sequence; anything else is the beginning."""
    if raw == "now":
        return current
    if isinstance(raw, bool):
        return 0
    if isinstance(raw, (int, float)):
        return int(raw) if raw == raw and abs(raw) != float("inf") else 0
    return int(raw) if isinstance(raw, str) and raw.isascii() and raw.isdigit() else 0


def flag(raw: Any) -> bool:
    return raw is True or raw == "true"


def whole_number(raw: Any, default: int) -> int:
    """A finite number or digits, else ``default``; text that is no digits counts as -1 where it is given at all."""
    if raw is None:
        return default
    if isinstance(raw, (int, float)) and not isinstance(raw, bool):
        return int(raw)
    if isinstance(raw, str):
        return int(raw) if raw.isascii() and raw.isdigit() else 0
    return default


def row_limit(raw: Any) -> int | None:
    """None without a limit; negative numbers and text that is no digits give no rows."""
    return None if raw is None else max(whole_number(raw, -1), 0)


def clamp(raw: Any, low: int, high: int, default: int) -> int:
    n = raw if isinstance(raw, (int, float)) and not isinstance(raw, bool) and raw == raw else default
    return int(min(max(n, low), high))


def feed_limit(raw: Any, narrow: bool) -> int:
    """Rows of a feed page; pages with bodies or a selector are shorter."""
    return clamp(raw if raw is not None else 1000, 1, 128 if narrow else 5000, 1000)


def key_value(raw: Any) -> Any:
    """A key bound: JSON text where it is quoted, else as it is; UNSET where there is none or the JSON is broken."""
    if raw is None:
        return UNSET
    if isinstance(raw, str) and raw[:1] == '"':
        try:
            return json.loads(raw)
        except ValueError:
            return UNSET
    return raw
