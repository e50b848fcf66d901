"""Checks of query arguments; values are bound as literals afterwards, never spliced into SQL."""

from __future__ import annotations

import re
from enum import Enum
from typing import TypeVar

E = TypeVar("E", bound=Enum)
_TIME = re.compile(r"[0-9\-:T .Z]{10,30}")


def identifier(value: str) -> str:
    """Letters, digits and ``-_.``; anything else is an error."""
    if not value or not all(c.isalnum() or c in "-_." for c in value):
        raise ValueError(f"not an identifier: {value!r}")
    return value


def timestamp_text(value: str) -> str:
    """10 to 30 bytes of digits and ``-:T .Z``."""
    if not _TIME.fullmatch(value):
        raise ValueError(f"not a timestamp: {value!r}")
    return value


def date_hint(value: str | None) -> str | None:
    """A date hint that isn't one is left out, without an error."""
    return value if value and re.fullmatch(r"\d{4}-\d{2}-\d{2}", value) else None


def choice(kind: type[E], value: str | E | None) -> E | None:
    """A member of an enum by its value; None stays None."""
    if value is None or isinstance(value, kind):
        return value
    try:
        return kind(value)
    except ValueError as e:
        raise ValueError(f"{value!r} is none of {[m.value for m in kind]}") from e


def clamp(value: int | None, default: int, most: int, least: int = 1) -> int:
    return max(least, min(most, default if value is None else value))


def users_limit(value: int | None) -> int:
    return clamp(value, 25, 200)


def events_limit(value: int | None) -> int:
    return clamp(value, 100, 1000)


def tenant_events_limit(value: int | None) -> int:
    return clamp(value, 50, 1000)


def recent_limit(value: int | None) -> int:
    return clamp(value, 50, 200)


def offset(value: int | None) -> int:
    return max(0, value or 0)
