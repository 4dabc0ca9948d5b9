"""Keyset cursors: comma-joined values as unpadded URL-safe base64, checked strictly on the way back."""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Sequence
from datetime import datetime

LONGEST = 512
_ALPHABET = re.compile(r"[A-Za-z0-9_-]+\Z")


class InvalidCursor(ValueError):
    """The text is no cursor of the expected kind."""


def encode(*values: object) -> str:
    """A cursor of timestamps (ISO), ids and other values as text."""
    shown = [v.isoformat() if isinstance(v, datetime) else str(v) for v in values]
    return base64.urlsafe_b64encode(",".join(shown).encode()).decode().rstrip("=")


def _time(text: str) -> datetime:
    found = datetime.fromisoformat(text.replace("Z", "+00:00"))
    if found.tzinfo is None:
        raise ValueError("a time without zone")
    return found


KINDS = {"time": _time, "uuid": uuid.UUID, "int": int, "text": str}


def decode(cursor: str, kinds: Sequence[str]) -> tuple:
    """The values of a cursor, one for each kind of KINDS."""
    if not cursor or len(cursor) > LONGEST or not _ALPHABET.match(cursor):
        raise InvalidCursor("a cursor is 1 to 512 characters of the URL-safe base64 alphabet")
    try:
        parts = base64.b64decode(cursor + "=" * (-len(cursor) % 4), altchars=b"-_", validate=True).decode().split(",")
        if len(parts) != len(kinds):
            raise ValueError("another number of values")
        return tuple(KINDS[kind](part) for kind, part in zip(kinds, parts, strict=True))
    except ValueError as e:
        raise InvalidCursor("the cursor's content doesn't fit") from e
