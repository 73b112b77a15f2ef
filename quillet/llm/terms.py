"""Words of ASCII letters, digits and all characters beyond ASCII, from UTF-8: one translation and one split a text."""

from __future__ import annotations

#: A-Z lower-cased; every other ASCII character but a-z and 0-9 is a blank. Bytes from 0x80 on are parts of letters.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """All words of a text with repeats, in order; none of null."""
    return text.translate(_FOLD).split() if text else []
