"""Words of a text for comparison with benchmark items."""

from __future__ import annotations

#: A-Z become a-z, every other ASCII character but digits and letters becomes a space; longer UTF-8 sequences stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def plain_words(text: bytes | None) -> list[bytes]:
    """The folded words of UTF-8 bytes, in order."""
    return text.translate(FOLD).split() if text else []
