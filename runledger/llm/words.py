"""Words of a text as bytes, in pieces of bounded size."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Text split into words at once, in bytes; a list of words takes some ten times as much.
PIECE_BYTES = 1 << 20

#: One character between words, as ``common.GAP`` has them; ``bytes.split()`` splits at these.
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def pieces(data: bytes, gap: re.Pattern[bytes] = SPACE, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """``data`` cut at characters between words into pieces of about ``size`` bytes, no word cut."""
    start = 0
    while len(data) - start > size:
        found = gap.search(data, start + size)
        if not found:
            break
        yield data[start : found.start()]
        start = found.end()
    yield data[start:]
