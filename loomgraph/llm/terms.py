"""Terms of UTF-8 texts: maximal runs of term bytes with ASCII capitals lowered; used inside tasks only.

Letters and every byte from 0x80 on belong to terms; digits only where they are asked for. As no character beyond ASCII
has a byte below 0x80, runs of bytes and runs of characters are the same.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa

#: Bytes of a text that are split at once.
SLICE = 1 << 20


class Splitter:
    def __init__(self, digits: bool):
        inside = {*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100), *(range(0x30, 0x3A) if digits else ())}
        self._table = bytes((i + 32 if 0x41 <= i <= 0x5A else i) if i in inside else 0x20 for i in range(256))
        self._outside = re.compile(b"[" + b"".join(re.escape(bytes([i])) for i in range(256) if i not in inside) + b"]")

    def counts(self, text: bytes) -> Counter[bytes]:
        """Occurrences of each term; long texts are split piece by piece, between terms."""
        found: Counter[bytes] = Counter()
        lo = 0
        while lo < len(text):
            hi = lo + SLICE
            if hi < len(text):
                met = self._outside.search(text, hi)
                hi = met.start() if met else len(text)
            found.update(text[lo:hi].translate(self._table).split())
            lo = hi
        return found


def values(col: pa.Array) -> Iterator[bytes]:
    """The bytes of a string or binary column, one after the other; nulls are empty."""
    for v in col:
        yield v.as_buffer().to_pybytes() if v.is_valid else b""
