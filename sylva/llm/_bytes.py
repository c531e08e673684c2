"""Helpers for Python workers that read texts as UTF-8 bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa

SEGMENT = 1 << 22
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def utf8(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes]:
    """The values of a string column as bytes; null is empty."""
    for value in column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()):
        yield value.as_py() or b""


def segments(data: bytes, size: int = SEGMENT) -> Iterator[bytes]:
    """data in pieces of about size bytes, cut at white space, so that the words of a huge text need not be held at once."""
    at = 0
    while len(data) - at > size:
        cut = _SPACE.search(data, at + size)
        if not cut:
            break
        yield data[at : cut.start()]
        at = cut.end()
    yield data[at:] if at else data
