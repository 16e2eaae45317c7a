"""Walking over whole texts inside Arrow batches with bounded memory."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa

BLOCK = 1 << 20  # bytes of text whose words are held at a time
_BREAK = re.compile(rb"[\x20\x09-\x0D]")


def word_blocks(text: bytes, size: int = BLOCK) -> Iterator[bytes]:
    """A text in blocks of about ``size`` bytes that end where a word ends."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > size and (gap := _BREAK.search(text, at + size)):
            end = gap.end()
        yield text[at:end]
        at = end


def text_groups(column: pa.Array, size: int = 4 * BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a batch, some megabytes at a time, with the first one's row; NULL reads as empty."""
    start, group, held = 0, [], 0
    for row, value in enumerate(column):
        text = (value.as_py() or "").encode()
        if group and held + len(text) > size:
            yield start, group
            start, group, held = row, [], 0
        group.append(text)
        held += len(text)
    if group:
        yield start, group
