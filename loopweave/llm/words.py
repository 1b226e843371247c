"""Cutting long texts into blocks that end between words."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of text that are cut into words at a time.
BLOCK = 1 << 18


def word_blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text, parted by ASCII white space, block by block."""
    at = 0
    while at < len(text):
        end = at + BLOCK
        while end < len(text) and not text[end : end + 1].isspace():
            end += 1
        yield text[at:end].split()
        at = end
