"""Byte-level BPE by backtracking instead of merging.

A piece's bytes become Latin-1 letters, so that an automaton over all tokens
finds the longest token that starts at each byte in one pass.  Tokens are then
taken from the left, the longest first; a token may stand after the one before
it only if merging their bytes by rank gives just these two.  Where none can
stand, the place is marked as dead and the token before it gives way to a
shorter one.  The sequence in which all neighbours are compatible is the one
that merging by rank reaches, and each place dies at most once, so a piece takes
time in proportion to its length, also where merging would take its square.
"""

from __future__ import annotations

import base64
import sys
from array import array
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces and pairs of tokens that are remembered, and how long such a piece may be.
PIECES, PAIRS, PIECE_CHARS = 600_000, 2_000_000, 64
#: Characters that are cut into pieces at a time, ids that are decoded at a time, and bytes of a batch that tasks return.
BLOCK, IDS, BATCH = 1 << 20, 1 << 20, 1 << 23
LITTLE = sys.byteorder == "little" and array("i").itemsize == 4
#: A place where a text may be cut: pieces hold white space only in front.
CUT = regex.compile(r"(?<=\S)(?=\s)")


#: A character of each class that patterns name, and one of none, which no pattern names by itself.
CLASSES, NO_CLASS = {r"\p{L}": "\u4e00", r"\p{N}": "\u00b2", r"\s": "\u2003"}, "\u2603"


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


@cache
def stand_ins() -> dict[int, str]:
    """Characters that the reference tokenizer puts in another class than the regular expressions here do.

    Both know the classes of different editions of Unicode.  Each such character
    has one in its place that both put where the reference tokenizer has it.
    """
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    place, here = np.zeros((2, sys.maxunicode + 1), np.uint8)
    for k, name in enumerate(CLASSES):
        reference = tiktoken.Encoding("class", pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        place[_codes(bytes(reference.encode_ordinary(every)).decode())] = k + 1
        here[_codes("".join(regex.findall(f"{name}+", every)))] = k + 1
    chars = [NO_CLASS, *CLASSES.values()]
    return {x: chars[place[x]] for x in np.flatnonzero(place != here).tolist()}


class ByteBPE:
    """Ids of pieces by a table of ranks, which holds all single bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        lacking = [b for b in range(256) if bytes([b]) not in ranks]
        if lacking:
            raise ValueError(f"the ranks lack {len(lacking)} single bytes")
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        size = max(ranks.values()) + 1
        self.bytes_of: list[bytes | None] = [None] * size
        #: The two tokens that a token is merged from; None for bytes, and for tokens that no merges reach.
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.merged: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        reached = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self.bytes_of[rank] = token
            if len(token) == 1 or self._part(token, rank, reached):
                reached[token] = rank
        self.fits.clear()
        self.width = [len(x or b"") for x in self.bytes_of]
        #: The longest token that is a token's beginning, or -1.
        self.shorter = array("i", [-1]) * size
        self.finder = ahocorasick.Automaton()
        for token, rank in reached.items():
            self.finder.add_word(token.decode("latin-1"), rank)
            self.shorter[rank] = next((reached[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in reached), -1)
        self.finder.make_automaton()
        self.known: dict[str, bytes] = {"": b""}
        self.other = stand_ins()
        self.is_other = np.zeros(sys.maxunicode + 1, bool)
        self.is_other[list(self.other)] = True

    def pieces(self, text: str) -> list[str]:
        """What the pattern's matches in ``text`` are."""
        if text.isascii() or not self.is_other[_codes(text)].any():
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.other))]

    def _part(self, token: bytes, rank: int, reached: dict[bytes, int]) -> bool:
        """Whether lower ranks leave ``token`` in two parts that its own merge joins; remembers them."""
        for cut in range(len(token) - 1, 0, -1):
            left, right = reached.get(token[:cut]), reached.get(token[cut:])
            if left is not None and right is not None and self._compatible(left, right):
                self.parts[rank], self.merged[left, right] = (left, right), rank
                return True
        return False

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both by rank gives these two tokens.

        The merges next to their border are undone, the latest first.  If what
        then meets at the border has a merge that would have come before the one
        undone, that merge would have crossed the border.  Of equal merges the
        one further left comes first.
        """
        before, parts = len(self.parts), self.parts
        while True:
            if self.merged.get((left, right), before) < before:
                return False
            made_left, made_right = left if parts[left] else -1, right if parts[right] else -1
            if made_left > made_right:
                before, left = left, parts[left][1]
            elif made_right >= 0:
                before, right = right + 1, parts[right][0]
            else:
                return True

    def _fit(self, left: int, right: int) -> bool:
        """``_compatible``, to be remembered."""
        if len(self.fits) > PAIRS:
            self.fits.clear()
        found = self.fits[left, right] = self._compatible(left, right)
        return found

    def tokens(self, piece: bytes) -> array:
        """The ids of one piece; a piece that is a token is that token, even one that merges don't reach."""
        if not piece or piece in self.ranks:
            return array("i", [self.ranks[piece]] if piece else [])
        width, shorter, fits, size = self.width, self.shorter, self.fits, len(piece)
        longest = [0] * (size + 1)
        for last, token in self.finder.iter(piece.decode("latin-1")):
            longest[last + 1 - width[token]] = token  # those that end later are longer
        dead, out, at, token, before = bytearray(size + 1), array("i"), 0, longest[0], -1
        while at < size:
            while token >= 0:
                end = at + width[token]
                if not dead[end]:
                    fit = before < 0 or fits.get((before, token))
                    if fit or (fit is None and self._fit(before, token)):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, before, token = end, token, longest[end]
            else:
                dead[at] = 1
                token = out.pop()
                at, before = at - width[token], out[-1] if out else -1
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian 32-bit numbers."""
        return b"".join(self._encode_block(x) for x in text_blocks(text))

    def _encode_block(self, text: str) -> bytes:
        pieces, known = self.pieces(text), self.known
        if len(known) > PIECES:
            known.clear()
        once = []
        for piece in {*pieces}.difference(known):
            ids = self.tokens(piece.encode())
            known[piece] = ids.tobytes() if LITTLE else np.array(ids, "<u4").tobytes()
            if len(piece) > PIECE_CHARS:
                once.append(piece)
        out = b"".join(map(known.__getitem__, pieces))
        for piece in once:
            del known[piece]
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for; an id that no token has is an error."""
        numbers, out = np.frombuffer(ids, "<u4"), []
        if len(numbers) and int(numbers.max()) >= len(self.bytes_of):
            raise ValueError(f"no token has the id {int(numbers.max())}")
        for low in range(0, len(numbers), IDS):
            out.append(b"".join(map(self.bytes_of.__getitem__, numbers[low : low + IDS].tolist())))
        return b"".join(out)


def text_blocks(text: str) -> Iterator[str]:
    """A text in parts that are cut into the same pieces as the whole."""
    at = 0
    while at < len(text):
        cut = CUT.search(text, at + BLOCK) if len(text) - at > BLOCK else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


@cache
def byte_bpe(path: str, pattern: str = public_tokenizers.PATTERN) -> ByteBPE:
    """The tokenizer of a file with a token in base 64 and its rank on each line."""
    with open(path, "rb") as lines:
        return ByteBPE({base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}, pattern)


def _batches(batches, column: str, work, names: list[str]):
    """Batches of at most about BATCH bytes: other columns as they are, and what ``work`` makes of each cell of ``column``."""
    for batch in batches:
        place, low, size, out = batch.schema.get_field_index(column), 0, 0, []
        for i in range(batch.num_rows):
            out.append(work(batch.column(place)[i].as_py()))
            size += sum(len(x) for x in out[-1] if isinstance(x, bytes))
            if size >= BATCH or i == batch.num_rows - 1:
                kept = [batch.column(c).slice(low, i + 1 - low) for c in range(batch.num_columns) if c != place or column in names]
                yield kept, list(zip(*out, strict=True))
                low, size, out = i + 1, 0, []


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``(doc_id, n_tokens, ids)``, a row for each row of ``docs``.

    ``ids`` are little-endian unsigned 32-bit numbers, as training jobs map them.
    Each match of ``pattern`` is encoded by itself; strings that look like
    special tokens are ordinary text.  Null and empty texts have no ids.  Rows
    without a ``doc_id`` and repeated rows are kept; other columns are ignored.
    ``path`` must name the file of ranks on all executors.
    """
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        model = byte_bpe(path, pattern)

        def work(text):
            ids = model.encode(text or "")
            return len(ids) // 4, ids

        for (doc_id,), (counts, ids) in _batches(batches, "text", work, []):
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def decode(tokens: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``tokens`` with ``decoded``, the bytes that the column ``ids`` stands for; null for null."""
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    fields = [x for x in tokens.schema.fields if x.name != "decoded"]
    names = [x.name for x in fields]

    def run(batches):
        model = byte_bpe(path, pattern)
        for kept, (decoded,) in _batches(batches, "ids", lambda ids: (None if ids is None else model.decode(ids),), names):
            yield pa.RecordBatch.from_arrays([*kept, pa.array(decoded, pa.binary())], [*names, "decoded"])

    return tokens.select(*names).mapInArrow(run, ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in fields), "decoded binary"]))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of each text, encoded and decoded again; hex digits are lower case."""
    found = decode(encode(docs, path), path)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
