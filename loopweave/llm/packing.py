"""Packing documents into token sequences by bounded-space online best fit.

Pieces come in a random but fixed order.  Each goes to the open bin that it
fills best; if none has room a new bin is opened, and if as many are open as
may be, the fullest is closed for it.  Bins are found by a bitset with a bit
for each amount of free space, so a piece costs a shift and a bit scan.  Pieces
are packed in groups, as a stream that holds only the open bins; the pieces in
the bins that are open at a group's end are packed again, with those of other
groups, until one group is left.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cache, reduce

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from loopweave.llm.storage import materialize
from loopweave.llm.words import word_blocks

#: Tokens of a sequence, and the id that ends a document.
LENGTH, END_ID = 4096, 1
#: Bins that may be open, and pieces that a group is to have.
OPEN, GROUP = 256, 1 << 14
#: Stems whose ids are remembered, and how long they may be.
WORDS, WORD_BYTES = 600_000, 48
#: Marks that may be taken off a word's end; apostrophes aren't, as the tokenizer joins them to letters.
MARKS = b".,;:!?*$%&#|)]}>"
#: Documents that are tokenized together, and bytes from which one is tokenized alone, block by block.
TOGETHER, LONG = 128, 1 << 20


class WordTokenizer:
    """Ids of texts, word by word.

    The tokenizer drops white space and never joins what it parts, so a text's
    ids are those of its words.  It also folds case, and parts letters and digits
    from the marks after them, so a word's ids are those of its stem and of its
    marks; these are remembered.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(path)
        #: Texts that are one id wherever they stand, as the tokenizer looks for them before all else.
        self.special = re.compile("|".join(re.escape(x.content.lower()) for x in self.model.get_added_tokens_decoder().values()).encode() or b"(?!)")
        names = self.model.get_vocab(with_added_tokens=False)
        #: Whether an id ends a run of letters.
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {b"": b""}
        self.long: list[bytes] = []

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _is_special(self, word: bytes) -> bool:
        """Whether a word, in any case, holds one of the special texts; it is then tokenized as it is."""
        return b"|>" in word and self.special.search(word.lower()) is not None

    def _learn(self, parts: set[bytes]) -> None:
        # The tokenizer folds case itself, letter by letter, which str.lower doesn't.
        texts = {x: x.decode("utf-8", "replace") for x in parts}
        # A run of letters is one unit, so the ids of many of them can be told apart when they are made at once.
        runs = [x for x, text in texts.items() if text.isalpha() and "".join(c.lower() for c in text).isalpha()]
        for low in range(0, len(runs), 4096):
            some = runs[low : low + 4096]
            data = self._encode([" ".join(texts[x] for x in some)])[0]
            at = [0, *((np.flatnonzero(self.ends[np.frombuffer(data, "<u4")]) + 1) * 4).tolist()]
            if len(at) == len(some) + 1:
                self.known.update(zip(some, (data[i:j] for i, j in zip(at, at[1:], strict=False)), strict=True))
        rest = [x for x in parts if x not in self.known]
        self.known.update(zip(rest, self._encode([texts[x] for x in rest]), strict=True))

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """A table that has the ids of all these words, as little-endian 32-bit numbers; it holds until the next call."""
        known = self.known
        if len(known) > WORDS:
            known.clear()
            known[b""] = b""
        for x in self.long:
            known.pop(x, None)
        parts = {}
        for w in words.difference(known):
            low = w.lower()
            stem = low.rstrip(MARKS)
            if self._is_special(low):
                parts[w] = (w, b"")
            elif stem and len(stem) < len(low) and (stem[-1:].isalnum() or stem.decode("utf-8", "replace").lower()[-1].isalnum()):
                parts[w] = (stem, low[len(stem) :])
            else:
                parts[w] = (low, b"")
        new = {x for pair in parts.values() for x in pair}.difference(known)
        if new:
            self._learn(new)
        for w, (stem, marks) in parts.items():
            known[w] = known[stem] + known[marks]
        self.long = [x for some in (parts, new) for x in some if len(x) > WORD_BYTES]
        return known


@cache
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def pieces_of(ids: Iterable[bytes], length: int, end_id: int) -> list[tuple[int, int]]:
    """``(tokens, crc32 of their ids)`` of each piece of a document whose ids come in blocks."""
    out, held = [], b""
    for block in ids:
        held += block
        at = 0
        while len(held) - at > 4 * length:
            out.append((length, zlib.crc32(held[at : at + 4 * length])))
            at += 4 * length
        held = held[at:]
    held += end_id.to_bytes(4, "little")
    for at in range(0, len(held), 4 * length):
        part = held[at : at + 4 * length]
        out.append((len(part) // 4, zlib.crc32(part)))
    return out


def token_ids(texts: list[bytes], model: WordTokenizer) -> Iterator[Iterable[bytes]]:
    """Each text's ids, in blocks: those of short texts together, those of a long one as they are asked for."""
    short = [x.split() if len(x) <= LONG else None for x in texts]
    of = model.learn(set().union(*(words for words in short if words))).__getitem__
    ids = [None if words is None else b"".join(map(of, words)) for words in short]

    def blocks(text: bytes) -> Iterator[bytes]:
        for words in word_blocks(text):
            yield b"".join(map(model.learn({*words}).__getitem__, words))

    for text, found in zip(texts, ids, strict=True):
        yield blocks(text) if found is None else [found]


def tokenize(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of each document's pieces; a null text is empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        model = tokenizer(path)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for low in range(0, batch.num_rows, TOGETHER):
                some = [x.as_py() or b"" for x in texts[low : low + TOGETHER]]
                found: list[tuple] = []
                for i, ids in enumerate(token_ids(some, model)):
                    found += [(low + i, n, n * length, size, crc) for n, (size, crc) in enumerate(pieces_of(ids, length, end_id))]
                at, *rest = zip(*found, strict=True)
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                columns = [batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(c, t) for c, t in zip(rest, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Open bins, found by free space: bit f of the bitset says that some bin has f tokens free."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.bits, self.count = 0, 0
        self.by_free: dict[int, list[list]] = {}

    def _take(self, free: int) -> list:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.count -= 1
        return found

    def put(self, size: int, item) -> list[list]:
        """Place an item of ``size`` tokens; return the bins that this closes."""
        closed = []
        room = self.bits >> size
        if room:
            free = size + (room & -room).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.count >= self.most:
                closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
            free, bin_ = self.length, []
        bin_.append(item)
        left = free - size
        if not left:
            closed.append(bin_)
            return closed
        self.by_free.setdefault(left, []).append(bin_)
        self.bits |= 1 << left
        self.count += 1
        return closed

    def close(self) -> list[list]:
        """All open bins, which are open no longer."""
        out = [b for f in sorted(self.by_free) for b in self.by_free[f]]
        self.by_free, self.bits, self.count = {}, 0, 0
        return out


PACKED = "piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _round(pieces: DataFrame, number: int, groups: int, last: bool, length: int, most: int) -> DataFrame:
    """Pack each group; pieces of bins left open have no ``sequence_id``, except in the last round."""
    kind = pieces.schema["doc_id"].dataType.simpleString()
    doc_type = to_arrow_type(pieces.schema["doc_id"].dataType)

    def run(batches):
        bins, now, seq = Bins(length, most), None, 0
        out: list[tuple] = []

        def emit(closed, named):
            nonlocal seq
            for bin_ in closed:
                at = 0
                for row in bin_:
                    out.append((*row, (number << 58 | now << 24 | seq) if named else None, at if named else None))
                    at += row[3]
                seq += 1

        def batch_of():
            kinds = [doc_type, pa.int32(), *[pa.int64()] * 5]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for group, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != now:
                    emit(bins.close(), last)
                    now, seq = group, 0
                emit(bins.put(row[3], tuple(row)), True)
            yield batch_of()
        emit(bins.close(), last)
        yield batch_of()

    cells = ["doc_id", "piece", "start", "length", "ids_crc32"]
    group = F.pmod(F.xxhash64(*cells, F.lit(number)), F.lit(groups)).alias("group")
    dealt = pieces.select(group, *cells).repartition("group").sortWithinPartitions("group", F.xxhash64(*cells), *cells)
    return dealt.mapInArrow(run, f"doc_id {kind}, {PACKED}")


def pack(pieces: DataFrame, length: int = LENGTH, most: int = OPEN, group: int = GROUP) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``: each sequence's pieces stand end to end from 0.

    Groups follow from the pieces alone, so reruns agree whatever the partitions.
    """
    done, rows, number, before = [], pieces, 0, None
    while True:
        n = rows.count()
        groups = max(1, -(-n // group))
        last = groups == 1 or (before is not None and groups >= before)
        packed = materialize(_round(rows, number, groups, last, length, most), "packed")
        done.append(packed.where("sequence_id is not null"))
        if last:
            return reduce(DataFrame.unionByName, done)
        rows, number, before = packed.where("sequence_id is null").drop("sequence_id", "offset"), number + 1, groups


def pack_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` for each piece.

    A document's tokens are its ids and ``end_id``; only documents of more than
    ``length`` tokens are cut, and only their last piece may be shorter.  Null
    and empty texts have one token.  ``path`` names the tokenizer's file, which
    must have the same place on all executors.  Rows without a ``doc_id`` are
    packed as any other, repeated rows are repeated, other columns are ignored.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    return pack(materialize(tokenize(docs, path, length, end_id), "pieces"), length)
