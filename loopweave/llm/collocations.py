"""Phrases whose words stand together more often than their parts would.

Two kinds of pass over the texts count phrases of one to three words.  Those of
the first kind, one for each length, keep no phrases: tasks add hashes to
count-min sketches, which are merged cell by cell; a cell counts all that falls
into it, so no phrase has less than its own count.  What is left of a merged
sketch is a bit for each cell that reaches the least count.  The last pass counts
exactly, but only phrases all of whose bits are set, and those of their parts:
all frequent ones, and a few others that exact counts then drop.
Scores, and which phrases a longer one subsumes, follow from exact counts by
joins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loopweave.llm.storage import materialize

#: Bytes that part pieces, and the one that parts words beside the space.
PARTS, TAB = b".,;:!?\n\x0b\x0c\r", b"\t"
TABLE = bytes(10 if b in PARTS else 32 if b in TAB else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes of text that are counted together.
CHUNK = 1 << 22
#: Rows of a sketch; occurrences that a cell may get on average; the fewest and the most cells of a row, as powers of two.
DEPTH, LOAD, LEAST_BITS, MOST_BITS = 2, 12, 16, 26
#: Cells that travel together, as a power of two, and how hard they are compressed.
BLOCK_BITS, LEVEL = 16, 9
#: Words of the longest phrase: ids of so many words share a 64-bit number.
LONGEST = 3
#: Odd multipliers of the hash, and what tells the sketch's rows apart.
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
ROWS = [np.uint64((row + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) for row in range(DEPTH)]


class Chunk:
    """Words of texts of one language, numbered, with the word 0 between pieces."""

    def __init__(self, lang: str, data: bytes, before: Sequence[str] = (), more: bool = False):
        """``before``: words of the same text that come before it; ``more``: whether the text goes on."""
        words = pc.split_pattern(pa.array([data.translate(TABLE).replace(b"\n", b" \n ")], pa.binary()).cast(pa.string()), " ").flatten()
        words = pa.concat_arrays([pa.array(["\n"]), pa.array(before, pa.string()), words.filter(pc.not_equal(words, ""))])
        found = words.dictionary_encode()
        self.lang, self.names, ids = lang, found.dictionary, found.indices.to_numpy()
        #: The last words, from which phrases may go on in the next chunk, aren't counted here.
        self.after = words[max(1, len(words) - LONGEST + 1) :].to_pylist() if more else []
        self.ids, self.starts = ids[1:], len(ids) - 1 - len(self.after)

    def phrases(self, length: int) -> np.ndarray:
        """Where phrases of so many words start."""
        n = max(0, min(self.starts, len(self.ids) - length + 1))
        whole = np.ones(n, bool)
        for k in range(length):
            whole &= self.ids[k : k + n] != 0
        return np.flatnonzero(whole)

    def hashes(self) -> np.ndarray:
        seed = xxhash.xxh32_intdigest(self.lang)
        return np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in self.names.to_pylist()), np.uint64, len(self.names))


def chunks(langs: pa.Array, texts: pa.Array) -> Iterator[Chunk]:
    """The words of a batch of texts, language by language; a text longer than a chunk goes over several."""
    codes = langs.dictionary_encode()
    of = codes.indices.to_numpy(zero_copy_only=False)
    for code, lang in enumerate(codes.dictionary.to_pylist()):
        held, size = [], 0
        for i in np.flatnonzero(of == code).tolist():
            text = texts[i].as_py() or b""
            if len(text) > CHUNK:
                yield from _long(lang, text)
                continue
            held.append(text)
            size += len(text)
            if size > CHUNK:
                yield Chunk(lang, b"\n".join(held))
                held, size = [], 0
        if held:
            yield Chunk(lang, b"\n".join(held))


def _long(lang: str, text: bytes) -> Iterator[Chunk]:
    at, before = 0, []
    while at < len(text):
        end = at + CHUNK
        while end < len(text) and TABLE[text[end]] not in (10, 32):
            end += 1
        chunk = Chunk(lang, text[at:end], before, end < len(text))
        yield chunk
        at, before = end, chunk.after


def cells(hashes: np.ndarray, ids: np.ndarray, starts: np.ndarray, length: int, bits: int) -> np.ndarray:
    """The cell of each phrase in each row of the sketch."""
    mixed = np.full(len(starts), length, np.uint64)
    for k in range(length):
        mixed = (mixed ^ hashes[ids[starts + k]]) * MIX[0]
        mixed ^= mixed >> np.uint64(29)
    out = np.empty((DEPTH, len(starts)), np.uint32)
    for row in range(DEPTH):
        x = (mixed + ROWS[row]) * MIX[1]
        x ^= x >> np.uint64(32)
        out[row] = (x * MIX[0]) >> np.uint64(64 - bits)
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


Bits = dict[int, np.ndarray]


def survivors(chunk: Chunk, hashes: np.ndarray, length: int, held: Bits) -> np.ndarray:
    """Where phrases of so many words start of which, and of whose parts, no length in ``held`` says that they are rare."""
    starts = chunk.phrases(length)
    for part in sorted(held):
        for first in range(length - part + 1):
            passed = np.ones(len(starts), bool)
            for row, at in zip(held[part], cells(hashes, chunk.ids, starts + first, part, int(len(held[part][0]) * 8).bit_length() - 1), strict=True):
                passed &= (row[at >> np.uint32(3)] >> (7 - (at & np.uint32(7))).astype(np.uint8)) & 1 == 1
            starts = starts[passed]
    return starts


def frequent_cells(docs: DataFrame, length: int, least: int, bits: int, held: Bits) -> np.ndarray:
    """A bit for each cell of the merged sketch of phrases of ``length`` words: whether it reaches ``least``.

    At most ``DEPTH * 2**MOST_BITS / 8`` bytes.  Only phrases whose parts may be
    frequent are counted.  Each task has one sketch, whose counts stop at 255 or
    beyond ``least``, and sends blocks of it in which something was counted.
    They are merged in a stream of blocks, so no group of them is held at once.
    """
    kind = np.uint8 if least <= 255 else np.uint64
    full, block = np.iinfo(kind).max, 1 << min(bits, BLOCK_BITS)
    known = docs.sparkSession.sparkContext.broadcast(held)

    def count(batches):
        codec, sketch = pa.Codec("zstd", compression_level=LEVEL), np.zeros((DEPTH, 1 << bits), kind)
        for batch in batches:
            for chunk in chunks(batch.column(0), batch.column(1).cast(pa.binary())):
                hashes = chunk.hashes()
                for row, at in enumerate(cells(hashes, chunk.ids, survivors(chunk, hashes, length, known.value), length, bits)):
                    at, n = np.unique(at, return_counts=True)
                    sketch[row, at] += np.minimum(n, full - sketch[row, at]).astype(kind)
        for row in range(DEPTH):
            blocks = sketch[row].reshape(-1, block)
            used = np.flatnonzero(blocks.any(axis=1))
            for low in range(0, len(used), 256):
                some = used[low : low + 256]
                data = [codec.compress(blocks[i].tobytes(), asbytes=True) for i in some]
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array(data, pa.binary())], ["depth", "block", "counts"])

    def merge(batches):
        codec, now, sums = pa.Codec("zstd"), None, None

        def out():
            bits_of = np.packbits(sums >= least).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([bits_of], pa.binary())], ["depth", "block", "bits"])

        for batch in batches:
            for row, at, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (row, at) != now:
                    if now is not None and (sums >= least).any():
                        yield out()
                    now, sums = (row, at), np.zeros(block, kind)
                more = np.frombuffer(codec.decompress(data, block * np.dtype(kind).itemsize, asbytes=True), kind)
                sums += np.minimum(more, full - sums)
        if now is not None and (sums >= least).any():
            yield out()

    sent = _texts(docs).mapInArrow(count, "depth int, block int, counts binary").repartition("depth", "block").sortWithinPartitions("depth", "block")
    found = np.zeros((DEPTH, (1 << bits) // block, block // 8), np.uint8)
    for row, at, data in sent.mapInArrow(merge, "depth int, block int, bits binary").toLocalIterator():
        found[row, at] = np.frombuffer(data, np.uint8)
    return found.reshape(DEPTH, -1)


def phrase_counts(docs: DataFrame, least: int = 10) -> DataFrame:
    """``(lang, words, phrase, f)``: exact counts of all phrases of one to three words that occur ``least`` times in a language.

    A row with no words has the number of all words of the language.  There is a
    sketch for each length, as a phrase can't occur more often than its parts.
    Its width follows from the texts' bytes, up to 2**26 cells a row (48 MB of
    bits in all); in larger corpora ``least`` should grow with the corpus, as
    otherwise more rare phrases get through to the second pass.  Counts are exact
    in any case.
    """
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(max(1, size / 6 / LOAD))))))
    held: Bits = {}
    for length in range(1, LONGEST + 1):
        held[length] = frequent_cells(docs, length, least, bits, held)
    sent = docs.sparkSession.sparkContext.broadcast(held)
    fields = ["key", "f"]

    def count(batches):
        for batch in batches:
            for chunk in chunks(batch.column(0), batch.column(1).cast(pa.binary())):
                hashes, base, ids = chunk.hashes(), np.int64(len(chunk.names)), chunk.ids.astype(np.int64)
                mark = f"\n{chunk.lang}"  # no phrase holds line ends
                yield pa.RecordBatch.from_arrays([pa.array([mark]), pa.array([len(chunk.phrases(1))], pa.int64())], fields)
                for length in range(1, LONGEST + 1):
                    starts = survivors(chunk, hashes, length, sent.value)
                    keys = np.zeros(len(starts), np.int64)
                    for k in range(length):
                        keys = keys * base + ids[starts + k]
                    keys, n = np.unique(keys, return_counts=True)
                    parts = []
                    for _ in range(length):
                        parts.insert(0, chunk.names.take(pa.array(keys % base)))
                        keys //= base
                    phrases = pc.binary_join_element_wise(pc.binary_join_element_wise(*parts, " "), mark, "")
                    for low in range(0, len(n), 1 << 15):
                        part = slice(low, low + (1 << 15))
                        yield pa.RecordBatch.from_arrays([phrases[part], pa.array(n[part], pa.int64())], fields)

    # The phrase and its language are one column, which makes the rows that are dealt out smaller.
    counted = _texts(docs).mapInArrow(count, "key string, f long").groupBy("key").agg(F.sum("f").alias("f"))
    counted = counted.select(F.substring_index("key", "\n", 1).alias("phrase"), F.expr("substring(key, instr(key, '\n') + 1)").alias("lang"), "f")
    words = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ", -1)))
    return counted.where((F.col("phrase") == "") | (F.col("f") >= least)).select("lang", words.alias("words"), "phrase", "f")


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, subsumed: int = 50) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's highest-scoring phrases of two and three words.

    ``a`` is a phrase's count, at least ``least``; ``l`` and ``r`` are those of
    the parts of the cut that scores lowest, floor(10^6 a a / (l r)), exactly;
    ``n`` counts all words of the language.  A phrase that stands within a
    longer one which has at least ``subsumed`` percent of its count is dropped.
    A null text is empty, a null language is ``und``; rows without an id count,
    and repeated rows count each.  Other columns are ignored.  Equal scores go
    by count and then by the phrase's bytes.
    """
    counts = materialize(phrase_counts(docs, least), "phrases")
    of = lambda n: counts.where(F.col("words") == n).select("lang", "phrase", "f", F.split("phrase", " ", -1).alias("w"))
    named = lambda df, key, **cells: df.select("lang", F.col("phrase").alias(key), *(F.col(c).alias(k) for k, c in cells.items()))
    exact = lambda x, y: F.expr(f"(1000000BD * (cast(a as decimal(18,0)) * cast(a as decimal(18,0)))) div (cast({x} as decimal(18,0)) * cast({y} as decimal(18,0)))")
    one = of(1).drop("w")
    two = of(2).select("lang", "phrase", F.col("f").alias("a"), F.get("w", F.lit(0)).alias("w1"), F.get("w", F.lit(1)).alias("w2"))
    two = two.join(named(one, "w1", l="f"), ["lang", "w1"]).join(named(one, "w2", r="f"), ["lang", "w2"])
    two = materialize(two.select("lang", "phrase", "a", "l", "r", exact("l", "r").alias("score")), "pairs")
    # What a phrase of three words needs of its words, its pairs know.
    pair = lambda i: F.array_join(F.slice("w", i, 2), " ")
    three = materialize(of(3).select("lang", "phrase", F.col("f").alias("a"), pair(1).alias("left"), pair(2).alias("right")), "triples")
    cut = lambda k, x, y: F.struct(exact(x, y).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r"))
    met = three.join(named(two, "left", f1="l", f12="a"), ["lang", "left"]).join(named(two, "right", f3="r", f23="a"), ["lang", "right"])
    cuts = met.select("lang", "phrase", "a", F.least(cut(1, "f1", "f23"), cut(2, "f12", "f3")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    inner = three.select("lang", "a", F.explode(F.array("left", "right")).alias("phrase"))
    over = inner.groupBy("lang", "phrase").agg(F.max("a").alias("over"))
    free = two.join(over, ["lang", "phrase"], "left").where(F.col("over").isNull() | (100 * F.col("over") < subsumed * F.col("a"))).drop("over")
    kept = free.unionByName(cuts)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # First within parts of a language, so that no task ranks all of one.
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    first = kept.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    total = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
