"""Near-duplicate documents by SimHash and a byte-position inverted index.

A fingerprint has eight bytes.  Two fingerprints that differ in at most four
bits differ in at most four bytes, so they share at least four positional
bytes: the guaranteed minimum.  The index holds each fingerprint under
combinations of three positional bytes.  Twenty such combinations suffice,
as any four positions contain one of them (a Turan system), and a posting is
2**16 times shorter than that of a single byte.  For each pair that meets in a
posting the shared positional bytes are tallied, pairs below the minimum go,
and the bits of the rest are counted.
"""

from __future__ import annotations

from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopweave.llm.components import connected_components
from loopweave.llm.shingles import first_copies
from loopweave.llm.storage import materialize
from loopweave.llm.words import word_blocks

BYTES = 8

def fingerprint(text: bytes, words: int) -> int:
    """The SimHash of a text's word shingles, as a signed 64-bit number.

    A text without words has fingerprint zero; one with fewer words than a
    shingle has one shingle of them all.
    """
    ones, total, tail = np.zeros(64, np.int64), 0, []
    for block in word_blocks(text.lower()):
        tail += block
        n = len(tail) - words + 1
        if n > 0:
            parts = map(b" ".join, zip(*(tail[i : i + n] for i in range(words)), strict=True))
            hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in parts), "<u8", n)
            for i in range(0, n, 1 << 14):
                bits = np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones += bits.sum(axis=0, dtype=np.int64)
            total += n
            tail = tail[n:]
    if not total:
        if not tail:
            return 0
        return int(np.array([xxhash.xxh64_intdigest(b" ".join(tail), 42)], "<u8").view("<i8")[0])
    return int(np.packbits((2 * ones > total).astype(np.uint8), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` for each row; a null text counts as an empty one."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = [fingerprint(x.as_py() or b"", words) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def _triples() -> list[tuple[int, ...]]:
    """Twenty triples of the eight positions, one of them inside any four."""
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    found = [g for g in groups if len(g) == 3]
    for a, b in permutations(range(3), 2):
        if (a + 1) % 3 == b:
            found += [(*two, one) for two in combinations(groups[a], 2) for one in groups[b]]
    return found


TRIPLES = _triples()


def _byte(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255).cast("long"))


def _postings(prints: DataFrame) -> DataFrame:
    """Each row under its twenty keys: three bytes and which they are."""
    fp = F.col("fp")
    keys = [
        sum((F.shiftleft(_byte(fp, p), 8 * i) for i, p in enumerate(t)), F.lit(k << 24).cast("long")) for k, t in enumerate(TRIPLES)
    ]
    return prints.select("*", F.explode(F.array(*keys)).alias("key"))


def _shared(a: Column, b: Column) -> Column:
    """The positions at which two fingerprints have the same byte, as bits."""
    same = [F.when(_byte(a.bitwiseXOR(b), i) == 0, 1 << i).otherwise(0) for i in range(BYTES)]
    return sum(same[1:], same[0])


def _verified(a: Column, b: Column, max_bits: int) -> Column:
    """Whether a pair shares the guaranteed number of positional bytes and differs in few enough bits."""
    return (F.bit_count(_shared(a, b)) >= BYTES - max_bits) & (F.bit_count(a.bitwiseXOR(b)) <= max_bits)


def _is_link(a: Column, b: Column, key: Column, max_bits: int) -> Column:
    """Whether a pair that meets under a key is a link and this its first key."""
    masks = [sum(1 << p for p in t) for t in TRIPLES]
    first = [next((k for k, m in enumerate(masks) if s & m == m), -1) for s in range(256)]
    at = F.element_at(F.array(*map(F.lit, first)), _shared(a, b).cast("int") + 1)
    return _verified(a, b, max_bits) & (at == F.shiftrightunsigned(key, 24))


def link_components(prints: DataFrame, max_bits: int = 4) -> DataFrame:
    """``(fp, root)``: distinct fingerprints with those they are linked to.

    First each posting's members are compared with its smallest one, which
    gives links in proportion to the postings and joins up dense families.
    Then all pairs of a posting that still are in different components are
    compared, which finds the rest: no link is missed, and a family of n
    fingerprints doesn't emit its n * n links.  Joins are merged, as here and in
    connected components any side may grow with the table, and what is broadcast
    is built in the driver.
    """
    if not 0 <= max_bits <= 4:
        raise ValueError("the index guarantees links of at most four bits")
    prints = prints.select("fp").distinct()
    posted = _postings(prints)
    hubs = posted.groupBy("key").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    near = posted.join(hubs.hint("merge"), "key").where("fp <> hub").where(_verified(F.col("fp"), F.col("hub"), max_bits))
    first = connected_components(near.select(F.col("fp").alias("a"), F.col("hub").alias("b")))
    known = materialize(
        prints.join(first.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("root")),
        "roots",
    )
    left, right = _postings(known).alias("l"), _postings(known).alias("r")
    rest = left.join(
        right.hint("merge"),
        (F.col("l.key") == F.col("r.key"))
        & (F.col("l.fp") < F.col("r.fp"))
        & (F.col("l.root") != F.col("r.root"))
        & _is_link(F.col("l.fp"), F.col("r.fp"), F.col("l.key"), max_bits),
    ).select(F.col("l.root").alias("a"), F.col("r.root").alias("b"))
    second = connected_components(rest)
    return known.join(second.withColumnRenamed("node", "root").hint("merge"), "root", "left").select("fp", F.coalesce("component", "root").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 4, max_bits: int = 4) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, a row for each row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` that links reach.  Texts are
    read whole; null and empty ones have fingerprint zero and are linked as any
    other.  Rows without a ``doc_id`` are kept, and lend no id to a component.
    Repeated rows each get a row.  Other columns are ignored.
    """
    prints = materialize(fingerprints(docs, words), "fingerprints")
    groups = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "groups")
    roots = groups.join(link_components(groups, max_bits).hint("merge"), "fp")
    least = roots.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = materialize(roots.join(least.hint("merge"), "root").select("fp", "component_id"), "components")
    return prints.join(named.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 5, print_words: int = 4, max_bits: int = 4) -> DataFrame:
    """``docs`` with one document of each group of near copies: that with the smallest id.

    Candidates are what :func:`near_duplicates` links, by SimHashes of shingles
    of ``print_words`` through the byte-position index; those count whose sets of
    shingles of ``words`` have a Jaccard similarity of 0.8 or more.  As
    fingerprints within four bits miss most such pairs, what is left apart is
    then looked up by its sets, exactly.
    Rows without a ``doc_id`` stay, as nothing tells them apart, and link no
    others.  Of rows that share an id but not the text each is judged by its own
    text; rows that repeat the kept one's id and text stay with it.
    """

    def linked(prints: DataFrame) -> DataFrame:
        return link_components(prints.withColumnRenamed("own", "fp"), max_bits).withColumnRenamed("fp", "own")

    found = first_copies(docs, words, lambda text: fingerprint(text, print_words), linked)
    gone = found.where((F.col("doc_id") != F.col("component_id")) | (F.col("text_hash") != F.col("first_hash")))
    gone = gone.select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash")).distinct()
    same = (docs["doc_id"] == gone["_gone_id"]) & (F.xxhash64(docs["text"]) == gone["_gone_hash"])
    return docs.join(gone, same, "left_anti").select(*docs.columns)
