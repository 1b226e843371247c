"""Documents whose sets of word shingles have a Jaccard similarity of 0.8 or more, all of them.

Sets are put in one order of all shingles, rare ones first.  Sets of n shingles
with that similarity to another share one of their first n // 5 + 1 (prefix
filtering), so postings of these find every pair.  How common shingles are is
estimated on a part of the documents: the order only says how long postings
get, and any order finds the same pairs.  Pairs are sorted out by size, then by
a parity bitmap, which never says more than how many shingles differ, and what
is left is compared shingle by shingle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopweave.llm.components import connected_components
from loopweave.llm.sieve import sieved
from loopweave.llm.storage import materialize
from loopweave.llm.words import word_blocks

#: One document in so many is read to estimate how common shingles are.
PART = 16
#: The most shingles that are sent to tasks as common ones.
COMMON = 1 << 20
#: 64-bit words of the parity bitmap, and of the wide one that pairs which it lets pass are compared by.
MAP, WIDE = 8, 64
#: Members of a posting that all others are compared with before any two are.
HUBS = 3


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The sorted hashes of a text's word shingles; a text of fewer words has one shingle of them all."""
    found, tail = [], []
    for block in word_blocks(text.lower()):
        tail += block
        n = len(tail) - words + 1
        if n > 0:
            parts = map(b" ".join, zip(*(tail[i : i + n] for i in range(words)), strict=True))
            found.append(np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in parts), "<u8", n)))
            tail = tail[n:]
    if not found and tail:
        found.append(np.array([xxhash.xxh64_intdigest(b" ".join(tail), 42)], "<u8"))
    return np.unique(np.concatenate(found)).view("<i8") if found else np.zeros(0, "<i8")


def _name(hashes: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int(np.array([xxhash.xxh64_intdigest(hashes.tobytes(), 7)], "<u8").view("<i8")[0])


def _parity(hashes: np.ndarray, size: int = MAP) -> np.ndarray:
    """A bitmap that has a bit where an odd number of the shingles fall."""
    odd = np.bincount((hashes.view("<u8") >> np.uint64(20)) % np.uint64(64 * size), minlength=64 * size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _common(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of common shingles, sorted, and how common they are as powers of two."""

    def run(batches):
        for batch in batches:
            found = [shingle_set(x.as_py() or b"", words) for x in batch.column(0).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, "<i8"), *found]))], ["h"])

    part = docs.where(F.pmod(F.xxhash64("text"), F.lit(PART)) == 0).select("text")
    counts = materialize(part.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "common")
    total = counts.agg(F.sum("c")).first()[0] or 0
    rows = counts.where(F.col("c") > total // COMMON).toPandas().sort_values("h")
    return rows["h"].to_numpy("<i8"), np.log2(rows["c"].to_numpy(float)).astype(np.int8) + 1


def _prefixes(docs: DataFrame, words: int, own: Callable[[bytes], int] | None = None) -> DataFrame:
    """``(doc_id, text_hash, fp, n, bits, keys, own)``: name, size, parity bitmap and first shingles of each document's set, and what ``own`` makes of its text."""
    sent = docs.sparkSession.sparkContext.broadcast(_common(docs, words))

    def first(hashes: np.ndarray) -> np.ndarray:
        known, level = sent.value
        n = len(hashes) // 5 + 1
        if not len(known):
            return hashes[:n]
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return hashes[np.argsort(np.where(known[at] == hashes, level[at], 0), kind="stable")[:n]]

    def run(batches):
        for batch in batches:
            names, sizes, bits, keys, prints = [], [], [], [], []
            for x in batch.column(1).cast(pa.binary()):
                prints.append(own(x.as_py() or b"") if own else None)
                hashes = shingle_set(x.as_py() or b"", words)
                names.append(_name(hashes))
                sizes.append(len(hashes))
                bits.append(_parity(hashes))
                keys.append(first(hashes))
            lists = (pa.array(x, pa.list_(pa.int64())) for x in (bits, keys))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), *lists, pa.array(prints, pa.int64())], ["doc_id", "text_hash", "fp", "n", "bits", "keys", "own"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, f"doc_id {kind}, text_hash long, fp long, n long, bits array<long>, keys array<long>, own long")


def _sizes_fit(n: Column, m: Column) -> Column:
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def _apart(a: str, b: str) -> Column:
    """How many bits two bitmaps differ in."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _of_sets(pairs: DataFrame, sets: DataFrame, docs: DataFrame, words: int, name: str, make) -> DataFrame:
    """``(fp, name)`` for each set that ``pairs`` names: what ``make`` makes of its shingles; other texts aren't moved."""
    needed = pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct()
    named = materialize(sets.select("fp", F.col("rep").alias("doc_id")).join(needed, "fp"), "needed")
    texts = sieved(docs, ["doc_id"], named).join(named, "doc_id").select("fp", "text")

    def run(batches):
        for batch in batches:
            each = zip(batch.column(0).to_pylist(), (shingle_set(x.as_py() or b"", words) for x in batch.column(1).cast(pa.binary())), strict=True)
            # Rows may repeat an id with another text.
            found = [(fp, make(hashes)) for fp, hashes in each if _name(hashes) == fp]
            yield pa.RecordBatch.from_arrays([pa.array([fp for fp, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int64()))], ["fp", name])

    return materialize(texts.mapInArrow(run, f"fp long, {name} array<long>").dropDuplicates(["fp"]), name)


def _links(pairs: DataFrame, sets: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """Those of the pairs ``(a, b)`` of names whose sets are similar."""
    side = lambda c: sets.select(F.col("fp").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}"))
    close = pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(9 * _apart("bitsa", "bitsb") <= F.col("na") + F.col("nb"))
    close = materialize(close.select("a", "b", "na", "nb"), "close")
    # Sets of many shingles fill the bitmap, so they are told apart by a wide one before they are compared.
    wide = _of_sets(close, sets, docs, words, "wide", lambda hashes: _parity(hashes, WIDE))
    one = lambda df, c, name: df.select(F.col("fp").alias(c), F.col(name).alias(f"{name}{c}"))
    near = close.join(one(wide, "a", "wide"), "a").join(one(wide, "b", "wide"), "b").where(9 * _apart("widea", "wideb") <= F.col("na") + F.col("nb"))
    near = materialize(near.select("a", "b", "na", "nb"), "near")
    whole = _of_sets(near, sets, docs, words, "hashes", lambda hashes: hashes)
    both = near.join(one(whole, "a", "hashes"), "a").join(one(whole, "b", "hashes"), "b")
    return both.where(9 * F.size(F.array_intersect("hashesa", "hashesb")) >= 4 * (F.col("na") + F.col("nb"))).select("a", "b")


def near_copies(docs: DataFrame, words: int = 5) -> DataFrame:
    """``(doc_id, component_id)`` for each row that has a ``doc_id``: the smallest one that links reach."""
    return first_copies(docs, words).select("doc_id", "component_id")


def _joined(rows: DataFrame, linked: DataFrame, sets: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """``(fp, root)`` of all sets, those joined up that are similar to the first one that ``linked`` ``(own, root)`` links them to."""
    each = rows.select("fp", "own").distinct().join(linked.select("own", F.col("root").alias("_root")).hint("merge"), "own")
    least = each.groupBy("_root").agg(F.min("fp").alias("b"))
    met = each.join(least.hint("merge"), "_root").where("fp <> b").select(F.col("fp").alias("a"), "b")
    found = connected_components(_links(met, sets, docs, words)).withColumnRenamed("node", "fp")
    return sets.select("fp").join(found.hint("merge"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("root"))


def first_copies(docs: DataFrame, words: int = 5, own: Callable[[bytes], int] | None = None, linked: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``(doc_id, text_hash, component_id, first_hash)`` for each row that has a ``doc_id``.

    Rows that share an id may differ in text, which ``text_hash`` tells; the
    first row of a component is that with the smallest id, and of these with the
    smallest hash.

    Documents are linked if their sets of shingles have a Jaccard similarity of
    at least 0.8, or are equal.  A posting's members are first compared with
    HUBS of them, and then all that still are in different components with each
    other, so dense families don't emit all their pairs.  The hubs are taken at
    once, as they don't follow from what others have joined: a round for each
    would find no other links, and the driver keeps the plans that it has run.

    ``own`` makes a number of each text, and ``linked`` of the column ``own`` of
    these ``(own, root)``: texts of one root are compared first, and only what
    this leaves apart is looked up in postings.
    """
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    rows = materialize(_prefixes(docs, words, own), "prefixes")
    sets = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.min_by("text_hash", F.struct("doc_id", "text_hash")).alias("rep_hash"), F.first("n").alias("n"), F.first("bits").alias("bits")), "names")
    each = rows.select("fp", "n", "keys").dropDuplicates(["fp"]).select("fp", "n", F.explode("keys").alias("key"))
    shared = materialize(each.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "shared-keys")
    posted = materialize(sieved(each, ["key"], shared).join(shared, "key"), "postings")
    roots = materialize(_joined(rows, linked(rows.select("own")), sets, docs, words), "roots") if linked else sets.select("fp", F.col("fp").alias("root"))
    for whole in (False, True):
        at = posted.join(roots, "fp")
        if not whole:
            at = materialize(at, "rooted")
            hubs = at.groupBy("key").agg(F.array_distinct(F.array(*(F.min_by(F.struct("fp", "n", "root"), F.xxhash64("fp", F.lit(k))) for k in range(HUBS)))).alias("hubs"))
            fit = F.filter("hubs", lambda hub: (F.col("root") != hub["root"]) & _sizes_fit(F.col("n"), hub["n"]))
            met = at.join(hubs, "key").select("fp", F.explode(fit).alias("hub"))
            pairs = met.select(F.least("fp", "hub.fp").alias("a"), F.greatest("fp", "hub.fp").alias("b"))
        else:
            apart = at.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
            rest = materialize(at.join(apart, "key"), "rest")
            left, right = rest.alias("l"), rest.alias("r")
            differ = (F.col("l.key") == F.col("r.key")) & (F.col("l.fp") < F.col("r.fp")) & (F.col("l.root") != F.col("r.root"))
            pairs = left.join(right, differ & _sizes_fit(F.col("l.n"), F.col("r.n"))).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
        links = _links(pairs, sets, docs, words)
        named = links.join(roots.select(F.col("fp").alias("a"), F.col("root").alias("ra")), "a").join(roots.select(F.col("fp").alias("b"), F.col("root").alias("rb")), "b")
        named = materialize(named.select("ra", "rb"), "named")
        if named.isEmpty():
            continue
        found = connected_components(named, "ra", "rb").withColumnRenamed("node", "root")
        roots = materialize(roots.join(found, "root", "left").select("fp", F.coalesce("component", "root").alias("root")), "roots")
    rep = F.struct("rep", "rep_hash")
    least = roots.join(sets.select("fp", "rep", "rep_hash"), "fp").groupBy("root").agg(F.min(rep).alias("x")).select("root", F.col("x.rep").alias("component_id"), F.col("x.rep_hash").alias("first_hash"))
    named = roots.join(least, "root").select("fp", "component_id", "first_hash")
    return rows.select("doc_id", "text_hash", "fp").join(named, "fp").select("doc_id", "text_hash", "component_id", "first_hash")
