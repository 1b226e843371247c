"""Mantel's test over tables of pairs, of any number of labels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopweave.operators.stats import average_rank
from loopweave.sources.places import written

#: Rounds of the relabelling's network, and relabelled pairs of a batch.
ROUNDS, BATCH = 4, 1 << 16


def relabelled(numbers: np.ndarray, n: int, seed: int, replicate: int) -> np.ndarray:
    """Where a replicate's permutation of 0 ... n - 1 takes ``numbers``, worked out for these alone.

    A Feistel network over the next power of four permutes all numbers below it;
    what lands at n or beyond goes through it again until it is below.
    """
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = np.random.default_rng([seed, replicate]).integers(0, 2**63, ROUNDS).astype(np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & low
        for key in keys:
            mixed = (right ^ key) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed >> np.uint64(33)) & low)
        return (left << np.uint64(half)) | right

    out = once(numbers.astype(np.uint64))
    while (beyond := out >= n).any():
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def numbered(names: DataFrame) -> DataFrame:
    """``(name, nth)`` of distinct names, from 0 in their order; they are dealt out by ranges, and only ranges are counted together."""
    rows = names.select("name").distinct().repartitionByRange("name").sortWithinPartitions("name").select("name", F.monotonically_increasing_id().alias("id"))
    rows = written(rows.withColumn("part", F.shiftright("id", 33)), "numbered")
    before, sums = {}, 0
    for r in rows.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # a row for each range
        before[r["part"]], sums = sums, sums + r["n"]
    if not before:
        return rows.select("name", F.lit(0).cast("long").alias("nth"))
    first = F.create_map(*(F.lit(v) for item in before.items() for v in item))
    return rows.select("name", (F.element_at(first, F.col("part")) + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias("nth"))


def mantel_pairs(m1: DataFrame, m2: DataFrame, permutations: int, rank: bool = True, seed: int = 0) -> DataFrame:
    """One row ``(observed, p, z, null_mean, null_sd, permutations, pairs)``: the correlation of two tables' pairs, and its two-sided p.

    Both are ``(a, b, dist)`` with each pair of the labels once, in either order.
    Pairs that one of them lacks, or whose distance is null, are left out of
    both.  A replicate relabels the second table, pair by pair in the tasks that
    hold the pairs, and meets the first one in a join; what comes back is a sum
    for each replicate.  A relabelled pair that was left out adds nothing.  By
    rank, all sums are of whole numbers, so that ties with the observed value
    are exact and reruns agree.  Fewer than three labels, or no variance, give
    nulls.
    """
    side = lambda m, c: m.where("a <> b and dist is not null and not isnan(dist)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("dist").cast("double").alias(c))
    both = written(side(m1, "x").join(side(m2, "y"), ["a", "b"]), "pairs")
    names = numbered(both.select(F.col("a").alias("name")).union(both.select(F.col("b").alias("name"))))
    names = written(names, "labels")
    n, total = names.count(), both.count()
    at = lambda c, to: names.select(F.col("name").alias(c), F.col("nth").alias(to))
    rows = both.join(at("a", "i"), "a").join(at("b", "j"), "b").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "x", "y")
    if rank:  # twice the ranks, less their mean, are whole
        rows = average_rank(average_rank(rows, "x", "_x"), "y", "_y")
        centred = lambda c: F.round(2 * F.col(c) - (total + 1)).cast("decimal(19,0)")
        rows = rows.select("i", "j", centred("_x").alias("x"), centred("_y").alias("y"))
    else:
        mean = rows.agg(F.avg("x"), F.avg("y")).first()
        rows = rows.select("i", "j", (F.col("x") - F.lit(mean[0])).alias("x"), (F.col("y") - F.lit(mean[1])).alias("y"))
    rows = written(rows, "centred")
    exact = lambda c: F.sum(c.cast("decimal(38,0)") if rank else c)
    sums = rows.agg(exact(F.col("x") * F.col("y")), exact(F.col("x") * F.col("x")), exact(F.col("y") * F.col("y"))).first()
    spark = m1.sparkSession
    fields = "observed double, p double, z double, null_mean double, null_sd double, permutations long, pairs long"
    if n < 3 or not sums[1] or not sums[2]:
        return spark.createDataFrame([(None,) * 6 + (total,)], fields)
    kind = "decimal(19,0)" if rank else "double"

    def run(batches):
        for batch in batches:
            i, j = (batch.column(k).to_numpy() for k in (0, 1))
            ends, place = np.unique(np.concatenate([i, j]), return_inverse=True)
            for rep in range(permutations):
                to = relabelled(ends, n, seed, rep)[place]
                a, b = to[: len(i)], to[len(i) :]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), rep, np.int32)), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), batch.column(2)], ["rep", "i", "j", "y"])

    moved = rows.select("i", "j", "y").repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, f"rep int, i long, j long, y {kind}")
    met = moved.join(rows.select("i", "j", "x"), ["i", "j"])
    null = met.groupBy("rep").agg(exact(F.col("x") * F.col("y")).alias("s")).toPandas()["s"]
    null = np.array([*null, *[0] * (permutations - len(null))])
    scale = float(sums[1]) ** 0.5 * float(sums[2]) ** 0.5
    observed, values = float(sums[0]) / scale, null.astype(float) / scale
    slack = 0 if rank else 1e-12 * scale
    k = int(sum(abs(v) >= abs(sums[0]) - slack for v in null))
    mean, sd = float(values.mean()), float(values.std(ddof=1)) if permutations > 1 else None
    z = (observed - mean) / sd if sd else None
    return spark.createDataFrame([(observed, (k + 1) / (permutations + 1), z, mean, sd, permutations, total)], fields)
