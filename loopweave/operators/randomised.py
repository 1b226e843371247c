"""Permutation tests: replicates are rows that Spark deals out.

What each replicate needs is bounded and broadcast; each has a random stream
of its own, seeded by its number, so results don't depend on how replicates
are dealt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopweave.kernels.trees import MOST
from loopweave.sources.places import written

#: Distinct values of a two-sample test that a task draws for at a time, and replicates.
BLOCK, REPLICATES = 1 << 15, 50
#: Replicates of a name that a task draws at a time.
DRAWS = 1 << 16


def replicates(spark: SparkSession, n: int, draw: Callable[[np.random.Generator], float], seed: int) -> DataFrame:
    """``(rep, value)`` of ``n`` replicates of ``draw``."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"rep": pdf["id"], "value": [float(draw(np.random.default_rng([seed, int(r)]))) for r in pdf["id"]]})

    return spark.range(0, n, 1, max(1, min(n // 64, 4 * spark.sparkContext.defaultParallelism))).mapInPandas(run, "rep long, value double")


def _summary(null: DataFrame, observed: float, two_sided: bool, floor: float) -> DataFrame:
    """One row: observed value, p, z, mean and deviation of the replicates."""
    beyond = F.abs("value") >= abs(observed) if two_sided else F.col("value") >= observed
    sums = null.agg(F.count("*").alias("n"), F.sum(beyond.cast("long")).alias("k"), F.avg("value").alias("null_mean"), F.stddev_samp("value").alias("null_sd"))
    z = (F.lit(float(observed)) - F.col("null_mean")) / F.nullif(F.col("null_sd") + floor, F.lit(0.0))
    return sums.select(F.lit(float(observed)).alias("observed"), ((F.col("k") + 1) / (F.col("n") + 1)).alias("p"), z.alias("z"), "null_mean", "null_sd", F.col("n").alias("permutations"))


def mantel(m1: DataFrame, m2: DataFrame, permutations: int, rank: bool = True, seed: int = 0) -> DataFrame:
    """One row: the correlation of two matrices' pairs, and its two-sided p over relabelled second matrices.

    Both are full matrices ``(a, b, dist)`` of the same labels, at most the kernels' bound.
    """
    rows = m1.where("a < b").select("a", "b", F.col("dist").alias("x")).join(m2.select("a", "b", F.col("dist").alias("y")), ["a", "b"]).limit(MOST * MOST + 1).toPandas()
    if len(rows) > MOST * MOST:
        raise ValueError(f"a Mantel test takes at most {MOST} labels")
    names = sorted(set(rows["a"]) | set(rows["b"]))
    if not 3 <= len(names) <= MOST:
        raise ValueError(f"a Mantel test needs 3 to {MOST} labels; there are {len(names)}")
    at = {v: i for i, v in enumerate(names)}
    i, j = rows["a"].map(at).to_numpy(int), rows["b"].map(at).to_numpy(int)
    x, y = np.zeros((len(names),) * 2), np.zeros((len(names),) * 2)
    x[i, j] = x[j, i] = rows["x"].to_numpy(float)
    y[i, j] = y[j, i] = rows["y"].to_numpy(float)
    up = np.triu_indices(len(names), 1)
    order = (lambda v: v.rank().to_numpy()) if rank else (lambda v: v.to_numpy())
    a = order(pd.Series(x[up]))
    # Relabelling moves values about, so their ranks can be taken once.
    ranked = np.zeros_like(y)
    ranked[up] = order(pd.Series(y[up]))
    ranked += ranked.T
    sent = m1.sparkSession.sparkContext.broadcast((a - a.mean(), ranked, up))

    def value(p: np.ndarray) -> float:
        a, full, up = sent.value
        b = full[np.ix_(p, p)][up]
        b = b - b.mean()
        scale = np.sqrt((a @ a) * (b @ b))
        return a @ b / scale if scale else 0.0

    observed = value(np.arange(len(names)))
    n = len(names)
    return _summary(replicates(m1.sparkSession, permutations, lambda g: value(g.permutation(n)), seed), observed, True, 1e-12)


def two_sample(df: DataFrame, flag: str, value: str, permutations: int, median: bool = False, seed: int = 0) -> DataFrame:
    """One row: the difference of means (or medians) of flagged rows and the others, and its two-sided p.

    Null where either side has fewer than two finite values.  Equal values are
    counted, and the counts dealt out in blocks of neighbouring values: each
    replicate draws how many flags fall in each block, and a task draws how many
    of its block's fall on each value.  At most 10 ** 9 values.
    """
    spark = df.sparkSession
    v = df.select(F.col(flag).cast("boolean").alias("f"), F.col(value).cast("double").alias("v")).where("f is not null and v is not null and not isnan(v) and abs(v) < double('inf')")
    counts = v.groupBy("v").agg(F.count("*").alias("n"), F.count_if("f").alias("k")).sort("v")
    # Blocks go by rank, so that reruns draw alike.
    size = BLOCK
    ranked = counts.rdd.zipWithIndex().map(lambda r: (r[1] // size, r[0][0], r[0][1], r[0][2]))
    rows = spark.createDataFrame(ranked, "block long, v double, n long, k long")
    blocks = rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("v", "n", "k"))).alias("r"))
    blocks = blocks.select("block", *(F.col(f"r.{c}").alias(c) for c in "vnk")).persist()
    try:
        share = blocks.select("block", *(F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x).alias(c) for c in "nk")).orderBy("block").toPandas()
        sizes, flagged = share["n"].to_numpy(np.int64), share["k"].to_numpy(np.int64)
        total, top = int(sizes.sum()), int(flagged.sum())
        if min(top, total - top) < 2:
            return spark.createDataFrame([(None,) * 6], "observed double, p double, z double, null_mean double, null_sd double, permutations long")
        sent = spark.sparkContext.broadcast((sizes, flagged))
        middle = [{(m - 1) // 2, m // 2} for m in (top, total - top)]

        def part(v: np.ndarray, n: np.ndarray, k: np.ndarray, before: tuple[int, int]) -> tuple[float, float]:
            """What a block adds to both sides' sums, or to those of their middle values."""
            both = (k, n - k)
            if not median:
                return tuple(float(v @ c) for c in both)
            found = []
            for c, first, places in zip(both, before, middle, strict=True):
                ends = np.cumsum(c)
                found.append(float(sum(v[np.searchsorted(ends, p - first, "right")] for p in places if 0 <= p - first < ends[-1])))
            return tuple(found)

        def run(batches):
            sizes, flagged = sent.value
            for batch in batches:
                for block, v, n, k, first, last in batch.itertuples(index=False):
                    out = []
                    for rep in range(first, last):
                        # Replicate -1 is what was observed.
                        if rep < 0:
                            shares = flagged
                        else:
                            shares = np.random.default_rng([seed, rep]).multivariate_hypergeometric(sizes, top, method="marginals")
                            k = np.random.default_rng([seed, rep, block]).multivariate_hypergeometric(np.asarray(n), shares[block], method="marginals")
                        before = (shares[:block].sum(), (sizes - shares)[:block].sum())
                        out.append((rep, block, *part(np.asarray(v), np.asarray(n), np.asarray(k), before)))
                    yield pd.DataFrame(out, columns=["rep", "block", "top", "rest"])

        spans = [(-1, 0)] + [(r, min(r + REPLICATES, permutations)) for r in range(0, permutations, REPLICATES)]
        tasks = blocks.join(F.broadcast(spark.createDataFrame(spans, "first long, last long")))
        drawn = tasks.repartition(min(len(spans) * len(sizes), 2000), "block", "first").mapInPandas(run, "rep long, block long, top double, rest double")
        # Summed in the order of blocks, so that reruns round alike.
        ordered = drawn.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("block", "top", "rest"))).alias("parts"))
        whole = lambda c, m: F.aggregate(f"parts.{c}", F.lit(0.0), lambda s, x: s + x) / F.lit(float(m))
        by = [len(m) for m in middle] if median else [top, total - top]
        diffs = ordered.select("rep", (whole("top", by[0]) - whole("rest", by[1])).alias("value")).toPandas()
    finally:
        blocks.unpersist()
    observed = float(diffs.loc[diffs["rep"] < 0, "value"].iloc[0])
    return _summary(spark.createDataFrame(diffs[diffs["rep"] >= 0].sort_values("rep")), observed, True, 0.0)


def _within(ends: np.ndarray, size: int, limits: np.ndarray) -> np.ndarray:
    """How many of the places around a circle are at most so far from the nearest end, for each of the limits."""
    b = np.unique(np.asarray(ends) % size)
    gaps = np.diff(np.append(b, b[0] + size)) - 1
    return np.array([len(b) + np.minimum(gaps, 2 * t).sum() for t in limits.tolist()], np.int64)


def boundary_enrichment(points: DataFrame, orfs: DataFrame, lengths: DataFrame, near: list[int], permutations: int, matched: bool = True, seed: int = 0) -> DataFrame:
    """``(threshold, observed, p, z, null_mean, null_sd, permutations)``: are points nearer to ORF ends than random ones?

    Each replicate draws, for each name, as many places as it has points.  Names
    without ORFs are left out of both sides, or, unless ``matched``, stay in the
    replicates' denominator.  As only the number of near places counts, that is
    what is drawn: how many of a name's places fall within each distance is
    multinomial, with the shares of the circle that lie so near.  A name has a
    random stream of its own, so results don't depend on how names are dealt; a
    task draws DRAWS replicates of a name at a time and sends on its sums alone.
    """
    ends = orfs.select("name", F.explode(F.array("start0", "end0")).alias("b")).distinct().groupBy("name").agg(F.array_sort(F.collect_list("b")).alias("ends"))
    counts = points.groupBy("name").agg(F.array_sort(F.collect_list("pos0")).alias("pos"), F.count("*").alias("k"))
    rows = counts.join(lengths.select("name", "genome_len"), "name").join(ends, "name", "left" if not matched else "inner")
    limits = np.array(sorted(set(near)))

    def run(batches):
        seen, null = np.zeros(len(limits), np.int64), np.zeros((permutations, len(limits)), np.int64)
        n, more = 0, 0
        for pdf in batches:
            for name, pos, k, size, ends in pdf.itertuples(index=False):
                if ends is None or not len(ends):
                    more += k
                    continue
                n += k
                b, places = np.asarray(ends), np.asarray(pos)
                at = np.searchsorted(b, places)
                dist = np.minimum.reduce([np.minimum(np.abs(places - s), size - np.abs(places - s)) for s in (b[(at - 1) % len(b)], b[at % len(b)])])
                seen += (dist[:, None] <= limits[None, :]).sum(axis=0)
                share = np.diff(np.concatenate([[0], _within(b, size, limits), [size]])) / size
                # The whole name, so that no two names draw alike.
                own = np.random.default_rng([seed, *hashlib.sha256(str(name).encode()).digest()[:16]])
                for low in range(0, permutations, DRAWS):
                    part = null[low : low + DRAWS]
                    part += np.cumsum(own.multinomial(k, share, len(part))[:, :-1], axis=1)
        reps = np.repeat(np.arange(-1, permutations), len(limits))
        hits = np.concatenate([seen, null.ravel()])
        yield pd.DataFrame({"rep": reps, "threshold": np.tile(limits, permutations + 1), "hits": hits, "n": np.where(reps < 0, n, n + more)})

    # Little to read but much to draw, so the number of tasks is given.
    dealt = rows.select("name", "pos", "k", "genome_len", "ends").repartition(4 * points.sparkSession.sparkContext.defaultParallelism, "name")
    each = dealt.mapInPandas(run, "rep int, threshold int, hits long, n long")
    sums = each.groupBy("rep", "threshold").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    full = sums.select("rep", "threshold", (F.col("hits") / F.nullif(F.col("n"), F.lit(0))).alias("frac"))
    full = full.where("frac is not null or rep >= 0")
    seen = full.where("rep = -1").select("threshold", F.col("frac").alias("observed"))
    null = full.where("rep >= 0").join(seen, "threshold")
    done = null.groupBy("threshold", "observed").agg(F.count("*").alias("permutations"), F.sum((F.col("frac") >= F.col("observed")).cast("long")).alias("k"), F.avg("frac").alias("null_mean"), F.stddev_samp("frac").alias("null_sd"))
    return done.select(
        "threshold", "observed", ((F.col("k") + 1) / (F.col("permutations") + 1)).alias("p"), ((F.col("observed") - F.col("null_mean")) / F.nullif(F.col("null_sd"), F.lit(0.0))).alias("z"), "null_mean", "null_sd", "permutations"
    )


def length_sensitivity(points: DataFrame, orfs: DataFrame, lengths: DataFrame, least: list[int], near: list[int], permutations: int, seed: int = 0) -> DataFrame:
    """``boundary_enrichment`` for ORFs of each of some least lengths, with ``least_aa``, ``n_orfs``, ``n_names`` and ``seed``.

    Lengths that no ORF has aren't in the result.
    """
    done = None
    for aa in least:
        long = orfs.where(F.col("aa_len") >= aa)
        sizes = long.agg(F.count("*").alias("n_orfs"), F.count_distinct("name").alias("n_names"))
        one = boundary_enrichment(points, long, lengths, near, permutations, seed=seed).join(F.broadcast(sizes))  # one row
        one = one.withColumns({"least_aa": F.lit(aa), "seed": F.lit(seed)})
        done = one if done is None else done.unionByName(one)
    return done


def weight_sensitivity(parts: DataFrame, schemes: list[tuple[str, float, float, float]], n: int) -> DataFrame:
    """``(scheme, overlap, jaccard, spearman)``: how far the best ``n`` names, and all ranks, change with the weights of the score's parts.

    ``parts`` has ``(name, dominant_frac, norm_entropy, switch_rate)``; the first
    scheme is what the others are held against.
    """
    from loopweave.operators.sensitivity import against_baseline

    weights = F.explode(F.array(*(F.struct(F.lit(s).alias("config"), F.lit(float(a)).alias("wp"), F.lit(float(b)).alias("we"), F.lit(float(c)).alias("ws")) for s, a, b, c in schemes)))
    score = F.col("w.wp") * (1 - F.col("dominant_frac")) + F.col("w.we") * F.col("norm_entropy") + F.col("w.ws") * F.col("switch_rate")
    scored = written(parts.select("*", weights.alias("w")).select("w.config", "name", F.round(score, 9).alias("score")), "schemes")
    return against_baseline(scored, schemes[0][0], n).select(F.col("config").alias("scheme"), "overlap", "jaccard", "spearman")
