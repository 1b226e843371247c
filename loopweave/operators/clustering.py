"""K-means of window profiles."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopweave.functions.sequences import BASES, at


def window_profiles(fragments: DataFrame, k: int) -> DataFrame:
    """``(name, start, vec)``: the k-mer frequencies of windows ``(name, start, fragment)``, over all 4 ** k k-mers in order."""
    codes = F.transform(F.sequence(F.lit(0), F.length("fragment") - k), lambda i: at(F.col("fragment"), i, k))
    valid = F.filter(codes, lambda c: F.rlike(c, F.lit(f"^[{BASES}]+$")))
    index = lambda c: F.aggregate(F.split(c, ""), F.lit(0), lambda s, x: s * 4 + F.instr(F.lit(BASES), x) - 1)
    rows = fragments.where(F.length("fragment") >= k).select("name", "start", F.explode(F.transform(valid, index)).alias("code"))
    counts = rows.groupBy("name", "start", "code").agg(F.count("*").alias("c"))
    sums = counts.groupBy("name", "start").agg(F.map_from_entries(F.collect_list(F.struct("code", "c"))).alias("m"), F.sum("c").alias("n"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(4**k - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)) / F.col("n"))
    return sums.select("name", "start", dense.alias("vec"))


def kmeans(points: DataFrame, k: int, seeds: range = range(1), cosine: bool = False) -> DataFrame:
    """``points`` with ``label``: the clustering of lowest cost over ``seeds``; fewer points than ``k`` are an error.

    Labels are numbered by their centres' order, so that they don't depend on
    the seed that won.
    """
    rows = points.withColumn("features", array_to_vector("vec")).persist()
    try:
        if rows.limit(k).count() < k:
            raise ValueError(f"fewer than {k} points")
        model = lambda s: KMeans(k=k, seed=s, distanceMeasure="cosine" if cosine else "euclidean", maxIter=100).fit(rows)
        best = min((model(s) for s in seeds), key=lambda m: m.summary.trainingCost)
    finally:
        rows.unpersist()
    order = sorted(range(len(best.clusterCenters())), key=lambda i: tuple(best.clusterCenters()[i]))
    names = F.array(*(F.lit(order.index(i)) for i in range(len(order))))
    done = best.transform(points.withColumn("features", array_to_vector("vec")))
    return done.withColumn("label", F.get(names, F.col("prediction"))).drop("features", "prediction")
