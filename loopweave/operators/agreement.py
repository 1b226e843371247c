"""Agreement of two labellings, and how well labels part points.

Everything follows from contingency counts or from sums by label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def contingency(df: DataFrame, x: str, y: str) -> DataFrame:
    """``(x, y, n)``."""
    return df.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"))


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def adjusted_rand(table: DataFrame) -> DataFrame:
    """One row ``(ari)`` of a contingency table; 1 if neither labelling parts anything."""
    cells = table.agg(F.sum(_pairs(F.col("n"))).alias("cells"), F.sum("n").alias("n"))
    a = table.groupBy("x").agg(F.sum("n").alias("m")).agg(F.sum(_pairs(F.col("m"))).alias("rows"))
    b = table.groupBy("y").agg(F.sum("n").alias("m")).agg(F.sum(_pairs(F.col("m"))).alias("cols"))
    one = cells.join(F.broadcast(a)).join(F.broadcast(b))
    expected = F.col("rows") * F.col("cols") / F.nullif(_pairs(F.col("n")), F.lit(0.0))
    most = (F.col("rows") + F.col("cols")) / 2
    return one.select(F.coalesce((F.col("cells") - expected) / F.nullif(most - expected, F.lit(0.0)), F.lit(1.0)).alias("ari"))


def normalized_mutual_information(table: DataFrame) -> DataFrame:
    """One row ``(nmi)``, by the mean of the entropies; 1 if neither labelling parts anything."""
    total = F.sum("n").over(W.Window.partitionBy())
    rows = table.withColumns({"t": total, "nx": F.sum("n").over(W.Window.partitionBy("x")), "ny": F.sum("n").over(W.Window.partitionBy("y"))})
    p = F.col("n") / F.col("t")
    sums = rows.agg(
        F.sum(p * F.ln(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))).alias("mi"),
        F.sum(-p * F.ln(F.col("nx") / F.col("t"))).alias("hx"),
        F.sum(-p * F.ln(F.col("ny") / F.col("t"))).alias("hy"),
    )
    mean = (F.col("hx") + F.col("hy")) / 2
    return sums.select(F.when(mean < 1e-15, 1.0).otherwise(F.greatest(F.lit(0.0), F.col("mi")) / mean).alias("nmi"))


def agreement_by(labelled: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """``(by, n, ari, nmi)`` of two labellings within each group, from contingency counts."""
    return agreement_of(labelled.groupBy(*by, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("c")), by)


def agreement_of(cells: DataFrame, by: list[str]) -> DataFrame:
    """``(by, n, ari, nmi)`` of two labellings within each group, from how often labels meet, ``(by, x, y, c)``."""
    side = lambda c: W.Window.partitionBy(*by, c)
    rows = cells.withColumns({"cx": F.sum("c").over(side("x")), "cy": F.sum("c").over(side("y")), "n": F.sum("c").over(W.Window.partitionBy(*by))})
    share = F.col("c") / F.col("n")
    # A label's own terms are dealt out to its cells.
    of_x, of_y = F.col("c") / F.col("cx"), F.col("c") / F.col("cy")
    sums = rows.groupBy(*by).agg(
        F.first("n").alias("n"),
        F.sum(_pairs(F.col("c"))).alias("cells"),
        F.sum(_pairs(F.col("cx")) * of_x).alias("rows"),
        F.sum(_pairs(F.col("cy")) * of_y).alias("cols"),
        F.sum(share * F.ln(F.col("c") * F.col("n") / (F.col("cx") * F.col("cy")))).alias("mi"),
        F.sum(-share * F.ln(F.col("cx") / F.col("n"))).alias("hx"),
        F.sum(-share * F.ln(F.col("cy") / F.col("n"))).alias("hy"),
    )
    expected = F.col("rows") * F.col("cols") / F.nullif(_pairs(F.col("n")), F.lit(0.0))
    apart = (F.col("rows") + F.col("cols")) / 2 - expected
    # Sums of shares of whole numbers may be off by a rounding.
    ari = F.when(F.abs(apart) > 1e-9 * F.col("n"), (F.col("cells") - expected) / apart).otherwise(1.0)
    mean = (F.col("hx") + F.col("hy")) / 2
    return sums.select(*by, "n", F.coalesce(ari, F.lit(1.0)).alias("ari"), F.when(mean < 1e-15, 1.0).otherwise(F.greatest(F.lit(0.0), F.col("mi")) / mean).alias("nmi"))


def seed_agreement(assignments: DataFrame, keys: list[str]) -> DataFrame:
    """One row ``(pairs, ari_mean, ari_sd, ari_min)`` over each two seeds of ``(keys, seed, label)``.

    Seeds meet on the keys; a single seed gives nulls, a single pair sd 0.
    """
    one = lambda c: assignments.select(*keys, F.col("seed").alias(f"seed_{c}"), F.col("label").alias(f"label_{c}"))
    both = one("a").join(one("b"), keys).where("seed_a < seed_b")
    found = agreement_by(both, ["seed_a", "seed_b"], "label_a", "label_b")
    sd = F.when(F.count("*") > 1, F.stddev_samp("ari")).when(F.count("*") == 1, 0.0)
    return found.agg(F.count("*").alias("pairs"), F.avg("ari").alias("ari_mean"), sd.alias("ari_sd"), F.min("ari").alias("ari_min"))


def reproduction(core: DataFrame, again: DataFrame, keys: list[str]) -> DataFrame:
    """One row on how far ``again`` reproduces ``core``, both ``(keys, label)``: matched and unmatched rows, ARI, NMI, equal labels."""
    a = core.select(*keys, F.col("label").alias("label_core"), F.lit(1).alias("in_core"))
    b = again.select(*keys, F.col("label").alias("label_again"), F.lit(1).alias("in_again"))
    both = a.join(b, keys, "full_outer")
    met = F.col("in_core").isNotNull() & F.col("in_again").isNotNull()
    counts = both.agg(
        F.count("in_again").alias("n_again"), F.count("in_core").alias("n_core"), F.count(F.when(met, 1)).alias("n_matched"), F.count(F.when(~met, 1)).alias("n_unmatched"),
        F.avg(F.when(met, F.col("label_core").eqNullSafe(F.col("label_again")).cast("double"))).alias("exact"),
    )
    agreed = agreement_by(both.where(met).withColumn("g", F.lit(1)), ["g"], "label_core", "label_again")
    return counts.join(F.broadcast(agreed.select("ari", "nmi")), how="left")  # one row


def k_scan(assignments: DataFrame, reference: DataFrame, n: int) -> DataFrame:
    """``(k, ari, nmi)``: clusterings ``(k, name, label)`` against labels ``(name, label)``; k below 2 or above ``n`` is passed over."""
    known = reference.select("name", F.col("label").alias("known"))
    rows = assignments.where((F.col("k") >= 2) & (F.col("k") <= n)).join(known, "name")
    return agreement_by(rows, ["k"], "known", "label").select("k", "ari", "nmi")


def over_seeds(metrics: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """``metrics`` over their seeds: of each value its mean and sample deviation."""
    parts = [f(c).alias(f"{c}_{n}") for c in values for n, f in (("mean", F.avg), ("sd", F.stddev_samp))]
    return metrics.groupBy(*by).agg(F.count("*").alias("n_seeds"), *parts)


def best_k(summary: DataFrame, criteria: dict[str, str], group: str = "geometry", k: str = "k") -> DataFrame:
    """``(group, criterion, direction, best_k, value)``: the k of the largest or smallest value of each criterion, the first of ties."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("criterion"), F.lit(d).alias("direction"), F.col(c).alias("value")) for c, d in criteria.items())))
    rows = summary.select(group, k, each.alias("x")).select(group, k, "x.*").where("value is not null")
    sign = F.when(F.col("direction") == "max", -F.col("value")).otherwise(F.col("value"))
    best = rows.groupBy(group, "criterion", "direction").agg(F.min(F.struct(sign.alias("s"), F.col(k).alias("k"), "value")).alias("b"))
    return best.select(group, "criterion", "direction", F.col("b.k").alias("best_k"), F.col("b.value").alias("value"))


def optimal_mapping(table: DataFrame, most: int = 2000) -> DataFrame:
    """``(x, y)``: which label of one side stands for which of the other, so that most rows match.

    ``table`` is a contingency table.  It is as small as labels are few, and
    more than ``most`` on a side are an error; labels left over have no row.
    """
    from loopweave.kernels.trees import assignment

    rows = table.select("x", "y", "n").limit(most * most + 1).toPandas()
    wide = rows.pivot(index="x", columns="y", values="n").fillna(0.0)
    if max(wide.shape, default=0) > most:
        raise ValueError(f"more than {most} labels")
    xs, ys = wide.index.tolist(), wide.columns.tolist()
    pairs = [(xs[i], ys[j]) for i, j in assignment(wide.to_numpy(float))] if len(wide) else []
    kinds = dict(table.dtypes)
    return table.sparkSession.createDataFrame(pairs, f"x {kinds['x']}, y {kinds['y']}")


def silhouette_sampled(points: DataFrame, most: int = 3000, seed: int = 0, cosine: bool = False) -> DataFrame:
    """One row ``(n, silhouette)`` of points ``(id, label, vec)``: the mean silhouette of a sample of at most ``most``.

    The sample is the points whose ids and seed have the smallest MD5.  Its
    points meet in pairs, so ``most`` bounds the work; a point alone in its
    label has silhouette 0.
    """
    some = points.orderBy(F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit(str(seed))))).limit(most)
    one = lambda c: some.select(*(F.col(x).alias(f"{x}_{c}") for x in ("id", "label", "vec")))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    p, q = F.col("vec_a"), F.col("vec_b")
    apart = F.sqrt(F.aggregate(F.zip_with(p, q, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v))
    d = 1 - F.try_divide(dot(p, q), F.sqrt(dot(p, p) * dot(q, q))) if cosine else apart
    pairs = one("a").crossJoin(F.broadcast(one("b"))).where("id_a <> id_b")  # of the bounded sample
    means = pairs.groupBy("id_a", "label_a", "label_b").agg(F.avg(d).alias("d"))
    own, rest = F.max(F.when(F.col("label_a") == F.col("label_b"), F.col("d"))), F.min(F.when(F.col("label_a") != F.col("label_b"), F.col("d")))
    each = means.groupBy("id_a").agg(F.coalesce((rest - own) / F.nullif(F.greatest(rest, own), F.lit(0.0)), F.lit(0.0)).alias("s"))
    return each.agg(F.count("*").alias("n"), F.avg("s").alias("silhouette"))


def majority_mapping(table: DataFrame) -> DataFrame:
    """``(x, y, n)``: for each ``x`` its commonest ``y``, the smallest of ties."""
    best = table.groupBy("x").agg(F.min(F.struct((-F.col("n")).alias("m"), "y")).alias("b"))
    return best.select("x", F.col("b.y").alias("y"), (-F.col("b.m")).alias("n"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0)))


def centroids(points: DataFrame) -> DataFrame:
    """``(label, i, n, mean)`` of points ``(id, label, vec)``: component ``i`` of each label's mean."""
    parts = points.select("label", F.posexplode("vec").alias("i", "v"))
    return parts.groupBy("label", "i").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))


def calinski_harabasz(points: DataFrame) -> DataFrame:
    """One row ``(calinski_harabasz)``: dispersion between labels over that within, each by its degrees of freedom."""
    parts = points.select("label", F.posexplode("vec").alias("i", "v"))
    own = parts.groupBy("label", "i").agg(F.count("*").alias("n"), F.avg("v").alias("m"), (F.var_pop("v") * F.count("*")).alias("w"))
    grand = F.sum(F.col("n") * F.col("m")).over(W.Window.partitionBy("i")) / F.sum("n").over(W.Window.partitionBy("i"))
    rows = own.withColumn("g", grand)
    sums = rows.agg(F.sum(F.col("n") * (F.col("m") - F.col("g")) * (F.col("m") - F.col("g"))).alias("b"), F.sum("w").alias("w"), F.count_distinct("label").alias("k"), F.sum(F.when(F.col("i") == 0, F.col("n"))).alias("n"))
    return sums.select(((F.col("b") / F.nullif(F.col("k") - 1, F.lit(0))) / F.nullif(F.col("w") / F.nullif(F.col("n") - F.col("k"), F.lit(0)), F.lit(0.0))).alias("calinski_harabasz"))


def davies_bouldin(points: DataFrame) -> DataFrame:
    """One row ``(davies_bouldin)``: the mean over labels of the worst ratio of spreads to distance of means."""
    means = centroids(points).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "mean"))).alias("c"))
    means = means.select("label", F.transform("c", lambda x: x["mean"]).alias("c"))
    apart = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    own = points.join(means, "label").groupBy("label").agg(F.avg(apart(F.col("vec"), F.col("c"))).alias("s"), F.first("c").alias("c"))
    pairs = own.alias("a").join(own.alias("b"), F.col("a.label") != F.col("b.label"))
    ratio = (F.col("a.s") + F.col("b.s")) / F.nullif(apart(F.col("a.c"), F.col("b.c")), F.lit(0.0))
    return pairs.groupBy("a.label").agg(F.max(ratio).alias("r")).agg(F.avg("r").alias("davies_bouldin"))
