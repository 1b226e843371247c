"""Single linkage over a table of pairs, by a minimum spanning forest.

The forest is made in Boruvka's rounds: each component takes its shortest edge
that leaves it, components that are so joined become one, and of the edges
between two components only the shortest stays.  Each round at least halves the
components, and joins and groups the edges once; no matrix, and no component,
comes together in one task.  Joins are merged, as both sides grow with the
table and what is broadcast is built in the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopweave.sources.places import written


def _roots(links: DataFrame) -> DataFrame:
    """``(comp, root)`` where each component ``comp`` points to ``to``, and two that point to each other have the lesser as root."""
    back = links.select(F.col("comp").alias("to"), F.col("to").alias("_back"))
    both = links.join(back.hint("merge"), "to", "left")
    top = F.when((F.col("_back") == F.col("comp")) & (F.col("comp") < F.col("to")), F.col("comp")).otherwise(F.col("to"))
    now = written(both.select("comp", top.alias("root")), "roots")
    while True:
        up = now.select(F.col("comp").alias("root"), F.col("root").alias("_next"))
        step = written(now.join(up.hint("merge"), "root").select("comp", F.col("_next").alias("root"), (F.col("_next") != F.col("root")).alias("_moved")), "roots")
        now = step.select("comp", "root")
        if step.where("_moved").isEmpty():
            return now


def spanning_forest(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(a, b, dist)`` of the forest's edges, and ``(name, comp)`` with the least name of each component.

    ``pairs`` has ``(a, b, dist)``, either way round; pairs of a name with
    itself only name it, null names and null or NaN distances link nothing.
    Equal distances go by the pair's names, so the forest is unique.
    """
    dist = F.col("dist").cast("double")
    pairs = pairs.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(~F.isnan(dist), dist).alias("dist"))
    # A name is a pair with itself, so that pairs are made and read once, and those that link nothing only name.
    named = [F.struct(F.col(c).alias("a"), F.col(c).alias("b"), F.lit(None).cast("double").alias("dist")) for c in ("a", "b")]
    each = pairs.select(F.explode(F.filter(F.array(*named, F.struct("a", "b", "dist")), lambda x: (x["a"] == x["b"]) | x["dist"].isNotNull())).alias("e")).select("e.*")
    each = written(each.groupBy("a", "b").agg(F.min("dist").alias("dist")), "pairs")
    comps = each.where("a = b").select(F.col("a").alias("name"), F.col("a").alias("comp"))
    good = each.where("a <> b")
    live = good.select("a", "b", "dist", F.col("a").alias("x"), F.col("b").alias("y"))
    forest = []
    while not live.isEmpty():
        order = F.struct("dist", "a", "b")
        sides = live.select(F.col("x").alias("comp"), F.col("y").alias("to"), "dist", "a", "b").unionByName(live.select(F.col("y").alias("comp"), F.col("x").alias("to"), "dist", "a", "b"))
        taken = written(sides.groupBy("comp").agg(F.min_by(F.struct("to", "dist", "a", "b"), order).alias("e")).select("comp", "e.*"), "taken")
        forest.append(taken.select("a", "b", "dist").distinct())
        roots = _roots(taken.select("comp", "to"))
        as_ = lambda c: roots.select(F.col("comp").alias(c), F.col("root").alias(f"_{c}"))
        comps = written(comps.join(roots.hint("merge"), "comp", "left").select("name", F.coalesce("root", "comp").alias("comp")), "components")
        moved = live.join(as_("x").hint("merge"), "x", "left").join(as_("y").hint("merge"), "y", "left").withColumns({"x": F.coalesce("_x", "x"), "y": F.coalesce("_y", "y")}).where("x <> y")
        between = moved.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min(order).alias("e"))
        live = written(between.select("e.a", "e.b", "e.dist", "x", "y"), "live")
    edges = good.limit(0)
    for some in forest:
        edges = edges.unionByName(some)
    least = comps.groupBy("comp").agg(F.min("name").alias("least"))
    return edges, comps.join(least.hint("merge"), "comp").select("name", F.col("least").alias("comp"))


def single_linkage(pairs: DataFrame, k: int | None = None, height: float | None = None) -> DataFrame:
    """``(name, cluster)``: clusters of single linkage, each called by its least name.

    ``height`` joins whatever pairs up to that distance link; ``k`` cuts the
    forest's longest edges until there are so many clusters, the last by names
    if equal.  Names that no pairs link are clusters anyhow, so there may be
    more than ``k``; fewer names than ``k`` are clusters each.
    """
    if (k is None) == (height is None):
        raise ValueError("give either k or height")
    if height is not None:
        # Longer pairs link nothing, so they needn't enter the forest.
        dist = F.col("dist").cast("double")
        comps = spanning_forest(pairs.select("a", "b", F.when(dist <= height, dist).alias("dist")))[1]
        return comps.select("name", F.col("comp").alias("cluster"))
    edges, comps = spanning_forest(pairs)
    cut = max(0, k - comps.select("comp").distinct().count())
    if not cut:
        return comps.select("name", F.col("comp").alias("cluster"))
    edges = written(edges, "forest")
    longest = edges.orderBy(F.desc("dist"), F.desc("a"), F.desc("b")).limit(cut)
    kept = edges.join(longest.select("a", "b").hint("merge"), ["a", "b"], "left_anti")
    alone = comps.select(F.col("name").alias("a"), F.col("name").alias("b"), F.lit(0.0).alias("dist"))
    return spanning_forest(kept.unionByName(alone))[1].select("name", F.col("comp").alias("cluster"))
