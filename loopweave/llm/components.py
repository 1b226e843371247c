"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopweave.llm.storage import materialize


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node ``u`` is linked to one ``v``, and none of these to another."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("leaf")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("leaf")))
    found = ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.count("*").alias("n"))
    return found.where("leaf > 0 and n > 1").isEmpty()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for each node that a link names.

    ``component`` is the smallest node that can be reached.  Large-star and
    small-star rounds alternate (Kiveris et al., 2014) until the links are a
    forest of stars; a round only joins and groups, and its links go to the
    shared folder, so neither a hub nor a long chain meets in one task.  Joins
    are merged, so that no round builds a table in the driver.  Each half of a
    round is a plan of its own and the last round isn't repeated to see that
    nothing changes, as the driver keeps the plans that a session has run.
    Links with a null end, or from a node to itself, join nothing.
    """
    edges = materialize(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "links",
    )
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # A row of each link at most, so that what repeats can stay until the round's end.
        large = materialize(both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "links")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select("m", F.explode(F.array_distinct(F.array("u", "v"))).alias("u"))
        edges = materialize(small.where("u <> m").select("u", F.col("m").alias("v")).distinct(), "links")
        if _are_stars(edges):
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
