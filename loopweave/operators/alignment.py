"""Aligned sequences, column by column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Symbols that aren't compared (fixed values).
SKIPPED = "-.X?"


def columns_of(rows: DataFrame) -> DataFrame:
    """``(name, col, res)`` of aligned rows ``(name, seq)``."""
    return rows.select("name", F.posexplode(F.split(F.upper("seq"), "")).alias("col", "res"))


def check_aligned(rows: DataFrame) -> DataFrame:
    """``rows``, if all sequences are equally long; else an error."""
    lengths = [r[0] for r in rows.select(F.length("seq").alias("n")).distinct().limit(2).collect()]
    if len(lengths) > 1:
        raise ValueError("the sequences aren't equally long")
    return rows


def identity_distance(rows: DataFrame) -> DataFrame:
    """``(a, b, compared, dist)`` for all pairs of a set of rows, ``a < b``: 1 less the share of equal columns among those that both have a residue in; null if there are none."""
    good = lambda c: ~c.isin(*SKIPPED)
    pairs = rows.select(F.col("name").alias("a"), F.split(F.upper("seq"), "").alias("x")).join(rows.select(F.col("name").alias("b"), F.split(F.upper("seq"), "").alias("y")), F.col("a") < F.col("b"))
    both = F.filter(F.arrays_zip("x", "y"), lambda s: good(s["x"]) & good(s["y"]))
    counted = pairs.select("a", "b", both.alias("z")).select("a", "b", F.size("z").alias("compared"), F.size(F.filter("z", lambda s: s["x"] == s["y"])).alias("same"))
    return counted.select("a", "b", "compared", (1 - F.col("same") / F.nullif(F.col("compared"), F.lit(0))).alias("dist"))


def trim_gaps(rows: DataFrame, most: float) -> DataFrame:
    """``(name, seq)`` without columns that have gaps in more than ``most`` of the rows."""
    cells = columns_of(rows)
    kept = cells.groupBy("col").agg(F.avg((F.col("res") == "-").cast("double")).alias("gaps")).where(F.col("gaps") <= most).select("col")
    joined = cells.join(kept, "col").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("col", "res"))).alias("cells"))
    trimmed = joined.select("name", F.array_join(F.transform("cells", lambda c: c["res"]), "").alias("seq"))
    return rows.select("name").join(trimmed, "name", "left").select("name", F.coalesce("seq", F.lit("")).alias("seq"))


def canonical_split(side, everyone):
    """A bipartition as its smaller side, the first in order if they are equally large; arrays of names."""
    a = F.array_sort(side)
    b = F.array_sort(F.array_except(everyone, side))
    smaller = (F.size(a) < F.size(b)) | ((F.size(a) == F.size(b)) & (F.array_join(a, "\x01") < F.array_join(b, "\x01")))
    return F.when(smaller, a).otherwise(b)
