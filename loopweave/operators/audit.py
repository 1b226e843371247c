"""Audits of records: annotated against predicted reading frames, flags and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

# What makes an annotated feature the one that is looked for.
WANTED, WANTED_SCORE = r"\borf\s*3\b|\borf3\b", 100
WORD, WORD_SCORE = "polyprotein", 50
PRODUCTS, PRODUCT_SCORE = ("reverse transcriptase", "rnase h", "movement protein", "capsid", "coat protein", "aspartic protease"), 5
LENGTH_UNIT = 10_000.0
SHARE = 0.80


def feature_score(text: Column, length: Column) -> Column:
    """How likely an annotated coding feature is the wanted one."""
    low = F.lower(F.coalesce(text, F.lit("")))
    products = sum((F.contains(low, F.lit(p)).cast("int") for p in PRODUCTS), F.lit(0))
    return length / LENGTH_UNIT + WANTED_SCORE * F.rlike(low, F.lit(WANTED)).cast("int") + WORD_SCORE * F.contains(low, F.lit(WORD)).cast("int") + PRODUCT_SCORE * products


def annotated_orf(features: DataFrame) -> DataFrame:
    """Of each record ``name`` its best coding feature, with ``score`` and ``basis``.

    ``features`` has ``(name, type, text, length)``, one row a feature; the
    highest score wins, then the longest, then the first by text.  Records
    without a coding feature are not in the result.
    """
    rows = features.where(F.upper("type") == "CDS").withColumn("score", feature_score(F.col("text"), F.col("length")))
    order = W.Window.partitionBy("name").orderBy(F.desc("score"), F.desc("length"), F.asc_nulls_first("text"))
    best = rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return best.withColumn("basis", F.when(F.col("score") >= WORD_SCORE, "annotation").otherwise("longest"))


def arc_overlap(start_a: Column, size_a: Column, start_b: Column, size_b: Column, around: Column) -> Column:
    """Positions that two arcs of a circle share; an arc longer than the circle is the circle."""
    a, b = F.pmod(start_a, around), F.pmod(start_b, around)
    la, lb = F.least(size_a, around), F.least(size_b, around)
    turned = [F.greatest(F.lit(0), F.least(a + la, b + lb + k * around) - F.greatest(a, b + k * around)) for k in (-1, 0, 1)]
    return turned[0] + turned[1] + turned[2]


def arc_size(start: Column, end: Column, around: Column) -> Column:
    """Positions from ``start`` on to ``end``, over the origin where the end isn't behind the start."""
    s = F.pmod(start, around)
    return F.when((end <= around) & (s < end), end - s).otherwise(around - s + F.pmod(end, around))


def interval_agreement(rows: DataFrame) -> DataFrame:
    """Predicted against annotated arcs: overlap, its share of either, their Jaccard index, and whether they agree.

    ``rows`` has ``genome_len`` and, for either side, ``start_`` and ``size_``
    with ``predicted`` and ``annotated``, and ``same_strand``.
    """
    n = F.col("genome_len")
    p, a = F.least("size_predicted", n), F.least("size_annotated", n)
    found = rows.withColumn("overlap", arc_overlap(F.col("start_predicted"), F.col("size_predicted"), F.col("start_annotated"), F.col("size_annotated"), n))
    shares = found.withColumns(
        {"of_predicted": F.try_divide("overlap", p), "of_annotated": F.try_divide("overlap", a), "jaccard": F.try_divide(F.col("overlap"), p + a - F.col("overlap"))}
    )
    agree = F.col("same_strand") & (F.col("of_predicted") >= SHARE) & (F.col("of_annotated") >= SHARE)
    return shares.withColumn("consistent", F.coalesce(agree, F.lit(False)))


def audit_summary(audit: DataFrame) -> DataFrame:
    """One row: records, those available, to be reviewed, consistent and exceptional.

    ``audit`` has ``record_available``, ``inclusion_status``, ``consistent`` and
    ``orf_status``; nulls count as no.
    """
    count = lambda c: F.count(F.when(c, 1))
    return audit.agg(
        F.count("*").alias("n_expected"),
        count(F.col("record_available")).alias("n_available"),
        count(F.col("inclusion_status") == "manual review required").alias("n_review"),
        count(F.col("consistent")).alias("n_consistent"),
        count(F.col("orf_status") == "exception").alias("n_exceptions"),
    )


def organism(annotated: Column, qualifiers: Column) -> Column:
    """A record's organism: what is annotated, else the first value of its source's qualifier, else empty."""
    from_source = F.get(F.try_element_at(qualifiers, F.lit("organism")), F.lit(0))
    return F.trim(F.coalesce(F.nullif(F.trim(annotated), F.lit("")), from_source, F.lit("")))


def qualifier_text(qualifiers: Column) -> Column:
    """A map of lists of texts as ``key=value;value | key=value``, keys in order."""
    each = F.transform(F.array_sort(F.map_entries(qualifiers)), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ";")))
    return F.coalesce(F.array_join(each, " | "), F.lit(""))


def level_counts(headers: DataFrame, levels: tuple[str, ...] = ("strong", "some", "id_only")) -> DataFrame:
    """``(level, n, frac, n_ids, n_repeated)`` of headers ``(id, level)``, levels without headers too."""
    spine = headers.sparkSession.createDataFrame([(x,) for x in levels], "level string")
    n = headers.groupBy("level").agg(F.count("*").alias("n"))
    ids = headers.agg(F.count("*").alias("total"), F.count_distinct("id").alias("n_ids"))
    rows = spine.join(n, "level", "left").join(F.broadcast(ids))  # one row
    return rows.select("level", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.try_divide(F.coalesce("n", F.lit(0)), "total"), F.lit(0.0)).alias("frac"), "n_ids", (F.col("total") - F.col("n_ids")).alias("n_repeated"))
