"""Lookups that say what they found, and joins whose columns keep apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from loopweave.sources.places import written


def without_version(name: Column) -> Column:
    """An accession without what follows its first dot."""
    return F.substring_index(name, ".", 1)


def accession_keys(names: Column) -> Column:
    """All names of an array that a record goes by, with and without version, each once and in order; blanks are left out."""
    given = F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.array_sort(F.array_distinct(F.concat(given, F.transform(given, without_version))))


def alias_index(records: DataFrame, names: Column, order: list[str]) -> DataFrame:
    """``records`` under each of their names, column ``alias``; a name that several have goes to the first by ``order``."""
    each = records.withColumn("alias", F.explode(accession_keys(names)))
    first = W.Window.partitionBy("alias").orderBy(*order)
    return each.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def by_alias(rows: DataFrame, name: str, index: DataFrame, cells: list[str]) -> DataFrame:
    """``rows`` with ``cells`` of an alias index, under the name or, failing that, the name without version; ``via`` says which."""
    one = lambda side: index.select(F.col("alias").alias(f"_{side}"), F.struct(*cells).alias(f"_r{side}"))
    keyed = rows.withColumn("_short", F.when(F.contains(F.col(name), F.lit(".")), without_version(F.col(name))))
    met = keyed.join(one("full"), F.col(name) == F.col("_full"), "left").join(one("cut"), F.col("_short") == F.col("_cut"), "left")
    via = F.when(F.col("_full").isNotNull(), "name").when(F.col("_cut").isNotNull(), "without version").otherwise("missing")
    hit = F.coalesce("_rfull", "_rcut")
    return met.select(*rows.columns, via.alias("via"), *(hit[c].alias(c) for c in cells))


def by_keys(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the other columns of ``table`` and ``found``; keys that the table has twice are an error, nulls meet nulls."""
    again = W.Window.partitionBy(*keys)
    checked = table.withColumn("found", F.when(F.count("*").over(again) > 1, F.raise_error(F.concat_ws(" ", F.lit("twice:"), *keys))).otherwise(F.lit(True)))
    other = checked.select(*(F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in checked.columns))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    return rows.join(other, same, "left").drop(*(f"_{c}" for c in keys)).withColumn("found", F.coalesce("found", F.lit(False)))


def misses(looked_up: DataFrame, by: list[str]) -> DataFrame:
    """``(by, n_rows, n_found, n_missed)`` of what :func:`by_keys` gives."""
    found = F.col("found").cast("long")
    return looked_up.groupBy(*by).agg(F.count("*").alias("n_rows"), F.sum(found).alias("n_found"), F.sum(1 - found).alias("n_missed"))


def first_candidate(rows: DataFrame, candidates: Column, table: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``match``, the first of their candidates that ``table`` has as ``key``, and its columns; null without one.

    Candidates are looked up in one join, whatever their number.  Rows are
    numbered as they are written, so that the join back meets the same numbers.
    """
    keyed = written(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered-rows")
    each = keyed.select("_row", F.posexplode(candidates).alias("_at", "_candidate"))
    hits = each.join(table.select(F.col(key).alias("_candidate"), F.struct(*table.columns).alias("_hit")), "_candidate")
    best = hits.groupBy("_row").agg(F.min_by(F.struct(F.col("_candidate").alias("match"), "_hit"), "_at").alias("_best"))
    met = keyed.join(best, "_row", "left")
    return met.select(*rows.columns, F.col("_best.match").alias("match"), *(F.col("_best._hit")[c].alias(c) for c in table.columns if c != key))


def with_blanks(rows: DataFrame, table: DataFrame, left: str, right: str) -> DataFrame:
    """``rows`` joined with a table of texts; where it has nothing its columns are empty texts."""
    other = table.select(F.col(right).alias("_key"), *(F.col(c).cast("string").alias(c) for c in table.columns if c != right))
    cells = [c for c in other.columns if c != "_key"]
    return rows.join(other, F.col(left) == F.col("_key"), "left").select(*rows.columns, *(F.coalesce(c, F.lit("")).alias(c) for c in cells))


def suffixed(a: DataFrame, b: DataFrame, keys: list[str], suffixes: tuple[str, str], how: str = "inner") -> DataFrame:
    """A join whose other columns end with a suffix where both sides have them."""
    both = (set(a.columns) & set(b.columns)) - set(keys)
    left, right = (df.select(*(F.col(c).alias(c + s if c in both else c) for c in df.columns)) for df, s in ((a, suffixes[0]), (b, suffixes[1])))
    return left.join(right, keys, how)


def one_sided(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``(key, only_in)``: what only the left or only the right side has."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("only_in", F.lit("left")).unionByName(y.join(x, key, "left_anti").withColumn("only_in", F.lit("right")))


def in_group(rows: DataFrame, chosen: DataFrame, key: str, names: tuple[str, str] = ("top", "other")) -> DataFrame:
    """``rows`` with ``grp``: the first name for keys that are chosen, else the second."""
    marked = chosen.select(F.col(key).alias("_key")).distinct().withColumn("_in", F.lit(True))
    return rows.join(marked, F.col(key) == F.col("_key"), "left").withColumn("grp", F.when(F.col("_in"), names[0]).otherwise(names[1])).drop("_key", "_in")


def before_separator(m: DataFrame, separator: str) -> DataFrame:
    """A matrix ``(a, b, dist)`` whose labels end before the separator; two labels that become one are an error."""
    cut = lambda c: F.split_part(F.col(c), F.lit(separator), F.lit(1))
    again = F.size(F.collect_set("b").over(W.Window.partitionBy("a", cut("b"))))
    rows = m.withColumn("_n", again)
    b = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("labels fall together: "), cut("b")))).otherwise(cut("b"))
    return rows.select(cut("a").alias("a"), b.alias("b"), "dist")


def report(rows: DataFrame, wanted: list[str], order: list[Column]) -> DataFrame:
    """A table to be read: ``rank`` by ``order`` and those of the wanted columns that there are; for few rows."""
    ranked = rows.withColumn("rank", F.row_number().over(W.Window.orderBy(*order)))
    return ranked.select("rank", *(c for c in wanted if c in rows.columns))


def whole_numbers(text: str) -> list[int]:
    """Numbers of a list ``1,4,9`` or a range ``2-6``, each once and in order; negative ones are an error."""
    low, dash, high = text.strip().partition("-")
    found = range(int(low), int(high) + 1) if dash and low.strip().isdigit() else [int(x) for x in text.split(",") if x.strip()]
    if any(x < 0 for x in found):
        raise ValueError(f"negative numbers in {text!r}")
    return sorted(set(found))
