"""Label tracks: ordered windows with a label each, circular or linear.

A track is a table ``(name, start, label)``; all operators order it by
``start`` within ``name`` and never across names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def _by() -> W.WindowSpec:
    return W.Window.partitionBy("name").orderBy("start")


def mosaic_summary(tracks: DataFrame, circular: bool = True) -> DataFrame:
    """A row for each name: windows, dominant label and share, entropy, labels, switches, boundaries, rate.

    The dominant label is the smallest of the commonest.  A circular track's last
    window is next to its first; a track of one window has no boundary.
    """
    first = F.first("label").over(_by().rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow))
    before = F.lag("label").over(_by())
    last = F.row_number().over(W.Window.partitionBy("name").orderBy(F.desc("start"))) == 1
    marked = tracks.select("name", "start", "label", before.alias("before"), first.alias("first"), last.alias("last"))
    turn = F.col("before").isNotNull() & (F.col("before") != F.col("label"))
    closing = F.col("last") & (F.col("label") != F.col("first")) if circular else F.lit(False)
    by_label = marked.groupBy("name", "label").agg(F.count("*").alias("n"), F.sum(turn.cast("int") + closing.cast("int")).alias("turns"))
    return summary_of(by_label, circular)


def summary_of(by_label: DataFrame, circular: bool = True) -> DataFrame:
    """What :func:`mosaic_summary` gives, from ``(name, label, n, turns)``: a label's windows, and those where the track turns to or closes with it."""
    ranked = by_label.groupBy("name").agg(
        F.sum("n").alias("n_windows"),
        F.min(F.struct((-F.col("n")).alias("m"), "label")).alias("top"),
        F.sum(F.col("n") * F.log2("n")).alias("nlogn"),
        F.count("*").alias("labels_seen"),
        F.sum("turns").alias("turns"),
    )
    n = F.col("n_windows")
    boundaries = F.when(n <= 1, 0).otherwise(n if circular else n - 1)
    switches = F.when(n <= 1, 0).otherwise(F.col("turns"))
    return ranked.select(
        "name",
        "n_windows",
        F.col("top.label").alias("dominant_label"),
        (-F.col("top.m") / n).alias("dominant_frac"),
        F.greatest(F.lit(0.0), F.log2(n) - F.col("nlogn") / n).alias("entropy_bits"),
        "labels_seen",
        switches.alias("switches"),
        boundaries.alias("boundaries"),
        F.coalesce(switches / F.nullif(boundaries, F.lit(0)), F.lit(0.0)).alias("switch_rate"),
    )


def complexity(summary: DataFrame, labels: int, least_purity: float = 0.5) -> DataFrame:
    """``summary`` with ``norm_entropy``, the complexity score and a flag for low purity.

    ``labels`` is how many labels there are in all; more in one track is an error.
    """
    if labels > 1:
        norm = F.col("entropy_bits") / F.lit(math.log2(labels))
        norm = F.when(norm > 1 + 1e-10, F.raise_error(F.lit("a track has more labels than there are"))).otherwise(norm)
    else:
        norm = F.lit(0.0)
    scored = summary.withColumn("norm_entropy", norm)
    score = (1 - F.col("dominant_frac")) + F.col("norm_entropy") + F.col("switch_rate")
    return scored.withColumns({"score": score, "flag_low_purity": F.col("dominant_frac") < least_purity})


def ranked(scores: DataFrame, n: int | None = None) -> DataFrame:
    """The most complex names first; ties by purity, switch rate and name.  ``n`` keeps that many."""
    out = scores.orderBy(F.desc("score"), "dominant_frac", F.desc("switch_rate"), "name")
    return out if n is None else out.limit(n)


def global_rank(scores: DataFrame, value: str, name: str) -> DataFrame:
    """``scores`` with ``rank``, 1 for the largest value; ties by name.  A row for each name is ordered in one place."""
    return scores.withColumn("rank", F.row_number().over(W.Window.orderBy(F.desc(value), name)))


def runs(tracks: DataFrame, circular: bool = True) -> DataFrame:
    """``(name, run, label, windows, first_start, last_start, first_index, n_runs)``, runs of equal labels in order.

    In a circular track the run over the origin is one, and the last.
    """
    change = F.coalesce((F.lag("label").over(_by()) != F.col("label")).cast("int"), F.lit(0))
    rows = tracks.withColumns({"change": change, "idx": F.row_number().over(_by()) - 1})
    rows = rows.withColumn("run", F.sum("change").over(_by().rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)))
    spans = rows.groupBy("name", "run").agg(
        F.first("label").alias("label"),
        F.count("*").alias("windows"),
        F.min("start").alias("first_start"),
        F.max("start").alias("last_start"),
        F.min("idx").alias("first_index"),
    )
    if circular:
        order = W.Window.partitionBy("name").orderBy("run").rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)
        head, tail, last = F.first("label").over(order), F.last("label").over(order), F.last("run").over(order)
        joins = (head == tail) & (last > 0)
        spans = spans.withColumn("run", F.when(joins & (F.col("run") == 0), last).otherwise(F.col("run")))
        # The part before the origin comes first in a run that goes over it.
        earlier = F.struct(F.col("first_index") == 0, "first_start")
        spans = spans.groupBy("name", "run").agg(
            F.first("label").alias("label"),
            F.sum("windows").alias("windows"),
            F.min_by("first_start", earlier).alias("first_start"),
            F.max_by("last_start", earlier).alias("last_start"),
            F.min_by("first_index", earlier).alias("first_index"),
        )
    every = W.Window.partitionBy("name")
    rank = F.row_number().over(every.orderBy("run")) - 1
    return spans.withColumns({"n_runs": F.count("*").over(every), "run": rank})


def switchpoints(tracks: DataFrame, least_run: int = 1, circular: bool = True, ends: bool = False) -> DataFrame:
    """``(name, pos0, prev_label, new_label, prev_run_windows, new_run_windows, circular_transition, new_run_start_window_index)``.

    A transition counts only if both runs have ``least_run`` windows.  ``pos0``
    is where the new run starts, or, with ``ends``, the middle between the old
    run's ``end`` and that; tracks then have ``end`` and, if circular,
    ``genome_len``.  Tracks with one label or window have none.
    """
    spans = runs(tracks, circular).where("n_runs > 1")
    order = W.Window.partitionBy("name").orderBy("run")
    around = order.rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)

    def following(c: str) -> Column:
        nxt = F.lead(c).over(order)
        return F.coalesce(nxt, F.first(c).over(around)) if circular else nxt

    cells = ("label", "windows", "first_start", "first_index")
    moved = spans.select("*", *(following(c).alias(f"new_{c}") for c in cells)).where("new_label is not null")
    moved = moved.where((F.col("windows") >= least_run) & (F.col("new_windows") >= least_run))
    pos = F.col("new_first_start")
    if ends:
        at = tracks.select("name", F.col("start").alias("last_start"), "end", *(["genome_len"] if circular else []))
        moved = moved.join(at, ["name", "last_start"])
        if circular:
            size = F.col("genome_len")
            pos = F.floor(F.pmod(F.pmod(F.col("end"), size) + F.pmod(pos - F.pmod(F.col("end"), size), size) / 2, size)).cast("int")
        else:
            pos = F.floor((F.col("end") + pos) / 2).cast("int")
    return moved.select(
        "name",
        pos.alias("pos0"),
        F.col("label").alias("prev_label"),
        "new_label",
        F.col("windows").alias("prev_run_windows"),
        F.col("new_windows").alias("new_run_windows"),
        F.lit(circular).alias("circular_transition"),
        F.col("new_first_index").alias("new_run_start_window_index"),
    )


def transition_counts(points: DataFrame) -> DataFrame:
    """``(prev_label, new_label, n)``."""
    return points.groupBy("prev_label", "new_label").agg(F.count("*").alias("n"))


def transition_matrix(points: DataFrame, labels: list) -> DataFrame:
    """Counts with a column for each new label, 0 where there is none."""
    return points.groupBy("prev_label").pivot("new_label", labels).count().na.fill(0)


def switchpoint_summary(points: DataFrame, lengths: DataFrame) -> DataFrame:
    """Of each name its switchpoints: number, run lengths, kinds of transition, and number per 1000 of ``genome_len``.

    ``lengths`` has ``(name, genome_len)``; a name without one fails.
    """
    run = F.least("prev_run_windows", "new_run_windows")
    found = points.withColumn("run", run).groupBy("name").agg(
        F.count("*").alias("n_switchpoints"),
        F.avg("run").alias("mean_run"),
        F.median("run").alias("median_run"),
        F.min("run").alias("min_run"),
        F.max("run").alias("max_run"),
        F.count_distinct("prev_label", "new_label").alias("transitions"),
    )
    full = found.join(lengths.select("name", "genome_len"), "name", "left")
    size = F.when(F.col("genome_len").isNull(), F.raise_error(F.concat(F.lit("no length for "), "name"))).otherwise(F.col("genome_len"))
    return full.withColumn("per_kb", F.col("n_switchpoints") * 1000 / F.nullif(size, F.lit(0)))


def position_histogram(points: DataFrame, lengths: DataFrame, bins: int) -> DataFrame:
    """``(bin, bin_mid, n, density)`` of positions relative to ``genome_len``, empty bins too."""
    if not 5 <= bins <= 10_000:
        raise ValueError("bins must be from 5 to 10000")
    share = F.col("pos0") / F.nullif(F.col("genome_len"), F.lit(0))
    clipped = F.least(F.greatest(F.floor(share * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = points.join(lengths, "name").select(clipped.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    spine = points.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = spine.join(counts, "bin", "left").na.fill(0, ["n"])
    total = F.nullif(F.sum("n").over(W.Window.partitionBy()), F.lit(0))
    return full.select("bin", ((F.col("bin") + 0.5) / bins).alias("bin_mid"), "n", (F.col("n") / total).alias("density"))
