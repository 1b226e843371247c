"""Mixing sources to target weights by balanced sampling with the cube method.

A source's target asks for so many copies of each of its documents: a whole
number of them, and one more for a share of the documents.  That share is
sampled by the cube method (Deville and Tille, 2004): every document starts
with the share as its inclusion probability, and a flight moves the
probabilities of three documents at a time along the null space of two
constraints, the number of documents and the number of words, until one of
them is 0 or 1.  A flight holds no more than three open documents, so it runs
as a stream over each block of a source.  What stays open, two documents a
block at most, flies on with that of other blocks, until each source has a
few open documents left: the landing problem, which is solved by trying all
roundings for the one that comes nearest to the words that are due.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W
from pyspark.sql.pandas.types import to_arrow_schema

from loopweave.llm.storage import materialize

#: Documents that a block is to have.
BLOCK = 4096
#: Open documents that a source may have when its landing begins.
LANDING = 10
EPS = 1e-9


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    spaced = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.filter(F.split(spaced, " "), lambda x: x != "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``(source, source_size, target)`` of a table ``(source, source_size)``, a row a source.

    Sources in the order of their code points, null last, take the weights in
    turn.  All get the same number of words for a unit of weight, except those
    that would get over ``cap`` times what they have, which get just that; what
    they leave goes to the others, again by weight.  The windows run over a row
    for each source.
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("at") % len(weights) + 1).cast("int"))
    order = W.Window.orderBy(F.col("source").asc_nulls_last())
    by_room = W.Window.orderBy(F.col("room") / F.col("weight"), "at").rowsBetween(W.Window.unboundedPreceding, -1)
    every = W.Window.orderBy(F.lit(1)).rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)
    rows = sizes.withColumn("at", F.row_number().over(order) - 1).withColumn("weight", weight)
    rows = rows.withColumns({"room": cap * F.col("source_size"), "due": share * F.sum("source_size").over(every), "all": F.sum("weight").over(every)})
    # With the sources before it full, what a unit of weight would give.
    rate = (F.col("due") - F.coalesce(F.sum("room").over(by_room), F.lit(0.0))) / (F.col("all") - F.coalesce(F.sum("weight").over(by_room), F.lit(0.0)))
    rows = rows.withColumn("rate", rate)
    # It rises while sources fill up and falls after that, so the right one is the largest.
    rows = rows.withColumn("level", F.max("rate").over(every))
    target = F.least("room", F.coalesce(F.col("level") * F.col("weight"), F.col("room")))
    return rows.select("source", "source_size", target.alias("target"))


class Flight:
    """Open documents of one block: row, size, probability."""

    def __init__(self):
        self.open: list[tuple[int, float, float]] = []

    def add(self, row: int, size: float, p: float, u: float) -> list[tuple[int, int]]:
        """Take in a document; return ``(row, 0 or 1)`` for those that are decided."""
        done = []
        if p <= EPS or p >= 1 - EPS:
            return [(row, int(p > 0.5))]
        self.open.append((row, size, p))
        while len(self.open) == 3:
            done += self._move(u)
        return done

    def _move(self, u: float) -> list[tuple[int, int]]:
        (_, a, _), (_, b, _), (_, c, _) = self.open
        # In the null space of the rows (1, 1, 1) and (a, b, c).
        v = (b - c, c - a, a - b) if not a == b == c else (1.0, -1.0, 0.0)
        up = min((1 - p) / x if x > 0 else p / -x for (_, _, p), x in zip(self.open, v, strict=True) if x)
        down = min(p / x if x > 0 else (1 - p) / -x for (_, _, p), x in zip(self.open, v, strict=True) if x)
        step = up if u * (up + down) < down else -down
        moved = [(r, s, min(1.0, max(0.0, p + step * x))) for (r, s, p), x in zip(self.open, v, strict=True)]
        self.open = [m for m in moved if EPS < m[2] < 1 - EPS]
        return [(r, int(p > 0.5)) for r, _, p in moved if not EPS < p < 1 - EPS]


def land(units: list[tuple[int, float, float]]) -> list[tuple[int, int]]:
    """Round the last open documents so that words, then documents, come nearest to what is due."""
    words, n = sum(s * p for _, s, p in units), sum(p for _, _, p in units)
    best = min(product((0, 1), repeat=len(units)), key=lambda c: (abs(sum(s * x for (_, s, _), x in zip(units, c, strict=True)) - words), abs(sum(c) - n)))
    return [(r, x) for (r, _, _), x in zip(units, best, strict=True)]


def _stream(last: bool, schema: pa.Schema):
    """Fly over rows sorted by block; ``chosen`` is null for what stays open.

    Rows begin with block, size, p, u and end with what is carried along.  In
    the last round a block is a whole source, whose last LANDING documents wait
    and land with those that are open then.
    """

    def run(batches):
        flight, now, n = Flight(), None, 0
        waiting: list[tuple[int, float, float, float]] = []
        units: dict[int, tuple] = {}
        out: list[tuple] = []

        def settle(done):
            for r, x in done:
                row = units.pop(r)
                out.append((*row[:3], x, *row[4:]))

        def finish():
            left = flight.open + [w[:3] for w in waiting]
            if last:
                settle(land(left))
            else:
                for r, _, p in left:
                    row = units.pop(r)
                    out.append((*row[:2], p, None, *row[4:]))
            flight.open = []
            waiting.clear()

        def batch_of(rows):
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != now:
                    finish()
                    now = row[0]
                units[n] = row
                waiting.append((n, *row[1:4]))
                if len(waiting) > (LANDING if last else 0):
                    settle(flight.add(*waiting.pop(0)))
                n += 1
            yield batch_of(out)
            out.clear()
        finish()
        yield batch_of(out)

    return run


def cube_sample(units: DataFrame, stratum: str, size: Column, by: list[str], seed: int = 1) -> DataFrame:
    """``units`` with ``chosen``, 0 or 1, sampled with probability ``p`` and balanced in each stratum.

    ``by`` names the columns that tell units apart.  Flights of blocks of about
    BLOCK rows come first, then flights of what they leave open, until a
    stratum's open rows are few enough for one stream.  Which rows share a
    block, and their order, depends on ``by`` alone, so reruns agree whatever
    the partitions.
    """
    names = [c for c in units.columns if c != "p"]
    rows = units.withColumns({"_stratum": F.xxhash64(stratum), "_size": size.cast("double")})
    found, round_ = [], 0
    while True:
        most = rows.groupBy("_stratum").count().agg(F.max("count")).first()[0] or 0
        last, blocks = most <= BLOCK, max(1, -(-most // BLOCK))
        block = F.concat_ws(":", F.col("_stratum").cast("string"), F.pmod(F.xxhash64(*by, F.lit(seed + round_)), F.lit(blocks)).cast("string"))
        draw = F.shiftrightunsigned(F.xxhash64(*by, F.lit(seed), F.lit(round_)), 11) / F.lit(float(2**53))
        dealt = rows.select(block.alias("_block"), "_size", "p", draw.alias("_u"), "_stratum", *names)
        dealt = dealt.repartition("_block").sortWithinPartitions("_block", "_u", *by)
        kinds = "_block string, _size double, p double, chosen int, _stratum long, " + ", ".join(f"`{c}` {units.schema[c].dataType.simpleString()}" for c in names)
        schema = to_arrow_schema(T.StructType.fromDDL(kinds))
        flown = materialize(dealt.mapInArrow(_stream(last, schema), kinds), "flight")
        found.append(flown.where("chosen is not null").select(*names, "chosen"))
        if last:
            return reduce(DataFrame.unionByName, found)
        rows, round_ = flown.where("chosen is null").select("_stratum", "_size", "p", *names), round_ + 1


def _row_hash(docs: DataFrame) -> Column:
    """A hash of all columns, nulls included; nested columns count as JSON, as maps have no hash."""
    parts = []
    for c in docs.columns:
        kind, value = docs.schema[c].dataType.simpleString(), F.col("`" + c.replace("`", "``") + "`")
        parts += [F.to_json(F.struct(value.alias("x"))) if "<" in kind or kind == "variant" else value, value.isNull()]
    return F.xxhash64(*parts)


#: What tells units apart.
KEYS = ["doc_id", "source", "size", "row_hash"]


def _units(docs: DataFrame, weights: tuple[int, ...], share: float, cap: float, seed: int) -> DataFrame:
    """KEYS, ``source_size``, ``target``, ``n``, ``whole`` and ``more`` of each group of rows that agree in KEYS.

    All ``n`` rows are taken ``whole`` times, and ``more`` of them once more.
    So many of a group's rows as its probabilities make up are certain to be
    among those; only the fraction that is left takes part in the sampling, as
    one row.  A group of any size thus moves the words by one row's at most.
    """
    doc, source, size = F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text").cast("string"))
    sized = materialize(docs.select(doc.alias("doc_id"), source.alias("source"), size.alias("size"), _row_hash(docs).alias("row_hash")), "sizes")
    sources = materialize(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap), "targets")
    of = sources.withColumnRenamed("source", "s")
    units = sized.groupBy(*KEYS).agg(F.count("*").alias("n"))
    units = units.join(of, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    ratio = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    # A share so near a whole number that it only is not one by rounding counts as whole.
    whole = F.floor(ratio + EPS).cast("long")
    due = F.greatest(F.lit(0.0), F.col("ratio") - F.col("whole")) * F.col("n")
    sure = F.floor(due + EPS).cast("long")
    units = units.withColumns({"ratio": ratio, "whole": whole}).withColumn("due", due)
    units = materialize(units.withColumns({"sure": sure, "p": F.greatest(F.lit(0.0), F.col("due") - sure)}).drop("ratio", "due"), "units")
    sampled = cube_sample(units, "source", F.col("size"), KEYS, seed)
    return sampled.withColumn("more", F.least("n", F.col("sure") + F.col("chosen"))).drop("sure", "chosen")


#: Rows that one row is repeated into at once; larger groups are dealt out in spans of so many.
SPAN = 4096


def _repeated(rows: DataFrame, times: Column) -> DataFrame:
    """``rows`` with ``nth`` from 1 to ``times``, each of them as often."""
    rows = rows.withColumn("_times", times.cast("long"))
    few = rows.where((F.col("_times") > 0) & (F.col("_times") <= SPAN)).withColumn("_from", F.lit(0).cast("long"))
    spans = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1, F.lit(SPAN).cast("long")))
    many = rows.where(F.col("_times") > SPAN).withColumn("_from", spans).repartition("_from")
    each = F.explode(F.sequence(F.col("_from") + 1, F.least("_times", F.col("_from") + SPAN)))
    return few.unionByName(many).withColumn("nth", each).drop("_times", "_from")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 1) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)``, a row for each row of ``docs``.

    ``copies`` says how often the mix takes the row, ``taken`` how many words
    that makes.  Of rows alike in all columns as many get one copy more as their
    share makes up, so repeated rows and rows without an id don't take a source
    off its target.  A null text has size 0, null is a source of its own, and
    sources without words have target 0 and give nothing.
    """
    rows = _repeated(_units(docs, weights, share, cap, seed), F.col("n"))
    copies = F.col("whole") + (F.col("nth") <= F.col("more")).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 1) -> DataFrame:
    """The mix itself: ``docs`` with each row as often as it is taken, and with all its columns.

    See :func:`mix`: rows without words are taken like others of their source,
    rows of a source without words never.  ``doc_id`` must hold integers or null.
    """
    units = _units(docs, weights, share, cap, seed).where("whole + more > 0").select(*KEYS, "n", "whole", "more")
    # The row is kept in one column, so that its names can't clash with others.
    names = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("row"), _row_hash(docs).alias("hash"), word_count(F.col("text").cast("string")).alias("words"))
    same = (F.col("hash") == F.col("row_hash")) & (F.col("words") == F.col("size"))
    same &= F.col("row.doc_id").cast("long").eqNullSafe(F.col("doc_id")) & F.col("row.source").cast("string").eqNullSafe(F.col("source"))
    alike = "more = 0 or more = n"
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("whole") + (F.col("more") > 0).cast("long")))
    taken = rows.join(units.where(f"({alike})"), same).select("row", times.alias("nth"))
    # Where only some rows of a unit are taken once more, one stands for all, as they are alike in all columns.
    parted = materialize(units.where(f"not ({alike})"), "parted-units")
    if not parted.isEmpty():
        one = rows.join(parted, same).groupBy(*KEYS).agg(F.first("row").alias("row"), F.first(F.col("whole") * F.col("n") + F.col("more")).alias("times"))
        taken = taken.unionByName(_repeated(materialize(one.select("row", "times"), "parted-rows"), F.col("times")).select("row", "nth"))
    return taken.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
