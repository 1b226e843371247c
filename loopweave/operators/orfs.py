"""Open reading frames of circular or linear sequences, and what is near their ends."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from loopweave.functions.headers import strand_sign
from loopweave.functions.sequences import STOPS, at, reverse_complement, translate_dna


#: Letters of sequences that are searched at a time.
LETTERS = 1 << 20
_COMPLEMENT = np.arange(256, dtype=np.uint8)
_COMPLEMENT[np.frombuffer(b"ACGTacgt", np.uint8)] = np.frombuffer(b"TGCAtgca", np.uint8)


def _frames(names: pa.Array, texts: list[tuple[int, bytes]], starts: Sequence[str], circular: bool, nested: bool):
    """Start codons of both strands of some sequences, each with the first stop behind it in its frame."""
    parts, rows, sizes = [], [], []
    for row, text in texts:
        letters = np.frombuffer(text, np.uint8)
        if len(letters) * (2 if circular else 1) >= 6:
            for strand in (letters, _COMPLEMENT[letters[::-1]]):
                parts += [strand, strand] if circular else [strand]
            rows.append(row)
            sizes.append(len(letters))
    if not rows:
        return
    scan = np.concatenate(parts).astype(np.int32)
    value = scan[:-2] << 16 | scan[1:-1] << 8 | scan[2:]
    code = lambda codons: [int.from_bytes(c.encode(), "big") for c in codons]
    is_one = lambda v, codons: np.logical_or.reduce([v == c for c in code(codons)])
    at_ = np.flatnonzero(is_one(value, {*starts, *STOPS}))
    n = np.repeat(np.array(sizes, np.int64), 2)
    length = n * 2 if circular else n
    first = np.cumsum(length) - length
    seg = np.searchsorted(first, at_, "right") - 1
    i = at_ - first[seg]
    inside = i <= length[seg] - 3
    at_, seg, i = at_[inside], seg[inside], i[inside]
    frame = seg * 3 + i % 3
    order = np.argsort(frame, kind="stable")
    at_, seg, i, frame = at_[order], seg[order], i[order], frame[order]
    stops = np.flatnonzero(is_one(value[at_], STOPS))
    begins = np.flatnonzero(is_one(value[at_], starts))
    place = np.searchsorted(stops, begins, "right")
    begins, place = begins[place < len(stops)], place[place < len(stops)]
    ends = stops[place]
    fits = (frame[begins] == frame[ends]) & (i[begins] + 3 <= n[seg[begins]]) & (i[ends] - i[begins] <= n[seg[begins]])
    begins, ends = begins[fits], ends[fits]
    if not nested:  # the first of those that share a stop
        lead = np.diff(ends, prepend=-1) != 0
        begins, ends = begins[lead], ends[lead]
    text = lambda k: pa.array([int(v).to_bytes(3, "big").decode("latin-1") for v in value[at_[k]]], pa.string())
    cells = [
        names.take(pa.array(np.array(rows)[seg[begins] // 2])), pa.array(np.where(seg[begins] % 2 == 0, "+", "-"), pa.string()), pa.array(n[seg[begins]], pa.int32()),
        pa.array(i[begins], pa.int32()), text(begins), pa.array(i[ends], pa.int32()), text(ends),
    ]
    yield pa.RecordBatch.from_arrays(cells, ["name", "strand", "n", "i", "codon", "stop_i", "stop_codon"])


def predict_orfs(seqs: DataFrame, least_aa: int, starts: Sequence[str] = ("ATG",), circular: bool = True, nested: bool = False) -> DataFrame:
    """``(name, strand, frame, start0, end0, span_start0, span_end0, wrap, wrap_compat, nt_len, aa_len, start_codon, stop_codon, scan_start)``.

    In each frame of either strand a start codon within the sequence goes with
    the first stop codon after it, no further than one length on; circular
    sequences are read on over the origin.  Unless ``nested``, only the first of
    the start codons that share a stop counts.  ``wrap`` says whether it goes
    over the origin, ``wrap_compat`` is the flag as other tables have it, which
    holds for nearly all of the minus strand.  ``scan_start`` counts along the
    strand that is read.  Sequences are searched where they lie, without a
    shuffle; rows that share a name are searched each.
    """
    kind = seqs.schema["name"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = [(row, x.as_py().encode("latin-1", "replace")) for row, x in enumerate(batch.column(1)) if x.is_valid]
            held, size = [], 0
            for row, text in texts:
                held.append((row, text))
                size += len(text)
                if size >= LETTERS:
                    yield from _frames(batch.column(0), held, starts, circular, nested)
                    held, size = [], 0
            yield from _frames(batch.column(0), held, starts, circular, nested)

    found = seqs.select("name", F.col("seq").cast("string")).mapInArrow(run, f"name {kind}, strand string, n int, i int, codon string, stop_i int, stop_codon string")
    found = found.withColumn("stop", F.struct(F.col("stop_i").alias("i"), F.col("stop_codon").alias("codon")))
    n, begin, end = F.col("n"), F.col("i"), F.col("stop.i") + 3
    plus = F.col("strand") == "+"
    start0 = F.when(plus, begin % n).otherwise((n - end % n) % n)
    end0 = F.when(plus, end % n).otherwise((n - begin % n) % n)
    rows = found.select(
        "name", "strand", (begin % 3).alias("frame"), start0.alias("start0"), end0.alias("end0"), (end > n).alias("wrap"), (end - begin).alias("nt_len"),
        F.floor((end - begin) / 3 - 1).cast("int").alias("aa_len"), F.col("codon").alias("start_codon"), F.col("stop.codon").alias("stop_codon"), begin.alias("scan_start"), "n",
    )
    rows = rows.where(F.col("aa_len") >= least_aa)
    if circular:
        low, high = F.when(plus, F.col("start0")).otherwise(F.col("end0")), F.when(plus, F.col("end0")).otherwise(F.col("start0"))
        compat = F.col("wrap") | (low >= high)
    else:
        # An end at the sequence's end is 0 by the modulus; it stays the length here.
        right = F.when(plus & (F.col("end0") == 0), n).when(~plus & (F.col("end0") == 0), n).otherwise(F.col("end0"))
        low, high, compat = F.least("start0", right), F.greatest("start0", right), F.lit(False)
    spans = rows.withColumns({"span_start0": low, "span_end0": high, "wrap_compat": compat})
    cells = "name strand frame start0 end0 span_start0 span_end0 wrap wrap_compat nt_len aa_len start_codon stop_codon scan_start".split()
    return spans.select(*cells)


def extract_orfs(seqs: DataFrame, orfs: DataFrame) -> DataFrame:
    """``orfs`` with ``nt_seq`` and ``aa_seq``, read around the origin where they go over it."""
    full = orfs.join(seqs.select("name", "seq"), "name")
    strand = F.when(F.col("strand") == "+", F.col("seq")).otherwise(reverse_complement(F.col("seq")))
    rows = full.withColumn("_s", F.concat(strand, strand)).withColumn("nt_seq", at(F.col("_s"), F.col("scan_start"), F.col("nt_len"))).drop("_s", "seq")
    return rows.withColumn("aa_seq", translate_dna(F.col("nt_seq")))


def longest_orfs(orfs: DataFrame, n: int = 1, least_aa: int = 0) -> DataFrame:
    """Each name's ``n`` longest, with ``rank``; ties by length in nucleotides, start, strand and end."""
    order = W.Window.partitionBy("name").orderBy(F.desc("aa_len"), F.desc("nt_len"), "start0", "strand", "end0")
    return orfs.where(F.col("aa_len") >= least_aa).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def orf_table(orfs: DataFrame) -> DataFrame:
    """A table of ORFs in its normal form: ``wrap``, ``orf_id`` and a numeric ``strand``.

    ``wrapped`` is another name of ``wrap``, which is false where it lacks or
    says anything but true or 1.  Without an ``orf_id`` a name's ORFs are numbered
    by start, then end, then strand.  Missing columns are an error.
    """
    flag = "wrap" if "wrap" in orfs.columns else "wrapped" if "wrapped" in orfs.columns else None
    wrap = F.coalesce(F.lower(F.col(flag).cast("string")).isin("true", "1"), F.lit(False)) if flag else F.lit(False)
    rows = orfs.withColumn("wrap", wrap).drop("wrapped")
    lacks = sorted({"name", "strand", "start0", "end0", "nt_len", "aa_len"} - set(rows.columns))
    if lacks:
        raise ValueError(f"columns that ORFs need are missing: {', '.join(lacks)}")
    rows = rows.withColumns({c: F.col(c).cast("int") for c in ("start0", "end0", "nt_len", "aa_len")}).withColumn("strand", strand_sign(F.col("strand")))
    if "orf_id" not in rows.columns:
        order = W.Window.partitionBy("name").orderBy("start0", "end0", "strand", "nt_len")
        rows = rows.withColumn("orf_id", F.concat(F.lit("orf"), F.row_number().over(order)))
    return rows


def longest_by_protein(orfs: DataFrame) -> DataFrame:
    """Each name's ORF with the longest protein; of ties the first by start, strand and end."""
    first = F.min(F.struct((-F.col("aa_len")).alias("size"), "start0", "strand", "end0"))
    kept = orfs.groupBy("name").agg(first.alias("k")).select("name", (-F.col("k.size")).alias("aa_len"), "k.start0", "k.strand", "k.end0")
    return orfs.join(kept, ["name", "aa_len", "start0", "strand", "end0"])


def ordered(orfs: DataFrame) -> DataFrame:
    """``orfs`` with their place ``nth`` within the name: longest proteins first, then by strand and start."""
    return orfs.withColumn("nth", F.row_number().over(W.Window.partitionBy("name").orderBy(F.desc("aa_len"), "strand", "start0", "end0")))


def median_distances(distances: DataFrame, n: int | None = None) -> DataFrame:
    """``(name, median)`` of the names nearest to boundaries, by the median of their points' distances."""
    found = distances.where("dist is not null").groupBy("name").agg(F.median("dist").alias("median")).orderBy("median", "name")
    return found if n is None else found.limit(n)


def orf_summary(orfs: DataFrame) -> DataFrame:
    """One row: number, names, median and largest length."""
    return orfs.agg(F.count("*").alias("n_orfs"), F.count_distinct("name").alias("n_names"), F.median("aa_len").alias("median_aa"), F.max("aa_len").alias("max_aa"))


def circular_distance(a: Column, b: Column, size: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, size - d)


def nearest_boundary(points: DataFrame, orfs: DataFrame, lengths: DataFrame, circular: bool = True) -> DataFrame:
    """``points`` with ``dist`` to the nearest end of an ORF of the same name; null if there is none.

    A name's points and ends are sorted together once: the nearest end is the
    one before or after, or, around the circle, the first or the last.
    """
    ends = orfs.select("name", F.explode(F.array("start0", "end0")).alias("boundary")).distinct()
    both = points.select("name", "pos0").distinct().withColumn("boundary", F.lit(None).cast("int"))
    both = both.unionByName(ends.select("name", F.col("boundary").alias("pos0"), F.col("boundary").cast("int").alias("boundary")))
    order = W.Window.partitionBy("name").orderBy("pos0")
    before = F.max("boundary").over(order.rangeBetween(W.Window.unboundedPreceding, W.Window.currentRow))
    after = F.min("boundary").over(order.rangeBetween(W.Window.currentRow, W.Window.unboundedFollowing))
    every = W.Window.partitionBy("name")
    found = both.select("name", "pos0", "boundary", before.alias("before"), after.alias("after"), F.min("boundary").over(every).alias("first"), F.max("boundary").over(every).alias("last"))
    found = found.where("boundary is null").join(lengths.select("name", "genome_len"), "name", "left")
    d = [circular_distance(F.col("pos0"), F.col(c), F.col("genome_len")) if circular else F.abs(F.col("pos0") - F.col(c)) for c in ("before", "after", "first", "last")]
    return points.join(found.select("name", "pos0", F.least(*d).alias("dist")), ["name", "pos0"], "left")


def near_fraction(distances: DataFrame, near: list[int]) -> DataFrame:
    """``(threshold, n, frac)`` of points at most so far from a boundary, among those that have one."""
    rows = distances.where("dist is not null").select("dist", F.explode(F.array(*map(F.lit, near))).alias("threshold"))
    return rows.groupBy("threshold").agg(F.count("*").alias("n"), F.avg((F.col("dist") <= F.col("threshold")).cast("double")).alias("frac"))
