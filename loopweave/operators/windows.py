"""Windows along sequences, circular or linear."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopweave.functions.sequences import BASES, at, base_entropy

#: Windows whose letters are counted at a time.
WINDOWS = 1 << 12


def sliding_windows(seqs: DataFrame, width: int, step: int, circular: bool = True) -> DataFrame:
    """``(name, start, end, end_mod, wrap, genome_len, circular_window, fragment)``.

    Circular windows start at 0, step, ... below the length and go around the
    circle, however often; linear ones start up to length - width, and one that
    is longer than the sequence is cut off there though ``end`` isn't.
    """
    n = F.length("seq")
    # Bytes are made once for each sequence, long enough for all its windows, before windows are told apart.
    times = F.ceil(F.lit(width) / n).cast("int") + 1
    letters = (F.repeat("seq", times) if circular else F.col("seq")).cast("binary")
    rows = seqs.where(n > 0).select("name", n.alias("genome_len"), letters.alias("letters"))
    last = F.col("genome_len") - 1 if circular else F.greatest(F.lit(0), F.col("genome_len") - width)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), last, F.lit(step))).alias("start"))
    end = F.col("start") + width
    if circular:
        mod, wrap = F.pmod(end, F.col("genome_len")), end > F.col("genome_len")
    else:
        mod, wrap = F.least(end, F.col("genome_len")), F.lit(False)
    return rows.select("name", "start", end.alias("end"), mod.alias("end_mod"), wrap.alias("wrap"), "genome_len", F.lit(circular).alias("circular_window"), at(F.col("letters"), F.col("start"), width).alias("fragment"))


def entropy_windows(seqs: DataFrame, width: int, step: int) -> DataFrame:
    """``(name, start, entropy)`` of circular windows in the sequence extended by its first ``width`` letters.

    Bases are counted up to each letter once, and windows have differences of
    these counts, so overlapping windows aren't read again.  The entropy is null
    for a window without A, C, G or T; a null or empty sequence has no windows.
    """
    kind = seqs.schema["name"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i, seq in enumerate(batch.column(1)):
                text = (seq.as_py() or "").encode("latin-1", "replace")  # a byte for each letter
                letters = np.frombuffer(text + text[:width], np.uint8)
                for low in range(0, len(text), WINDOWS * step):
                    starts = np.arange(low, min(len(text), low + WINDOWS * step), step)
                    ends = np.minimum(starts + width, len(letters))
                    part = letters[low : ends[-1]]
                    sums = [np.concatenate([[0], np.cumsum(part == ord(b))]) for b in BASES]
                    counts = np.stack([c[ends - low] - c[starts - low] for c in sums], axis=1)
                    total = counts.sum(axis=1)
                    share = counts / np.maximum(1, total)[:, None]
                    bits = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(starts))), pa.array(starts, pa.int32()), pa.array(bits, mask=total == 0)], ["name", "start", "entropy"])

    return seqs.select("name", "seq").mapInArrow(run, f"name {kind}, start int, entropy double")


def genome_summary(seqs: DataFrame) -> DataFrame:
    """Length, base counts, shares and entropy of each sequence."""
    from loopweave.functions.sequences import base_count

    counts = {b: base_count(F.col("seq"), b) for b in "ACGTN"}
    rows = seqs.select("name", F.length("seq").alias("length"), *(c.alias(b) for b, c in counts.items()), base_entropy(F.col("seq")).alias("entropy"))
    acgt = F.nullif(F.col("A") + F.col("C") + F.col("G") + F.col("T"), F.lit(0))
    return rows.withColumns({"n_frac": F.col("N") / F.nullif(F.col("length"), F.lit(0)), "gc": (F.col("G") + F.col("C")) / acgt})
