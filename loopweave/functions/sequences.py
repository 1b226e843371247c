"""Column functions on nucleotide and protein sequences.

Sequences are ASCII; where single positions of long ones are taken it is from
their bytes, which takes the same time at every position.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
STOPS = ("TAA", "TAG", "TGA")
#: The standard genetic code's amino acids for codons in the order T, C, A, G of each base (fixed values).
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = dict(zip(("".join(c) for c in product("TCAG", repeat=3)), AMINO, strict=True))
#: IUPAC letters and their complements (fixed values).
IUPAC, COMPLEMENTS = "ACGTUNRYSWKMBDHV", "TGCAANYRSWMKVHDB"


def at(seq: Column, start: Column | int, width: Column | int) -> Column:
    """``width`` letters from the 0-based ``start``."""
    width = width if isinstance(width, Column) else F.lit(width)
    start = start if isinstance(start, Column) else F.lit(start)
    return F.substring(seq.cast("binary"), (start + 1).cast("int"), width.cast("int")).cast("string")


def base_count(seq: Column, base: str) -> Column:
    return (F.length(seq) - F.length(F.replace(seq, F.lit(base), F.lit("")))).cast("int")


def entropy_of(counts: list[Column]) -> Column:
    """Bits of counts; null if all are 0."""
    total = F.nullif(sum(counts[1:], counts[0]), F.lit(0))
    terms = [F.when(c > 0, -(c / total) * F.log2(c / total)).otherwise(0.0) for c in counts]
    return F.when(total.isNotNull(), sum(terms[1:], terms[0]))


def base_entropy(seq: Column) -> Column:
    """Bits of the composition in A, C, G and T; null without any."""
    return entropy_of([base_count(seq, b) for b in BASES])


def reverse_complement(seq: Column) -> Column:
    """Reversed and complemented; letters other than A, C, G, T and N stay."""
    return F.reverse(F.translate(seq, "ACGTNacgtn", "TGCANtgcan"))


def reverse_complement_full(seq: Column) -> Column:
    """Reversed and complemented by the whole IUPAC alphabet."""
    return F.reverse(F.translate(seq, IUPAC + IUPAC.lower(), COMPLEMENTS + COMPLEMENTS.lower()))


def codon_to_amino(codon: Column) -> Column:
    """One codon's amino acid; ``X`` if the codon isn't one of the 64."""
    code = F.create_map(*(F.lit(x) for kv in CODONS.items() for x in kv))
    return F.coalesce(F.try_element_at(code, codon), F.lit("X"))


def translate_dna(seq: Column) -> Column:
    """The protein of frame 0, without a stop at its end; stops within are ``*``, and letters left over are dropped."""
    n = F.floor(F.length(seq) / 3).cast("int")
    codons = F.transform(F.sequence(F.lit(0), n - 1), lambda i: codon_to_amino(at(seq, i * 3, 3)))
    return F.when(n > 0, F.regexp_replace(F.array_join(codons, ""), r"\*$", "")).otherwise(F.when(seq.isNotNull(), ""))


def slice_circular(seq: Column, start: Column, end: Column, wrap: Column) -> Column:
    """``start`` to ``end``, or, if ``wrap``, from ``start`` to the end and on from the beginning to ``end``."""
    head = at(seq, F.lit(0), F.greatest(end, F.lit(0)))
    plain = F.when(end > start, at(seq, start, end - start)).otherwise("")
    return F.when(wrap, F.concat(at(seq, start, F.length(seq)), head)).otherwise(plain)


def circular_fragment(seq: Column, start: Column, width: int) -> Column:
    """``width`` letters from ``start`` around the circle, as often around as it takes; empty for an empty sequence."""
    n = F.length(seq)
    times = (F.ceil(F.lit(width) / F.nullif(n, F.lit(0))) + 1).cast("int")
    return F.when(n > 0, at(F.repeat(seq, times), F.pmod(start, F.nullif(n, F.lit(0))), width)).otherwise("")


def circular_extension(seq: Column, start: Column, width: int) -> Column:
    """``width`` letters from ``start`` in the sequence with its first ``width`` letters added: shorter if that is too short."""
    return at(F.concat(seq, at(seq, 0, width)), start, width)


def sanitize_protein(seq: Column) -> Column:
    """Upper case, without a stop at the end, other stops and unknown letters ``X``; null if nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(F.upper(F.trim(seq)), r"\*$", ""), r"[^ACDEFGHIKLMNPQRSTVWYBXZJUO-]", "X")
    return F.nullif(kept, F.lit(""))
