"""Results as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_delimited(df: DataFrame, path: str, sep: str = ",", one_file: bool = False) -> None:
    """A delimited table with a header; arrays are joined by semicolons."""
    flat = df.select(*(F.array_join(F.transform(c, lambda x: x.cast("string")), ";").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes))
    (flat.coalesce(1) if one_file else flat).write.option("header", "true").option("sep", sep).csv(path)


def write_fasta(df: DataFrame, path: str, width: int = 60) -> None:
    """FASTA files of rows ``(name, seq)``, lines of ``width`` letters."""
    wrapped = F.rtrim(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"), F.lit("\n"))
    df.select(F.concat(F.lit(">"), "name", F.lit("\n"), wrapped).alias("value")).write.text(path)


def markdown(df: DataFrame, rows: int, digits: int = 4) -> str:
    """The first ``rows`` rows as a Markdown table, for reports."""
    cell = lambda v: f"{v:.{digits}g}" if isinstance(v, float) else "" if v is None else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in df.limit(rows).collect()])


def latex(df: DataFrame, rows: int) -> str:
    """The first ``rows`` rows as the body of a LaTeX table."""
    cell = lambda v: f"{v:.4g}" if isinstance(v, float) else "" if v is None else str(v).replace("_", r"\_")
    return "\n".join(" & ".join(map(cell, r)) + r" \\" for r in [tuple(df.columns), *df.limit(rows).collect()])
