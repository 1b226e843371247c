"""Schemas of the tables that operators exchange, and column aliases."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQUENCES = "name string, fmt string, source_file string, seq string"
WINDOWS = "name string, start int, end int, end_mod int, wrap boolean, genome_len int, circular_window boolean, label int"
SWITCHPOINTS = "name string, pos0 int, prev_label string, new_label string, prev_run_windows int, new_run_windows int, circular_transition boolean, new_run_start_window_index int"
DISTANCES = "a string, b string, dist double"

#: Names that a column may have in tables of other makers, the preferred one first.
WINDOW_ALIASES = {"name": ["name", "genome"], "start": ["start"], "label": ["label", "assigned_cluster", "cluster"]}


def resolve_columns(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """``df`` with each canonical column under its name, whichever alias it came under.

    A canonical column without any alias in ``df`` is an error, raised at once.
    """
    picked = {}
    for name, others in aliases.items():
        found = next((c for c in others if c in df.columns), None)
        if found is None:
            raise ValueError(f"no column for {name}: tried {', '.join(others)}; there are {', '.join(df.columns)}")
        picked[name] = found
    rest = [c for c in df.columns if c not in picked.values() and c not in picked]
    return df.select(*(F.col(c).alias(n) for n, c in picked.items()), *rest)


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df``, if it has the columns; else an error that names those that lack."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df
