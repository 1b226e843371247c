"""Registered queries do the whole job: nothing is cut off their inputs."""

import hashlib
from unittest.mock import MagicMock

import duckdb

from loopweave.plans import more_queries as M
from loopweave.plans.queries import ORACLE_SQL


def equals_sql(spark, folder, name, tables):
    """The query's rows, which are those of its SQL."""
    with duckdb.connect() as db:
        for t in tables:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
        expected = db.execute(ORACLE_SQL[name]).fetchall()
    got = [tuple(r) for r in getattr(M, name)(spark, str(folder)).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    return got


def test_whole_texts_are_sanitised(spark, tmp_path):
    rows = [(0, "ab1 " * 50 + "end*"), (1, None), (2, "*"), (3, "x" * 80 + "tail")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r[0]: r[1:] for r in equals_sql(spark, tmp_path, "P9_sanitize_protein", ["documents"])}
    assert got[0] == (203, hashlib.md5(("ABXX" * 50 + "END").encode()).hexdigest())
    assert got[3][0] == 84 and got[1] == got[2] == (None, None)


def test_aligned_rows_are_as_wide_as_the_longest_text(spark, tmp_path):
    texts = ["ACDEFGHIKL" * 7 + "WYV", "ACDEFGHIKL" * 7 + "WYA", "ACDEFGHIKL" * 6, "MKV lit"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    cells = equals_sql(spark, tmp_path, "G7_alignment_columns", ["benchmark"])
    assert len(cells) == 4 * 73 and ("ref0", 72, "V") in cells and ("ref2", 72, "-") in cells
    pairs = {r[:2]: r[2:] for r in equals_sql(spark, tmp_path, "A15_identity_distance", ["benchmark"])}
    assert pairs["ref0", "ref1"] == (73, round(1 / 73, 6))
    equals_sql(spark, tmp_path, "A16_gap_trim", ["benchmark"])
    assert M.C6_bootstrap_support(spark, str(tmp_path)).count() > 0


def test_replicates_and_schemes_are_the_references(monkeypatch):
    seen = {}

    def note(name, at):
        return lambda *args, **_: seen.setdefault(name, args[at])

    for name in ("_panel_distances", "_composition_distances", "rounded"):
        monkeypatch.setattr(M, name, lambda *args: None)
    for name in ("genomes", "tracks", "proteins", "read"):
        monkeypatch.setattr(M.A, name, lambda *_: MagicMock())
    columns = MagicMock()
    columns.col.return_value.__eq__.return_value = MagicMock()
    monkeypatch.setattr(M, "F", columns)
    for module in ("matrix", "orfs", "tracks"):
        monkeypatch.setattr(M, module, MagicMock())
    monkeypatch.setattr(M.trees, "bootstrap_support", note("C6", 1))
    monkeypatch.setattr(M.mantel, "mantel_pairs", note("mantel", 2))
    for name, at in (("boundary_enrichment", 4), ("two_sample", 3), ("weight_sensitivity", 1)):
        monkeypatch.setattr(M.randomised, name, note(name, at))
    for query in (M.C6_bootstrap_support, M.R1_mantel, M.R2_boundary_enrichment, M.R4_two_sample, M.R6_weight_sensitivity):
        query(None, "")
    schemes = seen.pop("weight_sensitivity")
    assert seen == {"C6": 1000, "mantel": 5000, "boundary_enrichment": 2000, "two_sample": 10000}
    assert len({s[1:] for s in schemes}) == 9 and schemes[0] == ("equal", 1.0, 1.0, 1.0)
