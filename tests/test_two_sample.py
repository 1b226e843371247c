import numpy as np
import pytest
from pyspark.sql import functions as F

from loopweave.operators import randomised, windows


def test_more_than_two_million_values(spark):
    df = spark.range(2_000_050).select((F.col("id") % 11 < 4).alias("f"), (F.col("id") % 97).cast("double").alias("v"))
    r = randomised.two_sample(df, "f", "v", 100).first()
    ids = np.arange(2_000_050)
    f, v = ids % 11 < 4, (ids % 97).astype(float)
    assert r["observed"] == pytest.approx(v[f].mean() - v[~f].mean(), abs=1e-12)
    assert r["permutations"] == 100
    assert r["null_sd"] == pytest.approx(v.std() * np.sqrt(1 / f.sum() + 1 / (~f).sum()), rel=0.3)


@pytest.mark.parametrize("median", [False, True])
def test_blocks_draw_as_permutations_do(spark, monkeypatch, median):
    monkeypatch.setattr(randomised, "BLOCK", 7)
    g = np.random.default_rng(3)
    v, f = np.round(g.normal(size=150), 1), np.arange(150) % 3 == 0
    v[f] += 0.3
    middle = np.median if median else np.mean
    null = [middle(p[f]) - middle(p[~f]) for p in (g.permutation(v) for _ in range(4000))]
    rows = [(bool(a), float(b)) for a, b in zip(f, v)]
    r = randomised.two_sample(spark.createDataFrame(rows, "f boolean, v double"), "f", "v", 1000, median).first()
    observed = middle(v[f]) - middle(v[~f])
    assert r["observed"] == pytest.approx(observed, abs=1e-12)
    assert r["p"] == pytest.approx(np.mean(np.abs(null) >= abs(observed) - 1e-12), abs=0.05)
    assert abs(r["null_mean"]) < 0.03 and r["null_sd"] == pytest.approx(np.std(null), rel=0.12)


def test_enrichment_does_not_depend_on_spans_and_tells_names_apart(spark, monkeypatch):
    points = spark.createDataFrame([(n, p) for n in ("a_1234567", "b_1234567") for p in range(0, 300, 7)], "name string, pos0 int")
    orfs = spark.createDataFrame([(n, 10, 200) for n in ("a_1234567", "b_1234567")], "name string, start0 int, end0 int")
    lengths = spark.createDataFrame([(n, 500) for n in ("a_1234567", "b_1234567")], "name string, genome_len int")

    def one(names):
        rows = randomised.boundary_enrichment(points.where(F.col("name").isin(names)), orfs, lengths, [5, 20], 60).collect()
        return sorted(tuple(round(v, 9) for v in r) for r in rows)

    both = one(["a_1234567", "b_1234567"])
    monkeypatch.setattr(randomised, "DRAWS", 100)
    assert one(["a_1234567", "b_1234567"]) == both
    first, second = one(["a_1234567"]), one(["b_1234567"])
    assert [r[1] for r in first] == [r[1] for r in second] and [r[4:6] for r in first] != [r[4:6] for r in second]
    # Two names that draw apart spread less than one.
    assert all(b[5] < max(x[5], y[5]) for b, x, y in zip(both, first, second, strict=True))
    assert all(r[6] == 60 for r in both)


def test_least_lengths_are_tests_of_their_own(spark):
    points = spark.createDataFrame([("a", p) for p in range(0, 90, 9)], "name string, pos0 int")
    orfs = spark.createDataFrame([("a", 10, 40, 10), ("a", 50, 80, 30)], "name string, start0 int, end0 int, aa_len int")
    lengths = spark.createDataFrame([("a", 100)], "name string, genome_len int")
    got = {r["least_aa"]: r for r in randomised.length_sensitivity(points, orfs, lengths, [5, 20, 99], [3], 40).collect()}
    assert {k: (r["n_orfs"], r["n_names"], r["seed"]) for k, r in got.items()} == {5: (2, 1, 0), 20: (1, 1, 0)}
    for aa, r in got.items():
        alone = randomised.boundary_enrichment(points, orfs.where(F.col("aa_len") >= aa), lengths, [3], 40).first()
        assert all(abs(r[c] - alone[c]) < 1e-9 for c in ("observed", "p", "null_mean", "null_sd"))


def test_entropy_of_windows_from_cumulated_counts(spark):
    rows = [("a", "ACGTNNACGG" * 3), ("b", "NNNN"), ("c", ""), ("d", None), (None, "AAé" * 5)]
    got = {(r["name"], r["start"]): r["entropy"] for r in windows.entropy_windows(spark.createDataFrame(rows, "name string, seq string"), 7, 3).collect()}
    want = {}
    for name, seq in rows:
        text = (seq or "") + (seq or "")[:7]
        for start in range(0, len(seq or ""), 3):
            part = [text[start : start + 7].count(b) for b in "ACGT"]
            share = [c / sum(part) for c in part if c]
            want[name, start] = -sum(p * np.log2(p) for p in share) if share else None
    assert got.keys() == want.keys()
    assert all((got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 1e-12) for k, v in want.items())


def test_shares_of_the_circle_and_rows_of_many_names(spark):
    for ends, size in (([0], 9), ([3, 4, 20], 31), ([7, 37], 30), ([0, 15], 30)):
        near = np.array([min(min(abs(p - e % size), size - abs(p - e % size)) for e in ends) for p in range(size)])
        assert randomised._within(np.array(ends), size, np.array([0, 2, 50])).tolist() == [(near <= t).sum() for t in (0, 2, 50)]
    names = spark.range(300).select(F.concat(F.lit("n"), "id").alias("name"))
    points = names.select("name", F.explode(F.sequence(F.lit(0), F.lit(190), F.lit(10))).alias("pos0"))
    out = randomised.boundary_enrichment(points, names.select("name", F.lit(5).alias("start0"), F.lit(90).alias("end0")), names.select("name", F.lit(200).alias("genome_len")), [4, 20], 500)
    got = {r["threshold"]: r for r in out.collect()}
    for t, share in ((4, 18 / 200), (20, 82 / 200)):
        assert got[t]["null_mean"] == pytest.approx(share, abs=4 * np.sqrt(share / 6000 / 500)) and got[t]["null_sd"] == pytest.approx(np.sqrt(share * (1 - share) / 6000), rel=0.15)
