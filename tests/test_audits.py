import math

import pytest
from pyspark.sql import functions as F

from loopweave.functions import headers
from loopweave.operators import agreement, audit, lookups, orfs, sensitivity, stats, windows


def test_lookups(spark):
    rows = spark.createDataFrame([("A.1", 1), ("B.2", 2), ("C", 3), (None, 4)], "name string, i int")
    index = spark.createDataFrame([("A.1", "exact"), ("A", "short"), ("B", "short")], "alias string, path string")
    got = {r["i"]: (r["via"], r["path"]) for r in lookups.by_alias(rows, "name", index, ["path"]).collect()}
    assert got == {1: ("name", "exact"), 2: ("without version", "short"), 3: ("missing", None), 4: ("missing", None)}
    table = spark.createDataFrame([("A.1", 1, "x"), (None, 4, "n")], "name string, i int, seq string")
    found = lookups.by_keys(rows, table, ["name", "i"])
    assert {r["i"]: (r["found"], r["seq"]) for r in found.collect()} == {1: (True, "x"), 2: (False, None), 3: (False, None), 4: (True, "n")}
    assert tuple(lookups.misses(found, []).first()) == (4, 2, 2)
    with pytest.raises(Exception, match="twice"):
        lookups.by_keys(rows, table.union(table), ["name", "i"]).collect()
    some = spark.createDataFrame([(1, ["q", "b", "a"]), (2, []), (3, None)], "i int, c array<string>")
    refs = spark.createDataFrame([("a", 10), ("b", 20)], "id string, v int")
    assert {r["i"]: (r["match"], r["v"]) for r in lookups.first_candidate(some, F.col("c"), refs, "id").collect()} == {1: ("b", 20), 2: (None, None), 3: (None, None)}
    assert lookups.whole_numbers("3,1,3") == [1, 3] and lookups.whole_numbers("2-5") == [2, 3, 4, 5]
    with pytest.raises(ValueError):
        lookups.whole_numbers("1,-2")


def test_labels_that_fall_together(spark):
    m = spark.createDataFrame([("a|1", "b|1", 0.5), ("a|1", "b|2", 0.5)], "a string, b string, dist double")
    with pytest.raises(Exception, match="fall together"):
        lookups.before_separator(m, "|").collect()


def test_arcs(spark):
    rows = [(s1, l1, s2, l2, n) for n in (7, 10) for s1 in range(0, n, 2) for l1 in (1, 4, n, n + 3) for s2 in range(0, n, 3) for l2 in (2, n - 1)]
    df = spark.createDataFrame(rows, "a int, la int, b int, lb int, n int")
    for r in df.withColumn("o", audit.arc_overlap(F.col("a"), F.col("la"), F.col("b"), F.col("lb"), F.col("n"))).collect():
        x, y = ({(s + i) % r["n"] for i in range(size)} for s, size in ((r["a"], r["la"]), (r["b"], r["lb"])))
        assert r["o"] == len(x & y)


def test_annotated_orf(spark):
    rows = [("r", "CDS", "a capsid protein", 900), ("r", "cds", "orf 3", 300), ("r", "source", "ORF3 polyprotein", 9000), ("q", "CDS", None, 12)]
    got = {r["name"]: (r["length"], r["basis"]) for r in audit.annotated_orf(spark.createDataFrame(rows, "name string, type string, text string, length int")).collect()}
    assert got == {"r": (300, "annotation"), "q": (12, "longest")}


def test_header_values_may_hold_the_sign(spark):
    df = spark.createDataFrame([("g|orf=1|v=a=b=|k=|x",), (None,)], "h string")
    got = [r[0] for r in df.select(headers.parse_header_fields(F.col("h"))).collect()]
    assert got == [{"v": "a=b=", "k": ""}, None]


def test_agreement_within_groups(spark):
    rows = [("same", i, i % 3, i % 3) for i in range(9)] + [("none", i, 0, 0) for i in range(4)] + [("one", 0, 1, 2)]
    df = spark.createDataFrame(rows, "g string, i int, x int, y int")
    assert {r["g"]: (round(r["ari"], 9), round(r["nmi"], 9)) for r in agreement.agreement_by(df, ["g"], "x", "y").collect()} == {"same": (1.0, 1.0), "none": (1.0, 1.0), "one": (1.0, 1.0)}
    one = spark.createDataFrame([(1, 0, "a")], "i int, seed int, label string")
    assert tuple(agreement.seed_agreement(one, ["i"]).first()) == (0, None, None, None)


def test_configurations(spark):
    scores = [(c, f"n{i}", float((i * k) % 7)) for c, k in (("base", 1), ("other", 3)) for i in range(7)]
    got = {r["config"]: r for r in sensitivity.against_baseline(spark.createDataFrame(scores, "config string, name string, score double"), "base", 3).collect()}
    assert (got["base"]["overlap"], got["base"]["jaccard"]) == (3, 1.0) and got["base"]["spearman"] == pytest.approx(1.0)
    assert got["other"]["overlap"] == 2


def test_ranks_in_ranges(spark, monkeypatch):
    values = [float((i * 37) % 50 // 3) for i in range(200)] + [math.nan, -1e300]
    df = spark.createDataFrame([(v,) for v in values[:200]], "v double")
    order = sorted(values[:200])
    for parts in (1, 5, 64):
        monkeypatch.setattr(stats, "PARTS", parts)
        for r in stats.average_rank(df, "v", "r").distinct().collect():
            assert r["r"] == order.index(r["v"]) + (order.count(r["v"]) + 1) / 2


def test_nearest_boundary_equals_all_pairs(spark):
    orf = spark.createDataFrame([("a", 5, 90), ("a", 40, 3), ("b", 0, 0)], "name string, start0 int, end0 int")
    points = spark.createDataFrame([(n, p) for n in "abc" for p in range(0, 100, 7)], "name string, pos0 int")
    lengths = spark.createDataFrame([("a", 100), ("b", 100), ("c", 100)], "name string, genome_len int")
    ends = {"a": [5, 90, 40, 3], "b": [0], "c": []}
    for circular in (True, False):
        for r in orfs.nearest_boundary(points, orf, lengths, circular).collect():
            want = [min(abs(r["pos0"] - e), 100 - abs(r["pos0"] - e)) if circular else abs(r["pos0"] - e) for e in ends[r["name"]]]
            assert r["dist"] == (min(want) if want else None)


def test_windows_go_around_short_circles(spark):
    df = spark.createDataFrame([("s", "ACG"), ("e", "")], "name string, seq string")
    got = {r["start"]: (r["fragment"], r["end_mod"], r["wrap"]) for r in windows.sliding_windows(df, 7, 2).collect()}
    assert got == {0: ("ACGACGA", 1, True), 2: ("GACGACG", 0, True)}


def test_ranks_of_an_empty_table(spark):
    assert stats.average_rank(spark.createDataFrame([], "v double"), "v", "r").count() == 0
