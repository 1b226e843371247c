import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loopweave.llm import linededup, mixing


def distance(a, b):
    same = len(os.path.commonprefix([a, b]))  # costs no edits
    a, b = a[same:], b[same:]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, s, k):
    s = list(s)
    for _ in range(k):
        i = rng.randrange(len(s) + 1)
        what = rng.randrange(3)
        if what == 0:
            s.insert(i, rng.choice("abé"))
        elif s and what == 1:
            del s[min(i, len(s) - 1)]
        elif s:
            s[min(i, len(s) - 1)] = rng.choice("abé")
    return "".join(s)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_band_distance(spark, edits):
    rng = random.Random(edits)
    rows = []
    for _ in range(250):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(1, 50)))
        b = changed(rng, a, rng.randrange(0, edits + 3))
        a, b = (a, b) if len(a) >= len(b) else (b, a)
        if b and len(a) - len(b) <= edits:
            rows.append((a, b, distance(a, b)))
    df = spark.createDataFrame(rows, "a string, b string, d int")
    for r in df.select("d", linededup.band_distance(F.col("a"), F.col("b"), edits).alias("got")).collect():
        assert r["got"] == r["d"] if r["d"] <= edits else r["got"] > edits


def brute(rows, edits=2, least=linededup.LEAST_CHARS):
    last = 2**63
    order = sorted((d if d is not None else last, p, line) for d, t in rows if t is not None for p, line in enumerate(t.split("\n")) if len(line) >= least)
    first = {}
    for d, p, line in order:
        first.setdefault(line, (d, p))
    lines = sorted(first, key=first.get)
    gone = set()
    for j, y in enumerate(lines):
        for x in lines[:j]:
            limit = min(edits, min(len(x), len(y)) // linededup.CHARS_PER_EDIT)
            if abs(len(x) - len(y)) <= limit and distance(x, y) <= limit:
                gone.add(y)
                break
    keep = lambda d, p, line: len(line) < least or (line not in gone and first[line] == (d if d is not None else last, p))
    return [None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if keep(d, p, x)) for d, t in rows]


def test_lines_equal_brute_force(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randrange(15, 80))) for _ in range(40)]
    rows = [(i, "\n".join(changed(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randrange(0, 6)))) for i in range(90)]
    rows += [(500, None), (501, ""), (None, base[0] + "\na line that nobody else has got"), (3, rows[3][1]), (-7, base[5]), (502, "x" * 30_000), (503, "x" * 29_999 + "y")]
    df = spark.createDataFrame([(d, t, 1, i, "n") for i, (d, t) in enumerate(rows)], "doc_id long, text string, n_chars long, i int, line string")
    got = {r["i"]: r for r in linededup.dedup_lines(df).collect()}
    assert [got[i]["text"] for i in range(len(rows))] == brute(rows)
    assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) and r["line"] == "n" for r in got.values())


def test_long_postings_are_cut_further(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randrange(2, 7)))
    common = " ".join(word() for _ in range(30))
    lines = [f"{word()} {word()} {word()} {common}" for _ in range(12)] + [f"{common} {word()} {word()}" for _ in range(12)]
    for _ in range(40):
        parts = common.split()
        for _ in range(rng.randrange(1, 4)):
            parts[rng.randrange(len(parts))] = word()
        lines.append(" ".join(parts))
    lines += [changed(rng, rng.choice(lines), rng.randrange(1, 4)) for _ in range(40)]
    lines += ["Item %02d of the list that every page shows" % k for k in range(60)] + ["a" * 43, "a" * 44, "ab" * 22, "a" * 41 + "bb", "x" * 21, "x" * 20 + "y", "x" * 39, "x" * 40, "x" * 41]
    rng.shuffle(lines)
    rows = [(i, line) for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(df, few=10).collect()}
    want = brute(rows)
    assert [got[i] for i in range(len(rows))] == [t if t is not None else "" for t in want]


@pytest.mark.parametrize("at_once", [0, linededup.AT_ONCE])
def test_few_pairs_that_are_left_are_compared_without_more_rounds(spark, monkeypatch, at_once):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(6))
    common = " ".join(word() for _ in range(3))
    lines = [" ".join([common, *(word() for _ in range(6))]) for _ in range(30)]
    lines += [changed(rng, rng.choice(lines), rng.randrange(1, 4)) for _ in range(20)]
    rows = list(enumerate(lines))
    cuts = []
    monkeypatch.setattr(linededup, "AT_ONCE", at_once)
    monkeypatch.setattr(linededup, "_by_length", lambda *a, real=linededup._by_length: cuts.append(a) or real(*a))
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), few=20).collect()}
    assert [got[i] for i in range(len(rows))] == brute(rows)
    assert bool(cuts) == (at_once == 0)


def test_every_name_and_id_of_documents(spark):
    rows = [(None, "no id has this line too", 1, 1, 1), (2**63 - 1, "no id has this line too", 2, 2, 2), (5, "short", 3, 3, 3), (6, "short\nshort", 4, 4, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, doc int, `kept.of` int")
    got = sorted(linededup.dedup_lines(df).collect(), key=lambda r: r["row"])
    assert [tuple(r) for r in got] == [(None, "", 1, 1, 1), *rows[1:]] and list(got[0].asDict()) == df.columns
    got = sorted(linededup.dedup_lines(df, least_chars=1).collect(), key=lambda r: r["row"])
    assert [r["text"] for r in got] == ["", rows[1][1], "short", ""]
    with pytest.raises(ValueError):
        linededup.dedup_lines(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_rows_that_share_an_id_or_have_none(spark):
    near = ["the passage that both rows begin with, one", "the passage that both rows begin with, two", "the passage that both rows begin with, one!"]
    rows = [(d, line + f"\nand {d} {k} has a tail of its very own here {'xyz'[k] * 9}") for d in (None, 4) for k, line in enumerate((near[0], near[2], near[0]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [linededup.dedup_lines(df.repartition(p)).collect() for p in (1, 5)]
    assert sorted(map(str, kept[0])) == sorted(map(str, kept[1]))
    # One row of those that share the id keeps its first line; those without one come after it.
    first = [r["doc_id"] for r in kept[0] if r["text"].startswith("the passage")]
    assert first == [4]
    alone = linededup.dedup_lines(df.where("doc_id is null")).collect()
    assert sum(r["text"].startswith("the passage") for r in alone) == 1


def test_line_report(spark):
    line = "a passage that stands in both documents"
    df = spark.createDataFrame([(1, f"{line}\nshort"), (2, line), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_kept"], r["kept_chars"]) for r in linededup.line_report(df).collect()}
    assert got == {1: (2, 2, len(line) + 6), 2: (1, 0, 0), 3: (0, 0, 0)}
    assert linededup.line_report(df.where("doc_id > 9")).count() == 0


def water(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(cap * sizes[s] for s in full)
        target = {s: cap * sizes[s] if s in full else left * weight[s] / sum(weight[r] for r in rest) for s in names}
        over = {s for s in rest if target[s] > cap * sizes[s]}
        if not over:
            return target
        full |= over


def test_targets(spark):
    rng = random.Random(4)
    for n in (1, 2, 7, 30):
        sizes = {f"s{rng.randrange(999)}é{i}": rng.choice([0, 5, 10, 1000, 50_000]) for i in range(n)} | {None: 40}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
        want = water(sizes)
        assert got.keys() == want.keys()
        for s in want:
            assert got[s] == pytest.approx(want[s], rel=1e-9, abs=1e-9)


def documents(spark, n=6000):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 20, 300])), f"s{min(i % 9, 3)}" if i % 50 else None, "x") for i in range(n)]
    rows += [(None, "no id here", "s1", "x"), (7, "twice", "s2", "x"), (7, "twice", "s2", "x"), (8, None, "s2", "x"), (9, "\x1cnot\x0bsplit\x85here", "s3", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target string")


def test_mix(spark):
    df = documents(spark)
    got = mixing.mix(df).toPandas()
    assert len(got) == 6005
    assert (got["taken"] <= 2 * got["size"]).all() and (got["copies"] >= 0).all()
    for _, part in got.fillna({"source": "none"}).groupby("source"):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= 300
        assert part["size"].sum() == part["source_size"].iloc[0]
    again = mixing.mix(df.repartition(7)).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    words = df.select("doc_id", "text", mixing.word_count(F.col("text")).alias("n")).collect()
    assert all(r["n"] == len(re.findall("[^\x20\x09-\x0d]+", r["text"] or "")) for r in words)


def test_mixed_rows(spark):
    df = documents(spark, 300)
    rows = mixing.mixed(df)
    assert rows.columns == df.columns
    taken = mixing.mix(df).groupBy().agg(F.sum("copies")).first()[0]
    assert rows.count() == taken
    assert mixing.mix(df.where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("doc_id", [None, 5])
def test_repeated_rows_meet_the_target(spark, doc_id):
    rows = [(doc_id, "three words here", "a")] * 2000 + [(i, "two words", "b") for i in range(1000)] + [(i, f"row {i} repeats", "c") for i in range(300)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.count("*").alias("n"), F.sum("copies").alias("copies")).collect()
    assert {r["source"]: r["n"] for r in got} == {"a": 2000, "b": 1000, "c": 900}
    assert all(abs(r["taken"] - r["target"]) <= 6 for r in got)
    out = mixing.mixed(df)
    assert {r["source"]: r["count"] for r in out.groupBy("source").count().collect()} == {r["source"]: r["copies"] for r in got}


def test_large_units_are_dealt_out_in_spans(spark):
    df = spark.createDataFrame([("a", 9000), ("b", 0), ("c", mixing.SPAN)], "k string, n long")
    got = mixing._repeated(df, F.col("n")).groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("nth").alias("d"), F.max("nth").alias("m")).collect()
    assert {r["k"]: (r["n"], r["d"], r["m"]) for r in got} == {"a": (9000,) * 3, "c": (mixing.SPAN,) * 3}


def test_rows_that_differ_in_nulls_or_maps_are_told_apart(spark):
    rows = [(None, "w", "s", 1, None, {"a": 1}), (None, "w", "s", None, 1, {"a": 1}), (None, "w", "s", 1, None, {"a": 2})]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, x long, y long, m map<string,int>")
    assert df.select(mixing._row_hash(df).alias("h")).distinct().count() == 3
    assert mixing.mixed(df).columns == df.columns


def test_mixed_keeps_columns_of_any_name(spark):
    df = documents(spark, 200).withColumns({c: F.lit(c) for c in ("_doc_id", "size", "copies", "words", "row", "_nth")})
    got = mixing.mixed(df)
    assert got.columns == df.columns and got.where("copies <> 'copies' or row <> 'row'").count() == 0 and got.count() > 0
    assert mixing.mixed(df.where("false")).count() == 0


def test_very_long_texts_are_sized_whole(spark):
    df = spark.createDataFrame([(1, "word " * 700_000, "a"), (2, "word " * 300_000, "a"), (3, "w", "b")], "doc_id long, text string, source string")
    assert {r["doc_id"]: r["size"] for r in mixing.mix(df).collect()} == {1: 700_000, 2: 300_000, 3: 1}


def test_the_flight_keeps_the_sums():
    rng = np.random.default_rng(3)
    size, p = rng.integers(1, 100, 500), rng.uniform(0.05, 0.95, 500)
    flight, done = mixing.Flight(), {}
    for i in range(500):
        done |= dict(flight.add(i, float(size[i]), float(p[i]), rng.random()))
    left = {r: q for r, _, q in flight.open}
    chosen = np.array([left.get(i, done.get(i)) for i in range(500)], float)
    assert chosen.sum() == pytest.approx(p.sum()) and chosen @ size == pytest.approx(p @ size)
    assert len(left) <= 2


def test_inclusion_follows_the_probabilities(spark):
    units = spark.createDataFrame([(i, "s", i % 5 + 1, 0.3) for i in range(40)], "unit long, stratum string, size long, p double")
    hits = sum(mixing.cube_sample(units, "stratum", F.col("size"), ["unit"], seed=s).agg(F.sum("chosen")).first()[0] for s in range(3))
    assert 34 <= hits <= 38
