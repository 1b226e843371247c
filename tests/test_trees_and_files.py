import gzip
import hashlib
import io
import json
import random
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from loopweave.kernels import trees as kernel
from loopweave.operators import edges as E
from loopweave.operators import forest, landmarks, mantel, trees
from loopweave.sources import flat, genbank, staging

# Data sources


def test_ranges_cut_records_anywhere():
    rng = random.Random(1)
    text = b"junk > no record\n" + b"".join(b">r%d x>y\r\n%s\n" % (i, b"\n".join(b"ACGT"[: rng.randint(0, 4)] for _ in range(rng.randint(0, 5)))) for i in range(40)) + b">last"
    whole = list(flat.records(io.BytesIO(text), 0, None, b">"))
    assert [text[at : at + len(r)] for at, r in whole] == [r for _, r in whole] and len(whole) == 41
    for split in (1, 7, 50, 10_000):
        cut = [x for a in range(0, len(text), split) for x in flat.records(io.BytesIO(text), a, min(len(text), a + split), b">")]
        assert cut == whole
    assert list(flat.records(io.BytesIO(b""), 0, 0, b">")) == []


def test_fasta_source(spark, tmp_path):
    flat.register(spark)
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.fa").write_text(">one first\nac gt\n\nNN-\n>two\n" + "ACGT\n" * 50_000 + "> \nAA\n>one again\nT")
    (tmp_path / "in/sub/b.fasta.gz").write_bytes(gzip.compress(b"\n>three\r\nac\r\n"))
    (tmp_path / "in/_hidden.fa").write_text(">no\nA")
    (tmp_path / "in/c.csv").write_text("a,b")
    (tmp_path / "in/empty.fa").write_text("")
    reader = lambda: spark.read.format("fasta").option("splitBytes", 5000)
    rows = reader().load(f"{tmp_path}/in")
    want = [("one", "one again", "T"), ("one", "one first", "ACGTNN-"), ("three", "three", "AC"), ("two", "two", "ACGT" * 50_000)]
    assert sorted((r["name"], r["header"], r["seq"]) for r in rows.collect()) == want
    assert rows.rdd.getNumPartitions() > 10
    assert [r["rec"] for r in rows.where("name = 'one'").orderBy("rec").collect()] == [0, 250_033]
    assert "EqualTo" not in rows.where("name = 'two'")._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["header"] for r in rows.where("name in ('one', 'none') and length(seq) < 7").collect()) == ["one again"]
    assert reader().option("columns", "name, source_file").load(f"{tmp_path}/in").where(F.col("name").startswith("t")).orderBy("name").select("name").collect() == [("three",), ("two",)]
    assert reader().option("clean", "true").load(f"{tmp_path}/in/a.fa").where("header = 'one first'").first()["seq"] == "ACGTNN"
    (tmp_path / "in/d.fa").write_text("no header")
    with pytest.raises(Exception, match="doesn't start with"):
        reader().load(f"{tmp_path}/in").count()
    assert reader().option("tolerant", "true").load(f"{tmp_path}/in").count() == 4
    with pytest.raises(Exception):
        reader().load(f"{tmp_path}/nowhere").count()


def test_fasta_sink(spark, tmp_path):
    flat.register(spark)
    rows = [(f"s{i}", f"s{i} h", "ACGT" * i, None if i == 3 else f"k/{i % 2}") for i in range(9)]
    df = spark.createDataFrame(rows, "name string, header string, seq string, kind string").repartition(3)
    at = f"{tmp_path}/out"
    for mode, times in (("append", 1), ("append", 2), ("overwrite", 1)):
        df.write.format("fasta").option("width", 10).mode(mode).save(at)
        got = [tuple(r) for r in spark.read.format("fasta").load(at).select("name", "header", "seq").collect()]
        assert sorted(got) == sorted([r[:3] for r in rows] * times)
        manifest = json.loads(Path(f"{at}/_manifest.json").read_text())
        assert sorted(manifest["files"]) == sorted(p.name for p in Path(at).glob("*.fasta")) and manifest["rows"] == 9
        assert not list(Path(at).glob("_attempt-*"))
    df.write.format("fasta").option("partitionBy", "kind").option("compression", "gzip").mode("overwrite").save(at)
    assert {p.parent.name for p in Path(at).rglob("*.gz")} == {"kind=k%2F0", "kind=k%2F1", "kind=__HIVE_DEFAULT_PARTITION__"}
    assert sorted(tuple(r) for r in spark.read.format("fasta").load(at).select("name", "header", "seq").collect()) == sorted(r[:3] for r in rows)
    bad = df.withColumn("seq", F.when(F.col("name") == "s8", F.raise_error(F.lit("stop"))).otherwise(F.col("seq")))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("fasta").mode("overwrite").save(at)
    assert spark.read.format("fasta").load(at).count() == 9  # what was there stays
    with pytest.raises(Exception, match="lack"):
        df.select("name").write.format("fasta").mode("append").save(at)
    df.limit(0).write.format("fasta").mode("append").save(f"{tmp_path}/none")
    assert spark.read.format("fasta").load(f"{tmp_path}/none").count() == 0


def test_genbank_records_come_back():
    row = {
        "id": "X1.2", "name": "X1", "description": "a circle", "organism": "Some thing", "topology": "circular", "accessions": ["X1", "Y2"], "seq": "ACGTN" * 30,
        "features": [{"type": "CDS", "strand": -1, "parts": [{"start": 140, "end": 150}, {"start": 0, "end": 9}], "qualifiers": {"gene": ['a "b"', "c"], "note": ["x/y=1"]}}, {"type": "gene", "strand": 1, "parts": [{"start": 3, "end": 9}], "qualifiers": {}}],
    }
    assert genbank.parse_records(genbank.format_record(row) * 2) == [row, row]
    bare = genbank.parse_records(genbank.format_record({"name": "Z", "seq": ""}))[0]
    assert (bare["name"], bare["seq"], bare["features"]) == ("Z", "", [])


def test_staging_can_be_cut_off_and_repeated(spark, tmp_path):
    records = spark.createDataFrame([("A.1", "acgt", 1), ("A", "TTTT", 0), ("B", "GG", 1), ("C/x", "", 0), ("C/x", "AA", 1)], "name string, seq string, place int")
    wanted = spark.createDataFrame([("A.1",), ("B.2",), ("C/x",), ("A.1",), (None,)], "accession string")
    want = [("A.1", 0, "A.1.fasta", 4), ("B.2", 1, "B.2.fasta", 2), ("C/x", 0, "C_2Fx.fasta", 0)]
    with pytest.raises(FileNotFoundError):
        staging.read_manifest(spark, f"{tmp_path}/s")
    # A run that was cut off: one file is there, another half-written, one under an attempt's name, and no manifest.
    (tmp_path / "s").mkdir()
    (tmp_path / "s/A.1.fasta").write_text(">A.1\nTTTT\n")
    (tmp_path / "s/B.2.fasta").write_text(">B")
    (tmp_path / "s/_attempt-1").write_text("x")
    once = staging.stage(wanted, records, f"{tmp_path}/s").collect()
    assert sorted(once) == sorted(staging.stage(wanted, records, f"{tmp_path}/s").collect())
    got = {r["accession"]: r for r in once}
    assert set(got) == {"A.1", "B.2", "C/x"} and got["B.2"]["sha256"] == hashlib.sha256(b"GG").hexdigest() and got["B.2"]["place"] == 1
    assert got["A.1"]["length"] == 4 and sorted(p.name for p in (tmp_path / "s").glob("*.fasta")) == sorted(w[2] for w in want)
    assert (tmp_path / "s/B.2.fasta").read_text() == ">B.2\nGG\n" and not list((tmp_path / "s").glob("_attempt*"))
    lost = spark.createDataFrame([("B",), ("nowhere",)], "accession string")
    with pytest.raises(ValueError, match="nowhere"):
        staging.stage(lost, records, f"{tmp_path}/t")
    assert [r["path"] for r in staging.stage(lost, records, f"{tmp_path}/t", allow_missing=True).orderBy("accession").collect()] == ["B.fasta", None]


# Trees


def random_tree(rng, n):
    """``(node, parent, name, length)`` of a tree of ``n`` tips by joining random nodes."""
    nodes, rows, fresh = list(range(n)), [], n
    while len(nodes) > 1:
        some = [nodes.pop(rng.randrange(len(nodes))) for _ in range(min(len(nodes), rng.choice([2, 2, 3])))]
        rows += [(x, fresh, f"t{x}" if x < n else None, float(rng.randint(0, 9))) for x in some]
        nodes.append(fresh)
        fresh += 1
    return [*rows, (nodes[0], None, f"t{nodes[0]}" if nodes[0] < n else None, None)]


def frame(spark, tables):
    return spark.createDataFrame([(g, *r) for g, rows in tables.items() for r in rows], "grp int, node int, parent int, name string, length double")


def paths(rows):
    """Distances of all tips, through any parents."""
    near = defaultdict(list)
    for node, parent, _, length in rows:
        if parent is not None:
            near[node].append((parent, length or 0.0))
            near[parent].append((node, length or 0.0))
    out = {}
    names = {node: name for node, _, name, _ in rows if name is not None}
    for a in names:
        todo, seen = [(a, 0.0)], {a}
        while todo:
            x, d = todo.pop()
            if x in names:
                out[names[a], names[x]] = d
            for y, more in near[x]:
                if y not in seen:
                    seen.add(y)
                    todo.append((y, d + more))
    return out


@pytest.fixture(scope="module")
def forest_of_trees():
    rng = random.Random(6)
    return {g: random_tree(rng, n) for g, n in enumerate((1, 2, 3, 5, 9, 17, 30))}


def test_depths_and_splits_equal_brute_force(spark, forest_of_trees):
    df = frame(spark, forest_of_trees)
    got = {(r["grp"], r["node"]): (r["root"], r["dist"], r["hops"]) for r in E.depths(df).collect()}
    named = {(r["grp"], r["node"]): (r["split"], r["size"]) for r in E.split_names(df).collect()}
    for g, rows in forest_of_trees.items():
        parent = {n: (p, length or 0.0) for n, p, _, length in rows}
        under = defaultdict(set)
        tips = {n for n, _, name, _ in rows if name is not None}
        for n in parent:
            x, d, hops = n, 0.0, 0
            while True:
                if n in tips:
                    under[x].add(n)
                if parent[x][0] is None:
                    break
                x, d, hops = parent[x][0], d + parent[x][1], hops + 1
            assert got[g, n] == (x, d, hops)
        by_side = defaultdict(set)
        for n in parent:
            side = frozenset(min(under[n], tips - under[n], key=lambda s: (len(s), sorted(s))))
            split, size = named[g, n]
            assert size == len(side) and (split is None) == (size < 2)
            if split is not None:
                by_side[split].add(side)
        assert all(len(v) == 1 for v in by_side.values()) and len({next(iter(v)) for v in by_side.values()}) == len(by_side)


def test_midpoint_root_keeps_distances_and_halves_the_longest(spark, forest_of_trees):
    df = frame(spark, forest_of_trees).withColumn("support", F.col("node") * 1.0)
    done = E.midpoint_root(df, ("support",))
    rows = defaultdict(list)
    for r in done.collect():
        rows[r["grp"]].append((r["node"], r["parent"], r["name"], r["length"]))
    depth = {(r["grp"], r["node"]): r["dist"] for r in E.depths(done).collect()}
    for g, old in forest_of_trees.items():
        before, after = paths(old), paths(rows[g])
        assert before == after and sum(p is None for _, p, _, _ in rows[g]) == 1
        top = sorted((depth[g, n] for n, _, name, _ in rows[g] if name is not None), reverse=True)
        if len(top) > 1 and max(before.values()) > 0:
            assert top[0] == top[1] == max(before.values()) / 2
            kids = defaultdict(int)
            for _, p, _, _ in rows[g]:
                kids[p] += 1
            assert all(k > 1 for p, k in kids.items() if p is not None)


def test_support_of_many_trees(spark):
    texts = ["((A,B),(C,D),E);", "(((A,B),E),(C,D));", "((A,C),(B,D),E);", "(E,((D,C),(B,A)));"]
    df = E.read_newick(spark.createDataFrame(list(enumerate(texts)), "grp int, tree string"))
    got = {(r["size"], r["trees"], r["support"]) for r in E.split_support(df).collect()}
    assert got == {(2, 3, 0.75), (2, 1, 0.25)} and E.split_support(df).count() == 4
    named = E.annotated(df.where("grp = 0"), E.split_support(df))
    assert sorted(r["support"] for r in named.collect() if r["support"] is not None) == [0.75, 0.75]


def test_newick_comes_back(spark):
    rng = random.Random(2)
    names = ["A", "b c", "it's", "(x)", "e:1", "F_2", "g,h", "[i]"]
    pairs = [(a, b, float(rng.randint(1, 9)) + 10) for i, a in enumerate(names) for b in names[i + 1 :]]
    df = spark.createDataFrame(pairs, "a string, b string, dist double")
    back = E.read_newick(trees.newick(df))
    want = trees.neighbour_joining(df)
    ours = [(r["node"], r["parent"], r["name"], r["length"]) for r in back.collect()]
    theirs = [(r["node"], r["parent"], None if r["node"].startswith("#") else r["node"], r["length"]) for r in want.collect()]
    a, b = paths(ours), paths(theirs)
    assert set(n for _, _, n, _ in ours if n) == set(names)
    assert all(abs(a[k] - b[k]) < 1e-4 for k in b if k in a) and len(a) == len(names) ** 2
    for text in ("((A,B);", "(A));", ")("):
        with pytest.raises(Exception, match="match"):
            E.read_newick(spark.createDataFrame([(1, text)], "grp int, tree string")).collect()
    assert E.read_newick(spark.createDataFrame([(1, None), (2, "")], "grp int, tree string")).count() == 0


def test_a_tree_of_many_tips(spark):
    n = 20_000
    text = "(" * (n - 1) + "t0" + "".join(f":1,t{i}:1)" for i in range(1, n)) + ";"
    star = "(" + ",".join(f"s{i}:2" for i in range(n)) + ");"
    df = E.read_newick(spark.createDataFrame([(1, text), (2, star)], "grp int, tree string"))
    found = {r["grp"]: (r["n"], r["roots"]) for r in df.groupBy("grp").agg(F.count("*").alias("n"), F.count_if(F.col("parent").isNull()).alias("roots")).collect()}
    assert found == {1: (2 * n - 1, 1), 2: (n + 1, 1)}
    assert {r["grp"]: r["most"] for r in E.depths(df).groupBy("grp").agg(F.max("hops").alias("most")).collect()} == {1: n - 1, 2: 1}


def test_edges_that_are_no_trees(spark):
    for rows in ([(0, 1, "a", 1.0), (1, 0, "b", 1.0)], [(0, 5, "a", 1.0)]):
        with pytest.raises(Exception, match="round|no node"):
            E.depths(frame(spark, {1: rows})).collect()


# Forests


@pytest.mark.parametrize("seed", range(2))
def test_single_linkage_equals_kruskal(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randint(1, 40), rng.randint(1, 40), float(rng.randint(1, 12))) for _ in range(70)] + [(50, 50, 0.0), (51, None, 1.0), (None, 52, 1.0), (3, 53, None), (54, 4, float("nan"))]
    names = sorted({x for a, b, _ in rows if a is not None and b is not None for x in (a, b)})

    def joined(links):
        top = {x: x for x in names}

        def find(x):
            while top[x] != x:
                x = top[x]
            return x

        for _, a, b in links:
            top[max(find(a), find(b))] = min(find(a), find(b))
        return {x: find(x) for x in names}

    links, tree = sorted((d, min(a, b), max(a, b)) for a, b, d in rows if None not in (a, b, d) and a != b and d == d), []
    for link in links:
        before = joined(tree)
        if before[link[1]] != before[link[2]]:
            tree.append(link)
    comps = len(set(joined(tree).values()))
    df = spark.createDataFrame(rows, "a int, b int, dist double")
    edges, found = forest.spanning_forest(df)
    assert sorted((r["dist"], r["a"], r["b"]) for r in edges.collect()) == tree
    assert dict(found.collect()) == joined(tree)
    for k in (1, comps + 5):
        assert dict(forest.single_linkage(df, k=k).collect()) == joined(tree[: len(tree) - max(0, k - comps)])
    assert dict(forest.single_linkage(df, height=4).collect()) == joined([x for x in tree if x[0] <= 4])


def test_forest_of_nothing(spark):
    df = spark.createDataFrame([], "a string, b string, dist double")
    assert forest.single_linkage(df, k=3).collect() == [] and forest.single_linkage(df, height=1).collect() == []
    with pytest.raises(ValueError):
        forest.single_linkage(df)


# Scaling and Mantel's test


@pytest.mark.parametrize("cosine", [False, True])
def test_a_plane_comes_back(spark, cosine):
    rng = np.random.default_rng(4)
    axes = np.linalg.qr(rng.normal(size=(7, 2)))[0]
    x = rng.normal(size=(300, 2)) @ axes.T if not cosine else rng.normal(size=(300, 7))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (301, [float("nan")] * 7), (302, [])]
    df = spark.createDataFrame(rows, "name int, vec array<double>").repartition(4)
    got = {r["name"]: (r["x1"], r["x2"]) for r in landmarks.landmark_scaling(df, cosine=cosine, landmarks=40).collect()}
    assert [got[i] for i in (300, 301, 302)] == [(None, None)] * 3
    y = np.array([got[i] for i in range(300)])
    if cosine:
        assert np.isfinite(y).all()
    else:
        apart = lambda v: np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
        assert np.abs(apart(x) - apart(y)).max() < 1e-6
    assert landmarks.landmark_scaling(df.limit(0)).collect() == []
    with pytest.raises(Exception, match="doesn't have"):
        landmarks.landmark_scaling(df.where("name < 9").union(spark.createDataFrame([(400, [1.0])], df.schema))).collect()


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 40, 1000])
def test_relabelling_is_a_permutation(n):
    seen = {tuple(mantel.relabelled(np.arange(n), n, 0, r)) for r in range(50)}
    assert all(sorted(p) == list(range(n)) for p in seen) and (n < 4 or len(seen) > 10)
    assert mantel.relabelled(np.arange(n)[::-1], n, 0, 7).tolist() == mantel.relabelled(np.arange(n), n, 0, 7)[::-1].tolist()


@pytest.mark.parametrize("rank", [True, False])
def test_mantel_equals_brute_force(spark, rank):
    rng, n, times = random.Random(7), 14, 200
    names = [f"n{i:02d}" for i in range(n)]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    x = {p: float(rng.randint(1, 20)) for p in pairs}
    y = {p: x[p] + rng.randint(0, 25) for p in pairs}
    one = spark.createDataFrame([(*p, v) for p, v in x.items()] + [("n00", "n00", 0.0), ("n00", "zz", None)], "a string, b string, dist double")
    two = spark.createDataFrame([(b, a, v) for (a, b), v in y.items()], "a string, b string, dist double")
    got = mantel.mantel_pairs(one, two, times, rank, seed=3).first()

    def ranks(d):
        v = sorted(d.values())
        return {p: (v.index(c) + 1 + v.index(c) + v.count(c)) / 2 for p, c in d.items()} if rank else d

    rx, ry = ranks(x), ranks(y)
    a = np.array([rx[p] for p in pairs]) - np.mean(list(rx.values()))

    def value(order):
        b = np.array([ry[tuple(sorted((names[order[names.index(p[0])]], names[order[names.index(p[1])]])))] for p in pairs]) - np.mean(list(ry.values()))
        return float(a @ b / np.sqrt((a @ a) * (b @ b)))

    observed = value(range(n))
    null = []
    for r in range(times):  # the second table's labels move, so the first meets it under the inverse
        to = mantel.relabelled(np.arange(n), n, 3, r)
        null.append(value(np.argsort(to)))
    k = sum(abs(v) >= abs(observed) - 1e-12 for v in null)
    assert abs(got["observed"] - observed) < 1e-9 and got["p"] == (k + 1) / (times + 1) and got["pairs"] == len(pairs)
    assert abs(got["null_mean"] - np.mean(null)) < 1e-9 and abs(got["null_sd"] - np.std(null, ddof=1)) < 1e-9
    assert mantel.mantel_pairs(one.limit(0), two, 10).first()["p"] is None


def test_split_kernel_agrees_with_split_names(spark):
    rng = random.Random(11)
    names = [f"t{i}" for i in range(9)]
    d = np.zeros((9, 9))
    for i in range(9):
        for j in range(i):
            d[i, j] = d[j, i] = rng.randint(5, 20)
    tree = kernel.neighbour_joining(d)
    rows = [(int(c), int(p), names[c] if c < 9 else None, float(length)) for c, p, length in tree]
    root = ({p for _, p, _ in tree} - {c for c, _, _ in tree}).pop()
    got = E.split_names(frame(spark, {1: [*rows, (root, None, names[root] if root < 9 else None, None)]}))
    assert got.where("split is not null").select("split").distinct().count() == len(kernel.splits(tree, 9))


def _plans(monkeypatch, module):
    """The plans of all that the module writes from now on, as first made."""
    plans = []
    monkeypatch.setattr(module, "written", lambda df, label, real=module.written: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, label))
    return plans


def test_joins_by_node_send_nothing_to_the_driver(spark, monkeypatch):
    plans = _plans(monkeypatch, E)
    rows = spark.createDataFrame([("t", k, k // 2 if k > 1 else None, f"n{k}", 1.0) for k in range(1, 8)], "grp string, node int, parent int, name string, length double")
    rows = E.written(rows, "rows")
    hops = E.depths(rows)
    E.below(rows, hops, {"n": (F.lit(1).cast("long"), F.sum)})
    assert len(plans) > 4 and not any("BroadcastHashJoin" in x for x in plans)


def test_long_pairs_do_not_enter_the_forest(spark, monkeypatch):
    pairs = spark.createDataFrame([(1, 2, 1.0), (2, 3, 5.0), (4, 4, 0.0), (5, 4, float("nan")), (7, 6, 2.0), (2, 1, 9.0), (8, None, 1.0), (9, 10, None)], "a int, b int, dist double")
    plans = _plans(monkeypatch, forest)
    seen = []
    real = forest.spanning_forest
    monkeypatch.setattr(forest, "spanning_forest", lambda rows: seen.append(rows.where("dist > 2").count()) or real(rows))
    got = {r["name"]: r["cluster"] for r in forest.single_linkage(pairs, height=2.0).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 9: 9, 10: 10}
    assert seen == [0] and not any("BroadcastHashJoin" in x for x in plans)


def test_tree_texts_are_dealt_out_by_their_size(spark, monkeypatch):
    texts = spark.createDataFrame([(f"t{k}", f"((a:1,b{k}:2)x:3,c);") for k in range(20)], "grp string, tree string")
    want = sorted(map(tuple, E.read_newick(texts).collect()), key=str)
    monkeypatch.setattr(E, "TASK_CHARS", 30)
    found = E.read_newick(texts)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect()), key=str) == want and len(want) == 100
