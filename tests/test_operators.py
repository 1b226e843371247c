import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loopweave.kernels import trees as kernel
from loopweave.operators import agreement, alignment, kmers, matrix, orfs, randomised, stats, tracks, trees, windows


def track(spark, labels):
    return spark.createDataFrame([("t", i * 10, v) for i, v in enumerate(labels)], "name string, start int, label int")


@pytest.mark.parametrize(
    "labels, circular, switches, boundaries, dominant",
    [([1, 1, 2, 2, 1], True, 2, 5, 1), ([1, 1, 2, 2, 1], False, 2, 4, 1), ([1, 2], True, 2, 2, 1), ([2, 2, 1, 1], True, 2, 4, 1), ([3], True, 0, 0, 3), ([4, 4, 4, 4], True, 0, 4, 4)],
)
def test_mosaic_summary(spark, labels, circular, switches, boundaries, dominant):
    r = tracks.mosaic_summary(track(spark, labels), circular).first()
    assert (r["switches"], r["boundaries"], r["dominant_label"]) == (switches, boundaries, dominant)


def test_switches_dont_depend_on_the_origin(spark):
    rng = random.Random(5)
    labels = [rng.randrange(3) for _ in range(30)]
    found = {tracks.mosaic_summary(track(spark, labels[k:] + labels[:k])).first()["switches"] for k in (0, 7, 19)}
    assert len(found) == 1


def brute_switchpoints(labels, least, circular):
    n = len(labels)
    if n <= 1 or len(set(labels)) <= 1:
        return []
    off = next((i for i in range(n) if labels[i] != labels[i - 1]), 0) if circular else 0
    order = [(off + i) % n for i in range(n)]
    runs = []
    for i in order:
        if runs and labels[runs[-1][-1]] == labels[i]:
            runs[-1].append(i)
        else:
            runs.append([i])
    out = []
    for r in range(len(runs) if circular else len(runs) - 1):
        a, b = runs[r], runs[(r + 1) % len(runs)]
        if len(a) >= least and len(b) >= least:
            out.append((b[0] * 10, labels[a[0]], labels[b[0]], len(a), len(b), b[0]))
    return sorted(out)


@pytest.mark.parametrize("circular", [True, False])
def test_switchpoints(spark, circular):
    rng = random.Random(7)
    cases = {f"c{k}": [rng.randrange(3) for _ in range(rng.randrange(1, 14))] for k in range(60)}
    rows = spark.createDataFrame([(k, i * 10, v) for k, ls in cases.items() for i, v in enumerate(ls)], "name string, start int, label int")
    for least in (1, 2):
        got: dict[str, list] = {}
        for r in tracks.switchpoints(rows, least, circular).collect():
            got.setdefault(r["name"], []).append((r["pos0"], r["prev_label"], r["new_label"], r["prev_run_windows"], r["new_run_windows"], r["new_run_start_window_index"]))
        for k, ls in cases.items():
            assert sorted(got.get(k, [])) == brute_switchpoints(ls, least, circular), (k, ls)


def test_histogram_edges(spark):
    points = spark.createDataFrame([("a", p) for p in (0, 10, 99, 100)], "name string, pos0 int")
    lengths = spark.createDataFrame([("a", 100)], "name string, genome_len int")
    got = {r["bin"]: r["n"] for r in tracks.position_histogram(points, lengths, 10).collect()}
    assert got == {0: 1, 1: 1, **dict.fromkeys(range(2, 9), 0), 9: 2}


def scan(s, starts, least, circular, nested):
    n, text, out = len(s), s + s if circular else s, []
    for frame in range(3):
        i = frame
        while i + 3 <= n:
            hop = 3
            if text[i : i + 3] in starts:
                j = i + 3
                while j + 3 <= len(text) and j - i <= n:
                    if text[j : j + 3] in ("TAA", "TAG", "TGA"):
                        if (j + 3 - i) // 3 - 1 >= least:
                            out.append((i, j + 3 - i))
                        hop = 3 if nested else j + 3 - i
                        break
                    j += 3
            i += hop
    return sorted(out)


@pytest.mark.parametrize("circular", [True, False])
@pytest.mark.parametrize("nested", [True, False])
def test_orfs_equal_a_scan(spark, circular, nested):
    rng = random.Random(11)
    seqs = {f"s{k}": "".join(rng.choice("ATG" if k % 2 else "ACGT") for _ in range(rng.randrange(0, 90))) for k in range(60)}
    df = spark.createDataFrame(list(seqs.items()), "name string, seq string")
    got: dict = {}
    for r in orfs.predict_orfs(df, 2, circular=circular, nested=nested).collect():
        got.setdefault((r["name"], r["strand"]), []).append((r["scan_start"], r["nt_len"]))
    flip = str.maketrans("ACGT", "TGCA")
    for k, s in seqs.items():
        assert sorted(got.get((k, "+"), [])) == scan(s, ("ATG",), 2, circular, nested)
        assert sorted(got.get((k, "-"), [])) == scan(s.translate(flip)[::-1], ("ATG",), 2, circular, nested)


def test_extracted_orfs_have_the_length_they_say(spark):
    df = spark.createDataFrame([("a", "CCATGAAATTTTAGGG"), ("b", "TTTTAGGGCCATGAAA"), ("none", "CCCC"), ("empty", "")], "name string, seq string")
    found = orfs.extract_orfs(df, orfs.predict_orfs(df, 1)).collect()
    assert found and all(len(r["nt_seq"]) == r["nt_len"] and r["nt_seq"].startswith("ATG") and len(r["aa_seq"]) == r["aa_len"] for r in found)
    assert any(r["wrap"] for r in found)
    assert orfs.orf_summary(orfs.predict_orfs(df.where("name = 'none'"), 1)).first()["n_orfs"] == 0


def test_kmers_and_distances(spark):
    df = spark.createDataFrame([("x", "ACGTNACGT"), ("y", "ACGT"), ("e", ""), ("s", "ACG"), ("n", "NNNN")], "name string, seq string")
    counts = kmers.kmer_counts(df, 4)
    assert {(r["name"], r["kmer"], r["cnt"]) for r in counts.collect()} == {("x", "ACGT", 2), ("y", "ACGT", 1)}
    dist = {(r["a"], r["b"]): r["dist"] for r in kmers.cosine_distances(df.select("name"), counts).collect()}
    assert dist["x", "y"] == pytest.approx(0) and dist["e", "x"] is None and len(dist) == 10
    two = kmers.kmer_counts(spark.createDataFrame([("p", "AAAA"), ("q", "CCCC"), ("r", "AAAA")], "name string, seq string"), 4)
    js = {(r["a"], r["b"]): r["dist"] for r in kmers.jensen_shannon(two.select("name"), two).collect()}
    assert js["p", "q"] == pytest.approx(1) and js["p", "r"] == pytest.approx(0)


def test_windows(spark):
    df = spark.createDataFrame([("a", "ACGTACGTAC")], "name string, seq string")
    rows = windows.sliding_windows(df, 4, 4).collect()
    assert [(r["start"], r["end"], r["end_mod"], r["wrap"], r["fragment"]) for r in rows] == [(0, 4, 4, False, "ACGT"), (4, 8, 8, False, "ACGT"), (8, 12, 2, True, "ACAC")]
    assert windows.sliding_windows(df, 25, 5, circular=False).count() == 1


def test_statistics(spark):
    df = spark.createDataFrame([("g", v) for v in (1.0, 2.5, 7.0, 9.0, 20.0)] + [("h", 1.0), ("g", float("nan"))], "k string, v double")
    r = stats.tail_metrics(df, "k", "v").collect()
    assert len(r) == 1 and r[0]["p05"] == pytest.approx(1.3)
    assert stats.group_stats(df, "k", "v").where("k = 'g'").first()["n_rows"] == 6
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert stats.spearman(flat, "x", "y").first()["rho"] is None


def test_agreement(spark):
    table = lambda pairs: agreement.contingency(spark.createDataFrame(pairs, "x int, y int"), "x", "y")
    same = [(i % 3, i % 3) for i in range(12)]
    swapped = [(i % 3, (i + 1) % 3) for i in range(12)]
    for pairs in (same, swapped):
        assert agreement.adjusted_rand(table(pairs)).first()["ari"] == pytest.approx(1)
        assert agreement.normalized_mutual_information(table(pairs)).first()["nmi"] == pytest.approx(1)
    assert agreement.adjusted_rand(table([(0, 0)] * 4)).first()["ari"] == 1
    df = spark.createDataFrame([([1, 2], [2, 3]), ([], [])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(F.round(agreement.jaccard(F.col("a"), F.col("b")), 6)).collect()] == [round(1 / 3, 6), 1.0]


def test_incomplete_matrices(spark):
    rows = [(a, b, None if "d" in (a, b) else 0.5) for a in "abcd" for b in "abcd" if a != b]
    m = spark.createDataFrame(rows, "a string, b string, dist double")
    assert {r["a"] for r in matrix.drop_incomplete(m).collect()} == set("abc")
    assert matrix.drop_incomplete(m, compat=True).count() == 0
    asym = spark.createDataFrame([("a", "b", 0.2), ("b", "a", 0.4)], "a string, b string, dist double")
    for how, value in (("average", 0.3), ("upper", 0.2), ("lower", 0.4)):
        assert {round(r["dist"], 6) for r in matrix.symmetrize(asym, how).collect()} == {value}


def test_alignment(spark):
    df = spark.createDataFrame([("a", "AC-D"), ("b", "AC-E"), ("c", "----")], "name string, seq string")
    d = {(r["a"], r["b"]): r["dist"] for r in alignment.identity_distance(df).collect()}
    assert d["a", "b"] == pytest.approx(1 / 3) and d["a", "c"] is None
    assert {r["name"]: r["seq"] for r in alignment.trim_gaps(df, 0.5).collect()} == {"a": "ACD", "b": "ACE", "c": "---"}


def additive():
    edges = {("a", "x"): 2, ("b", "x"): 3, ("x", "y"): 4, ("c", "y"): 1, ("y", "z"): 2, ("d", "z"): 5, ("e", "z"): 3}
    near: dict = {}
    for (p, q), w in edges.items():
        near.setdefault(p, []).append((q, w))
        near.setdefault(q, []).append((p, w))

    def far(s):
        seen, todo = {s: 0}, [s]
        while todo:
            p = todo.pop()
            for q, w in near[p]:
                if q not in seen:
                    seen[q] = seen[p] + w
                    todo.append(q)
        return seen

    return np.array([[far(p)[q] for q in "abcde"] for p in "abcde"], float)


def test_neighbour_joining_recovers_an_additive_tree(spark):
    d = additive()
    assert {tuple(sorted(s)) for s in kernel.splits(kernel.neighbour_joining(d), 5)} == {(0, 1), (3, 4)}
    rows = [("abcde"[i], "abcde"[j], float(d[i, j])) for i in range(5) for j in range(i + 1, 5)]
    edges = trees.neighbour_joining(spark.createDataFrame(rows, "a string, b string, dist double")).collect()
    assert sum(r["length"] for r in edges) == pytest.approx(20)


def test_kernels():
    d = additive()
    x = np.random.default_rng(1).normal(size=(12, 2))
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    y = kernel.smacof(far, eps=1e-9)
    assert np.abs(np.sqrt(((y[:, None] - y[None]) ** 2).sum(axis=2)) - far).max() < 0.05
    assert len(set(kernel.linkage(d, 2))) == 2 and kernel.linkage(d, 5).tolist() == [0, 1, 2, 3, 4]
    assert kernel.assignment(np.array([[1, 9, 0], [8, 7, 0]])) == [(0, 1), (1, 0)]
    with pytest.raises(ValueError):
        kernel.linkage(np.array([[0, np.nan], [np.nan, 0]]), 1)


def test_bootstrap_and_permutations(spark):
    rows = spark.createDataFrame([("a", "AAAACCCC"), ("b", "AAAACCCD"), ("c", "DDDDEEEE"), ("d", "DDDDEEEF")], "name string, seq string")
    support = {r["split"]: r["support"] for r in trees.bootstrap_support(rows, 20).collect()}
    assert support == {"a|b": 1.0} or support == {"c|d": 1.0}
    df = spark.createDataFrame([(i < 20, float(i)) for i in range(40)], "f boolean, v double")
    r = randomised.two_sample(df, "f", "v", 200).first()
    assert r["observed"] == -20 and r["p"] == pytest.approx(1 / 201)
    assert randomised.two_sample(df.limit(1), "f", "v", 10).first()["p"] is None
