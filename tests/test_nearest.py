import random

import numpy as np

from loopweave.operators import kmers


def test_nearest_reference_is_exact(spark):
    rng = random.Random(4)
    seq = lambda n: "".join(rng.choices("ACGT", k=n))
    panel = [("c", "CCCCCC")] + [(f"p{i}{j}", s) for i, s in enumerate(seq(300) for _ in range(3)) for j in range(9)]  # with copies
    rows = [("none", "AAAA"), ("short", "AC"), *((f"q{i}", seq(rng.randrange(20, 200)) + "AAAA") for i in range(300))]
    frame = lambda x: spark.createDataFrame(x, "name string, seq string")
    count = lambda s: {m: sum(s[i : i + 4] == m for i in range(len(s) - 3)) for m in {s[i : i + 4] for i in range(len(s) - 3)}}
    want, sides = {}, [(n, count(s), np.sqrt(float(sum(c * c for c in count(s).values())))) for n, s in panel]
    for name, s in rows:
        own = count(s)
        norm = np.sqrt(float(sum(c * c for c in own.values())))
        dots = [(sum(c * x.get(m, 0) for m, c in own.items()), norm * length, n) for n, x, length in sides]
        if any(d for d, _, _ in dots):
            dist, hit = min((round(1 - d / both, 12), n) for d, both, n in dots if d)
            want[name] = hit, dist
    assert want.keys() == {r[0] for r in rows} - ({"none", "short"} if not any("AAAA" in s for _, s in panel) else {"short"})
    got = {r["query"]: (r["hit"], r["dist"]) for r in kmers.nearest_reference(frame(rows), frame(panel)).collect()}
    assert got.keys() == want.keys() and all(got[q][0] == want[q][0] and abs(got[q][1] - want[q][1]) < 2e-12 for q in want)
    assert kmers._rounded(np.array([0.5, -1.5, 2.4, 0.0]), 0).tolist() == [1.0, -2.0, 2.0, 0.0]


def test_frames_of_either_strand_are_found_without_a_shuffle(spark):
    from loopweave.operators import orfs

    rows = [("a", "ATGAAACCCTAA"), ("b", "TTACCCGGGCAT"), ("c", ""), ("d", None), (None, "CCATGTAGCC"), ("a", "GGGG"), ("e", "AAATAGGGATG")]
    found = orfs.predict_orfs(spark.createDataFrame(rows, "name string, seq string"), 1)
    got = {(r["name"], r["strand"], r["start0"], r["end0"], r["aa_len"], r["wrap"], r["stop_codon"]) for r in found.collect()}
    assert {("a", "+", 0, 0, 3, False, "TAA"), ("b", "-", 0, 0, 3, False, "TAA"), ("e", "+", 8, 6, 2, True, "TAG")} <= got
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
