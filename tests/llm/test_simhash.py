import random

import pytest
import xxhash

from loopweave.llm import simhash
from loopweave.llm.components import connected_components
from loopweave.llm.words import word_blocks


def plain_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, k=4, bits=4):
    prints = [plain_fingerprint(t, k) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                group[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{p:016x}", least.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints))), key=str)


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 40, 300]))] for _ in range(n // 4)]
    out = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2])):
            if words:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append((i, rng.choice([" ", "\n", "\t \x0b"]).join(words)))
    return out


def test_equals_brute_force(spark):
    rows = [*texts(3, 120), (500, None), (501, ""), (502, "\x1cone"), (None, "A b C d E"), (7, "repeated row with id seven"), (7, "repeated row with id seven")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, fp string, key string")
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.keep_one(df).columns == ["doc_id", "text"]


def test_dense_family_of_fingerprints(spark):
    rng = random.Random(1)
    base = rng.getrandbits(63)
    values = sorted({base ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(0, 7))) for _ in range(150)} | {rng.getrandbits(63) for _ in range(50)})
    roots = {r["fp"]: r["root"] for r in simhash.link_components(spark.createDataFrame([(v,) for v in values], "fp long")).collect()}
    group = {v: v for v in values}

    def find(v):
        while group[v] != v:
            v = group[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                group[y] = x
    assert {(a, b) for a in values for b in values if find(a) == find(b)} == {(a, b) for a in values for b in values if roots[a] == roots[b]}


def test_any_four_positions_hold_a_triple():
    from itertools import combinations

    assert len(simhash.TRIPLES) == 20
    assert all(any(set(t) <= set(four) for t in simhash.TRIPLES) for four in combinations(range(8), 4))


def test_blocks_join_up_to_the_whole():
    text = b" ".join(b"word%d" % (i % 977) for i in range(90_000))
    assert [w for block in word_blocks(text) for w in block] == text.split()
    assert simhash.fingerprint(text, 4) % 2**64 == plain_fingerprint(text.decode(), 4)


@pytest.mark.parametrize("links", [[], [(1, 2), (2, 3), (5, 4), (9, 9), (None, 3)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)]])
def test_components(spark, links):
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    if not links:
        assert got == {}
    elif links[0] == (1, 2):
        assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    else:
        assert set(got.values()) == {0}


def test_no_join_is_built_in_the_driver(spark):
    rows = [(i, t) for i, (_, t) in enumerate(texts(5, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for out in (simhash.near_duplicates(docs), simhash.link_components(simhash.fingerprints(docs)), connected_components(spark.createDataFrame([(1, 2)], "a long, b long"))):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan
