import random

from loopweave.llm import components, shingles as sets, simhash


def shingles(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def kept_by_brute_force(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8:
                group[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted(least.values())


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(2000)]
    common = [rng.choice(vocabulary) for _ in range(60)]
    rows, bands = [], {0.8: 0, 0.85: 0, 0.9: 0, 0.95: 0}
    for b in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 9, 30, 100, 400]))] + (common if b % 3 == 0 else [])
        first = shingles(" ".join(base))
        rows.append((" ".join(base)))
        for _ in range(4):
            words = list(base)
            for _ in range(rng.randrange(1, max(2, len(words) // 35))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append(" ".join(words))
            s = similarity(first, shingles(rows[-1]))
            for low in bands:
                bands[low] += low <= s < low + 0.05
    rows += ["", None, "one two", "ONE two", "a b c d e f g h", "a b c d e f g h i"]
    rows = list(enumerate(rows))
    assert all(n >= 10 for n in bands.values())
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string")
    got = [r["doc_id"] for r in simhash.keep_one(docs).collect()]
    assert got.count(None) == 1
    assert sorted(d for d in got if d is not None) == kept_by_brute_force(rows)


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark):
    one, near = " ".join(f"a{i}" for i in range(60)), " ".join([*(f"a{i}" for i in range(59)), "other"])
    rows = [(3, one), (5, one), (5, "like nothing else here at all"), (3, near), (3, one), (8, None), (8, "not null")]
    got = sorted(map(tuple, simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    kept = [t for d, t in got if d == 3]
    assert (5, "like nothing else here at all") in got and (5, one) not in got
    assert kept in ([one, one], [near])  # one text of the group, with rows that repeat it
    assert [r for r in got if r[0] == 8] == [(8, "not null"), (8, None)] or len([r for r in got if r[0] == 8]) == 2


def test_simhashes_come_first_and_are_checked(spark, monkeypatch):
    words = [f"v{i}" for i in range(90)]
    near = " ".join([*words[:-1], "other"])
    rows = [(1, " ".join(words)), (2, near), (3, "quite another text than these"), (4, "THIS is quite another text"), (5, None)]
    seen, whole = [], simhash.link_components

    def link(prints, max_bits=4):
        seen.append(sorted(r["fp"] for r in prints.collect()))
        # All are called alike, which the exact check must set right.
        return whole(prints, max_bits).selectExpr("fp", "0L AS root") if len(seen) == 2 else whole(prints, max_bits)

    monkeypatch.setattr(simhash, "link_components", link)
    for _ in range(2):
        got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted(r["doc_id"] for r in got.collect()) == [1, 3, 4, 5]
    assert seen == [sorted(simhash.fingerprint((t or "").encode(), 4) for _, t in rows)] * 2


def test_plans_of_a_job_are_few(spark, monkeypatch):
    """The driver keeps what a session has run, so its memory grows with the number of plans."""
    rng = random.Random(3)
    rows = []
    for b in range(40):
        words = [f"w{b}_{i}" for i in range(80)]
        rows.append(" ".join(words))
        for _ in range(5):
            words[rng.randrange(80)] = "other"
            rows.append(" ".join(words))
    written, whole = [], components.materialize

    def count(df, label):
        written.append(label)
        return whole(df, label)

    for module in (components, sets, simhash):
        monkeypatch.setattr(module, "materialize", count)
    pairs = spark.createDataFrame([(i, i % 3) for i in range(3, 90)], "a long, b long")
    got = dict(map(tuple, components.connected_components(pairs).collect()))
    assert got == {i: i % 3 for i in range(90)}
    assert len(written) == 3  # the links and one round's halves; none to see that nothing changes
    written.clear()
    got = simhash.keep_one(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == kept_by_brute_force(list(enumerate(rows)))
    assert sum(x in ("close", "rooted") for x in written) <= 4  # SimHashes' candidates, hubs and the rest


def test_components_equal_brute_force(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(1000, 1040)]
    some = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + chain + [(7, 7), (None, 3), (4, None)] + [(500, i) for i in range(400, 460)]
    group = {}

    def find(i):
        while group.setdefault(i, i) != i:
            i = group[i]
        return i

    for a, b in some:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            group[y] = x
    got = [tuple(r) for r in components.connected_components(spark.createDataFrame(some, "a long, b long")).collect()]
    assert sorted(got) == sorted((i, find(i)) for i in group)
