import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loopweave.llm import embeddings, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(rows):
    n = len(rows)
    links, group = [0] * n, list(range(n))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    def good(v):
        return v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v)

    for i in range(n):
        for j in range(i):
            (a, x, p), (b, y, q) = rows[i], rows[j]
            if None in (a, b, p, q) or p != q or not good(x) or not good(y) or len(x) != len(y):
                continue
            x, y = np.array(x, float), np.array(y, float)
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                links[i] += 1
                links[j] += 1
                group[find(i)] = find(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d)) if d is not None else least.get(find(i))
    return sorted(((d, links[i], least[find(i)], d == least[find(i)]) for i, (d, _, _) in enumerate(rows)), key=str)


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 24))
    rows = []
    for i in range(700):
        v = base[rng.integers(60)] + rng.normal(scale=rng.choice([0.0, 0.1, 0.3]), size=24)
        rows.append((i, [float(c) for c in v], int(rng.integers(3))))
    odd = [None, [], [0.0] * 24, [1.0, None] + [0.0] * 22, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [1.0, 2.0]]
    rows += [(1000 + i, v, 1) for i, v in enumerate(odd)] + [(2000, rows[5][1], None), (None, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2]), (3000, [1.0, 2.0], 1), (3001, [c * 1e200 for c in rows[5][1]], rows[5][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, cid string")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df).collect()), key=str)
    assert got == brute(rows[:-1] + [(3001, rows[5][1], rows[5][2])])


def test_large_bucket_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 512)
    rng = np.random.default_rng(1)
    v = rng.normal(size=16)
    rows = [(i, [float(c) for c in v + rng.normal(scale=0.02, size=16)], 1) for i in range(1300)]
    r = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).agg(F.min("n_links"), F.max("component_id"), F.count("*")).first()
    assert tuple(r) == (1299, 0, 1300)


@pytest.mark.parametrize("hashes", [1, 2, 3])
def test_recall_near_the_threshold(spark, hashes):
    rng = np.random.default_rng(4)
    n = 400 // hashes**2
    base = rng.normal(size=(n, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    off = rng.normal(size=base.shape)
    off -= (off * base).sum(1)[:, None] * base
    off /= np.linalg.norm(off, axis=1)[:, None]
    c = rng.uniform(0.931, 0.95, n)[:, None]
    rows = [(i, [float(v) for v in x], 1) for i, x in enumerate(np.r_[base, c * base + np.sqrt(1 - c * c) * off])]
    found = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), hashes=hashes).agg(F.sum("n_links")).first()[0]
    assert 0.95 * 2 * n <= found <= 2 * n


def test_larger_corpora_join_hashes():
    assert embeddings.plan(50, 128) == (1, 6) and embeddings.plan(8000, 128)[0] == 1 and embeddings.plan(10**6, 128)[0] == 2
    codes = embeddings.codes_of(np.random.default_rng(0).normal(size=(5, 64)), 2, 3)
    assert codes.shape == (5, 3, 4)


def test_empty_tables(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_words_make_the_ids_of_the_whole():
    whole = Tokenizer.from_file(PATH)
    rng = random.Random(1)
    letters = "aAbBéÉßŒ中文١²½Ⅷ'’\"“”….,;:!?*$%&#|)]}>-–_<|end́̀   \t\n\x0b\x0c\r\x1c\x85🙂İıſK가ᄀ"
    model = packing.WordTokenizer(PATH)
    special = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", " "]
    for k in range(3000):
        text = "".join(rng.choice([*letters, *special] if k % 3 == 0 else letters) for _ in range(rng.randrange(0, 40)))
        ids = np.frombuffer(b"".join(next(packing.token_ids([text.encode()], model))), "<u4").tolist()
        assert ids == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["river", "Mill,", "été", "qwrt"]) for _ in range(rng.choice([0, 3, 400, 3000, 9000]))) for _ in range(150)]
    rows = [*enumerate(texts), (900, None), (None, "no id"), (3, texts[3]), (901, "x" * 5000), (903, "in <|endoftext|>a<|startoftext|>.<|EndOfText|> word"), (902, "long " * 400_000)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, piece int").repartition(5)
    got = [r.asDict() for r in packing.pack_documents(df, PATH).collect()]
    whole = Tokenizer.from_file(PATH)
    want = []
    for d, t in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(d, i // 4096, i, len(ids[i : i + 4096]), zlib.crc32(np.array(ids[i : i + 4096], "<u4").tobytes())) for i in range(0, len(ids), 4096)]
    cells = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted((tuple(r[c] for c in cells) for r in got), key=str) == sorted(want, key=str)
    bins: dict = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(bins) <= 1.03 * sum(r["length"] for r in got) / 4096 + 2


def test_rounds_of_groups(spark):
    rng = random.Random(5)
    rows = [(i, 0, 0, rng.randrange(1, 101), i) for i in range(3000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(pieces, 100, most=16, group=200)
    r = got.agg(F.count("*"), F.count_distinct("sequence_id"), F.sum("length"), F.count_distinct("doc_id")).first()
    # A plain best fit of one stream with as many open bins; the rounds may cost three in a hundred more.
    free, plain = [], 0
    for _, _, _, size, _ in rows:
        fits = [f for f in free if f >= size]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - size)
        else:
            plain += 1
            if len(free) == 16:
                free.remove(min(free))
            free.append(100 - size)
    assert r[0] == r[3] == 3000 and r[1] <= 1.03 * plain
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m")).where("n <> m or n > 100").count() == 0


def test_other_kinds_of_ids(spark):
    for kind, ids in (("int", [1, None]), ("string", ["a", None]), ("smallint", [3, 4])):
        got = packing.pack_documents(spark.createDataFrame([(i, "some words") for i in ids], f"doc_id {kind}, text string"), PATH)
        assert got.schema["doc_id"].dataType.simpleString() == kind and {r["doc_id"] for r in got.collect()} == set(ids)


def test_best_fit_and_closing():
    bins = packing.Bins(10, 2)
    assert bins.put(6, "a") == [] and bins.put(7, "b") == []
    assert bins.put(3, "c") == [["b", "c"]]
    assert bins.put(8, "d") == [] and bins.put(9, "e") == [["d"]]
    assert bins.close() == [["e"], ["a"]]


def test_capitals_of_all_alphabets_make_the_ids_of_the_whole():
    plain, model, rng = Tokenizer.from_file(PATH), packing.WordTokenizer(PATH), random.Random(9)
    capitals = [c for c in map(chr, range(0x80, 0x2FFFF)) if c.isalpha() and c != c.lower()]
    words = ["ΟΔΟΣ", "ΣΑΣ.", "İSTANBUL", "Σ", "ΑΣ'", "ẞ"] + ["".join(rng.choices(capitals + list("aσß.,"), k=rng.randint(1, 8))) for _ in range(5000)]
    known = model.learn({w.encode() for w in words})
    for w in words:
        assert np.frombuffer(known[w.encode()], "<u4").tolist() == plain.encode(w, add_special_tokens=False).ids, w
