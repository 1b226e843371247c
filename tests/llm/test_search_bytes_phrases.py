import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from loopweave.llm import bytebpe, collocations, search

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, term string, row int, ids string, n int, f int"


def table(spark, rows):
    """Documents with columns whose names clash with those that operators make."""
    return spark.createDataFrame([(*r, None, "x", 1, "y", 2, 3)[:9] if len(r) == 3 else r for r in rows], SCHEMA)


def tokenizer(path=PATH):
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# Ranked search


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k=20):
    counts = [(d, Counter(terms_of(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in counts:
            m = 75 + 25 * c.total() * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms_of(text) if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def test_search_equals_brute_force(spark):
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "É", "é", "x1", "the", "THE", "日本", "a-b", "İ"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30))) if i % 7 else None, "en") for i in range(60)]
    docs += [docs[3], docs[3], (5, "other text of the same id gamma", "en"), (None, "alpha alpha", None), (None, "gamma", None), (99, "", None), (98, "!? \x00", None)]
    docs += [(200, "alpha " * 30 + "rare", "fr"), (201, "the " * 2_000_000 + "gamma", "fr")]
    items = [(1, "The alpha, the ALPHA é!"), (2, None), (3, ""), (4, "nothing here"), (1, "gamma"), (5, "日本 x1 a b rare"), (None, "beta"), (6, "İ")]
    got = search.ranked_search(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute_search([(d, t) for d, t, _ in docs], items)


def test_search_in_blocks_and_empty_tables(spark, monkeypatch):
    docs = [(i, f"w{i % 5} w{i % 3} all", None) for i in range(40)]
    items = [(i, f"w{i % 5} all w1") for i in range(9)]
    frame = spark.createDataFrame(items, "item_id long, text string")
    index = search.build_index(table(spark, docs), buckets=3)
    want = brute_search([(d, t) for d, t, _ in docs], items, 4)
    assert sorted(map(tuple, search.search(index, frame, 4).collect()), key=str) == want
    monkeypatch.setattr(search, "SENT", 100)  # blocks of single items, some of which are then shuffled
    assert sorted(map(tuple, search.search(index, frame, 4).collect()), key=str) == want
    for d, i in (([], items), (docs, []), ([], [])):
        got = search.ranked_search(table(spark, d), spark.createDataFrame(i, "item_id long, text string"))
        assert got.collect() == [] and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_terms_of_long_texts(monkeypatch):
    text = "aé B,c " * 50 + "x" * 40
    want = Counter(x.encode() for x in terms_of(text))
    monkeypatch.setattr(search, "BLOCK", 7)
    assert search.term_counts(text.encode()) == want


# Byte-level BPE


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def test_ids_equal_the_library(name):
    path = public_tokenizers.path(name)
    model, plain, rng = bytebpe.byte_bpe(path), tokenizer(path), random.Random(3)
    tokens = [t.decode("utf-8", "ignore") for t in model.ranks]
    texts = ["".join(rng.choices(tokens, k=rng.randint(1, 12))) for _ in range(3000)]
    texts += ["".join(rng.choices("aab bcn' \n\t  es", k=rng.randint(1, 60))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x80, 0xD800), rng.randrange(0xE000, 0x110000), 32, 97])) for _ in range(20)) for _ in range(2000)]
    texts += ["", " ", "a" * 5001, "ab" * 3000, " " * 999 + "x", "\n" * 77, "é" * 1000, "<|endoftext|>", "    a\x85\x1cb", "ΟΔΟΣ it's IT'S 12\u00b2"]
    for text in texts:
        ids = model.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode_ordinary(text), text
        assert model.decode(ids) == text.encode()


def test_blocks_do_not_change_ids(monkeypatch):
    model, rng = bytebpe.byte_bpe(PATH), random.Random(4)
    texts = ["".join(rng.choices("ab \n\t's1!\u3000", k=200)) for _ in range(200)]
    want = [model.encode(x) for x in texts]
    monkeypatch.setattr(bytebpe, "BLOCK", 5)
    assert [model.encode(x) for x in texts] == want
    monkeypatch.setattr(bytebpe, "IDS", 3)
    assert [model.decode(x) for x in want] == [x.encode() for x in texts]


def test_round_trip_query(spark):
    rows = [(1, "One text, 2 parts.\n", "en"), (2, None, None), (3, "", None), (1, "One text, 2 parts.\n", "en"), (None, "日本語 <|endoftext|>", None), (4, "x" * 300_000 + " word" * 400_000, "en")]
    plain = tokenizer()

    def want(doc_id, text):
        ids = np.array(plain.encode_ordinary(text), "<u4")
        return doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    got = sorted(map(tuple, bytebpe.round_trip(table(spark, rows)).collect()), key=str)
    assert got == sorted((want(d, t or "") for d, t, _ in rows), key=str)
    assert bytebpe.round_trip(table(spark, [])).collect() == []
    with pytest.raises(ValueError):
        bytebpe.byte_bpe(PATH).decode(b"\xff\xff\xff\x00")
    with pytest.raises(ValueError):
        bytebpe.ByteBPE({b"a": 0}, ".")


# Collocations


def brute_phrases(docs, least, top, subsumed=50):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        held, found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}, []
        for p, a in held.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= subsumed * a for q, b in held.items() if len(q) > len(p)):
                continue
            cuts = [(10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), " ".join(p), counts[p[:k]], counts[p[k:]]))
        out += [(lang, r + 1, p, -a, x, y, n[lang], -s) for r, (s, a, _, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


def test_collocations_equal_brute_force(spark):
    rng = random.Random(8)
    words = ["New", "york", "city", "of", "the", "é", "\x00", "\x85", "a-b", "\x1c", "日本"]
    docs = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "\r\n", ","]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "fr", None, "und"])) for i in range(150)]
    docs += [(i, "the one and only phrase here", "en") for i in range(12)]
    docs += [docs[0], docs[0], (None, docs[1][1], "en"), (7, None, "en"), (8, "", None), (9, "   ", "zz"), (10, "go on " * 900_000, "long")]
    got = collocations.collocations(table(spark, docs), least=10, top=15)
    assert sorted(map(tuple, got.collect())) == brute_phrases(docs, 10, 15)
    assert sorted(map(tuple, collocations.collocations(table(spark, docs), least=300, top=15).collect())) == brute_phrases(docs, 300, 15)
    assert collocations.collocations(table(spark, [])).collect() == []


def test_chunks_of_long_texts(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["aa", "b", "c"]) + rng.choice([" ", "\t", ". "]) for _ in range(200)), "x y", "", "q" * 90]

    def counted():
        found = Counter()
        for c in collocations.chunks(pa.array(["en"] * len(texts)), pa.array([x.encode() for x in texts])):
            names = c.names.to_pylist()
            for k in (1, 2, 3):
                found.update(tuple(names[i] for i in c.ids[s : s + k]) for s in c.phrases(k))
        return found

    want = counted()
    for size in (1, 5, 23):
        monkeypatch.setattr(collocations, "CHUNK", size)
        assert counted() == want


def test_sketch_loses_nothing():
    rng = np.random.default_rng(0)
    hashes, ids = rng.integers(0, 2**63, 500).astype(np.uint64), rng.integers(1, 500, 20_000)
    at = collocations.cells(hashes, ids, np.arange(19_999), 2, 8)
    exact = Counter(zip(ids[:-1].tolist(), ids[1:].tolist(), strict=True))
    sums = [np.bincount(row, minlength=256) for row in at]
    for i in range(0, 19_999, 97):
        assert min(s[row[i]] for s, row in zip(sums, at, strict=True)) >= exact[ids[i], ids[i + 1]]
