import random

import corpus_pipeline
from loopweave.llm.storage import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TOXIC = "you idiot! you stupid clown! what a moron, you loser! idiot, scum!"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def representatives(rows):
    """Ids that stay: the smallest of each group that a Jaccard similarity of 0.8 or more joins up."""
    rows = [(d, shingles(t)) for d, t in rows if d is not None]
    group = {d: d for d, _ in rows}

    def find(d):
        while group[d] != d:
            d = group[d]
        return d

    for i, (d, x) in enumerate(rows):
        for e, y in rows[:i]:
            if x == y or (x | y and len(x & y) >= 0.8 * len(x | y)):
                a, b = sorted((find(d), find(e)))
                group[b] = a
    return {find(d) for d, _ in rows}


def tables(spark, path, rows, labels):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_stages(spark, tmp_path):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    texts = [" ".join(word() for _ in range(120)) for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 3}", 1) for i, t in enumerate(texts)]
    for i in range(20):  # one to twelve words of 120 differ
        words = texts[i].split()
        for k in range(i % 12 + 1):
            words[9 * k + 3] = "other"
        rows.append((100 + i, " ".join(words), "en", "s1", 1))
    rows += [(200, texts[0], "en", "s0", 1), (201, None, "en", None, None), (202, TOXIC, "en", "s1", 1), (203, "", "en", "s2", 0), (None, "a row without an id but with some words", "en", "s0", 1)]
    tables(spark, tmp_path, rows, [(i, 1, 0) for i in range(60)] + [(202, 1, 1)])
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, str(tmp_path)), "stage")
        seen[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS
    ids = lambda name: {r["doc_id"] for r in seen[name].collect()}
    assert ids("toxicity") == {r[0] for r in rows} - {202}
    kept = {r["doc_id"]: r["text"] for r in seen["line dedup"].collect()}
    assert kept.keys() == ids("toxicity") and kept[200] == "" and kept[0] == texts[0] and kept[201] is None
    want = representatives(list(kept.items()))
    assert 60 < len(want) < len(kept) - 5
    assert ids("SimHash near-dedup") == want | {None}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, whole.drop("sequence_id", "offset").collect())) == sorted(map(str, seen["best-fit packing"].drop("sequence_id", "offset").collect()))


def test_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, [], [])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == corpus_pipeline.STAGES[-1][0] or out.columns == COLUMNS)


def test_columns_with_clashing_names(spark, tmp_path):
    tables(spark, tmp_path, [(1, TOXIC, "en", "a", 5), (2, "some words that nobody minds at all", "en", "a", 5)], [(1, 1, 1), (2, 1, 0)])
    extra = ("label", "score", "row", "words", "size", "copies", "fp", "key", "component_id", "taken")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", *(f"'{c}' AS {c}" for c in extra))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [*COLUMNS, *extra] and docs.where("score <> 'score' or fp <> 'fp'").count() == 0
