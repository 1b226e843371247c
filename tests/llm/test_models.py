import math
import random
import zlib

import numpy as np

from loopweave.llm import quality, toxicity

FILLER = "the river ran past our old house and the mill where we played in summer".split()


def corpus(spark, n=900):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(FILLER) for _ in range(rng.randrange(20, 120))]
        bad, toxic = i % 5 == 0, i % 4 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["vequtant", "vequmoi", "idiot"]))
        if bad:
            words = [w.upper() + "!!" for w in words] if i % 2 else [f"{w}***" for w in words]
        docs.append((i, " ".join(words), "xx"))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(n, None, "x"), (n + 1, "", "x"), (None, "a text without id", "x"), (5, docs[5][1], "x"), (n + 2, "word " * 60_000, "x")]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def plainly(text, lexicon):
    """The features, by a plain reading of the grammar's three rules, clause by clause."""
    sums, insults, words = [0.0] * 6, set(), 0
    tokens = toxicity.TOKEN.findall(text.lower())
    clauses = [[]]
    left = 0
    for token in tokens:
        words += 1
        symbol, weight = lexicon.of(token)
        if symbol == toxicity.END:
            clauses.append([])
            left = 0
            continue
        if symbol == toxicity.NEGATION:
            left = toxicity.REACH
        else:
            clauses[-1].append((token, symbol, weight, left > 0))
            left = max(0, left - 1)
    for clause in clauses:
        reported, live, held_back, had = False, 0.0, 0.0, set()
        for token, symbol, weight, negated in clause:
            if symbol == toxicity.REPORT:
                reported = True
            elif symbol in (toxicity.INSULT, toxicity.THREAT):
                if negated or reported:
                    held_back += weight
                    had.add("negated" if negated else "reported")
                else:
                    live += weight
                    had.add(symbol)
                    if symbol == toxicity.INSULT:
                        insults.add(token[:8])
            elif symbol == toxicity.TARGET:
                had.add(symbol)
        threat, insult, target = (x in had for x in (toxicity.THREAT, toxicity.INSULT, toxicity.TARGET))
        tests = (threat and target, insult and target, insult, threat, "reported" in had, "negated" in had)
        kind = next((k for k, t in enumerate(tests) if t), None)
        if kind is not None:
            sums[kind] += live if kind < 4 else held_back
    return [*(math.log1p(x) for x in sums), math.log1p(100 * sum(sums[:4]) / (words + 20)), math.log1p(len(insults))]


def test_features_equal_a_plain_reading():
    rng = random.Random(2)
    lexicon = toxicity.Lexicon({"vequ": 1.5, "abc": 0.7})
    words = ["vequtant", "abcx", "idiot", "kill", "hurt", "you", "them", "not", "never", "said", "told", "house", "river", ".", "!", "\n", "; "]
    for _ in range(2000):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 25)))
        assert np.allclose(toxicity.features(text, lexicon), plainly(text, lexicon)), text
    assert toxicity.features("you are not an idiot", lexicon)[-1] == 0 and toxicity.features("he said you idiot", lexicon)[-1] == 0


def test_scores_and_lexicon_equal_brute_force(spark):
    docs, labels = corpus(spark, 300)
    known = [r for r in labels.collect() if not held(r["doc_id"], 3, 1)]
    texts = {}
    for r in docs.where("text is not null and doc_id is not null").collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    counts: dict = {}
    for r in known:
        for text in texts.get(r["doc_id"], ()):
            found = {w[:k] for w in toxicity.TOKEN.findall(text.lower()) if len(w) >= 3 for k in toxicity.PREFIXES if k <= len(w)}
            for x in found:
                counts.setdefault(x, [0, 0])[r["toxic"]] += 1
    pure = {x: c for x, c in counts.items() if c[1] >= toxicity.SUPPORT and c[1] >= toxicity.PURITY * sum(c)}
    want = {x for x, c in pure.items() if not any(y[:-1] == x and d[1] >= toxicity.PURITY * c[1] for y, d in pure.items())}
    lexicon = toxicity.learn_lexicon(docs.select("doc_id", "text"), toxicity.labelled(labels, "toxic", 3, 1))
    assert set(lexicon.insults) == want
    rows = [(toxicity.features(t, lexicon), r["toxic"], 1) for r in known for t in texts.get(r["doc_id"], ())]
    w = toxicity.fit_logistic(rows, toxicity.N_FEATURES)
    for r in toxicity.toxicity_scores(docs, labels).join(docs.withColumnRenamed("score", "s"), "doc_id").where("doc_id <> 5").collect():
        z = float(np.dot(w[:-1], toxicity.features(r["text"] or "", lexicon)) + w[-1])
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-6


def held(i, folds, k):
    return i is not None and zlib.crc32(str(i).encode()) % folds == k


def accuracy(rows, labels, column):
    known = {r["doc_id"]: r[column] for r in labels.collect()}
    tested = [(r["predicted"], known[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in known]
    return sum(a == b for a, b in tested) / len(tested)


def test_toxicity(spark):
    docs, labels = corpus(spark)
    rows = toxicity.toxicity_scores(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == held(r["doc_id"], 3, 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert accuracy(rows, labels, "toxic") > 0.97
    kept = {r["doc_id"] for r in toxicity.drop_toxic(docs, labels).collect()}
    assert None in kept and 901 in kept and toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_held_out_labels_are_not_learned_from(spark):
    docs, labels = corpus(spark, 300)
    flipped = spark.createDataFrame([(r["doc_id"], 1 - r["quality"], 1 - r["toxic"]) if held(r["doc_id"], 3, 1) and held(r["doc_id"], 5, 0) else tuple(r) for r in labels.collect()], labels.schema)
    a, b = (sorted((str(r["doc_id"]), round(r["score"], 9)) for r in toxicity.toxicity_scores(docs, x).collect()) for x in (labels, flipped))
    assert a == b
    a, b = (sorted((str(r["doc_id"]), round(r["score"], 9)) for r in quality.quality_scores(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_quality(spark):
    docs, labels = corpus(spark)
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == held(r["doc_id"], 5, 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert accuracy(rows, labels, "quality") > 0.97


def test_without_labels_or_documents(spark):
    docs, labels = corpus(spark, 40)
    none = labels.where("doc_id < 0")
    assert toxicity.toxicity_scores(docs, none).count() == quality.quality_scores(docs, none).count() == docs.count()
    assert toxicity.toxicity_scores(docs.where("false"), labels).count() == quality.quality_scores(docs.where("false"), labels).count() == 0
    assert quality.quality_scores(docs, labels.where("quality = 1")).count() == docs.count()


def kinds(text):
    x = toxicity.features(text, toxicity.Lexicon({}))
    return {name for name, v in zip(toxicity.KINDS, x) if v}


def test_grammar():
    assert kinds("the barn is red. nothing here") == set()
    assert kinds("you are an idiot.") == {"insult to a target"}
    assert kinds("what an idiot!") == {"insult"}
    assert kinds("i will kill you") == {"threat to a target"}
    assert kinds("shoot. you are nice.") == {"threat"}
    assert kinds("that is not an idiot.") == {"negated"}
    assert kinds("she wrote idiot.") == {"reported"}
    assert kinds("not so. what an idiot.") == {"insult"}
    assert kinds("the man said that this is a moron; you stupid clown") == {"reported", "insult to a target"}


def test_composition_equals_running_one_after_the_other():
    parts = [toxicity.negation(), toxicity.reported_speech(), toxicity.clause_kinds()]
    rng = random.Random(3)
    for _ in range(200):
        word = [rng.randrange(toxicity.END + 1) for _ in range(rng.randrange(1, 30))]
        step = word
        for machine in parts:
            state, out = 0, []
            for s in step:
                state, o = machine.arcs[state, s]
                out.append(o)
            step = out
        state, direct = 0, []
        for s in word:
            state, o = toxicity.GRAMMAR.arcs[state, s]
            direct.append(o)
        assert direct == step


def test_discriminant_is_the_gaussian_log_ratio():
    rng = np.random.default_rng(0)
    x = [rng.normal(0, 1, (400, 3)), rng.normal(1, 2, (300, 3))]
    model = quality.fit(np.array([400.0, 300.0]), np.array([v.sum(0) for v in x]), np.array([v.T @ v for v in x]), 0.0, 0.0)
    point = np.array([[0.3, -0.2, 0.9]])
    logs = []
    for v in x:
        c = np.cov(v.T) + 1e-6 * np.eye(3)
        d = point[0] - v.mean(0)
        logs.append(np.log((len(v) + 1) / 702) - 0.5 * np.log(np.linalg.det(c)) - 0.5 * d @ np.linalg.inv(c) @ d)
    assert np.isclose(model.scores(point)[0], 1 / (1 + np.exp(logs[0] - logs[1])), rtol=1e-6)
