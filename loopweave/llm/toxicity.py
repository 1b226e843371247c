"""Toxic documents by a weighted finite-state grammar over clauses.

A lexicon maps words to classes: insults with learned weights, and fixed lists
of threats, targets, negations and verbs of reported speech.  Three transducers
read a clause's classes one after the other.  The first turns insults and
threats that follow a negation into negated ones, the second those that follow
a verb of reporting into reported ones, and the third says at the clause's end
what was matched.  They are composed into one machine, which is run once over
each text.  A document's score is a logistic function of the weights of its
matched clauses, by kind.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopweave.llm.storage import materialize

#: Labelled rows that the lexicon is learned from, at most about so many.
SAMPLE = 20_000
#: Beginnings of words that an insult may be known by, in characters.
PREFIXES = range(3, 9)
#: Labelled documents with it, and share of toxic ones among them, that make a beginning an insult.
SUPPORT, PURITY = 5, 0.9
#: Insults that may be sent to tasks; a lexicon with more fails.
INSULTS = 200_000

# Words by class.
THREATS = "kill hurt beat destroy shoot stab strangle tuer frapper töten schlagen umbringen matar golpear".split()
TARGETS = "you your yours yourself he she they him her them we us ihr du dich dir sie euch tu te toi vous ton votre usted ustedes ellos".split()
NEGATIONS = "not no never neither nor don't isn't aren't wasn't pas jamais ni nicht kein keine nie nunca jamás".split()
REPORTS = "said says say told wrote quoted claimed reported dit disait écrit sagte sagt schrieb dijo dice escribió".split()
#: Weights of insults that need no labels.
KNOWN = dict.fromkeys("idiot idiots moron morons stupid scum loser losers trash pathetic worthless disgusting clown clowns".split(), 2.0)

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END, NEGATED, REPORTED = range(9)
#: What the grammar says within a clause: that an insult or a threat counts, or that it is negated or reported.
COUNTS, HELD = 101, 102
#: What a clause may be found to be, the gravest first.
KINDS = ("threat to a target", "insult to a target", "insult", "threat", "reported", "negated")
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n|]")
#: Words after a negation that it still holds for.
REACH = 3


class Transducer:
    """A deterministic letter transducer: ``(state, symbol) -> (state, output)``; 0 is the start."""

    def __init__(self, arcs: dict[tuple[int, int], tuple[int, int]]):
        self.arcs = arcs

    def compose(self, other: Transducer) -> Transducer:
        """The machine that gives this one's output to ``other``."""
        names: dict[tuple[int, int], int] = {(0, 0): 0}
        arcs, todo = {}, [(0, 0)]
        symbols = sorted({s for _, s in self.arcs})
        while todo:
            a, b = todo.pop()
            for symbol in symbols:
                to_a, between = self.arcs[a, symbol]
                to_b, out = other.arcs[b, between]
                if (to_a, to_b) not in names:
                    names[to_a, to_b] = len(names)
                    todo.append((to_a, to_b))
                arcs[names[a, b], symbol] = (names[to_a, to_b], out)
        return Transducer(arcs)


def negation() -> Transducer:
    """States count the words that the last negation still holds for."""
    arcs = {}
    for left, symbol in product(range(REACH + 1), range(END + 1)):
        if symbol == NEGATION:
            arcs[left, symbol] = (REACH, OTHER)
        elif symbol == END:
            arcs[left, symbol] = (0, END)
        else:
            arcs[left, symbol] = (max(0, left - 1), NEGATED if left and symbol in (INSULT, THREAT) else symbol)
    return Transducer(arcs)


def reported_speech() -> Transducer:
    """State 1: someone else's words, up to the clause's end."""
    arcs = {}
    for inside, symbol in product((0, 1), range(NEGATED + 1)):
        if symbol == REPORT:
            arcs[inside, symbol] = (1, OTHER)
        elif symbol == END:
            arcs[inside, symbol] = (0, END)
        else:
            arcs[inside, symbol] = (inside, REPORTED if inside and symbol in (INSULT, THREAT) else symbol)
    return Transducer(arcs)


def clause_kinds() -> Transducer:
    """States are sets of what the clause has had; the output at its end is 1 + its kind, or 0, and COUNTS, HELD or 0 before."""
    says = {INSULT: COUNTS, THREAT: COUNTS, REPORTED: HELD, NEGATED: HELD}
    had = {INSULT: 1, THREAT: 2, TARGET: 4, REPORTED: 8, NEGATED: 16}
    arcs = {}
    for state, symbol in product(range(32), range(REPORTED + 1)):
        if symbol == END:
            tests = (state & 6 == 6, state & 5 == 5, state & 1, state & 2, state & 8, state & 16)
            arcs[state, symbol] = (0, next((k + 1 for k, t in enumerate(tests) if t), 0))
        else:
            arcs[state, symbol] = (state | had.get(symbol, 0), says.get(symbol, 0))
    return Transducer(arcs)


GRAMMAR = negation().compose(reported_speech()).compose(clause_kinds())


class Lexicon:
    """Classes and weights of words; ``insults`` maps beginnings of words, or whole words, to weights."""

    def __init__(self, insults: dict[str, float]):
        self.insults = insults
        self.fixed = {w: (c, 1.0) for c, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}
        self.fixed |= dict.fromkeys(".!?;:\n|", (END, 0.0))
        self.seen: dict[str, tuple[int, float]] = {}

    def of(self, word: str) -> tuple[int, float]:
        found = self.seen.get(word)
        if found is None:
            found = self.fixed.get(word)
            if found is None:
                weight = max((self.insults.get(word[:k], 0.0) for k in PREFIXES if k <= len(word)), default=0.0)
                weight = max(weight, KNOWN.get(word, 0.0))
                found = (INSULT, weight) if weight else (OTHER, 0.0)
            if len(self.seen) > 500_000:
                self.seen.clear()
            self.seen[word] = found
        return found


def features(text: str, lexicon: Lexicon) -> list[float]:
    """By kind, the logarithm of the matched clauses' weights; then their density and the number of different insults in them.

    Only what the grammar says counts: a clause that is more than negated or
    reported weighs as much as its live words, others as much as those held.
    """
    sums, words, state, live, held, insults = [0.0] * len(KINDS), 0, 0, 0.0, 0.0, set()
    arcs, of, live_kinds = GRAMMAR.arcs, lexicon.of, 4

    def close(kind: int) -> None:
        if kind:
            sums[kind - 1] += live if kind <= live_kinds else held

    for match in TOKEN.finditer(text.lower()):
        symbol, w = of(match.group())
        words += 1
        if symbol:
            state, said = arcs[state, symbol]
            if symbol == END:
                close(said)
                live = held = 0.0
            elif said == COUNTS:
                live += w
                if symbol == INSULT:
                    insults.add(match.group()[:8])
            elif said == HELD:
                held += w
        elif state:
            state = arcs[state, OTHER][0]
    close(arcs[state, END][1])
    total = sum(sums[:live_kinds])
    return [*(math.log1p(x) for x in sums), math.log1p(100 * total / (words + 20)), math.log1p(len(insults))]


N_FEATURES = len(KINDS) + 2


def labelled(labels: DataFrame, column: str, folds: int, held: int) -> DataFrame:
    """``(doc_id, label)`` of the rows that may be learned from, one for each document."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).where(F.crc32(F.col("doc_id").cast("string")) % folds != held)
    return rows.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label"))


def learn_lexicon(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """Learn insults from a sample of about ``sample`` labelled documents.

    Beginnings of words are counted within each partition, by documents of
    either label, and summed by Spark; those that nearly only toxic
    documents have become insults, weighted by their log-odds.
    """
    share = min(1.0, sample / max(1, labels.count()))
    some = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.where("text is not null").join(F.broadcast(some), "doc_id").select("text", "label")

    def count(batches):
        found: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = {w for w in TOKEN.findall(text.as_py().lower()) if len(w) >= PREFIXES[0]}
                found[label].update({w[:k] for w in words for k in PREFIXES if k <= len(w)})
        names = sorted(set(found[0]) | set(found[1]))
        for i in range(0, len(names), 100_000):
            part = names[i : i + 100_000]
            yield pa.RecordBatch.from_pydict({"start": part, "other": pa.array([found[0][x] for x in part], pa.int64()), "toxic": pa.array([found[1][x] for x in part], pa.int64())})

    total = {r["label"]: r["n"] for r in some.groupBy("label").agg(F.count("*").alias("n")).collect()}
    sums = rows.mapInArrow(count, "start string, other long, toxic long").groupBy("start").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    pure = materialize(sums.where((F.col("toxic") >= SUPPORT) & (F.col("toxic") >= PURITY * (F.col("toxic") + F.col("other")))), "pure-beginnings")
    # Of beginnings of one another that stand in the same documents, or nearly so, the longest is taken.
    longer = pure.select(F.expr("substring(start, 1, length(start) - 1)").alias("_start"), F.col("toxic").alias("_toxic"))
    starts = pure.join(longer, (F.col("start") == F.col("_start")) & (F.col("_toxic") >= PURITY * F.col("toxic")), "left_anti")
    kept = starts.limit(INSULTS + 1).collect()
    if len(kept) > INSULTS:
        raise ValueError(f"more than {INSULTS} insults were learned; raise SUPPORT or take a smaller sample")
    scale = [total.get(k, 0) + 1 for k in (0, 1)]
    return Lexicon({r["start"]: max(0.5, math.log((r["toxic"] + 0.5) / scale[1]) - math.log((r["other"] + 0.5) / scale[0])) for r in kept})


def fit_logistic(sums: Iterator, n: int, penalty: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights, the intercept last, by Newton's method on rows ``(features, label, count)``."""
    rows = list(sums)
    if not rows:
        return np.append(np.full(n, 1.0), -3.0)
    x = np.array([[*r[0], 1.0] for r in rows])
    y, count = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    w, ridge = np.zeros(n + 1), np.append(np.full(n, penalty), 1e-3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (count * p * (1 - p))[:, None]) + np.diag(ridge), x.T @ (count * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, a row for each row of ``docs``.

    Learned from rows of ``labels`` whose ``crc32(doc_id) % folds`` isn't
    ``held``, and from the text alone.  Null and empty texts are scored as texts
    that nothing matches; rows without a ``doc_id`` aren't held out, as they have
    no label.  Without labels of both kinds the fixed word lists decide.  Other
    columns are ignored, repeated rows each get a row.
    """
    known = materialize(labelled(labels, "toxic", folds, held), "toxic-labels")
    lexicon = learn_lexicon(docs.select("doc_id", "text"), known, sample)
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [features(x.as_py() or "", sent.value) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "x"])

    rows = materialize(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x array<double>"), "toxic-features")
    share = min(1.0, sample / max(1, known.count()))
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    fit = rows.join(F.broadcast(some), "doc_id").groupBy("x", "label").agg(F.count("*").alias("n")).collect()
    w = fit_logistic(((r["x"], r["label"], r["n"]) for r in fit), N_FEATURES) if len({r["label"] for r in fit}) == 2 else fit_logistic((), N_FEATURES)
    z = sum((F.get("x", F.lit(i)) * float(w[i]) for i in range(N_FEATURES)), F.lit(float(w[-1])))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held, F.lit(False))
    scored = rows.select("doc_id", held_out.alias("held_out"), (1 / (1 + F.exp(-z))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``docs`` without the documents that are scored toxic, with all their columns.

    Null and empty texts are judged like texts without matches and rows without
    an id stay; of rows that share an id all go if one is toxic.  An empty table
    stays empty.
    """
    gone = toxicity_scores(docs, labels, threshold=threshold).where("predicted = 1").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
