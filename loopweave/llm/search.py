"""Ranked lexical search over a table of postings.

The index is one Parquet table whose folders are buckets of terms: a row for
each term of each document with its occurrences, and in a bucket of its own a
row for each document with its length.  A search joins its items' terms with the
postings, which reads only the buckets and row groups that hold them, deals what
matches out by document, scores it in integers, sums it for each item and
document where it lies, and ranks the sums in a window.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopweave.llm.storage import materialize, new_dir

#: Letters and digits of ASCII and all beyond it make up terms; only A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TABLE = bytes(ord(chr(b).lower()) if b > 127 or chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))
#: Bytes of text that are cut into terms at a time, and postings of a batch that tasks return.
BLOCK, BATCH = 1 << 22, 1 << 17
#: The bucket of documents' lengths.
LENGTHS = -1
#: Bytes of items' terms that are sent to all tasks; more items are searched in blocks.
SENT = 16 << 20
#: Scored terms of items that a task is to sum up.
SUMMED = 4_000_000


@dataclass
class Index:
    """Postings ``(bucket, term, row, tf)`` and lengths ``(row, doc_id, n)`` of documents that have terms."""

    postings: DataFrame
    lengths: DataFrame
    buckets: int


def term_counts(text: bytes) -> Counter:
    """How often a UTF-8 text has each of its terms."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        end = at + BLOCK
        while end < len(text) and TABLE[text[end]] != 32:
            end += 1
        found.update(text[at:end].translate(TABLE).split())
        at = end
    return found


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build_index(docs: DataFrame, buckets: int | None = None) -> Index:
    """The index of ``docs``, written to the shared folder.

    Each row is a document of its own, also those that share an id or have none;
    documents without terms, null ones too, are left out.  Rows are numbered as
    they are written, so the numbers hold.  A bucket that grows too large for one
    task, as that of a very common term or of all lengths, is split by Spark when
    it deals them out.  ``buckets`` is at first the number of shuffle partitions,
    which should grow with the corpus.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, places = batch.column(1), batch.column(2).cast(pa.binary()), batch.column(0).to_pylist()
            terms, owners, counts, docs_of = [], [], [], []

            def out() -> pa.RecordBatch:
                columns = [pa.array(terms, pa.binary()).cast(pa.string()), pa.array(owners, pa.int64()), pa.array(counts, pa.int64()), ids.take(pa.array(docs_of, pa.int32()))]
                for some in (terms, owners, counts, docs_of):
                    some.clear()
                return pa.RecordBatch.from_arrays(columns, ["term", "row", "tf", "doc_id"])

            for i, row in enumerate(places):
                found = term_counts(texts[i].as_py() or b"")
                if found:
                    terms += [None, *found]
                    owners += [row] * (len(found) + 1)
                    counts += [found.total(), *found.values()]
                    docs_of += [i, *[None] * len(found)]
                if len(terms) >= BATCH:
                    yield out()
            yield out()

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string"))
    rows = numbered.mapInArrow(run, f"term string, row long, tf long, doc_id {kind}")
    dealt = rows.withColumn("bucket", F.when(F.col("term").isNull(), LENGTHS).otherwise(_bucket(F.col("term"), buckets))).hint("rebalance", "bucket")
    at = new_dir(spark, "postings")
    dealt.sortWithinPartitions("bucket", "term", "row").write.partitionBy("bucket").option("compression", "zstd").parquet(at)
    table = spark.read.schema(f"term string, row long, tf long, doc_id {kind}, bucket int").parquet(at)
    return Index(table.where(F.col("bucket") != LENGTHS).drop("doc_id"), table.where(F.col("bucket") == LENGTHS).select("row", "doc_id", F.col("tf").alias("n")), buckets)


def item_terms(items: DataFrame) -> DataFrame:
    """``(asked, item_id, term, times)`` of each row of ``items``; ``asked`` tells rows apart that share an id."""
    terms = F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, LOWER), F.lit(TERM), 0)
    each = items.select(F.monotonically_increasing_id().alias("asked"), "item_id", terms.alias("terms"))
    return each.select("asked", "item_id", F.explode("terms").alias("term")).groupBy("asked", "item_id", "term").agg(F.count("*").alias("times"))


def search(index: Index, items: DataFrame, k: int = 20) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` documents that score highest for each row of ``items``.

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))); a document has the
    sum over the item's terms, repeats included, of the weight times
    (10^9 tf) div (1000 tf + 12 m), with m = 75 + (25 n N) div L.  Equal scores
    go by ascending ``doc_id``, nulls last.  An item without terms, or whose
    terms no document has, has no rows, nor has a null one; rows of ``items``
    that share an id are ranked each.
    """
    spark = items.sparkSession
    n_docs, n_terms = index.lengths.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    terms = materialize(item_terms(items), "item-terms")
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0))).first()[0]
    blocks = -(-size // SENT)
    parts = [terms.where(F.pmod(F.xxhash64("asked"), F.lit(blocks)) == b) if blocks > 1 else terms for b in range(blocks)]
    ranked = [_search(index, part, n_docs, n_terms, k) for part in parts]
    empty = spark.createDataFrame([], "rank int, score long").join(terms.select("item_id").limit(0)).join(index.lengths.select("doc_id").limit(0))
    return reduce(DataFrame.unionByName, ranked) if ranked else empty.select("item_id", "rank", "doc_id", "score")


def _search(index: Index, terms: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``search`` for one block of items' terms; one item may be larger than what is sent, and is then joined by shuffling."""
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0))).first()[0]
    sent = F.broadcast if size <= 2 * SENT else lambda x: x
    wanted = terms.groupBy("term").agg(F.count("*").alias("items")).withColumn("bucket", _bucket(F.col("term"), index.buckets))
    weight = F.floor(1000 * F.ln(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    held = index.postings.join(sent(wanted), ["bucket", "term"]).groupBy("bucket", "term").agg(F.count("*").alias("df"), F.first("items").alias("items"))
    weights = materialize(held.select("bucket", "term", "items", "df", weight.alias("w")), "weights")
    summed = weights.agg(F.sum(F.col("items") * F.col("df"))).first()[0] or 0
    tasks = max(int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-summed // SUMMED))
    matched = index.postings.join(sent(weights.drop("items", "df")), ["bucket", "term"]).select("row", "term", "tf", "w").repartition(tasks, "row")
    m = F.expr(f"75 + (25 * n * {n_docs}L) div {max(1, n_terms)}L")
    points = F.expr("w * ((1000000000L * tf) div (1000L * tf + 12L * m))")
    scored = matched.join(index.lengths.repartition(tasks, "row"), "row").withColumn("m", m).select("row", "doc_id", "term", points.alias("points"))
    hits = scored.where("points > 0").join(sent(terms), "term").groupBy("row", "doc_id", "asked", "item_id").agg(F.sum(F.col("points") * F.col("times")).alias("score"))
    order = Window.partitionBy("asked", "item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """``search`` of ``items`` in an index of ``docs`` that is made for it."""
    return search(build_index(docs), items, k)
