"""A training corpus from ``documents``, stage by stage.

Each stage takes the session, its predecessor's documents and the folder of
tables, and returns documents with the columns of the table ``documents``; the
last one returns packed pieces.  What a stage returns is written as Parquet and
read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loopweave.llm import linededup, mixing, packing, simhash, toxicity
from loopweave.llm.storage import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't scored as toxic; null and empty texts and rows without an id stay."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand before; a null text stays null, one whose lines all go is empty."""
    return linededup.dedup_lines(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: Jaccard similarity 0.8 or more of shingles of five words.

    SimHashes within four bits, as op1 links them, are candidates that are checked; pairs that they miss are found by their sets.
    Texts without words are one group; rows without an id stay.
    """
    return simhash.keep_one(docs, words=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: rows of a source without words never; null is a source of its own."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, with the sequence and the place that each has; repeated rows are packed each."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack),
]
#: No SQL: scoring, sampling and packing are beyond it; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each to what the one before wrote; an empty table gives no pieces.

    Columns beyond those of the table, whatever their names, pass all stages but the last.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-").lower())
    return docs
