"""The supplied tables as the domain's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sequences ``(name, seq)``: their letters A, C, G and T."""
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("name"), F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as sequences ``(name, seq)``."""
    items = read(spark, sf_dir, "benchmark")
    return items.select(F.concat(F.lit("ref"), F.col("item_id").cast("string")).alias("name"), F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as label tracks ``(name, start, label, end, genome_len)``: window k goes from 10 k to 10 k + 10."""
    events = read(spark, sf_dir, "events")
    order = W.Window.partitionBy("user_id").orderBy("ts", "event_id")
    start = (F.row_number().over(order) - 1) * 10
    n = F.count("*").over(W.Window.partitionBy("user_id"))
    return events.select(
        F.col("user_id").cast("string").alias("name"), start.alias("start"), F.col("event_type").alias("label"), (start + 10).alias("end"), (n * 10).cast("int").alias("genome_len")
    )


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as aligned rows ``(name, seq)``: letters of their text, filled with gaps to the longest one."""
    items = read(spark, sf_dir, "benchmark")
    letters = F.regexp_replace(F.upper(F.regexp_replace("text", "[^A-Za-z]", "-")), "[^ACDEFGHIKLMNPQRSTVWY]", "-")
    rows = items.select(F.concat(F.lit("ref"), F.col("item_id").cast("string")).alias("name"), letters.alias("seq"))
    longest = rows.agg(F.max(F.length("seq")).alias("width"))
    return rows.join(F.broadcast(longest)).select("name", F.rpad("seq", F.col("width"), F.lit("-")).alias("seq"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as labelled points ``(id, label, vec)``."""
    rows = read(spark, sf_dir, "embeddings").where("label is not null and embedding is not null")
    return rows.select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


#: The same tables in DuckDB's SQL.
GENOMES = "g AS (SELECT CAST(doc_id AS VARCHAR) AS name, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents)"
PANEL = "p AS (SELECT 'ref' || CAST(item_id AS VARCHAR) AS name, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM benchmark)"
TRACKS = """t AS (SELECT CAST(user_id AS VARCHAR) AS name, event_type AS label,
    CAST((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 10 AS INTEGER) AS start,
    CAST(count(*) OVER (PARTITION BY user_id) * 10 AS INTEGER) AS genome_len FROM events)"""
PROTEINS = """l AS (SELECT 'ref' || CAST(item_id AS VARCHAR) AS name, regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '-', 'g')), '[^ACDEFGHIKLMNPQRSTVWY]', '-', 'g') AS letters FROM benchmark),
    a AS (SELECT name, rpad(letters, CAST((SELECT max(length(letters)) FROM l) AS INTEGER), '-') AS seq FROM l)"""
POINTS = "v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL)"
