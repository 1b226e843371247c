"""Folders that driver and executors share, and files in them that tasks write and read themselves."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Kinds of URI that the system's own client opens; Spark's readers know more.
SCHEMES = ("file", "hdfs", "s3", "gs")


def new_dir(spark: SparkSession, label: str) -> str:
    """The URI of an unused folder below ``spark.checkpoint.dir``; only a session in this one process may do without that."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='loopweave-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/loopweave/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as Parquet in an unused shared folder, which cuts its lineage: later stages start from files."""
    at = new_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or local path, and the path in it."""
    scheme = uri.partition(":")[0] if ":" in uri.partition("/")[0] else ""
    if scheme and scheme not in SCHEMES:
        raise ValueError(f"tasks can't open {uri}; it must be a local path or one of {', '.join(SCHEMES)}")
    if scheme == "file":  # with one slash or three
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri) if scheme else (pafs.LocalFileSystem(), uri)
