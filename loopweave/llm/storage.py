"""Where jobs keep what must outlive an executor.

Everything is written below the folder that the session names in
``spark.checkpoint.dir``, which all executors share.  Only where that setting
is missing, and the session runs in this one process, a temporary folder is
taken instead.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI, without a slash at its end."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='loopweave-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_dir(spark: SparkSession, label: str) -> str:
    """The URI of a folder that nothing has been written to yet."""
    return f"{shared_dir(spark)}/loopweave/{label}-{uuid.uuid4().hex}"


#: Bytes of a batch of rows on their way to Python.
BATCH_KEY, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Whatever runs meanwhile sends Python batches of about BATCH, a longer row alone; a session that has a limit of its own keeps it.

    Spark's own limits let 10,000 texts be some tens of MB, which each task
    holds several times, outside the heap and in Python.
    """
    if BATCH_KEY in spark.conf.getAll:
        yield
        return
    spark.conf.set(BATCH_KEY, BATCH)
    try:
        yield
    finally:
        spark.conf.unset(BATCH_KEY)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: later stages start from files, whichever executor
    wrote them.
    """
    at = new_dir(df.sparkSession, label)
    with small_batches(df.sparkSession):
        df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def remove(spark: SparkSession, at: str) -> None:
    """Delete a folder of the shared store; a missing one is no error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Kinds of URI that tasks can write files to beside Spark, with the settings of the system's own client.
SCHEMES = ("file", "hdfs", "s3", "gs")


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it, for code inside tasks.

    Spark's own readers know more kinds of store (``s3a``, ``abfs``, ``viewfs``),
    whose Hadoop settings don't reach this client; those fail.
    """
    scheme = uri.partition(":")[0] if ":" in uri else "file"
    if scheme not in SCHEMES:
        raise ValueError(f"files can't be written to {uri} by tasks; spark.checkpoint.dir must be one of {', '.join(SCHEMES)} for archives and media")
    return pafs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


class AtomicFile:
    """A file that appears under its name only when it is whole.

    Names must be those of one attempt of a task, as some stores don't move a
    file onto another.
    """

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.temp = f"{self.path.rpartition('/')[0]}/_attempt-{uuid.uuid4().hex}"

    def __enter__(self):
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.temp)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.fs.move(self.temp, self.path)
        else:
            self.fs.delete_file(self.temp)
