"""Staging: a sequence file for each accession, and a manifest that is committed last."""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopweave.operators.lookups import alias_index, by_alias
from loopweave.sources.flat import fasta_text
from loopweave.sources.places import filesystem

MANIFEST = "accession string, place int, path string, length long, sha256 string"


def file_name(accession: str) -> str:
    """A file's name for an accession: other characters than letters, digits, dots and dashes by their codes."""
    return re.sub("[^A-Za-z0-9.-]", lambda m: "".join(f"_{b:02X}" for b in m[0].encode()), accession) + ".fasta"


def stage(accessions: DataFrame, records: DataFrame, folder: str, width: int = 60, allow_missing: bool = False) -> DataFrame:
    """Write ``folder``'s files and then its manifest; returns ``(accession, place, path, length, sha256)``.

    ``records`` has ``(name, seq, place)``; an accession gets the record of the
    least place that goes by its name or, failing that, by its name without
    version.  Each accession's file appears under its name when it is whole, with
    the same bytes whichever attempt of a task wrote it, and files that are there
    with these bytes stay.  The manifest is written when all files are there, so
    a folder with one is complete, and a run that was cut off can be repeated.
    Accessions without a record are an error before anything is written, or, if
    ``allow_missing``, have nulls; null ones are left out, repeated ones count once.
    """
    wanted = accessions.select("accession").where("accession is not null").distinct()
    index = alias_index(records.select("name", "seq", "place"), F.array("name"), ["place", "name", "seq"])
    found = by_alias(wanted, "accession", index, ["place", "seq"])
    if not allow_missing:
        lacks = [r["accession"] for r in found.where("seq is null").select("accession").orderBy("accession").limit(10).collect()]
        if lacks:
            raise ValueError(f"no records of {', '.join(lacks)}")

    def run(batches):
        fs, top = filesystem(folder)
        fs.create_dir(top, recursive=True)
        for batch in batches:
            paths, lengths, sums = [], [], []
            for accession, seq in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if seq is None:
                    paths.append(None), lengths.append(None), sums.append(None)
                    continue
                data, path = fasta_text({"name": accession, "seq": seq}, width).encode(), f"{top}/{file_name(accession)}"
                if not _holds(fs, path, data):
                    temp = f"{top}/_attempt-{uuid.uuid4().hex}"
                    with fs.open_output_stream(temp) as out:
                        out.write(data)
                    fs.move(temp, path)
                paths.append(file_name(accession)), lengths.append(len(seq)), sums.append(hashlib.sha256(seq.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(paths, pa.string()), pa.array(lengths, pa.int64()), pa.array(sums, pa.string())], ["accession", "place", "path", "length", "sha256"])

    # An accession is one task's, so attempts alone can write a file twice.
    done = found.select("accession", F.col("place").cast("int").alias("place"), F.upper("seq").alias("seq")).repartition("accession").mapInArrow(run, MANIFEST)
    at = f"{folder.rstrip('/')}/_manifest"
    done.write.mode("overwrite").option("header", "true").option("sep", "\t").csv(at)
    fs, top = filesystem(folder)
    for x in fs.get_file_info(pa.fs.FileSelector(top)):
        if x.base_name.startswith("_attempt-"):
            fs.delete_file(x.path)
    return read_manifest(accessions.sparkSession, folder)


def _holds(fs, path: str, data: bytes) -> bool:
    info = fs.get_file_info(path)
    if not info.is_file or info.size != len(data):
        return False
    with fs.open_input_stream(path) as stream:
        return stream.read() == data


def read_manifest(spark, folder: str) -> DataFrame:
    """The manifest of a staged folder; one that isn't complete has none, which is an error."""
    at = f"{folder.rstrip('/')}/_manifest"
    fs, top = filesystem(at)
    if not fs.get_file_info(f"{top}/_SUCCESS").is_file:
        raise FileNotFoundError(f"{folder} isn't complete")
    return spark.read.schema(MANIFEST).option("header", "true").option("sep", "\t").csv(at)
