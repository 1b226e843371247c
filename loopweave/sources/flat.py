"""FASTA and GenBank files as Spark data sources, for reading and writing.

``register(spark)`` makes ``spark.read.format("fasta")`` and ``"genbank"``, and
``df.write.format(...)``, work.  Readers cut files into ranges of bytes: a task
takes the records that start in its range, so one large file is read by many
tasks, and small files are read together.  Gzipped files are read whole, each by
one task.  Filters on ``name`` are pushed into the reader, which then doesn't
put together the sequences it drops; the option ``columns`` leaves columns out
of the schema, so that they are never made.
"""

from __future__ import annotations

import gzip
import json
import math
import re
import sys
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loopweave.sources import genbank, places
from loopweave.sources.genbank import format_record, parse_records
from loopweave.sources.places import filesystem

#: Bytes of a range, of a read, and of a batch of rows.
SPLIT, CHUNK, BATCH = 32 << 20, 1 << 20, 8 << 20
#: Files that a writing task keeps open for different values of the partitioning column.
OPEN = 32
#: Columns of both formats and their types.
FASTA = {"name": "string", "header": "string", "seq": "string", "source_file": "string", "rec": "long"}
FEATURES = "array<struct<type:string,strand:int,parts:array<struct<start:int,end:int>>,qualifiers:map<string,array<string>>>>"
GENBANK = dict.fromkeys(("id", "name", "description", "organism", "topology"), "string") | {"accessions": "array<string>", "seq": "string", "features": FEATURES, "source_file": "string", "rec": "long"}


@dataclass
class Ranges(InputPartition):
    """Ranges ``(uri, start, end)`` of files that one task reads; ``end`` is None for whole gzipped files."""

    parts: list[tuple[str, int, int | None]]


def files_below(uri: str, pattern: str) -> list[tuple[str, int]]:
    """``(path, size)`` of the files at or below ``uri`` whose name fits ``pattern``, by path; hidden ones and ``_...`` are left out."""
    fs, path = filesystem(uri)
    top = fs.get_file_info(path)
    if top.type == pafs.FileType.NotFound:
        raise FileNotFoundError(uri)
    found = [top] if top.is_file else fs.get_file_info(pafs.FileSelector(path, recursive=True))
    hidden = re.compile(r"(^|/)[._]")
    return sorted((x.path, x.size) for x in found if x.is_file and re.search(pattern, x.base_name) and (top.is_file or not hidden.search(x.path[len(path) :])))


def ranges(files: list[tuple[str, int]], split: int) -> list[Ranges]:
    """Files in ranges of about ``split`` bytes, small ones together."""
    out, held, size = [], [], 0
    for path, length in files:
        if path.endswith(".gz"):
            parts = [(path, 0, None, length)]
        else:
            n = max(1, math.ceil(length / split))
            ends = [length * k // n for k in range(n + 1)]
            parts = [(path, a, b, b - a) for a, b in zip(ends, ends[1:], strict=False)]
        for *part, cost in parts:
            if held and size + cost > split:
                out.append(Ranges(held))
                held, size = [], 0
            held.append(tuple(part))
            size += cost
    return [*out, *([Ranges(held)] if held else [])]


def records(stream, start: int, end: int | None, mark: bytes) -> Iterator[tuple[int, bytes]]:
    """``(offset, record)`` of the records whose ``mark``, at a line's start, stands in ``[start, end)``.

    A record goes on to the next mark or the file's end, also beyond ``end``.
    """
    sign, held, base, begun, scan = b"\n" + mark, bytearray(), start - 1, False, 0
    if start == 0:
        held += b"\n"
    else:
        stream.seek(start - 1)
    while True:
        at = held.find(sign, scan)
        if at < 0:
            # All that needn't be looked at again goes.
            drop = 0 if begun else max(0, len(held) - len(sign) + 1)
            del held[:drop]
            base, scan = base + drop, max(0, len(held) - len(sign) + 1)
            more = stream.read(CHUNK)
            if not more:
                if begun:
                    yield base, bytes(held)
                return
            held += more
            continue
        if begun:
            yield base, bytes(held[: at + 1])
        del held[: at + 1]
        base, begun, scan = base + at + 1, True, 1
        if end is not None and base >= end:
            return


def name_test(filters: list[Filter]) -> tuple[Callable[[str], bool], list[Filter]]:
    """What filters on ``name`` say of a name, and the filters that Spark must apply itself."""
    tests, rest = [], []
    for f in filters:
        if getattr(f, "attribute", None) != ("name",):
            rest.append(f)
        elif isinstance(f, EqualTo):
            tests.append(lambda name, value=f.value: name == value)
        elif isinstance(f, In):
            tests.append(lambda name, values=frozenset(f.value): name in values)
        elif isinstance(f, StringStartsWith):
            tests.append(lambda name, value=f.value: name.startswith(value))
        else:
            rest.append(f)
    return (lambda name: all(t(name) for t in tests)), rest


def fasta_row(record: bytes, wanted: Callable[[str], bool], columns: list[str], clean: bool) -> dict | None:
    """A record's columns; None for one without a header or whose name isn't wanted."""
    head, _, body = record[1:].partition(b"\n")
    header = head.decode("utf-8", "replace").strip()
    name = header.split(None, 1)[0] if header else ""
    if not header or not wanted(name):
        return None
    seq = None
    if "seq" in columns:
        seq = body.translate(None, b" \t\r\n\x0b\x0c").decode("utf-8", "replace").upper()
        seq = re.sub("[^A-Z]", "", seq) if clean else seq
    return {"name": name, "header": header, "seq": seq}


def genbank_row(record: bytes, wanted: Callable[[str], bool], columns: list[str], clean: bool) -> dict | None:
    """A record's columns; None for one whose name isn't wanted."""
    locus = record.partition(b"\n")[0].decode("utf-8", "replace").split()
    if not wanted(locus[1] if len(locus) > 1 else ""):
        return None
    row = parse_records(record.decode("utf-8", "replace"))[0]
    for f in row["features"]:
        f["qualifiers"] = list(f["qualifiers"].items())
    return row


class FlatReader(DataSourceReader):
    """Reads ranges of files record by record, as batches of bounded size."""

    def __init__(self, source: FlatSource, schema: StructType):
        self.options, self.schema, self.mark, self.row, self.pattern = dict(source.options), schema, source.mark, source.row, source.pattern
        self.wanted: Callable[[str], bool] = lambda name: True

    def pushFilters(self, filters):
        self.wanted, rest = name_test(filters)
        yield from rest

    def partitions(self):
        found = files_below(self.options["path"], self.options.get("pattern", self.pattern))
        # A source needs a partition, even without files.
        return ranges(found, int(self.options.get("splitbytes", SPLIT))) or [Ranges([])]

    def read(self, partition):
        arrow, fs = to_arrow_schema(self.schema), filesystem(self.options["path"])[0]
        tolerant, clean = (self.options.get(x, "false").lower() == "true" for x in ("tolerant", "clean"))
        columns, rows, size = arrow.names, [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in arrow], schema=arrow)

        for path, start, end in partition.parts:
            opened = fs.open_input_stream(path, compression="gzip") if end is None else fs.open_input_file(path)
            with opened as stream:
                if start == 0:
                    self._check(stream, path, tolerant)
                    stream.close()
                    stream = fs.open_input_stream(path, compression="gzip") if end is None else fs.open_input_file(path)
                for offset, record in records(stream, start, end, self.mark):
                    try:
                        row = self.row(record, self.wanted, columns, clean)
                    except Exception:
                        if not tolerant:
                            raise
                        continue
                    if row is not None:
                        rows.append(row | {"source_file": path, "rec": offset})
                        size += len(record)
                    if size >= BATCH:
                        yield batch()
                        rows, size = [], 0
                stream.close()
        if rows:
            yield batch()

    def _check(self, stream, path: str, tolerant: bool) -> None:
        """A file that doesn't start with a record is an error, unless tolerant; so is none that holds white space only."""
        head = stream.read(CHUNK).lstrip()
        if head and not head.startswith(self.mark) and not tolerant:
            raise ValueError(f"{path} doesn't start with {self.mark.decode()}")


@dataclass
class Written(WriterCommitMessage):
    """Files of one task, as ``(temporary path, path)``, and their rows."""

    files: list[tuple[str, str]]
    rows: int


class FlatWriter(DataSourceArrowWriter):
    """Writes a file for each task, or for each task and value of the column ``partitionby``.

    Tasks write under names of their own attempt; only the commit, which gets the
    files of one attempt of each task, moves them to their names and then writes
    ``_manifest.json``.  ``overwrite`` removes the files that were there, after
    the new ones are whole.
    """

    def __init__(self, source: FlatSource, schema: StructType, overwrite: bool):
        self.options, self.overwrite, self.names, self.text, self.suffix = dict(source.options), overwrite, schema.names, source.text, source.suffix
        missing = {"name", "seq"} - set(self.names)
        if missing:
            raise ValueError(f"rows to be written lack {', '.join(sorted(missing))}")
        self.by, self.gz = self.options.get("partitionby"), self.options.get("compression", "none") == "gzip"

    def write(self, iterator):
        fs, top = filesystem(self.options["path"])
        attempt, width, files, rows = uuid.uuid4().hex, int(self.options.get("width", 60)), [], 0
        #: For each value of the partitioning column the stream to write to and those to be closed, the last used one last.
        held: dict[object, tuple] = {}

        def out(value):
            if value not in held:
                if len(held) >= OPEN:
                    close(held.pop(next(iter(held))))
                name = f"part-{attempt}-{len(files):05d}{self.suffix}{'.gz' if self.gz else ''}"
                temp = f"{top}/_attempt-{attempt}/{len(files):05d}"
                fs.create_dir(f"{top}/_attempt-{attempt}", recursive=True)
                files.append((temp, f"{top}/{self._folder(value)}{name}"))
                stream = fs.open_output_stream(temp)
                held[value] = (gzip.GzipFile(fileobj=stream, mode="wb", mtime=0), stream) if self.gz else (stream,)
            else:
                held[value] = held.pop(value)
            return held[value][0]

        def close(streams):
            for stream in streams:
                stream.close()

        for batch in iterator:
            for row in batch.to_pylist():
                out(row[self.by] if self.by else None).write(self.text(row, width).encode())
                rows += 1
        for streams in held.values():
            close(streams)
        return Written(files, rows)

    def _folder(self, value) -> str:
        if self.by is None:
            return ""
        safe = "__HIVE_DEFAULT_PARTITION__" if value is None else re.sub("[^A-Za-z0-9_.-]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), str(value))
        return f"{self.by}={safe}/"

    def commit(self, messages):
        fs, top = filesystem(self.options["path"])
        fs.create_dir(top, recursive=True)
        found = fs.get_file_info(pafs.FileSelector(top, recursive=True))
        done = [m for m in messages if m is not None]
        names = []
        for temp, name in (x for m in done for x in m.files):
            fs.create_dir(name.rpartition("/")[0], recursive=True)
            fs.move(temp, name)
            names.append(name[len(top) + 1 :])
        kept = [x.path[len(top) + 1 :] for x in found if x.is_file and "/_" not in x.path[len(top) :]]
        if self.overwrite:
            for x in kept:
                fs.delete_file(f"{top}/{x}")
            kept = []
        for x in fs.get_file_info(pafs.FileSelector(top)):
            if x.base_name.startswith("_attempt-"):
                fs.delete_dir(x.path)
        with fs.open_output_stream(f"{top}/_manifest.json") as stream:
            stream.write(json.dumps({"files": sorted(names + kept), "rows": sum(m.rows for m in done)}).encode())

    def abort(self, messages):
        fs, _ = filesystem(self.options["path"])
        for temp, _ in (x for m in messages if m is not None for x in m.files):
            if fs.get_file_info(temp).is_file:
                fs.delete_file(temp)


def fasta_text(row: dict, width: int) -> str:
    """A record; its header is ``header`` if the row has one, else ``name``."""
    seq = row["seq"] or ""
    lines = [seq[i : i + width] for i in range(0, len(seq), width)] if width else [seq]
    return "\n".join([">" + (row.get("header") or row["name"] or ""), *lines]) + "\n"


class FlatSource(DataSource):
    """What both formats share; a format says how records start, and how a row is read and written."""

    mark: bytes
    full: dict[str, str]
    pattern: str
    suffix: str
    row: Callable
    text: Callable

    def schema(self):
        columns = [c.strip() for c in self.options.get("columns", ",".join(self.full)).split(",")]
        return ", ".join(f"{c} {self.full[c]}" for c in columns)

    def reader(self, schema):
        return FlatReader(self, schema)

    def writer(self, schema, overwrite):
        return FlatWriter(self, schema, overwrite)


class FastaSource(FlatSource):
    mark, full, pattern, suffix = b">", FASTA, r"\.(fa|fasta|fna|fas|txt)(\.gz)?$", ".fasta"
    row, text = staticmethod(fasta_row), staticmethod(fasta_text)

    @classmethod
    def name(cls):
        return "fasta"


class GenbankSource(FlatSource):
    mark, full, pattern, suffix = b"LOCUS", GENBANK, r"\.(gb|gbk|genbank)(\.gz)?$", ".gb"
    row, text = staticmethod(genbank_row), staticmethod(format_record)

    @classmethod
    def name(cls):
        return "genbank"


def register(spark: SparkSession) -> None:
    """Make the formats ``fasta`` and ``genbank`` known to a session.

    Options for reading: ``splitBytes``, ``pattern`` of file names, ``columns``,
    ``clean`` (letters only), ``tolerant`` (leave out what isn't of the format).
    For writing, in mode ``append`` or ``overwrite``: ``width`` of lines,
    ``compression`` (``gzip``), ``partitionBy`` a column.  Turns on the setting
    that lets Spark push filters into such sources.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for module in (sys.modules[__name__], genbank, places):
        cloudpickle.register_pickle_by_value(module)  # sources are planned by a worker that needn't know this package
    spark.dataSource.register(FastaSource)
    spark.dataSource.register(GenbankSource)
