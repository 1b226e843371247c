"""WARC archives: writing, normalising, and reading by offset.

``write_monolithic`` leaves what careless crawlers leave: archives that are one
gzip stream from end to end, which nothing can be read from but by inflating
all that stands before it.  ``normalise`` inflates each such stream once,
record by record, and writes every record as a gzip member of its own, with
a sidecar index of the members' offsets.  ``read`` opens only what the index
names.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopweave.llm.storage import AtomicFile, filesystem, materialize, new_dir, remove

#: Bytes that are read or written at a time.
BLOCK = 1 << 20
INDEX = "archive string, offset long, length long, page_id long, record_type string, refers_to long, payload_digest string"


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(value: str) -> int | None:
    last = value.strip("<>").rpartition(":")[2]
    return None if last in ("", "none") else int(last)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has no block but names the record it repeats."""
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _id(page_id)),
        ("WARC-Target-URI", "".join((url or "").splitlines())),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if revisit:
        fields.append(("WARC-Refers-To", _id(refers_to)))
    block = b"" if revisit else payload
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def split_header(data: bytes | bytearray, at: int = 0) -> tuple[dict[str, str], int] | None:
    """The fields of the header of the record at ``at`` and where its block starts; None if the header isn't whole."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    lines = data[at:end].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record starts with {lines[0][:40]!r}")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, end + 4


def records_of(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an inflated stream; no more than one and a block is held, and each byte is moved once."""
    data, need = bytearray(), 0
    for chunk in chunks:
        data += chunk
        at = 0
        while len(data) - at > need and (found := split_header(data, at)):
            fields, start = found
            end = start + int(fields["content-length"]) + 4
            if len(data) < end:
                need = end - at - 1
                break
            yield fields, bytes(data[at:end])
            at, need = end, 0
        del data[:at]
    if data:
        raise ValueError("the archive ends within a record")


def inflated(source) -> Iterator[bytes]:
    """A gzip file's content, inflated once from its start, block by block."""
    engine = zlib.decompressobj(31)
    while block := source.read(BLOCK):
        while block:
            yield engine.decompress(block, 4 * BLOCK)
            block = engine.unconsumed_tail
            if engine.eof:
                block, engine = engine.unused_data, zlib.decompressobj(31)
    yield engine.flush()


def write_monolithic(pages: DataFrame, at: str) -> DataFrame:
    """Write one gzip stream for each partition, each row a response.

    Returns ``(archive, seq, page_id, payload_bytes, same)`` for each record,
    ``same`` being the payload's SHA-256.  Each attempt of a task writes an
    archive of its own; that of the attempt whose rows are kept is the one they
    name.
    """

    def run(batches):
        uri = f"{at}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        with AtomicFile(uri) as out:
            engine, seq = zlib.compressobj(1, zlib.DEFLATED, 31), 0
            for batch in batches:
                found: dict[str, list] = {"archive": [uri] * batch.num_rows, "seq": [], "page_id": [], "payload_bytes": [], "same": []}
                for row in zip(*(batch.column(i) for i in range(3)), strict=True):
                    page_id, url, html = (x.as_py() for x in row)
                    payload = (html or "").encode()
                    out.write(engine.compress(record(page_id, url, payload, hashlib.sha1(payload).hexdigest(), None, False)))
                    for k, v in (("seq", seq), ("page_id", page_id), ("payload_bytes", len(payload)), ("same", hashlib.sha256(payload).digest())):
                        found[k].append(v)
                    seq += 1
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(found.values(), kinds, strict=True)], list(found))
            out.write(engine.flush())

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "archive string, seq long, page_id long, payload_bytes long, same binary")


def revisits(records: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """``(archive, known)``: each archive with its revisits' places and targets.

    Of records with equal payloads of ``least_bytes`` or more, that with the
    largest ``page_id`` is the response (all rows that share that id are);
    smaller ones and rows without an id are responses.  Payloads don't move for
    this, and what is gathered is at most an archive's records.
    """
    large = records.where(F.col("payload_bytes") >= least_bytes)
    last = large.groupBy("same").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = large.join(last, "same").where("page_id < last")
    known = again.groupBy("archive").agg(F.collect_list(F.struct("seq", "last")).alias("known"))
    return records.select("archive").distinct().join(known, "archive", "left")


def normalise(archives: DataFrame, at: str) -> DataFrame:
    """Rewrite monolithic archives, one gzip member a record, and index them.

    ``archives`` has their URIs and, in ``known``, which of their records are
    to become revisits of which page.  Each archive is streamed by one task,
    whatever its size; beside the new archive stands its sidecar index, a line
    for each record.  Returns the new archives' URIs and numbers of records;
    archives of attempts that were given up are named nowhere.
    """

    def rewritten(uri: str, targets: dict[int, int]) -> tuple[str, int]:
        fs, path = filesystem(uri)
        new, offset, seq = f"{at}/{uri.rpartition('/')[2].partition('.')[0]}-{uuid.uuid4().hex}.warc.gz", 0, 0
        with fs.open_input_stream(path, compression=None) as source, AtomicFile(new) as out, AtomicFile(f"{new}.idx") as index:
            for fields, data in records_of(inflated(source)):
                page, digest = _page(fields["warc-record-id"]), fields["warc-payload-digest"].partition(":")[2]
                if seq in targets:
                    data = record(page, fields.get("warc-target-uri"), b"", digest, targets[seq], True)
                member = zlib.compressobj(6, zlib.DEFLATED, 31)
                packed = member.compress(data) + member.flush()
                out.write(packed)
                cells = [new, offset, len(packed), page, "revisit" if seq in targets else "response", targets.get(seq), digest]
                index.write(("\t".join("" if x is None else str(x) for x in cells) + "\n").encode())
                offset += len(packed)
                seq += 1
        return new, seq

    def run(batches):
        for batch in batches:
            for uri, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new, n = rewritten(uri, {x["seq"]: x["last"] for x in known or ()})
                yield pa.RecordBatch.from_pydict({"archive": [new], "records": pa.array([n], pa.int64())})

    count = max(1, archives.count())
    return archives.select("archive", "known").repartition(count).mapInArrow(run, "archive string, records long")


def read_index(spark: SparkSession, at: str) -> DataFrame:
    """The sidecar indexes of a folder of normalised archives."""
    return spark.read.schema(INDEX).option("sep", "\t").option("pathGlobFilter", "*.idx").option("quote", "").csv(at)


def read(index: DataFrame) -> DataFrame:
    """Read the records that an index names: ``(page_id, record_type, refers_to, payload, payload_digest)``.

    Every member is inflated by itself.  A digest that doesn't fit its payload
    fails the job.
    """

    def run(batches):
        open_uri, source = None, None
        for batch in batches:
            found: dict[str, list] = {"page_id": [], "record_type": [], "refers_to": [], "payload": [], "payload_digest": []}
            for uri, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if uri != open_uri:
                    fs, path = filesystem(uri)
                    open_uri, source = uri, fs.open_input_file(path)
                source.seek(offset)
                data = zlib.decompress(source.read(length), 31)
                fields, start = split_header(data)
                payload, digest = data[start : start + int(fields["content-length"])], fields["warc-payload-digest"].partition(":")[2]
                revisit = fields["warc-type"] == "revisit"
                if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"{uri} at {offset}: the payload doesn't fit its digest")
                found["page_id"].append(_page(fields["warc-record-id"]))
                found["record_type"].append(fields["warc-type"])
                found["refers_to"].append(_page(fields["warc-refers-to"]) if revisit else None)
                found["payload"].append(None if revisit else payload)
                found["payload_digest"].append(digest)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(found.values(), kinds, strict=True)], list(found))

    return index.select("archive", "offset", "length").mapInArrow(run, "page_id long, record_type string, refers_to long, payload binary, payload_digest string")


def archive_pages(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Write ``pages`` to archives, normalise them and return their index.

    Null html is an empty payload, a null url an empty field, a null id is
    written as such.  Other columns of ``pages`` are ignored, repeated rows are
    repeated records, and an empty table leaves archives without records.
    """
    spark = pages.sparkSession
    raw, at = new_dir(spark, "warc-raw"), new_dir(spark, "warc")
    filesystem(raw)  # fails here rather than in tasks
    records = materialize(write_monolithic(pages, raw), "warc-list")
    archives = materialize(revisits(records, least_bytes), "warc-archives")
    done = materialize(normalise(archives, at), "warc-done")
    remove(spark, raw)
    if not done.agg(F.sum("records")).first()[0]:
        return spark.createDataFrame([], INDEX)
    return read_index(spark, at).join(done.select("archive"), "archive", "left_semi").select(*(c.split()[0] for c in INDEX.split(", ")))


def page_records(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Archive ``pages`` and read every record back.

    ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``; a
    revisit's payload is that of the response it refers to.
    """
    found = read(archive_pages(pages, least_bytes)).select(
        "page_id", F.length("payload").cast("long").alias("payload_bytes"), F.col("payload_digest"), "record_type", "refers_to"
    )
    found = materialize(found, "warc-records")
    of = found.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("full"))
    again = found.where("record_type = 'revisit'").join(of, ["refers_to", "payload_digest"], "left")
    cells = ["page_id", "payload_digest", "record_type", "refers_to"]
    return (
        found.where("record_type = 'response'")
        .select("payload_bytes", *cells)
        .unionByName(again.select(F.col("full").alias("payload_bytes"), *cells))
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    )
