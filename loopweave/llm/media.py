"""Media columns kept as content-defined chunks.

A payload is cut where a rolling gear hash of the last 32 bytes has a number of
zero bits at its top, so that equal passages are cut alike wherever they stand.
Writers append each chunk that is new to them to a pack file in the shared
folder; which of the packs' copies of a chunk counts is settled by joining
digests, which are all that is shuffled.  A document is then its ordered list
of chunks.  Reading follows the list, checks each chunk against its digest and
joins them up.

The stored form of a document is a manifest, which has the sample format and
each chunk's digest and size, followed by the chunks as they are stored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopweave.llm.storage import AtomicFile, filesystem, materialize, new_dir

#: Payloads are whole numbers of so many bytes.
UNIT = 64
#: Sizes of chunks: at least, typically (a power of two), at most.
LEAST, BITS, MOST = 512, 11, 16384
#: A pack's place: its number and the offset in it make one number.
OFFSETS = 1 << 40
#: Packs that a reader keeps open.
OPEN_PACKS = 32
_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], np.uint32)
_BLOCK = 1 << 20


def payload_of(text: str | None) -> tuple[bytes, int]:
    """A text's bytes, filled with zeros to a positive multiple of UNIT, and how many are the text's."""
    data = (text or "").encode()
    return data + bytes(-len(data) % UNIT if data else UNIT), len(data)


def cut_points(data: bytes) -> list[int]:
    """Where chunks end."""
    marks = []
    for low in range(0, len(data), _BLOCK):
        before = min(low, 31)
        h = _GEAR[np.frombuffer(data, np.uint8, min(_BLOCK, len(data) - low) + before, low - before)]
        # Doubling: after k rounds each value sums up 2**k bytes, the earlier ones shifted further.
        for k in (1, 2, 4, 8, 16):
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
        marks.append(np.flatnonzero(h[before:] >> np.uint32(32 - BITS) == 0) + low + 1)
    at = np.concatenate(marks)
    out, start = [], 0
    while start < len(data):
        k = np.searchsorted(at, start + LEAST)
        end = min(int(at[k]) if k < len(at) else len(data), start + MOST, len(data))
        out.append(end)
        start = end
    return out


def chunks_of(data: bytes) -> list[bytes]:
    ends = cut_points(data)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def manifest(size: int, chunks: list[tuple[bytes, int]]) -> bytes:
    """The head of a stored form: 8-bit unsigned samples, one channel; then each chunk's digest and size."""
    return struct.pack("<4sHHQI", b"CDC1", 8, 1, size, len(chunks)) + b"".join(d + struct.pack("<I", n) for d, n in chunks)


_CHUNK = "struct<place:long, stored:int, size:int, digest:binary>"
_ARROW_CHUNK = pa.struct([("place", pa.int64()), ("stored", pa.int32()), ("size", pa.int32()), ("digest", pa.binary())])


def write_packs(docs: DataFrame, at: str) -> DataFrame:
    """Chunk each document and write the chunks; ``(row, doc_id, n_bytes, chunks)`` with where they are.

    Each attempt of a task writes a pack of its own, numbered by the attempt, and
    the rows that are kept name the pack that counts, whatever order rows come
    in when a task is run again.  A chunk is written once in a pack; what a task remembers for
    that is a digest for each chunk of its partition.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        part = TaskContext.get().taskAttemptId()
        if part >= 1 << 23:
            raise ValueError("pack numbers have 23 bits; start a new application")
        zstd, known, offset, row = zstandard.ZstdCompressor(level=6), {}, 0, 0
        with AtomicFile(f"{at}/{part}.pack") as out:
            for batch in batches:
                rows, sizes, lists = [], [], []
                for text in batch.column(1):
                    data, n = payload_of(text.as_py())
                    cells = []
                    for chunk in chunks_of(data):
                        digest = hashlib.sha256(chunk).digest()
                        if digest not in known:
                            frame = zstd.compress(chunk)
                            out.write(frame)
                            known[digest] = (part * OFFSETS + offset, len(frame))
                            offset += len(frame)
                        place, stored = known[digest]
                        cells.append({"place": place, "stored": stored, "size": len(chunk), "digest": digest})
                    rows.append(part * OFFSETS + row)
                    sizes.append(n)
                    lists.append(cells)
                    row += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows, pa.int64()), batch.column(0), pa.array(sizes, pa.int64()), pa.array(lists, pa.list_(_ARROW_CHUNK))], ["row", "doc_id", "n_bytes", "chunks"]
                )

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"row long, doc_id {kind}, n_bytes long, chunks array<{_CHUNK}>")


def settle_chunks(written: DataFrame) -> DataFrame:
    """``written`` with each chunk at the one place that counts: the first that any pack has it at.

    A pack has a digest once, so neither the digests' groups nor the join meets
    a common chunk more often than there are packs.
    """
    refs = written.select("row", "doc_id", "n_bytes", F.posexplode("chunks").alias("nth", "c")).select("row", "doc_id", "n_bytes", "nth", "c.*")
    index = refs.groupBy("digest", "place").agg(F.first("stored").alias("stored"))
    index = materialize(index, "chunk-index")
    first = index.groupBy("digest").agg(F.min("place").alias("first"), F.count("*").alias("packs")).where("packs > 1").drop("packs")
    moved = index.join(first, "digest").where("place <> first").select("place", "first")
    stored = index.select(F.col("place").alias("first"), "stored")
    moved = materialize(moved.join(stored, "first").select("place", "first", F.col("stored").alias("now")), "chunks-moved")
    refs = refs.join(moved, "place", "left")
    chunk = F.struct("nth", F.coalesce("first", "place").alias("place"), F.coalesce("now", "stored").alias("stored"), "size", "digest")
    dealt = refs.select("row", F.shiftrightunsigned("row", 40).alias("pack"), "doc_id", "n_bytes", chunk.alias("chunk")).repartition("pack")
    return dealt.groupBy("pack", "row").agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.array_sort(F.collect_list("chunk")).alias("chunks"))


class Packs:
    """Reads places of a folder's packs; a few packs stay open."""

    def __init__(self, at: str):
        self.at, self.files = at, OrderedDict()

    def read(self, place: int, stored: int) -> bytes:
        part, offset = divmod(place, OFFSETS)
        if part not in self.files:
            if len(self.files) >= OPEN_PACKS:
                self.files.popitem(last=False)[1].close()
            fs, path = filesystem(f"{self.at}/{part}.pack")
            self.files[part] = fs.open_input_file(path)
        self.files.move_to_end(part)
        file = self.files[part]
        file.seek(offset)
        return file.read(stored)


def sample_features(data: bytes, chunks: int) -> str:
    """Statistics of 8-bit samples."""
    of = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = of[of > 0] / len(data)
    values = np.flatnonzero(of)
    return f"chunks={chunks};min={values[0]};max={values[-1]};mean={(of @ np.arange(256)) / len(data):.6f};entropy={abs(float(-(p * np.log2(p)).sum())):.6f}"


RESULT = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_media(settled: DataFrame, at: str) -> DataFrame:
    """Read each document's chunks back, check them, and describe payload and stored form."""
    kind = settled.schema["doc_id"].dataType.simpleString()

    def run(batches):
        packs, zstd = Packs(at), zstandard.ZstdDecompressor()
        for batch in batches:
            found: list[list] = [[] for _ in range(7)]
            for n_bytes, cells in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                frames = [packs.read(c["place"], c["stored"]) for c in cells]
                parts = [zstd.decompress(f) for f in frames]
                for c, part in zip(cells, parts, strict=True):
                    if hashlib.sha256(part).digest() != c["digest"]:
                        raise ValueError(f"the chunk at {c['place']} doesn't fit its digest")
                data = b"".join(parts)
                head = manifest(len(data), [(c["digest"], c["size"]) for c in cells])
                media = hashlib.sha256(head)
                for frame in frames:
                    media.update(frame)
                row = (n_bytes, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(head) + sum(map(len, frames)), media.hexdigest(), sample_features(data, len(cells)))
                for column, v in zip(found, row, strict=True):
                    column.append(v)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(found, kinds, strict=True))], ["doc_id", *names])

    return settled.select("doc_id", "n_bytes", "chunks").mapInArrow(run, f"doc_id {kind}, {RESULT}")


def media_report(docs: DataFrame) -> DataFrame:
    """Store every row's text as media, read it back, and return a row for each.

    A null text is empty, and an empty one is UNIT zero bytes.  Equal texts give
    equal values.  Rows without a ``doc_id`` and repeated rows are stored as any
    other; other columns are ignored.
    """
    at = new_dir(docs.sparkSession, "media")
    filesystem(at)  # fails here rather than in tasks
    written = materialize(write_packs(docs, at), "media-written")
    return read_media(settle_chunks(written), at)
