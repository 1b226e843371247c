import gzip
import hashlib
import json
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loopweave.llm import media, urlfilter, warc
from loopweave.llm.queries import RULES
from loopweave.llm.storage import filesystem, new_dir


def test_warc_round_trip(spark):
    big = "ä" * 600
    rows = [(1, "http://a/\r\nx", big), (2, "u", big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", "y" * 5_000_000), (3, None, big), (None, "u", big)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, archive string").repartition(3)
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.page_records(df).collect()), key=str)
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        again = html == big and page is not None and page < 3
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 3 if again else None))
    assert got == sorted(want, key=str)


def test_every_member_stands_alone(spark):
    df = spark.createDataFrame([(i, f"http://x/{i}", "body %d" % i * 50) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    for r in warc.archive_pages(df).collect():
        fs, path = filesystem(r["archive"])
        with fs.open_input_file(path) as f:
            f.seek(r["offset"])
            data = gzip.decompress(f.read(r["length"]))
        fields, at = warc.split_header(data)
        assert fields["warc-type"] == "response" and data[at:-4] == (b"body %d" % r["page_id"]) * 50


def test_monolithic_stream_is_read_record_by_record():
    records = [warc.record(i, "u", b"x" * (i * 1000), "d", None, False) for i in range(50)]
    squeezed = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = squeezed.compress(b"".join(records)) + squeezed.flush()
    import io

    assert [d for _, d in warc.records_of(warc.inflated(io.BytesIO(data)))] == records
    with pytest.raises(ValueError):
        list(warc.records_of(iter([records[3][:-7]])))


def test_empty_tables(spark):
    assert warc.page_records(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert urlfilter.url_verdicts(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0
    assert media.media_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


URLS = [
    (1, "http://A.Example.COM/en/1", ("a.example.com", "/en/1", "example.com/en/", "block")),
    (2, "https://www.example.com/en/?q", ("www.example.com", "/en/", "www.example.com/en/", "allow")),
    (3, "https://x.www.example.com/fr/", ("x.www.example.com", "/fr/", "com/", "allow")),
    (4, "http://notexample.com/en/", ("notexample.com", "/en/", "com/", "allow")),
    (5, "http://example.net/es/a#b", ("example.net", "/es/a", "net/es/", "block")),
    (6, "http://example.net/ess", ("example.net", "/ess", None, "allow")),
    (7, "http://example.com", ("example.com", "", None, "allow")),
    (8, None, ("", "", None, "allow")),
    (9, "no scheme", ("", "", None, "allow")),
    (10, "http:///en/", ("", "/en/", None, "allow")),
    (11, "http://net?x=/es/", ("net", "", None, "allow")),
    (12, "a://b.com/://c.net/es/", ("b.com", "/://c.net/es/", "com/", "allow")),
]


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u, _ in URLS], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.url_verdicts(df, RULES).collect()}
    assert got == {i: w for i, _, w in URLS}


def test_cascade_is_exact_over_its_universe(spark):
    keys = [f"k{i}" for i in range(20_000)]
    listed = keys[::7]
    hashed = spark.createDataFrame([(k,) for k in keys], "k string").select(urlfilter.key_hash(F.col("k")).alias("key"))
    cascade = urlfilter.build_cascade(hashed, listed)
    values = np.array([r["key"] for r in hashed.collect()], np.int64).view(np.uint64)
    assert len(cascade.levels) > 1
    assert cascade.has(values).tolist() == [k in set(listed) for k in keys]
    with pytest.raises(ValueError):
        urlfilter.build_cascade(hashed, listed, max_bytes=100)


def test_levels_stay_small_however_many_keys(spark):
    keys = spark.range(3_000_000).select(F.xxhash64("id").alias("key"))
    listed = ["example.com/"]
    cascade = urlfilter.build_cascade(keys.unionByName(spark.createDataFrame([(x,) for x in listed], "k string").select(urlfilter.key_hash(F.col("k")).alias("key"))), listed)
    assert cascade.bytes() < 2000
    assert keys.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [int(cascade.has(b.column(0).to_numpy().view(np.uint64)).sum())]}) for b in batches), "n long").agg(F.sum("n")).first()[0] == 0


def test_many_small_records_and_a_large_one():
    some = [warc.record(i, "u", b"x" * (i % 50), "d", None, False) for i in range(100_000)] + [warc.record(1, "u", b"y" * 30_000_000, "d", None, False)]
    whole = b"".join(some)
    start = time.time()
    got = [data for _, data in warc.records_of(whole[i : i + (4 << 20)] for i in range(0, len(whole), 4 << 20))]
    assert got == some and time.time() - start < 20
    with pytest.raises(ValueError):
        list(warc.records_of([whole[:-1]]))


def test_media_round_trip(spark):
    texts = [None, "", "a" * 64, "b" * 63, "é" * 100_000, "shared passage " * 900 + "x", "y" + "shared passage " * 900, "\x00"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, "a" * 64), (None, "b" * 63), (3, "b" * 63)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row long").repartition(3)
    got = media.media_report(df).collect()
    by_text = {}
    assert len(got) == len(rows)
    known = dict(rows)
    for r in got:
        text = (known[r["doc_id"]] or "").encode()
        data = text + bytes(-len(text) % 64 if text else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        assert by_text.setdefault(text, (r["media_bytes"], r["media_sha256"], r["feature"])) == (r["media_bytes"], r["media_sha256"], r["feature"])


def test_chunks_follow_the_content():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 3_000_000, dtype=np.uint8).tobytes()
    parts = media.chunks_of(data)
    assert b"".join(parts) == data
    assert max(map(len, parts)) <= media.MOST and min(map(len, parts[:-1])) >= media.LEAST
    moved = set(media.chunks_of(b"some bytes before" + data))
    assert sum(p in moved for p in parts) > 0.99 * len(parts)


def test_feature_names_are_stable():
    assert media.sample_features(bytes(64), 1) == "chunks=1;min=0;max=0;mean=0.000000;entropy=0.000000"
    assert json.dumps(media.payload_of("ab")[1]) == "2"


def test_new_dirs_differ(spark):
    assert new_dir(spark, "x") != new_dir(spark, "x")
