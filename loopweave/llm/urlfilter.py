"""URL rules held in a Bloom filter cascade.

Rules name a host and a path; a rule is the key ``host/path``.  A URL's
candidate keys are its host's suffixes with its path's prefixes.  For each
verdict a cascade says whether a candidate key is listed: level 0 is a Bloom
filter of the listed keys, level 1 one of the keys of the corpus that pass
level 0 without being listed, level 2 one of the listed keys that pass level
1, and so on, until a level passes no key wrongly.  The levels are made over
all candidate keys that the corpus has, so for each of them the answer is
exact, and looking up needs no join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopweave.llm.storage import materialize

#: Share of keys that pass a level wrongly, from the second level on.
WRONG = 0.01
#: The fewest bits of a level.
LEAST_BITS = 1024
#: The bytes that all levels of a cascade may have: what is sent to every task.
MAX_BYTES = 64 << 20


class Bloom:
    """A Bloom filter of ``n`` 64-bit keys that hash well already; of others a share of ``wrong`` passes."""

    def __init__(self, n: int, salt: int, wrong: float = WRONG):
        self.hashes = max(1, math.ceil(-math.log2(wrong)))
        self.size = max(LEAST_BITS, math.ceil(1.45 * self.hashes * n) + 7 & ~7)
        self.salt = np.uint64((salt * 0x9E3779B97F4A7C15 + 1) % 2**64)
        self.bits = np.zeros(self.size // 8, np.uint8)

    def _at(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (keys ^ self.salt) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
            y = (x * np.uint64(0x94D049BB133111EB)) | np.uint64(1)
            z = x + np.arange(self.hashes, dtype=np.uint64)[:, None] * y
            # Mixed once more, as steps of one width fall together in small filters.
            return (((z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(16)) % np.uint64(self.size)

    def add(self, keys: np.ndarray) -> None:
        at = self._at(keys).ravel()
        np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = self._at(keys)
        found = self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1
        return found.all(axis=0)


@dataclass
class Cascade:
    """Levels of filters; a key is listed if the first level that lacks it is odd."""

    levels: list[Bloom]

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), len(self.levels) % 2 == 1)
        left = np.arange(len(keys))
        for depth, level in enumerate(self.levels):
            passed = level.has(keys[left])
            out[left[~passed]] = depth % 2 == 1
            left = left[passed]
        return out

    def bytes(self) -> int:
        return sum(len(x.bits) for x in self.levels)


def key_hash(key: Column) -> Column:
    """The 64-bit key of ``host/path`` text."""
    return F.xxhash64(key)


def _split(rules: Sequence[tuple[str, str]]) -> list[tuple[str, str, str]]:
    """Verdict, host and path of rules ``(verdict, 'host/path')``; the path keeps its slash."""
    return [(v, r.partition("/")[0].lower(), "/" + r.partition("/")[2]) for v, r in rules]


def parse(pages: DataFrame) -> DataFrame:
    """``pages`` with ``host`` and ``path``; both empty without a ``://``."""
    rest = F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumns({"host": host, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def candidates(rules: Sequence[tuple[str, str]]) -> Column:
    """A URL's candidate keys, the longest first, for paths as long as the rules have."""
    lengths = sorted({len(path) for _, _, path in _split(rules)}, reverse=True)
    parts = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    paths = F.filter(
        F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths)), lambda x: x.isNotNull()
    )
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))
    longest = F.array_sort(keys, lambda a, b: F.length(b) - F.length(a))
    return F.when(F.col("host") != "", longest).otherwise(F.array().cast("array<string>"))


def build_cascade(keys: DataFrame, listed: Sequence[str], max_bytes: int = MAX_BYTES) -> Cascade:
    """The cascade of ``listed`` keys over the column ``key`` (hashes) of ``keys``.

    Level 0 is made from the list, with so many bits a key that about as many
    keys of the corpus pass it wrongly as are listed, however many there are:
    their number is estimated first.  One pass over the corpus finds the keys
    that pass, grouped as they are found, so neither the universe nor a hot key
    is gathered; the number of those that aren't listed is checked against the
    bound before they are fetched.
    """
    spark = keys.sparkSession
    if not listed:
        return Cascade([])
    hashes = spark.createDataFrame([(x,) for x in listed], "k string").select(key_hash(F.col("k")).alias("key")).distinct()
    held = np.array([r[0] for r in hashes.collect()], np.int64).view(np.uint64)
    universe = keys.agg(F.approx_count_distinct("key", 0.05)).first()[0]
    levels = [Bloom(len(held), 0, min(WRONG, len(held) / max(1, universe)))]
    levels[0].add(held)
    filter_ = spark.sparkContext.broadcast(levels[0])

    def passing(batches):
        for batch in batches:
            x = np.unique(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(x[filter_.value.has(x)].view(np.int64))], ["key"])

    passed = keys.select("key").mapInArrow(passing, "key long").groupBy("key").agg(F.lit(0).alias("listed"))
    both = passed.unionByName(hashes.select("key", F.lit(1).alias("listed"))).groupBy("key").agg(F.max("listed").alias("listed"))
    wrong = materialize(both.where("listed = 0").select("key"), "false-positives")
    n = wrong.count()
    if levels[0].size // 8 + 2 * (n + len(held)) > max_bytes:
        raise ValueError(f"{len(held)} listed keys and {n} false positives need more than {max_bytes} bytes; split the list")
    others = wrong.toArrow().column(0).to_numpy().view(np.uint64)
    while len(others):
        level = Bloom(len(others), len(levels))
        level.add(others)
        levels.append(level)
        held, others = others, held[level.has(held)]
    return Cascade(levels)


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str]], default: str = "allow") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for each row of ``pages``.

    ``rules`` are pairs of a verdict and ``host/path``; a rule fits its host
    and all subdomains if the URL's path starts with the rule's, and the longest
    that fits wins.  Without one ``rule`` is null and the verdict ``default``.
    A null URL, or one without ``://``, has an empty host and path and fits no
    rule.  Other columns are ignored; repeated rows each get a row.
    """
    verdicts = sorted({v for v, _ in rules})
    rows = parse(pages.select("page_id", F.col("url").cast("string"))).drop("url").withColumn("names", candidates(rules))
    rows = rows.withColumn("keys", F.transform("names", key_hash))
    universe = rows.select(F.explode("keys").alias("key"))
    cascades = [build_cascade(universe, [h + p for v, h, p in _split(rules) if v == verdict]) for verdict in verdicts]
    sent = pages.sparkSession.sparkContext.broadcast(cascades)

    def look_up(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("keys"))
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            starts = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))[: batch.num_rows]
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            hit, which = np.zeros(batch.num_rows, np.int32), np.full(batch.num_rows, -1, np.int32)
            best = np.full(batch.num_rows, len(flat) + 1, np.int64)
            for k, cascade in enumerate(sent.value):
                at = np.flatnonzero(cascade.has(flat)) if len(flat) else np.zeros(0, np.int64)
                rows_hit, first = np.unique(owner[at], return_index=True)
                sooner = at[first] < best[rows_hit]
                best[rows_hit[sooner]] = at[first][sooner]
                hit[rows_hit[sooner]] = (at[first] - starts[rows_hit] + 1)[sooner]
                which[rows_hit[sooner]] = k
            named = pa.array([verdicts[k] if k >= 0 else default for k in which], pa.string())
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "host", "path", "names")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(hit), named], ["page_id", "host", "path", "names", "hit", "verdict"])

    kind = pages.schema["page_id"].dataType.simpleString()
    judged = rows.select("page_id", "host", "path", "names", "keys").mapInArrow(
        look_up, f"page_id {kind}, host string, path string, names array<string>, hit int, verdict string"
    )
    rule = F.when(F.col("hit") > 0, F.try_element_at("names", F.col("hit")))
    return judged.select("page_id", "host", "path", rule.alias("rule"), "verdict")
