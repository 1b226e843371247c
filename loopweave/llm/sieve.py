"""A sieve of bits that spares a join from shuffling what it will drop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a sieve, in groups: at most 16 MB are sent to tasks.
GROUP_BITS, MOST_GROUPS, BITS_PER_KEY = 1 << 15, 1 << 12, 16


def sieved(rows: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """Those of ``rows`` that a join on ``keys`` with ``wanted`` may keep, so that it needn't shuffle all of them.

    Each wanted key sets a bit by its hash.  Rows whose bit is set without
    being wanted stay too; the more there are to be wanted, up to all rows.
    """
    groups = min(MOST_GROUPS, max(1, -(-BITS_PER_KEY * wanted.count() // GROUP_BITS)))
    bit = F.pmod(F.xxhash64(F.lit(7), *keys), F.lit(groups * GROUP_BITS)).cast("int")
    word, at = (bit % GROUP_BITS / 64).cast("int"), bit % 64
    words = wanted.groupBy((bit / GROUP_BITS).cast("int").alias("_group"), word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at)).alias("bits"))
    full = F.map_from_entries(F.collect_list(F.struct("word", "bits")))
    sets = words.groupBy("_group").agg(full.alias("m")).select("_group", F.transform(F.sequence(F.lit(0), F.lit(GROUP_BITS // 64 - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("_bits"))
    marked = rows.withColumn("_at", bit).join(F.broadcast(sets), (F.col("_at") / GROUP_BITS).cast("int") == F.col("_group"))
    return marked.where(F.getbit(F.get("_bits", (F.col("_at") % GROUP_BITS / 64).cast("int")), F.col("_at") % 64) == 1).select(rows.columns)
