"""Near-duplicate vectors by cross-polytope hashing.

A vector is turned by pseudo-random rotations (three rounds of sign flips and a
fast Hadamard transform each) and hashed to the signed axis that it is nearest
to (Andoni et al., 2015).  Each table puts a vector into the buckets of its
PROBES nearest axes, so that one close to a border meets those on either side.
Tables of large corpora join up several hashes, so that a bucket keeps about
MEMBERS members.  All pairs of a bucket are compared by cosine, block by block;
what leaves a block is a count for each vector and enough links to connect
them, not the pairs.  Equal vectors are compared once, as one class.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopweave.llm.components import connected_components
from loopweave.llm.storage import materialize

#: Tables of one hash, axes that a hash gives, and members that a bucket is to have.
TABLES, PROBES, MEMBERS = 6, 2, 64
#: Members of a block: a bucket of m sends each vector m / BLOCK times.
BLOCK = 2048


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of rows whose length is a power of two."""
    h = 1
    while h < x.shape[1]:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(x.shape)
        h *= 2
    return x / math.sqrt(x.shape[1])


def nearest_axes(x: np.ndarray, seed: int, probes: int = PROBES) -> np.ndarray:
    """The signed axes that rows are nearest to after the rotation of ``seed``."""
    size = 1 << max(0, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), size))
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng(seed)
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], size))
    axes = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :probes]
    return 2 * axes + (np.take_along_axis(y, axes, 1) > 0)


def codes_of(x: np.ndarray, hashes: int, tables: int, probes: int = PROBES) -> np.ndarray:
    """A row's buckets: an array (rows, tables, probes ** hashes)."""
    out = []
    for table in range(tables):
        axes = [nearest_axes(x, 1000 * table + k, probes) for k in range(hashes)]
        base = 2 << max(0, (x.shape[1] - 1).bit_length())
        mixes = [sum(axes[k][:, p] * base**k for k, p in enumerate(ps)) for ps in product(range(min(probes, axes[0].shape[1])), repeat=hashes)]
        out.append(np.stack(mixes, axis=1))
    return np.stack(out, axis=1)


def plan(n: int, axes: int, hashes: int | None = None) -> tuple[int, int]:
    """Hashes of a table, and tables, for groups of up to ``n`` vectors; more tables make up for more hashes."""
    hashes = hashes or max(1, math.ceil(math.log(max(n, 1) / MEMBERS) / math.log(axes))) if n > MEMBERS else 1
    return hashes, TABLES + 2 * (hashes - 1)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` nodes the smallest node that links ``a``-``b`` connect it with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def bucket_codes(x: np.ndarray, hashes: int, tables: int) -> np.ndarray:
    """:func:`codes_of`, with as many codes in each table whatever the dimension."""
    codes, most = codes_of(x, hashes, tables), PROBES**hashes
    return np.concatenate([codes] + [codes[:, :, -1:]] * (most - codes.shape[2]), axis=2) if codes.shape[2] < most else codes


def _compare(threshold: float, hashes: int, tables: int):
    def run(group: pa.Table) -> pa.Table:
        table, code, i, j = (group.column(c)[0].as_py() for c in ("tab", "code", "i", "j"))
        block = group.column("block").to_numpy()
        ids, n = group.column("cid").to_numpy(), group.column("n").to_numpy()
        x = group.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).astype(np.float64)
        order = np.argsort(ids, kind="stable")
        ids, n, x, block = ids[order], n[order], x[order], block[order]
        unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for low in range(0, len(left), 512):
            p, q = np.nonzero(unit[left[low : low + 512]] @ unit[right].T >= threshold)
            p += low
            a.append(left[p] if i != j else left[p[p < q]])
            b.append(right[q] if i != j else right[q[p < q]])
        a, b = np.concatenate(a), np.concatenate(b)
        # A pair counts in the first bucket that its vectors share: that of the lowest table, then code.
        some, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        codes = bucket_codes(x[some], hashes, tables) if len(some) else np.zeros((0, tables, 1), np.int64)
        counted = np.ones(len(a), bool)
        for low in range(0, len(a), 1 << 15):
            high = min(low + (1 << 15), len(a))
            ca, cb = codes[at[low:high]], codes[at[len(a) + low : len(a) + high]]
            shared = (ca[:, : table + 1, :, None] == cb[:, : table + 1, None, :]).any(axis=3)
            own = np.where(shared[:, table], ca[:, table], np.iinfo(np.int64).max).min(axis=1) == code
            counted[low:high] = own & ~shared[:, :table].any(axis=(1, 2))
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, a[counted], n[b[counted]])
        np.add.at(links, b[counted], n[a[counted]])
        root = forest(a, b, len(ids))
        told = (links > 0) | (root != np.arange(len(ids)))
        return pa.table({"cid": ids[told], "links": links[told], "root": ids[root][told]})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, hashes: int | None = None) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, a row for each row of ``vectors``.

    Vectors are compared if their labels are equal and not null and they have
    equally many components.  Null and zero vectors, and those with null or
    non-finite components, link with nothing and are their own component; so is
    a row without a ``vec_id``, which isn't compared.  Repeated rows are vectors
    of their own.  Other columns are ignored.  ``hashes`` is the number of hashes
    that a table joins up; by default it follows from the number of vectors.
    """
    v = F.transform("embedding", lambda c: c.cast("double"))
    good = F.coalesce(
        (F.size(v) > 0)
        & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        & F.exists(v, lambda c: c != 0)
        & F.col("label").isNotNull()
        & F.col("vec_id").isNotNull(),
        F.lit(False),
    )
    # Very large and very small vectors are scaled, so that squares neither overflow nor vanish.
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.when(good, v).alias("vec"))
    top = F.array_max(F.transform("vec", lambda c: F.abs(c)))
    rows = rows.withColumn("vec", F.when((top > 1e100) | (top < 1e-100), F.transform("vec", lambda c: c / top)).otherwise(F.col("vec")))
    rows = rows.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")})
    keys = ["label", "h1", "h2"]
    usable = rows.where("vec is not null")
    classes = usable.groupBy(*keys).agg(F.min("vec_id").alias("cid"), F.count("*").alias("n"), F.min_by("vec", "vec_id").alias("vec"))
    classes = materialize(classes, "vector-classes")
    shape = classes.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).agg(F.max("n"), F.max("d")).first()
    most, d = shape[0] or 0, shape[1] or 1
    hashes, tables = plan(most, 2 << max(0, (d - 1).bit_length()), hashes)
    per_table = PROBES**hashes

    def encode(batches):
        for batch in batches:
            vecs = batch.column(batch.schema.get_field_index("vec"))
            sizes = vecs.value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                x = part.column(batch.schema.get_field_index("vec")).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, int(size))
                codes = bucket_codes(x, hashes, tables)
                flat = codes.reshape(part.num_rows, -1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, flat.shape[1]), pa.int32()), pa.array(flat.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "codes"])

    cells = "label long, h1 long, h2 long, cid long, n long, vec array<double>"
    coded = materialize(classes.select(*keys, "cid", "n", "vec").mapInArrow(encode, f"{cells}, codes array<long>"), "vector-codes")
    named = F.flatten(
        F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.transform(F.array_distinct(F.slice("codes", t * per_table + 1, per_table)), lambda c: F.struct(t.alias("tab"), c.alias("code"))))
    )
    bucket = ["label", "dim", "tab", "code"]
    posted = coded.select("label", F.size("vec").alias("dim"), "cid", F.explode(named).alias("b")).select("label", "dim", "b.tab", "b.code", "cid")
    sizes = posted.groupBy(*bucket).agg(F.count("*").alias("m")).where("m > 1")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = posted.join(sizes, bucket).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks").cast("long")).cast("int"))
    # A block is compared with itself and with each other block of its bucket.
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    dealt = dealt.select(*bucket, "cid", "block", F.explode(pairs).alias("p")).select(*bucket, "cid", "block", "p.i", "p.j")
    members = dealt.join(coded.select("cid", "n", "vec"), "cid")
    found = members.groupBy(*bucket, "i", "j").applyInArrow(_compare(threshold, hashes, tables), "cid long, links long, root long")
    found = materialize(found, "vector-links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    joined = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    known = classes.select(*keys, "cid", "n").join(links, "cid", "left").join(joined.withColumnRenamed("node", "cid"), "cid", "left")
    known = known.select(*keys, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component_id"))
    done = usable.select("vec_id", *keys).join(known, keys).select("vec_id", "n_links", "component_id")
    alone = rows.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
