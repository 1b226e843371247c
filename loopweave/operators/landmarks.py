"""Scaling of any number of rows by their distances to a panel of landmarks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the panel, whatever the table's size.
LANDMARKS = 200


@dataclass
class Panel:
    """Landmarks' vectors, the mean of their squared distances, and what turns squared distances into coordinates."""

    vectors: np.ndarray
    mean: np.ndarray
    turn: np.ndarray

    def place(self, x: np.ndarray, cosine: bool) -> np.ndarray:
        return -0.5 * (squared(x, self.vectors, cosine) - self.mean) @ self.turn.T


def squared(x: np.ndarray, y: np.ndarray, cosine: bool) -> np.ndarray:
    """Squared distances of rows, Euclidean, or one less the cosine; a row of zeros has cosine 0 with all."""
    if cosine:
        unit = lambda v: v / np.where((n := np.sqrt((v * v).sum(axis=1))) > 0, n, 1)[:, None]
        return (1 - np.clip(unit(x) @ unit(y).T, -1, 1)) ** 2
    return np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * x @ y.T + (y * y).sum(axis=1))


def panel_of(vectors: np.ndarray, dims: int, cosine: bool) -> Panel:
    """Classical scaling of the landmarks; axes beyond those that their distances have are zero.

    An axis' sign is that of its largest coordinate, made positive.
    """
    d = squared(vectors, vectors, cosine)
    mean = d.mean(axis=0)
    values, axes = np.linalg.eigh(-0.5 * (d - mean[None, :] - mean[:, None] + d.mean()))
    order = np.argsort(values)[::-1][:dims]
    turn = np.zeros((dims, len(vectors)))
    for k, i in enumerate(order):
        if values[i] > 1e-9 * max(1e-300, values[order[0]]):
            axis = axes[:, i] * np.sign(axes[np.argmax(np.abs(axes[:, i])), i])
            turn[k] = axis / np.sqrt(values[i])
    return Panel(vectors, mean, turn)


def landmark_scaling(rows: DataFrame, dims: int = 2, cosine: bool = False, landmarks: int = LANDMARKS, seed: int = 0) -> DataFrame:
    """``(name, x1, x2, ...)``: coordinates of rows ``(name, vec)`` that fit their distances.

    The landmarks are the rows with the least hashes of ``name``; their
    distances are the one matrix that is scaled, and each row is then placed by
    its distances to them, where it lies, without a shuffle.  Distances that
    ``dims`` dimensions hold exactly come back exactly, if the landmarks span
    them.  Rows whose vector is null or holds null or no finite numbers have
    null coordinates; vectors of different lengths are an error.
    """
    good = F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    typed = rows.select("name", F.col("vec").cast("array<double>").alias("vec"))
    typed = typed.select("name", F.when(good, F.col("vec")).alias("vec"))
    some = typed.where("vec is not null").orderBy(F.xxhash64(F.col("name").cast("string"), F.lit(seed)), "name", "vec").limit(landmarks).select("vec").toPandas()
    widths = sorted(map(len, some["vec"]))
    if widths and widths[0] != widths[-1]:
        raise ValueError(f"a vector doesn't have {widths[-1]} numbers but {widths[0]}")
    names = [f"x{k + 1}" for k in range(dims)]
    kind = rows.schema["name"].dataType.simpleString()
    sent = rows.sparkSession.sparkContext.broadcast(panel_of(np.vstack(some["vec"].to_list()), dims, cosine) if len(some) else None)

    def run(batches):
        for batch in batches:
            vectors = batch.column(1)
            whole = vectors.drop_null()
            out = np.full((batch.num_rows, dims), np.nan)
            if len(whole):
                at = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
                width = sent.value.vectors.shape[1]
                if set(whole.value_lengths().to_pylist()) != {width}:
                    raise ValueError(f"a vector doesn't have {width} numbers")
                out[at] = sent.value.place(whole.flatten().to_numpy(zero_copy_only=False).reshape(len(at), width), cosine)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, from_pandas=True) for c in out.T)], ["name", *names])

    return typed.mapInArrow(run, f"name {kind}, " + ", ".join(f"{c} double" for c in names))
