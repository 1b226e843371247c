"""Clusters, trees and embeddings of grouped distance matrices.

Each group is one small matrix; Spark deals the groups out, and a group beyond
the kernels' bound fails rather than being cut.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopweave.kernels import trees


def _matrix(pdf: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    names = sorted(set(pdf["a"]) | set(pdf["b"]))
    at = {x: i for i, x in enumerate(names)}
    d = np.zeros((len(names), len(names)))
    i, j = pdf["a"].map(at).to_numpy(int), pdf["b"].map(at).to_numpy(int)
    d[i, j] = d[j, i] = pdf["dist"].to_numpy(float)
    return names, d


def _grouped(pairs: DataFrame, by: str | None) -> DataFrame:
    return pairs.withColumn("grp", F.col(by).cast("string") if by else F.lit("")).select("grp", "a", "b", F.col("dist").cast("double").alias("dist"))


def cluster(pairs: DataFrame, k: int, method: str = "average", by: str | None = None) -> DataFrame:
    """``(grp, name, cluster)`` of ``k`` clusters by agglomerative linkage of each group's matrix."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, d = _matrix(pdf)
        return pd.DataFrame({"grp": pdf["grp"].iloc[0], "name": names, "cluster": trees.linkage(d, min(k, len(names)), method)})

    return _grouped(pairs, by).groupBy("grp").applyInPandas(run, "grp string, name string, cluster int")


def neighbour_joining(pairs: DataFrame, by: str | None = None) -> DataFrame:
    """``(grp, node, parent, length)``: edges of each group's tree; inner nodes are ``#n``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, d = _matrix(pdf)
        title = lambda i: names[i] if i < len(names) else f"#{i}"
        rows = [(pdf["grp"].iloc[0], title(c), title(p), length) for c, p, length in trees.neighbour_joining(d)]
        return pd.DataFrame(rows, columns=["grp", "node", "parent", "length"])

    return _grouped(pairs, by).groupBy("grp").applyInPandas(run, "grp string, node string, parent string, length double")


def newick(pairs: DataFrame, by: str | None = None) -> DataFrame:
    """``(grp, tree)``: each group's tree as Newick text."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, d = _matrix(pdf)
        return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "tree": [trees.newick(trees.neighbour_joining(d), names)]})

    return _grouped(pairs, by).groupBy("grp").applyInPandas(run, "grp string, tree string")


def scaling(pairs: DataFrame, by: str | None = None, seed: int = 0) -> DataFrame:
    """``(grp, name, mds1, mds2)``: two coordinates of each label that fit the distances."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, d = _matrix(pdf)
        x = trees.smacof(d, seed=seed)
        return pd.DataFrame({"grp": pdf["grp"].iloc[0], "name": names, "mds1": x[:, 0], "mds2": x[:, 1]})

    return _grouped(pairs, by).groupBy("grp").applyInPandas(run, "grp string, name string, mds1 double, mds2 double")


def bootstrap_support(rows: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """``(split, support)``: in which share of trees of resampled columns each split of the tree occurs.

    ``rows`` are aligned, ``(name, seq)``, at least four and at most the kernels'
    bound; every task has them, and draws and builds trees for its replicates.
    """
    aligned = rows.orderBy("name").limit(trees.MOST + 1).collect()
    if not 4 <= len(aligned) <= trees.MOST:
        raise ValueError(f"a bootstrap needs 4 to {trees.MOST} sequences")
    names = [r["name"] for r in aligned]
    cells = np.array([list(r["seq"].upper()) for r in aligned])
    sent = rows.sparkSession.sparkContext.broadcast((names, cells))

    def tree_of(weights: np.ndarray) -> list[str]:
        names, cells = sent.value
        good = ~np.isin(cells, list("-.X?"))
        n = len(names)
        compared = (good * weights) @ good.T.astype(float)
        same = np.zeros((n, n))
        for letter in np.unique(cells[good]):
            has = ((cells == letter) & good).astype(float)
            same += (has * weights) @ has.T
        with np.errstate(divide="ignore", invalid="ignore"):
            d = np.where(compared > 0, 1 - same / compared, 1.0)
        np.fill_diagonal(d, 0.0)
        return ["|".join(names[i] for i in sorted(s)) for s in trees.splits(trees.neighbour_joining(d), n)]

    def run(batches):
        width = sent.value[1].shape[1]
        for pdf in batches:
            found = []
            for rep in pdf["id"]:
                weights = np.ones(width) if rep < 0 else np.random.default_rng([seed, int(rep)]).multinomial(width, np.full(width, 1 / width))
                found += [(int(rep), s) for s in tree_of(weights)]
            yield pd.DataFrame(found, columns=["rep", "split"])

    spark = rows.sparkSession
    trees_of = spark.range(-1, replicates, 1, max(1, min(replicates // 8, 64))).mapInPandas(run, "rep long, split string")
    count = F.sum((F.col("rep") >= 0).cast("int")) / F.lit(float(replicates))
    return trees_of.groupBy("split").agg(F.max((F.col("rep") < 0).cast("int")).alias("own"), count.alias("support")).where("own = 1").drop("own")
