import random

import pytest

from loopweave.operators import clustering, models
from loopweave.plans import model_queries as Q


@pytest.mark.parametrize("cosine", [False, True])
def test_kmeans(spark, cosine):
    rng = random.Random(2)
    centres = [(0.1, 0.9), (0.5, 0.5), (0.9, 0.1)]
    rows = [(i, [c + rng.uniform(-0.03, 0.03) for c in centres[i % 3]]) for i in range(60)]
    points = spark.createDataFrame(rows, "id int, vec array<double>")
    got = {r["id"]: r["label"] for r in clustering.kmeans(points, 3, range(4), cosine).collect()}
    assert got == {i: i % 3 for i in range(60)}
    with pytest.raises(ValueError):
        clustering.kmeans(points.limit(2), 3)


@pytest.mark.parametrize("query, seeds, spherical", [("C1_kmeans_windows", 20, False), ("C2_spherical_kmeans", 5, True)])
def test_all_windows_are_clustered_with_the_references_parameters(spark, monkeypatch, tmp_path, query, seeds, spherical):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (730, 260, 51, 0)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    once = models.fit

    def fit(seqs, some, *args, **more):
        seen.extend(some)
        return once(seqs, some[:2], passes=3)

    monkeypatch.setattr(models, "fit", fit)
    rows = getattr(Q, query)(spark, str(tmp_path)).collect()
    assert seen == [models.Model(4, 250, 50, 8, s, spherical) for s in range(seeds)]
    assert {(r["name"], r["start"]) for r in rows} == {(str(i), s) for i, t in enumerate(texts) for s in range(0, len(t), 50)}
    assert {r["label"] for r in rows} <= set(range(8))
