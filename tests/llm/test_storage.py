import pyarrow as pa

from loopweave.llm import storage


def test_long_texts_reach_python_in_batches_of_a_few_megabytes(spark):
    def widest(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    texts = spark.range(0, 3000, 1, 1).selectExpr("repeat(cast(id % 10 as string), if(id = 7, 9000000, 10000)) AS text")
    sizes = storage.materialize(texts.mapInArrow(widest, "n long, size long"), "sizes").collect()
    assert sum(r["n"] for r in sizes) == 3000
    assert max(r["size"] for r in sizes) < 9_000_000 + 5_000_000 and sorted(r["size"] for r in sizes)[-2] < 5_000_000


def test_the_limit_is_the_session_s_own_if_it_has_one(spark):
    with storage.small_batches(spark):
        assert spark.conf.get(storage.BATCH_KEY) == storage.BATCH
    assert storage.BATCH_KEY not in spark.conf.getAll
    spark.conf.set(storage.BATCH_KEY, "1m")
    try:
        with storage.small_batches(spark):
            assert spark.conf.get(storage.BATCH_KEY) == "1m"
        assert spark.conf.get(storage.BATCH_KEY) == "1m"
    finally:
        spark.conf.unset(storage.BATCH_KEY)
