"""Arrow batches of the pipeline's stages and of the Python helpers stay small."""

import pyarrow as pa

from cohortlab.llm import common


def test_slices_hold_every_row_once():
    batches = [pa.RecordBatch.from_pydict({"a": list(range(n))}) for n in (0, 1, 2500)]
    cut = list(common.slices(batches))
    assert max(b.num_rows for b in cut) <= 1000
    assert [x for b in cut for x in b.column(0).to_pylist()] == [0, *range(2500)]


def test_pipeline_stages_hand_over_small_batches(spark):
    import corpus_pipeline
    keys = [f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = [spark.conf.get(k) for k in keys]
    try:
        spark.conf.set(keys[0], "10000")
        spark.conf.set(keys[1], str(64 << 20))
        docs = spark.createDataFrame([(i, f"text {i}") for i in range(2100)], "doc_id long, text string").coalesce(1)
        stage = corpus_pipeline._stage(lambda s, d, _: d.mapInArrow(
            lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long"))
        sizes = [r["n"] for r in stage(spark, docs, "").collect()]
        assert sum(sizes) == 2100 and max(sizes) <= common.ARROW_ROWS
        assert int(spark.conf.get(keys[1]).rstrip("bB")) == common.ARROW_BYTES
        spark.conf.set(keys[0], "10")
        common.small_batches(spark)
        assert spark.conf.get(keys[0]) == "10"
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)
