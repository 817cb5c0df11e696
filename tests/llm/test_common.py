import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from plumbline.llm import common

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def _sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "bytes"])


def test_batches_are_small_while_a_table_is_written(spark):
    before = spark.conf.get(KEY)
    long = F.repeat(F.lit("x"), F.when(F.col("id") == 7, 3 * common.BATCH_BYTES).otherwise(20_000).cast("int"))
    texts = spark.range(0, 1000, 1, 1).select(long.alias("text"))
    rows = common.written(texts.mapInArrow(common.lean(_sizes), "rows long, bytes long"), "sizes").collect()
    assert sum(r.rows for r in rows) == 1000 and max(r.bytes for r in rows if r.rows > 8) <= common.BATCH_BYTES * 1.1
    assert max(r.bytes for r in rows) < 4.2 * common.BATCH_BYTES  # the long text, and what stood before it
    assert spark.conf.get(KEY) == before


def test_the_setting_is_put_back_after_an_error_and_a_lower_one_stays(spark):
    before = spark.conf.get(KEY)
    with pytest.raises(ZeroDivisionError), common.small_batches(spark):
        1 / 0
    assert spark.conf.get(KEY) == before
    for own, inside in (("1000", "1000b"), ("64m", f"{common.BATCH_BYTES}b"), ("2k", "2048b")):
        spark.conf.set(KEY, own)
        try:
            with common.small_batches(spark):
                assert spark.conf.get(KEY) == inside
            assert spark.conf.get(KEY) == own
        finally:
            spark.conf.set(KEY, before)


def test_a_task_gives_back_memory_once_it_is_through(monkeypatch):
    seen = []
    monkeypatch.setattr(common, "give_back", lambda: seen.append("back"))
    assert list(common.lean(lambda xs: (seen.append(x) or x for x in xs))([1, 2])) == [1, 2]
    assert seen == [1, 2, "back"]
