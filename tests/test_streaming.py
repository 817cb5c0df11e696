from plumbline.sources.tables import MEASUREMENTS
from plumbline.streaming import ingest


def test_each_file_is_read_once(spark, tmp_path):
    def put(name, ys):
        spark.createDataFrame([("T_Ki", "T", "Ki", f"m{i}", "s", "d", "a", 2000, y) for i, y in enumerate(ys)], MEASUREMENTS).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    source, out, at = str(tmp_path / "in" / "*"), str(tmp_path / "out"), str(tmp_path / "check")
    put("one", [1.0, None])
    for _ in range(2):
        ingest.append(ingest.arrivals(spark, source), out, at)
    assert spark.read.parquet(out).count() == 1
    put("two", [2.0, 3.0])
    ingest.append(ingest.arrivals(spark, source), out, at)
    assert sorted(r.y for r in spark.read.parquet(out).collect()) == [1.0, 2.0, 3.0]
