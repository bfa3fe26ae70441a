import pytest

from lintlake.sources import tables
from lintlake.streaming import incremental


def test_first_seen_over_many_batches_keeps_null_times_and_keys(spark, tmp_path):
    schema = "pattern_name string, value string, seen_at timestamp"
    rows = [[("a", "1", "2025-01-01 00:00:00"), ("a", "2", None)], [("a", "1", None), (None, "1", None), ("b", None, "1990-01-01 00:00:00")], [("b", None, None), ("c", "3", "2030-01-01 00:00:00"), (None, "1", "2025-01-01 00:00:00")]]
    for i, part in enumerate(rows):
        spark.createDataFrame(part, "pattern_name string, value string, t string").selectExpr("pattern_name", "value", "cast(t as timestamp) as seen_at").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = incremental.document_stream(spark, str(tmp_path / "in" / "*"), spark.createDataFrame([], schema).schema, files_per_batch=1)
    incremental.write_first_seen(stream, ["pattern_name", "value"], str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = [(r.pattern_name, r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got, key=str) == sorted([("a", "1"), ("a", "2"), (None, "1"), ("b", None), ("c", "3")], key=str)
    assert len(list((tmp_path / "out").glob("batch=*"))) == 3


def test_a_cluster_must_name_the_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

        class _jsc:
            sc = staticmethod(lambda: type("J", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))

        getConf = staticmethod(lambda: type("C", (), {"get": staticmethod(lambda k, default: None)}))

    with pytest.raises(RuntimeError):
        tables.ensure_checkpoint_dir(type("S", (), {"sparkContext": Context}))
