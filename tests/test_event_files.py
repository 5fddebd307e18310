from datetime import datetime, timedelta

from quillstone import registry


def test_thirds_of_events_are_written_by_all_cores(spark, tmp_path, monkeypatch):
    rows = [(i, datetime(2024, 3, 1) + timedelta(hours=i), 1, "a", 1.0) for i in range(600)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    paths = []
    monkeypatch.setattr(registry, "scratch_path", lambda spark, tag: paths.append(str(tmp_path / f"{tag}{len(paths)}")) or paths[-1])
    registry._event_stream(spark, str(tmp_path))
    found = [spark.read.parquet(f"{paths[-1]}/{i}") for i in range(3)]
    assert [len(f.inputFiles()) for f in found] == [spark.sparkContext.defaultParallelism] * 3
    assert {r["event_id"] for f in found for r in f.collect()} == set(range(600))
