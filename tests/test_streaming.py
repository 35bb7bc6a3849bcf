"""Streams against their batch meaning."""

import pytest
from pyspark.sql import functions as F

from rasterloom import streaming


def test_requests_go_once(spark, tmp_path):
    schema = "request_id long, cache_key string, ts timestamp"
    rows = [(i, f"k{i % 3}") for i in range(9)]
    spark.createDataFrame(rows, "request_id long, cache_key string").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for run in ("a", "b"):  # the second run finds all keys in the cache
        work = lambda df: df.select("cache_key", F.lit(run).alias("made_by"))  # noqa: E731, B023
        streaming.to_cache(streaming.coalesce_requests(stream), work, str(tmp_path / "cache"), str(tmp_path / f"ck-{run}")).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "cache")).collect()
    assert sorted((r.cache_key, r.made_by) for r in got) == [("k0", "a"), ("k1", "a"), ("k2", "a")]


@pytest.mark.parametrize("files", [1, 2])
def test_frames_keep_state(spark, tmp_path, files):
    schema = "user_id long, frame_no int, value double"
    rows = [(1, 0, 5.0), (1, 1, 5.0), (1, 2, 6.0), (1, 3, 6.0), (2, 0, 6.0)]
    cuts = [rows] if files == 1 else [rows[:2], rows[2:]]
    (tmp_path / "in").mkdir()
    for i, part in enumerate(cuts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = streaming.dedupe_frames(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(r.user_id, r.frame_no): r.same for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 0): False, (1, 1): True, (1, 2): False, (1, 3): True, (2, 0): False}
