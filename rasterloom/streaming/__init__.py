"""Streams. Both are additions: the batch operators have the semantics, these keep state between batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coalesce_requests(requests: DataFrame, delay: str = "1 minute", key: str = "cache_key", at: str = "ts") -> DataFrame:
    """Of identical requests within the watermark the first goes on; the others share its result."""
    return requests.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def to_cache(requests: DataFrame, work: Callable[[DataFrame], DataFrame], cache: str, checkpoint: str):
    """Process each batch's requests that the cache lacks, and append their results."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        try:
            known = spark.read.parquet(cache).select("cache_key")
        except Exception as e:  # the first batch finds no cache yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            known = df.select("cache_key").limit(0)
        work(df.join(known, "cache_key", "left_anti").dropDuplicates(["cache_key"])).write.mode("append").parquet(cache)

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def dedupe_frames(frames: DataFrame, key: str = "user_id", value: str = "value", order: str = "frame_no") -> DataFrame:
    """Whether each frame's value repeats the one before of its key, across batches: the state is the last value."""

    def step(ids, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(pdfs)).sort_values(order)
        last = state.get[0] if state.exists else None
        before = [last, *pdf[value].tolist()[:-1]]
        same = [b is not None and b == v for b, v in zip(before, pdf[value].tolist(), strict=True)]
        state.update((float(pdf[value].iloc[-1]),))
        yield pdf[[key, order, value]].assign(same=same)

    kinds = dict(frames.dtypes)
    out = f"{key} {kinds[key]}, {order} {kinds[order]}, {value} {kinds[value]}, same boolean"
    return frames.groupBy(key).applyInPandasWithState(step, out, "last double", "append", "NoTimeout")


def counted(stream: DataFrame) -> DataFrame:
    return stream.agg(F.count("*").alias("n"))
