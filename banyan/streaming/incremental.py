"""Streams: idempotent appends of unseen rows, and windows with watermarks (an extension)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from banyan.operators.conform import append_unseen
from banyan.sources.files import read_optional


def append_stream(stream: DataFrame, path: str, signature: list[str], checkpoint: str):
    """Writes the rows of a stream whose signature the table at path lacks; a repeated batch adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        have = read_optional(batch.sparkSession, path, batch.schema, "parquet")
        append_unseen(have, batch, signature).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def unseen_in_time(stream: DataFrame, signature: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each signature within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(signature)


def windowed(df: DataFrame, time: str, length: str, keys: list[str], *measures: Column, slide: str | None = None, delay: str | None = None) -> DataFrame:
    """Measures for each window and key; on streams a delay bounds the state."""
    if delay and df.isStreaming:
        df = df.withWatermark(time, delay)
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return df.groupBy(w, *keys).agg(*measures).withColumn("start", F.col("window.start")).drop("window")


def sessions(df: DataFrame, time: str, gap: str, key: str, *measures: Column) -> DataFrame:
    """Measures for each session of a key: events that follow within the gap."""
    return df.groupBy(F.session_window(time, gap), key).agg(*measures).withColumns({"start": F.col("session_window.start"), "end": F.col("session_window.end")}).drop("session_window")
