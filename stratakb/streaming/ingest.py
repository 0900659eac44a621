"""Structured Streaming: deduplicated ingest, windowed event counts, per-key hit state, counter upserts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from stratakb.functions.text import body_sha256
from stratakb.operators.governance import upsert_counts

HIT_STATE = "hits long, days array<int>"
HIT_OUTPUT = "key string, hits long, days int, promoted boolean"


def read_stream(spark: SparkSession, folder: str, schema: str | StructType, files: int = 100, only: str = "*") -> DataFrame:
    """Parquet files as they arrive in a folder, at most `files` of them per batch; only those whose name fits the glob."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", only).parquet(folder)


def new_documents(stream: DataFrame, time: str, late: str = "7 days") -> DataFrame:
    """Documents whose normalised body hasn't been seen within the watermark; null bodies are dropped."""
    hashed = stream.where("body is not null").withColumn("content_sha256", body_sha256(F.col("body")))
    return hashed.withWatermark(time, late).dropDuplicatesWithinWatermark(["content_sha256"])


def windowed_counts(stream: DataFrame, time: str, key: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Event counts per window and key; events later than the watermark are dropped."""
    frame = F.window(time, size, slide) if slide else F.window(time, size)
    counted = stream.withWatermark(time, late).groupBy(frame.alias("w"), key).agg(F.count(F.lit(1)).alias("events"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "events")


def session_counts(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions per key: a gap ends one."""
    counted = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("events"))
    return counted.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "events")


def _count_hits(hits: int, days: int, keep_ms: int) -> Callable:
    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, seen = state.get if state.exists else (0, [])
        known = set(seen)
        for frame in frames:
            count += len(frame)
            known.update(int(d) for d in frame["day"])
        state.update((count, sorted(known)))
        state.setTimeoutTimestamp(max(max(known) * 86_400_000 + keep_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [key[0]], "hits": [count], "days": [len(known)], "promoted": [count >= hits and len(known) >= days]})

    return update


def hit_state(stream: DataFrame, key: str, time: str, hits: int = 3, days: int = 2, late: str = "7 days", keep_days: int = 400) -> DataFrame:
    """(key, hits, days, promoted): running hits of each key and on how many distinct days they fell, in whatever order they come.

    Rows with a null key or time are dropped. A key without a hit for keep_days behind the watermark is forgotten.
    """
    rows = stream.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withWatermark(time, late)
    rows = rows.select(F.col(key).cast("string").alias("key"), time, F.unix_date(F.to_date(time)).alias("day"))
    update = _count_hits(hits, days, keep_days * 86_400_000)
    return rows.groupBy("key").applyInPandasWithState(update, HIT_OUTPUT, HIT_STATE, "update", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, mode: str, folder: str, timeout: int = 600) -> DataFrame:
    """Run a stream to the end of what its source holds and read what it wrote: its rows with the number of their batch.

    Every batch is one written version, so a batch that is repeated after a failure replaces its own.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    if not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"the stream did not end within {timeout} seconds")
    return stream.sparkSession.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch int").parquet(f"{folder}/out")


def last_rows(drained: DataFrame, *keys: str) -> DataFrame:
    """The rows of the last batch that updated each key."""
    names = [c for c in drained.columns if c not in (*keys, "batch")]
    return drained.groupBy(*keys).agg(F.max_by(F.struct(*names), "batch").alias("r")).select(*keys, "r.*")


def keep_counts(folder: str, key: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: counter state as one written version per batch; a repeated batch rewrites its own."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{folder}/v{number - 1}"
        path = spark._jvm.org.apache.hadoop.fs.Path(before)
        exists = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)
        state = spark.read.parquet(before) if exists else spark.createDataFrame([], f"{key} string, count long")
        upsert_counts(state, batch, key).write.mode("overwrite").parquet(f"{folder}/v{number}")

    return write
