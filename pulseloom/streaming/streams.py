"""Streaming forms of the window operators, and a replay that runs them over stored beats.

Every operator takes a DataFrame with an event-time column `ts` and works alike on a stream, where a watermark bounds its
state, and on a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "2 hours"


def tumbling(rows: DataFrame, width: str = "30 minutes") -> DataFrame:
    """(record, start, n, v): counts in tumbling windows."""
    return _counted(rows, F.window("ts", width))


def sliding(rows: DataFrame, width: str = "1 hour", step: str = "30 minutes") -> DataFrame:
    """(record, start, n, v): counts in overlapping windows."""
    return _counted(rows, F.window("ts", width, step))


def sessions(rows: DataFrame, gap: str = "5 hours") -> DataFrame:
    """(record, start, n, v): counts in sessions that a gap ends."""
    return _counted(rows, F.session_window("ts", gap))


def _counted(rows: DataFrame, window) -> DataFrame:
    out = rows.withWatermark("ts", LATE).groupBy("record", window.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "V").alias("v"))
    return out.select("record", F.col("w.start").alias("start"), "n", "v")


def deduplicated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key within the watermark."""
    watched = rows.withWatermark("ts", LATE)
    return watched.dropDuplicatesWithinWatermark(keys) if rows.isStreaming else watched.dropDuplicates(keys)


def refractory(rows: DataFrame, gap_seconds: float) -> DataFrame:
    """(record, t): beats kept when one closer than the gap to the last kept beat is dropped; the state is one number."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        kept = []
        for t in sorted(t for frame in frames for t in frame["t"]):
            if last is None or t - last >= gap_seconds:
                kept.append(t)
                last = t
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"record": [key[0]] * len(kept), "t": kept})

    return rows.groupBy("record").applyInPandasWithState(step, "record long, t double", "last double", "append", GroupStateTimeout.NoTimeout)


def replay(spark: SparkSession, folder: str, schema: str, files: int = 1) -> DataFrame:
    """A stream over the Parquet files of a folder, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return what it wrote to an in-memory table."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def idempotent_sink(folder: str):
    """A `foreachBatch` consumer that writes each batch to a place of its own, so a batch run again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return write
