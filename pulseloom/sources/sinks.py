"""Result sinks: JSON lines by model, metric tables, nested exports and a status table for work queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_results(results: DataFrame, folder: str, model: str) -> None:
    """Add results as JSON lines under the model's own folder; running a model again replaces its results."""
    results.write.mode("overwrite").json(f"{folder}/model={model}")


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.json(folder)


def metric_table(metrics: DataFrame, path: str) -> None:
    """One CSV with semicolons and a header; metrics are a few rows, so one file."""
    metrics.coalesce(1).write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def nested(beats: DataFrame) -> DataFrame:
    """(record, doc): each record as a JSON document of its ordered beats; missing values are null."""
    each = F.transform(F.array_sort(F.collect_list(F.struct("i", F.struct("t", "kind", "value").alias("b")))), lambda s: s["b"])
    return beats.groupBy("record").agg(F.to_json(F.struct(F.first("record").alias("id"), each.alias("beats")), {"ignoreNullFields": "false"}).alias("doc"))


def claim(queue: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """The next n unprocessed records in an order by hash, which every run repeats."""
    return queue.where("status = 'unprocessed'").orderBy(F.xxhash64(F.lit(seed), "record"), "record").limit(n)


def finished(queue: DataFrame, done: DataFrame) -> DataFrame:
    """The queue with the records of `done` marked as processed."""
    marks = done.select("record").distinct().withColumn("_done", F.lit(True))
    return queue.join(marks, "record", "left").withColumn("status", F.when(F.col("_done"), "processed").otherwise(F.col("status"))).drop("_done")
