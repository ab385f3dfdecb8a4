"""Region algebra: masks, runs, morphology and interval unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sequence import ordered


def regions(rows: DataFrame, mask: Column, closed: bool = False) -> DataFrame:
    """(record, start, end): runs of a mask. The end is exclusive; `closed` ends a run at the last sample one earlier."""
    flagged = rows.withColumn("_m", mask.cast("int"))
    flagged = flagged.withColumn("_start", ((F.col("_m") == 1) & (F.coalesce(F.lag("_m").over(ordered()), F.lit(0)) == 0)).cast("int"))
    flagged = flagged.withColumn("_run", F.sum("_start").over(ordered())).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("record")))
    runs = flagged.where("_m = 1").groupBy("record", "_run").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("end"), F.max("_n").alias("_n")).drop("_run")
    if closed:
        runs = runs.withColumn("end", F.when(F.col("end") == F.col("_n"), F.col("_n") - 1).otherwise(F.col("end")))
    return runs.drop("_n")


def to_mask(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(record, i, mask) from regions and the records' sizes (record, n)."""
    grid = sizes.select("record", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    inside = runs.where("end > start").select("record", F.explode(F.sequence("start", F.col("end") - 1)).alias("i")).distinct().withColumn("mask", F.lit(True))
    return grid.join(inside, ["record", "i"], "left").withColumn("mask", F.coalesce("mask", F.lit(False)))


def _frame(rows: DataFrame, value: str, out: str, low: int, high: int, largest: bool) -> DataFrame:
    pick = F.max if largest else F.min
    return rows.withColumn(out, pick(value).over(ordered().rowsBetween(low, high)))


def closing_shifted(rows: DataFrame, value: str, k: int) -> DataFrame:
    """The rules' closing: dilation then erosion over the same frame [i - k//2, i + k//2 - 1], which shifts by one."""
    half = k // 2
    rows = _frame(rows, value, "_dilated", -half, half - 1, True)
    return _frame(rows, "_dilated", "closed", -half, half - 1, False).drop("_dilated")


def opening_shifted(rows: DataFrame, value: str, k: int) -> DataFrame:
    """The rules' opening: erosion then dilation over the same asymmetric frame."""
    half = k // 2
    rows = _frame(rows, value, "_eroded", -half, half - 1, False)
    return _frame(rows, "_eroded", "opened", -half, half - 1, True).drop("_eroded")


def closing_symmetric(rows: DataFrame, value: str, k: int) -> DataFrame:
    """Dilation then erosion over [i - k//2, i + k//2], clipped at the ends."""
    rows = _frame(rows, value, "_dilated", -(k // 2), k // 2, True)
    return _frame(rows, "_dilated", "closed", -(k // 2), k // 2, False).drop("_dilated")


def causal_morphology(rows: DataFrame, value: str, k: int) -> DataFrame:
    """Grey dilation over the past and erosion over the future, opening and closing, and the top and bottom hats."""
    rows = _frame(_frame(rows, value, "dilated", 1 - k, 0, True), value, "eroded", 0, k - 1, False)
    rows = _frame(_frame(rows, "eroded", "opened", 1 - k, 0, True), "dilated", "closed", 0, k - 1, False)
    return rows.withColumn("top_hat", F.col(value) - F.col("opened")).withColumn("bottom_hat", F.col("closed") - F.col(value))


def largest(runs: DataFrame) -> DataFrame:
    """The longest region of each record, the first of equals."""
    w = Window.partitionBy("record").orderBy((F.col("start") - F.col("end")), "start")
    return runs.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def merged(intervals: DataFrame, gap: float) -> DataFrame:
    """The union of (record, start, end) intervals that overlap or are less than `gap` apart."""
    w = Window.partitionBy("record").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = intervals.withColumn("_new", F.coalesce((F.col("start") - reach >= gap).cast("int"), F.lit(1)))
    rows = rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("record", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("parts")).drop("_island")
