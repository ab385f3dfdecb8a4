"""Ordered operators over the beats of a record: intervals, neighbourhoods, filters, runs and folds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def ordered(by: str = "record", order: str = "i") -> WindowSpec:
    return Window.partitionBy(by).orderBy(order)


def rr_intervals(beats: DataFrame) -> DataFrame:
    """rr_raw: time since the beat before, the first taking the second's; rr: the same, null for abnormal beats."""
    w = ordered()
    raw = F.col("t") - F.lag("t").over(w)
    beats = beats.withColumn("rr_raw", F.coalesce(raw, F.lead("t").over(w) - F.col("t")))
    return beats.withColumn("rr", F.when(F.col("kind") == "N", F.col("rr_raw")))


def neighbourhood(beats: DataFrame, flag: Column, reach: int = 2) -> DataFrame:
    """Count, size and share of flagged beats among those at most `reach` beats away, clipped at the ends."""
    w = ordered().rowsBetween(-reach, reach)
    n, c = F.count(F.lit(1)).over(w), F.sum(flag.cast("int")).over(w)
    return beats.withColumn("near_n", n).withColumn("near_flagged", c).withColumn("near_share", c / n)


def box_sum(beats: DataFrame, flag: Column, reach: int = 2) -> DataFrame:
    """Sum of the flag over a box; beats beyond the ends count as flagged."""
    w = ordered().rowsBetween(-reach, reach)
    return beats.withColumn("box", F.sum(flag.cast("int")).over(w) + (2 * reach + 1) - F.count(F.lit(1)).over(w))


def median_filter(rows: DataFrame, value: str, reach: int) -> DataFrame:
    """The upper median over a centred frame, clipped at the ends."""
    frame = F.array_sort(F.collect_list(value).over(ordered().rowsBetween(-reach, reach)))
    rows = rows.withColumn("_frame", frame)
    return rows.withColumn("median", F.element_at("_frame", (F.size("_frame") / 2).cast("int") + 1)).drop("_frame")


def rolling(rows: DataFrame, value: str, size: int) -> DataFrame:
    """Mean, sum, maximum and range over the last `size` rows."""
    w = ordered().rowsBetween(1 - size, 0)
    hi, lo = F.max(value).over(w), F.min(value).over(w)
    return rows.withColumn("roll_mean", F.avg(value).over(w)).withColumn("roll_sum", F.sum(value).over(w)).withColumn("roll_max", hi).withColumn("roll_range", hi - lo)


def derivative5(rows: DataFrame, value: str, fs: float) -> DataFrame:
    """Five-point derivative (-x[-2] - 2x[-1] + 2x[1] + x[2]) * fs / 8, null at the borders."""
    w = ordered()
    at = lambda k: F.lead(value, k).over(w) if k > 0 else F.lag(value, -k).over(w)
    return rows.withColumn("d5", (-at(-2) - 2 * at(-1) + 2 * at(1) + at(2)) * F.lit(fs / 8))


def close_pairs(beats: DataFrame, gap: float) -> DataFrame:
    """Beats closer than `gap` to a neighbour."""
    w = ordered()
    near = lambda d: F.coalesce(d < gap, F.lit(False))
    return beats.withColumn("double", near(F.col("t") - F.lag("t").over(w)) | near(F.lead("t").over(w) - F.col("t")))


def change_points(rows: DataFrame, label: str) -> DataFrame:
    """(record, run, label, first, last): the runs of equal labels."""
    changed = F.coalesce((F.col(label) != F.lag(label).over(ordered())).cast("int"), F.lit(0))
    runs = rows.withColumn("_changed", changed).withColumn("run", F.sum("_changed").over(ordered()))
    return runs.groupBy("record", "run").agg(F.first(label).alias("label"), F.min("i").alias("first"), F.max("i").alias("last"))


def streak(beats: DataFrame, value: str, least: int = 3, band: float = 0.25) -> DataFrame:
    """The first run of at least `least` values within `band` of the record's median."""
    middle = beats.groupBy("record").agg(F.percentile(value, 0.5).alias("_median"))
    near = beats.join(middle, "record").withColumn("_near", F.abs(F.col(value) - F.col("_median")) <= band * F.col("_median"))
    runs = change_points(near.withColumn("_label", F.coalesce("_near", F.lit(False)).cast("string")), "_label").where("label = 'true'")
    runs = runs.withColumn("length", F.col("last") - F.col("first") + 1).where(F.col("length") >= least)
    return runs.groupBy("record").agg(F.min_by(F.struct("first", "last", "length"), "first").alias("s")).select("record", "s.*")


def refractory(beats: DataFrame, gap: float) -> DataFrame:
    """The beats kept when one closer than `gap` to the last kept beat is dropped: an ordered fold of each record."""
    times = F.array_sort(F.collect_list("t"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("last"))
    kept = F.aggregate(times, start, lambda acc, t: F.when(acc["last"].isNull() | (t - acc["last"] >= gap), F.struct((acc["n"] + 1).alias("n"), t.alias("last"))).otherwise(acc))
    folded = beats.groupBy("record").agg(F.count(F.lit(1)).alias("n"), kept.alias("kept"))
    return folded.select("record", "n", F.col("kept.n").alias("n_kept"), F.col("kept.last").alias("last_kept"))


#: Beats back that still count in `smooth_in_place`: 3 to this power is beyond a double's digits.
_REACH = 40


def smooth_in_place(beats: DataFrame, value: str) -> DataFrame:
    """Three-point means from left to right, each with its already smoothed left neighbour; the ends stay.

    The smoothed value is a third of the one before and of two raw ones, so it is the sum of their shares divided by the powers
    of three; a frame of `_REACH` beats holds all that counts.
    """
    w = ordered()
    own = F.when(F.lag("i").over(w).isNull(), F.col(value)).otherwise((F.col(value) + F.lead(value).over(w)) / 3)
    rows = beats.select("record", "i", F.col(value).cast("double").alias(value)).withColumn("_own", own)
    frame = F.collect_list(F.coalesce("_own", F.lit(0.0))).over(w.rowsBetween(-_REACH, 0))
    folded = F.aggregate(frame, F.lit(0.0), lambda acc, x: acc / 3 + x)
    last = F.lead("i").over(w).isNull() | F.lag("i").over(w).isNull()
    return rows.select("record", "i", F.when(last, F.col(value)).otherwise(folded).alias("smooth"))


def local_maxima(rows: DataFrame, value: str, height: float) -> DataFrame:
    """Strict local maxima above a height."""
    w = ordered()
    peak = (F.col(value) > F.lag(value).over(w)) & (F.col(value) > F.lead(value).over(w)) & (F.col(value) > height)
    return rows.withColumn("_peak", peak).where("_peak").drop("_peak")


def prominences(values: np.ndarray) -> np.ndarray:
    """Height of each sample over the higher of the lowest ones on either side, each side up to the first higher sample or the end."""

    def lowest(v):
        out, stack = np.empty(len(v)), []  # (value, lowest up to it) of samples that none since has reached
        for k, x in enumerate(v):
            low = x
            while stack and stack[-1][0] <= x:
                low = min(low, stack.pop()[1])
            stack.append((x, low))
            out[k] = low
        return out

    return values - np.maximum(lowest(values), lowest(values[::-1])[::-1])


def peak_prominence(rows: DataFrame, value: str, height: float) -> DataFrame:
    """(record, i, prominence) of the strict local maxima above a height, over whole records in order of i."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("i")
        v = frame[value].to_numpy(float)
        peak = np.zeros(len(v), bool)
        peak[1:-1] = (v[1:-1] > v[:-2]) & (v[1:-1] > v[2:]) & (v[1:-1] > height)
        return pd.DataFrame({"record": frame["record"], "i": frame["i"], "prominence": prominences(v)})[peak]

    return rows.select("record", "i", value).groupBy("record").applyInPandas(run, "record long, i long, prominence double")


def page_hinkley(rows: DataFrame, value: str, delta: float, limit: float) -> DataFrame:
    """The first index at which the cumulated rise over the running mean, less `delta`, leaves its minimum by `limit`."""
    mean = F.avg(value).over(ordered().rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_d", F.col(value) - mean - delta)
    rows = rows.withColumn("_m", F.sum("_d").over(ordered().rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_gap", F.col("_m") - F.min("_m").over(ordered().rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("record").agg(F.min(F.when(F.col("_gap") > limit, F.col("i"))).alias("change_at"))
