"""From chances and masks, sample by sample, to waves: QRS complexes, P waves, checked peaks, corrected fibrillation."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import regions, rhythm
from .sequence import ordered


def _runs(rows: DataFrame, mask: str, before: int, after: int) -> DataFrame:
    """One row for each run of a mask, its middle sample, with start and end; runs that touch noise, up to the sample after them,
    or that come too near either end of the record are left out."""
    w = ordered()
    rows = rows.withColumn("_new", ((F.col(mask) == 1) & (F.coalesce(F.lag(mask).over(w), F.lit(0)) == 0)).cast("int"))
    rows = rows.withColumns({"_run": F.sum("_new").over(w), "_n": F.count(F.lit(1)).over(Window.partitionBy("record")), "_noisy": F.col("noise") | F.coalesce(F.lead("noise").over(w), F.lit(False))})
    run = Window.partitionBy("record", "_run")
    rows = rows.where(F.col(mask) == 1).withColumns({"start": F.min("i").over(run), "end": F.max("i").over(run) + 1, "_dirty": F.max("_noisy").over(run)})
    clean = ~F.col("_dirty") & (F.col("start") > before) & (F.col("end") < F.col("_n") - after) & (F.col("end") < F.col("_n") - 1)
    return rows.where(clean & (F.col("i") == F.floor((F.col("start") + F.col("end")) / 2)))


def qrs_waves(rows: DataFrame, fs: float) -> DataFrame:
    """(record, start, end, first, last, width, abnormal) of the complexes in rows (record, i, normal, abnormal, noise).

    Where the chances of a normal and of an abnormal complex add up to more than 0.25, gaps of 0.12 s closed, is a complex; its
    frame goes from 0.1 s before its middle to 0.2 s after, and it is abnormal if that chance passes 0.1 anywhere there.
    """
    before, after = int(0.1 * fs), int(0.2 * fs)
    rows = rows.withColumn("_m", (F.col("normal") + F.col("abnormal") > 0.25).cast("int"))
    rows = regions.closing_shifted(rows, "_m", int(0.12 * fs)).withColumn("_most", F.max("abnormal").over(ordered().rowsBetween(-before, after - 1)))
    found = _runs(rows, "closed", before, after)
    return found.select("record", "start", "end", (F.col("i") - before).alias("first"), (F.col("i") + after).alias("last"), (F.col("end") - F.col("start") + 1).alias("width"), (F.col("_most") > 0.1).alias("abnormal"))


def p_waves(rows: DataFrame, fs: float) -> DataFrame:
    """(record, start, end, first, last, double) of the P waves in rows (record, i, p, t, noise), masks all three.

    A wave that begins and ends within a T wave is none; two whose frames, 0.1 s either side of their middle and as much again,
    overlap are double.
    """
    reach = int(0.1 * fs)
    w = ordered()
    rows = rows.withColumn("_after", F.lead("t").over(w)).withColumn("_p", F.col("p").cast("int"))
    rows = rows.withColumns({"_before": F.col("p") & ~F.coalesce(F.lag("p").over(w), F.lit(False)) & F.col("t"), "_behind": F.col("p") & ~F.coalesce(F.lead("p").over(w), F.lit(False)) & F.coalesce("_after", F.lit(False))})
    # Whether either end lies in a T wave, carried to the middle over the run.
    island = F.sum((F.col("p") & ~F.coalesce(F.lag("p").over(w), F.lit(False))).cast("int")).over(w)
    run = Window.partitionBy("record", "_island")
    rows = rows.withColumn("_island", F.when(F.col("p"), island)).withColumns({"_t1": F.max("_before").over(run), "_t2": F.max("_behind").over(run)})
    found = _runs(rows, "_p", reach, reach).where(~(F.col("_t1") & F.col("_t2")))
    found = found.select("record", "start", "end", (F.col("i") - reach).alias("first"), (F.col("i") + reach).alias("last"))
    w = Window.partitionBy("record").orderBy("start")
    near = (F.col("last") + reach > F.lead("first").over(w) - reach), (F.lag("last").over(w) + reach > F.col("first") - reach)
    return found.withColumn("double", F.coalesce(near[0], F.lit(False)) | F.coalesce(near[1], F.lit(False)))


def peak_check(peaks: DataFrame, others: DataFrame, window: float = 30.0, tolerance: float = 0.15) -> DataFrame:
    """(record, part, tp, fp, fn, mismatch) of two detectors' peaks (record, t) in windows of time; a window where sensitivity,
    precision or their harmonic mean is under a half is a mismatch, to be marked as noise.

    Both series lie in one ordered pass: a peak's nearest ones of the other series are the last before and the first after.
    """
    both = peaks.select("record", "t", F.lit(True).alias("mine")).unionByName(others.select("record", "t", F.lit(False).alias("mine")))
    both = both.withColumn("part", F.floor(F.col("t") / window))
    w = Window.partitionBy("record", "part").orderBy("t", "mine")

    def nearest(of_mine: bool):
        value = F.when(F.col("mine") == of_mine, F.col("t"))
        last = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        first = F.first(value, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
        return F.least(F.col("t") - last, first - F.col("t"))

    both = both.withColumn("d", F.when(F.col("mine"), nearest(False)).otherwise(nearest(True))).withColumn("hit", F.coalesce(F.col("d") <= tolerance, F.lit(False)))
    counts = both.groupBy("record", "part").agg(
        F.count_if(F.col("mine") & F.col("hit")).alias("tp"), F.count_if(F.col("mine") & ~F.col("hit")).alias("fp"), F.count_if(~F.col("mine") & ~F.col("hit")).alias("fn")
    )
    share = lambda other: F.when(F.col("tp") + F.col(other) > 0, F.col("tp") / (F.col("tp") + F.col(other))).otherwise(F.lit(0.0))
    both = F.when(share("fn") + share("fp") > 0, 2 * share("fn") * share("fp") / (share("fn") + share("fp"))).otherwise(F.lit(0.0))
    return counts.withColumn("mismatch", (share("fn") < 0.5) | (share("fp") < 0.5) | (both < 0.5))


def suspicious(beats: DataFrame, pause: float = 3.0, unrest: float = 0.5, window: float = 30.0) -> DataFrame:
    """Records (record, t, rr_raw) with a long pause, or with a window whose intervals' RMSSD is high: those to check."""
    d = F.col("rr_raw") - F.lag("rr_raw").over(Window.partitionBy("record", "part").orderBy("t"))
    parts = beats.withColumn("part", F.floor(F.col("t") / window)).withColumn("d", d).groupBy("record", "part").agg(F.max("rr_raw").alias("most"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmssd"))
    return parts.groupBy("record").agg(F.max("most").alias("most"), F.max("rmssd").alias("rmssd")).where((F.col("most") > pause) | (F.col("rmssd") > unrest)).select("record")


#: Beats that look like fibrillation to a network and are none.
_VETO = tuple(re.compile(p) for p in ("V{3,}", "(NV){3,}", "(NNV){3,}"))


def corrected_fibrillation(mask: np.ndarray, noise: np.ndarray, doubt: np.ndarray, beats: np.ndarray, abnormal: np.ndarray, has_p: np.ndarray, fs: float) -> np.ndarray:
    """A fibrillation mask less what beats, P waves, noise and doubt speak against; `beats` are samples, in order.

    In this order: stretches of ventricular patterns; stretches where most of five beats have a P wave; noise; then gaps of a
    second are closed, stretches with fewer than three beats go, a second's opening and closing, and stretches under three
    seconds whose mean log doubt is -5 or more.
    """
    mask = mask.astype(bool).copy()
    text = "".join(np.where(abnormal, "V", "N"))
    for pattern in _VETO:
        for m in pattern.finditer(text):
            mask[beats[m.start()] : beats[m.end() - 1] + 1] = False
    if len(beats) >= 5:
        ones = np.ones(5)
        near = np.convolve(has_p, ones, "same") / np.convolve(np.ones(len(beats)), ones, "same")
        for a, b in rhythm.runs(near > 0.5):
            mask[beats[a] : beats[b - 1] + 1] = False
    mask &= ~noise.astype(bool)
    second = int(fs)
    mask = rhythm.closing(mask, second).astype(bool)
    for a, b in list(rhythm.runs(mask)):
        if ((beats >= a) & (beats <= b)).sum() < 3:
            mask[a:b] = False
    mask = rhythm.closing(rhythm.opening(mask, second), second).astype(bool)
    for a, b in list(rhythm.runs(mask)):
        if b - a < 3 * fs and np.log(doubt[a:b] + 0.0001).mean() >= -5:
            mask[a:b] = False
    return mask


def fibrillation(rows: DataFrame, fs: float) -> DataFrame:
    """(record, start, end) of the corrected mask of rows (record, i, afib, noise, doubt, beat, abnormal, has_p): an ordered chain
    of steps, each on the result of the one before, so one task for a record."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("i")
        at = np.flatnonzero(frame["beat"].to_numpy(bool))
        flags = [frame[c].to_numpy(bool)[at] for c in ("abnormal", "has_p")]
        mask = corrected_fibrillation(frame["afib"].to_numpy(bool), frame["noise"].to_numpy(bool), frame["doubt"].to_numpy(float), at, *flags, fs)
        found = pd.DataFrame(list(rhythm.runs(mask)), columns=["start", "end"])
        found.insert(0, "record", frame["record"].iloc[0])
        return found

    return rows.select("record", "i", "afib", "noise", "doubt", "beat", "abnormal", "has_p").groupBy("record").applyInPandas(run, "record long, start long, end long")


def r_peak(x: np.ndarray, start: int, end: int) -> int:
    """The sample inside a wave that turns most: the largest change of slope among its local extremes, or else the largest value
    off the line between its ends."""
    at = np.arange(max(start, 1), min(end, len(x) - 1))
    bend = np.abs(2 * x[at] - x[at - 1] - x[at + 1])
    turning = (x[at] - x[at - 1]) * (x[at + 1] - x[at]) <= 0
    if turning.any():
        return int(at[turning][bend[turning].argmax()])
    line = np.interp(np.arange(start, end), [start, end - 1], [x[start], x[end - 1]])
    return start + int(np.abs(x[start:end] - line).argmax())
