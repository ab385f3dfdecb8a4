"""Single rhythm rules as DataFrame stages: beats in, labelled intervals (record, name, first, last, seq) out.

Each reads the beats as they come; all rules in order, each seeing the labels before it, are in `rhythm`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns
from . import regions, sequence

#: Distances, in deviations, of the normal law for one-sided chances of 0.05, 0.01 and 0.10 and a two-sided one of 0.05.
ONE_SIDED = {0.05: 1.6449, 0.01: 2.3263, 0.10: 1.2816}
TWO_SIDED = 1.96


def _labels(runs: DataFrame, name: str, seq: int) -> DataFrame:
    return runs.select("record", F.lit(name).alias("name"), F.col("start").alias("first"), (F.col("end") - 1).alias("last"), F.lit(seq).alias("seq"))


def mask_rule(beats: DataFrame, mask: Column, name: str, seq: int) -> DataFrame:
    """Runs of a mask: noise without fibrillation, fibrillation."""
    return _labels(regions.regions(beats, mask), name, seq)


def ventricular_runs(beats: DataFrame, seq: int, fast: float = 100.0, slow: float = 50.0) -> DataFrame:
    """Runs of three or more abnormal beats after the repair of a lone normal one, named by their mean rate."""
    runs = patterns.find_all(patterns.repaired(patterns.beat_string(beats)), "V", patterns.PATTERNS["V_RUN"])
    inside = runs.select("record", "first", "last", F.explode(F.sequence("first", "last")).alias("i")).join(beats.select("record", "i", "rr_raw"), ["record", "i"])
    rate = inside.where("i > first").groupBy("record", "first", "last").agg((60 / F.avg("rr_raw")).alias("rate"))
    name = F.when(F.col("rate") >= fast, "VT").when(F.col("rate") >= slow, "AIVR").otherwise("IVR")
    return rate.select("record", name.alias("name"), "first", "last", F.lit(seq).alias("seq"))


def pattern_rule(beats: DataFrame, name: str, seq: int) -> DataFrame:
    """Bigeminy, trigeminy and quadrigeminy."""
    return patterns.find_all(patterns.beat_string(beats), name, patterns.PATTERNS[name]).withColumn("seq", F.lit(seq))


def rate_rule(beats: DataFrame, name: str, seq: int, above: float | None = None, below: float | None = None, opening: int = 4) -> DataFrame:
    """Runs of a rate beyond a limit that outlast an opening."""
    rate = 60 / F.col("rr_raw")
    rows = beats.withColumn("_m", F.coalesce((rate > above if above is not None else rate < below).cast("int"), F.lit(0)))
    return _labels(regions.regions(regions.opening_shifted(rows, "_m", opening), F.col("opened") == 1), name, seq)


def sinus_rule(beats: DataFrame, seq: int) -> DataFrame:
    """Stretches where at least four of any five beats are normal, named by their mean rate and its spread."""
    rows = sequence.box_sum(beats, F.col("kind") == "N").withColumn("_m", F.col("box") >= 4)
    runs = regions.regions(rows, F.col("_m")).where(F.col("end") - F.col("start") >= 3)
    inside = runs.select("record", "start", "end", F.explode(F.sequence("start", F.col("end") - 1)).alias("i")).join(beats.select("record", "i", "rr_raw"), ["record", "i"])
    stats = inside.groupBy("record", "start", "end").agg((60 / F.avg("rr_raw")).alias("rate"))
    name = F.when(F.col("rate") < 50, "BRADYCARDIA").otherwise("NSR")
    return stats.select("record", name.alias("name"), F.col("start").alias("first"), (F.col("end") - 1).alias("last"), F.lit(seq).alias("seq"))


def premature_beats(beats: DataFrame, seq: int, chance: float = 0.05) -> DataFrame:
    """Beats that come earlier than the weighted last three intervals let expect, PVC if abnormal, else PAC.

    The published tool draws random numbers for this test; here it is the normal law itself, whose distance for the
    chance is a constant.
    """
    w = Window.partitionBy("record").orderBy("i")
    back = [F.lag("rr_raw", k).over(w) for k in (1, 2, 3)]
    expected = (3 * back[0] + 2 * back[1] + back[2]) / 6
    spread = F.stddev_pop("rr_raw").over(w.rowsBetween(-6, -1))
    early = expected - F.col("rr_raw") > ONE_SIDED[chance] * spread
    rows = beats.withColumn("_early", F.coalesce(early, F.lit(False))).where("_early")
    return rows.select("record", F.when(F.col("kind") == "V", "PVC").otherwise("PAC").alias("name"), F.col("i").alias("first"), F.col("i").alias("last"), F.lit(seq).alias("seq"))
