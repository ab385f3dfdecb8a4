"""Interval, tolerance and as-of joins as equi-joins on time bins, so no record is paired with itself whole."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def within(left: DataFrame, right: DataFrame, tolerance: float, how: str = "inner", strict: bool = True) -> DataFrame:
    """Pairs of (record, t) rows of `left` and (record, t2) rows of `right` at most `tolerance` apart.

    Each left row looks into three bins of the width of the tolerance.
    """
    bins = left.withColumn("_bin", F.explode(F.array(*[F.floor(F.col("t") / tolerance) + k for k in (-1, 0, 1)])))
    other = right.withColumn("_bin", F.floor(F.col("t2") / tolerance)).withColumnRenamed("record", "_record")
    gap = F.abs(F.col("t") - F.col("t2"))
    on = (F.col("record") == F.col("_record")) & (bins["_bin"] == other["_bin"]) & ((gap < tolerance) if strict else (gap <= tolerance))
    return bins.join(other, on, how).drop(bins["_bin"]).drop(other["_bin"]).drop("_record")


def nearest(left: DataFrame, right: DataFrame, tolerance: float) -> DataFrame:
    """(record, t, t2): for each left row the nearest right row less than `tolerance` away, null if there is none."""
    best = within(left.select("record", "t"), right.select("record", F.col("t").alias("t2")), tolerance)
    best = best.groupBy("record", "t").agg(F.min_by("t2", F.struct(F.abs(F.col("t") - F.col("t2")), "t2")).alias("t2"))
    return left.select("record", "t").join(best, ["record", "t"], "left")


def match_counts(truth: DataFrame, found: DataFrame, tolerance: float) -> DataFrame:
    """(record, tp, fn, fp): true points with a found point less than `tolerance` away, those without, and found points
    farther than `tolerance` from every true one."""
    hit = nearest(truth, found, tolerance).groupBy("record").agg(F.count("t2").alias("tp"), (F.count(F.lit(1)) - F.count("t2")).alias("fn"))
    near = within(found.select("record", "t"), truth.select("record", F.col("t").alias("t2")), tolerance, strict=False).select("record", "t").distinct()
    false = found.select("record", "t").join(near, ["record", "t"], "left_anti").groupBy("record").agg(F.count(F.lit(1)).alias("fp"))
    out = hit.join(false, "record", "full")
    return out.select("record", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fn", "fp")])


def last_before(left: DataFrame, right: DataFrame) -> DataFrame:
    """(record, t, t2): for each left row the last right row strictly before it, by one ordered pass over both."""
    both = left.select("record", "t", F.lit(None).cast("double").alias("c"), F.lit(0).alias("o")).unionByName(right.select("record", "t", F.col("t").alias("c"), F.lit(1).alias("o")))
    w = Window.partitionBy("record").orderBy("t", "o").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("t2", F.last("c", ignorenulls=True).over(w)).where("o = 0").select("record", "t", "t2")


def first_after(left: DataFrame, right: DataFrame, limit: float) -> DataFrame:
    """(record, t, t2): the first right row after each left row and less than `limit` later."""
    both = left.select("record", "t", F.lit(None).cast("double").alias("c"), F.lit(1).alias("o")).unionByName(right.select("record", "t", F.col("t").alias("c"), F.lit(0).alias("o")))
    w = Window.partitionBy("record").orderBy("t", "o").rowsBetween(1, Window.unboundedFollowing)
    found = both.withColumn("t2", F.first("c", ignorenulls=True).over(w)).where("o = 1")
    return found.select("record", "t", F.when(F.col("t2") - F.col("t") < limit, F.col("t2")).alias("t2"))


def label_beats(beats: DataFrame, labels: DataFrame) -> DataFrame:
    """Each beat with the name of the last written label (highest seq) whose [first, last] holds its index."""
    covered = labels.select("record", "name", "seq", F.explode(F.sequence("first", "last")).alias("i"))
    last = covered.groupBy("record", "i").agg(F.max_by("name", "seq").alias("diagnosis"))
    return beats.join(last, ["record", "i"], "left")


def clip(labels: DataFrame, segments: DataFrame) -> DataFrame:
    """Labels (record, name, start, end) cut to overlapping segments (record, seg, s0, s1) and moved to their origin."""
    both = labels.join(segments, "record").where((F.col("start") < F.col("s1")) & (F.col("end") > F.col("s0")))
    return both.select("record", "seg", "name", (F.greatest("start", "s0") - F.col("s0")).alias("start"), (F.least("end", "s1") - F.col("s0")).alias("end"))


def overlap_share(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Percent of the second interval that the first covers."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0)) / (b1 - b0) * 100


def window_match(truth: DataFrame, found: DataFrame, width: float, tolerance: float) -> DataFrame:
    """(record, win, tp, fn, fp) in tumbling windows; a pair at exactly the tolerance matches, both in one window."""
    win = lambda df: df.select("record", "t", F.floor(F.col("t") / width).alias("win"))
    a, b = win(truth), win(found)
    pairs = within(a, b.withColumnRenamed("t", "t2").withColumnRenamed("win", "win2"), tolerance, strict=False).where("win = win2")
    hit = pairs.select("record", "win", "t").distinct().groupBy("record", "win").agg(F.count(F.lit(1)).alias("tp"))
    got = pairs.select("record", "win", "t2").distinct().groupBy("record", "win").agg(F.count(F.lit(1)).alias("got"))
    n, m = (df.groupBy("record", "win").agg(F.count(F.lit(1)).alias(c)) for df, c in ((a, "n"), (b, "m")))
    out = n.join(m, ["record", "win"], "full").join(hit, ["record", "win"], "left").join(got, ["record", "win"], "left").na.fill(0)
    return out.select("record", "win", "tp", (F.col("n") - F.col("tp")).alias("fn"), (F.col("m") - F.col("got")).alias("fp"))


#: Waveforms of a group in a block; all pairs of two blocks are made in one call.
BLOCK = 400


def all_pairs_rmse(waves: DataFrame, group: str, block: int = BLOCK) -> DataFrame:
    """(record, record2, rmse) of all pairs record < record2 within a group; waveforms are of one length.

    The waveforms of a group are dealt into blocks by a hash, and each pair of blocks is one group of rows."""
    most = waves.groupBy(group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    blocks = -(-most // block)
    dealt = waves.select(group, "record", "x", F.pmod(F.xxhash64("record"), F.lit(blocks)).alias("own"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    dealt = dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        x, ids = np.stack([np.asarray(v, float) for v in frame["x"]]), frame["record"].to_numpy()
        left = np.flatnonzero(frame["own"] == key[1])
        right = np.flatnonzero(frame["own"] == key[2])
        parts = []
        for a in left:
            b = right[ids[right] > ids[a]] if key[1] == key[2] else right[ids[right] != ids[a]]
            d = np.sqrt(((x[b] - x[a]) ** 2).mean(axis=1))
            parts.append((np.minimum(ids[b], ids[a]), np.maximum(ids[b], ids[a]), d))
        made = [np.concatenate([p[k] for p in parts]) if parts else [] for k in range(3)]
        return pd.DataFrame({"record": made[0], "record2": made[1], "rmse": made[2]})

    return dealt.groupBy(group, "low", "high").applyInPandas(run, "record long, record2 long, rmse double")


#: Parts into which `disjoint` cuts the line; what is told about them fits a broadcast.
PARTS = 64


def disjoint(rows: DataFrame, key: str, low: str, high: str) -> DataFrame:
    """The keys whose intervals [low, high] overlap none of the others.

    One does if it starts after all that start before it have ended, and ends before the next one starts. The line is cut into
    `PARTS`; what lies before and after a part is told by each part's extremes, so parts are sorted by themselves.
    """
    ends = rows.agg(F.min(low).alias("_a"), F.max(low).alias("_b"))
    part = F.when(F.col("_b") > F.col("_a"), F.least(F.floor((F.col(low) - F.col("_a")) / (F.col("_b") - F.col("_a")) * PARTS), F.lit(PARTS - 1))).otherwise(F.lit(0)).cast("int")
    rows = rows.crossJoin(F.broadcast(ends)).withColumn("_part", part).drop("_a", "_b")  # one row of two numbers
    extremes = rows.groupBy("_part").agg(F.max(high).alias("_high"), F.min(low).alias("_low"))
    order = Window.partitionBy(F.lit(0)).orderBy("_part")  # at most PARTS rows
    extremes = extremes.select("_part", F.max("_high").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_reached"), F.lead("_low").over(order).alias("_next"))
    w = Window.partitionBy("_part").orderBy(low, key)
    rows = rows.join(F.broadcast(extremes), "_part")
    before = F.greatest(F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_reached"))
    after = F.coalesce(F.lead(low).over(w), F.col("_next"))
    rows = rows.withColumn("_before", before).withColumn("_after", after)
    return rows.where((F.col("_before").isNull() | (F.col("_before") < F.col(low))) & (F.col("_after").isNull() | (F.col("_after") > F.col(high)))).select(key)
