"""Evaluation: counts, rates, confusion, thresholds and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """The rates of a two-class table; `npv` follows the published tool, which divides by tn + fp like `sp`."""
    share = lambda a, b: F.when(b != 0, a / b)
    return {
        "se": share(tp, tp + fn), "sp": share(tn, tn + fp), "ppv": share(tp, tp + fp), "npv": share(tn, tn + fp), "npv_true": share(tn, tn + fn),
        "f1": share(2 * tp, 2 * tp + fp + fn), "acc": share(tp + tn, tp + fp + fn + tn), "fnr": share(fn, fn + tp),
        "iou": share(tp, tp + fp + fn),
    }


def counts(rows: DataFrame, truth: str, found: str, by: list[str]) -> DataFrame:
    """tp, fp, fn, tn of two boolean columns by group."""
    case = lambda a, b: F.count_if((F.col(truth) == a) & (F.col(found) == b))
    return rows.groupBy(*by).agg(case(True, True).alias("tp"), case(False, True).alias("fp"), case(True, False).alias("fn"), case(False, False).alias("tn"))


def set_metrics(rows: DataFrame, truth: str, found: str, by: list[str]) -> DataFrame:
    table = counts(rows, truth, found, by)
    return table.select(*by, "tp", "fp", "fn", "tn", *[v.alias(k) for k, v in rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]).items()])


def micro_macro(rows: DataFrame, truth: str, found: str, group: str) -> DataFrame:
    """Pooled counts (macro, as the published tool calls them) and means over groups that leave undefined ones out (micro)."""
    each = set_metrics(rows, truth, found, [group])
    pooled = counts(rows, truth, found, []).select(*[v.alias(f"pooled_{k}") for k, v in rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]).items() if k in ("se", "sp", "ppv", "f1")])
    return each.agg(*[F.avg(k).alias(f"mean_{k}") for k in ("se", "sp", "ppv", "f1")]).crossJoin(F.broadcast(pooled))  # one row each


def confusion(rows: DataFrame, truth: str, found: str) -> DataFrame:
    """(truth, found, n) over all pairs of two label arrays: the summed outer products of multi-label rows."""
    return rows.select(F.explode(truth).alias("truth"), found).select("truth", F.explode(found).alias("found")).groupBy("truth", "found").agg(F.count(F.lit(1)).alias("n"))


def threshold_grid(rows: DataFrame, truth: str, score: str, steps: int = 99) -> DataFrame:
    """Balanced accuracy at thresholds k / (steps + 1): one pass over a histogram of the scores, then running sums."""
    from pyspark.sql.window import Window

    n, at = F.lit(steps + 1), F.col(score)
    k = F.least(n, F.greatest(F.lit(0), F.ceil(at * n) - 1))
    # The product may be off by a rounding: the last threshold below the score by comparison.
    k = F.when((k > 0) & (k / n >= at), k - 1).when((k < n) & ((k + 1) / n < at), k + 1).otherwise(k)
    bins = rows.select(F.col(truth).alias("y"), k.cast("int").alias("b"))
    bins = bins.groupBy("b").agg(F.count_if(F.col("y")).alias("p"), F.count_if(~F.col("y")).alias("q"))
    grid = rows.sparkSession.range(0, steps + 2).select(F.col("id").cast("int").alias("b")).join(bins, "b", "left").na.fill(0)
    # At most `steps` + 2 rows, whatever the table.
    up, every = Window.orderBy("b").rowsBetween(0, Window.unboundedFollowing), Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    grid = grid.withColumn("tp", F.sum("p").over(up)).withColumn("fp", F.sum("q").over(up)).withColumn("pos", F.sum("p").over(every)).withColumn("neg", F.sum("q").over(every))
    grid = grid.where(F.col("b").between(1, steps))
    return grid.select((F.col("b") / (steps + 1)).alias("threshold"), ((F.col("tp") / F.col("pos") + (F.col("neg") - F.col("fp")) / F.col("neg")) / 2).alias("balanced"))


def best_threshold(rows: DataFrame, truth: str, score: str, steps: int = 99) -> DataFrame:
    """The lowest threshold with the highest balanced accuracy."""
    grid = threshold_grid(rows, truth, score, steps)
    return grid.agg(F.max_by(F.struct("threshold", "balanced"), F.struct("balanced", -F.col("threshold"))).alias("best")).select("best.*")


def bootstrap_mean(rows: DataFrame, value: str, replicates: int = 200, seed: int = 7) -> DataFrame:
    """Mean and 95 percent interval by Poisson bootstrap: each row weighs in with Poisson(1) in each replicate.

    Weights come from a hash of row value and replicate, so every run and every partitioning gives the same interval.
    """
    u = (F.pmod(F.xxhash64(F.lit(seed), "replicate", *rows.columns), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    below = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    weight = sum(((u > b).cast("int") for b in below[1:]), (u > below[0]).cast("int"))
    drawn = rows.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", weight)
    means = drawn.groupBy("replicate").agg((F.sum(F.col(value) * F.col("w")) / F.sum("w")).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
