"""Statistics of interval series as aggregate expressions; all deviations are of the population."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rmssd(beats: DataFrame, value: str) -> DataFrame:
    """Root mean square of successive differences; 0 for fewer than two values."""
    d = beats.where(F.col(value).isNotNull()).withColumn("_d", F.col(value) - F.lag(value).over(Window.partitionBy("record").orderBy("i")))
    return d.groupBy("record").agg(F.coalesce(F.sqrt(F.avg(F.col("_d") * F.col("_d"))), F.lit(0.0)).alias("rmssd"))


def summary(value: str) -> list[Column]:
    """Extremes, moments, median, quartile range and coefficient of variation of a column."""
    x = F.col(value)
    return [
        F.count(x).alias("n"), F.min(x).alias("least"), F.max(x).alias("most"), F.avg(x).alias("mean"), F.sum(x).alias("total"),
        F.max(F.abs(x)).alias("abs_most"), F.min(F.abs(x)).alias("abs_least"), F.percentile(x, 0.5).alias("median"),
        F.stddev_pop(x).alias("sd"), (F.percentile(x, 0.75) - F.percentile(x, 0.25)).alias("iqr"), (F.stddev_pop(x) / F.avg(x)).alias("cv"),
        F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"),
    ]


def arg_extremes(rows: DataFrame, value: str) -> DataFrame:
    """Index of the smallest and the largest value of each record, the first of equals."""
    return rows.groupBy("record").agg(F.min_by("i", F.struct(value, "i")).alias("argmin"), F.max_by("i", F.struct(F.col(value), -F.col("i"))).alias("argmax"))


def outliers(rows: DataFrame, value: str) -> DataFrame:
    """Rows within 1.5 quartile ranges of their record's quartiles."""
    q = rows.groupBy("record").agg(F.percentile(value, 0.25).alias("_q1"), F.percentile(value, 0.75).alias("_q3"))
    reach = 1.5 * (F.col("_q3") - F.col("_q1"))
    return rows.join(q, "record").where(F.col(value).between(F.col("_q1") - reach, F.col("_q3") + reach)).drop("_q1", "_q3")


def close_values(beats: DataFrame, value: str, reach: float) -> DataFrame:
    """(record, dx, dy): the distances of the values, and of the next values, of all pairs of beats of a record at most `reach`
    apart; dy is null where one of them is the last. Values meet in bins of width `reach`, not all with all."""
    w = Window.partitionBy("record").orderBy("i")
    rows = beats.where(F.col(value).isNotNull()).select("record", "i", F.col(value).alias("x"), F.lead(value).over(w).alias("y"))
    rows = rows.withColumn("bin", F.floor(F.col("x") / reach))
    near = rows.select("record", F.col("i").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    dx = F.abs(F.col("x") - F.col("x2"))
    return rows.join(near, ["record", "bin"]).where((F.col("i") < F.col("j")) & (dx <= reach)).select("record", dx.alias("dx"), F.abs(F.col("y") - F.col("y2")).alias("dy"))


def sample_entropy_pairs(beats: DataFrame, value: str, r: float) -> DataFrame:
    """(record, b, a, n): pairs of beats, but the last, whose values are at most `r` apart, and those whose next values are too."""
    n = beats.where(F.col(value).isNotNull()).groupBy("record").agg((F.count(F.lit(1)) - 1).alias("n")).where("n > 0")
    pairs = close_values(beats, value, r).where("dy is not null").groupBy("record").agg(F.count(F.lit(1)).alias("b"), F.count_if(F.col("dy") <= r).alias("a"))
    return n.join(pairs, "record", "left").fillna(0, ["a", "b"])


def cosen(beats: DataFrame, value: str, r: float) -> DataFrame:
    """Coefficient of sample entropy at radius r: -ln(a / b) + ln(2 r) - ln(mean); without a, its term is 0."""
    pairs = sample_entropy_pairs(beats, value, r)
    mean = beats.groupBy("record").agg(F.avg(value).alias("_mean"))
    quotient = F.when(F.col("a") > 0, -F.log(F.col("a") / F.col("b"))).otherwise(F.lit(0.0))
    return pairs.join(mean, "record").where("b > 0").select("record", "a", "b", (quotient + F.log(F.lit(2 * r)) - F.log("_mean")).alias("cosen"))


def radii(first: float = 0.03, step: float = 0.005, last: float = 0.5) -> list[float]:
    return [round(first + step * k, 6) for k in range(round((last - first) / step) + 1)]


def cosen_grid(beats: DataFrame, value: str, grid: list[float], least: int = 5) -> DataFrame:
    """(record, r, a, b, cosen): the coefficient of sample entropy at the smallest radius of the grid with at least `least` ordered
    matches of two values, else at the largest; infinite where not even single values match.

    All beats are single values, all but the last begin a pair of values. One pass over the close pairs serves the whole
    grid: each pair counts from the radius on that it needs.
    """
    needs = lambda d: F.aggregate(F.array(*map(F.lit, grid)), F.lit(0), lambda k, r: k + (r < d).cast("int"))
    pairs = close_values(beats, value, grid[-1]).select("record", needs(F.col("dx")).alias("kb"), needs(F.greatest("dx", "dy")).alias("ka"), F.col("dy").isNotNull().alias("two"))
    b = pairs.groupBy("record", F.col("kb").alias("k")).agg((2 * F.count(F.lit(1))).alias("b"), F.lit(0).cast("long").alias("a"))
    a = pairs.where("two").groupBy("record", F.col("ka").alias("k")).agg(F.lit(0).cast("long").alias("b"), (2 * F.count(F.lit(1))).alias("a"))
    mean = beats.where(F.col(value).isNotNull()).groupBy("record").agg(F.avg(value).alias("_mean"))
    every = mean.select("record", F.posexplode(F.array(*map(F.lit, grid))).alias("k", "r"))
    counts = b.unionByName(a).groupBy("record", "k").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    w = Window.partitionBy("record").orderBy("k")
    rows = every.join(counts, ["record", "k"], "left").fillna(0, ["a", "b"]).withColumns({c: F.sum(c).over(w) for c in ("a", "b")})
    chosen = rows.where((F.col("a") >= least) | (F.col("k") == len(grid) - 1)).groupBy("record").agg(F.min_by(F.struct("r", "a", "b"), "k").alias("s")).select("record", "s.*").join(mean, "record")
    quotient = F.when(F.col("a") > 0, -F.log(F.col("a") / F.col("b"))).otherwise(F.lit(0.0))
    value = F.when(F.col("b") == 0, F.lit(float("inf"))).otherwise(quotient + F.log(2 * F.col("r")) - F.log("_mean"))
    return chosen.select("record", "r", "a", "b", value.alias("cosen"))


def fuzzy_entropy(beats: DataFrame, value: str, r: float = 0.05) -> DataFrame:
    """(record, entropy): -ln(A / B) + ln(2 r) - 0.8 ln(mean), where A and B are the mean likeness exp(-d^n / r) of all ordered
    pairs of two consecutive values and of single ones, n being how many there are. The distance of two single values is 0, so
    is their B one; that of two pairs is the spread of their two differences over their sum."""
    w = Window.partitionBy("record").orderBy("i")
    known = beats.where(F.col(value).isNotNull())
    rows = known.select("record", "i", F.col(value).alias("x"), F.lead(value).over(w).alias("y")).where("y is not null")
    n = rows.groupBy("record").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(n, "record")
    other = rows.select("record", F.col("i").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    d1, d2 = F.abs(F.col("x") - F.col("x2")), F.abs(F.col("y") - F.col("y2"))
    d = F.abs(d1 - d2) / (d1 + d2 + 1e-5)
    # All pairs within a record are what is asked; (i, j) and (j, i) are alike, and a pair with itself has distance 0.
    sums = rows.join(other, "record").where("i < j").groupBy("record").agg(F.sum(F.exp(-F.pow(d, F.col("n")) / r)).alias("s"))
    mean = known.groupBy("record").agg(F.avg(value).alias("_mean"))
    a = (2 * F.coalesce("s", F.lit(0.0)) + F.col("n")) / (F.col("n") * F.col("n"))
    out = n.join(sums, "record", "left").join(mean, "record")
    return out.select("record", (-F.log(a) + F.log(F.lit(2 * r)) - 0.8 * F.log("_mean")).alias("entropy"))


def binary_entropy(p: Column) -> Column:
    """Entropy in bits of a chance, clipped away from 0 and 1."""
    q = F.greatest(F.lit(1e-10), F.least(F.lit(1 - 1e-10), p))
    return -(q * F.log2(q) + (1 - q) * F.log2(1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def algebraic_sigmoid(x: Column, alpha: float = 4.0) -> Column:
    return 1 - alpha * x / F.sqrt(1 + (alpha * x) * (alpha * x))
