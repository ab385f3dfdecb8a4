"""Further queries: boundaries, ensembles, fingerprints, filters, guards, paging, joins by label, sequence rules."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats, waveform
from ..operators import joins, regions, sequence
from ..sources.tables import beats, samples, table
from .intervals import SAMPLES, N, P, _frame
from .measures import _waves
from .sequences import BEATS, HOUR, rounded

#: Savitzky-Golay weights of 5 taps for a cubic.
SAVGOL = [-3 / 35, 12 / 35, 17 / 35, 12 / 35, -3 / 35]


def boundary_iou(spark, sf):
    """Overlap of the dilated borders of two masks of each record."""
    rows = beats(spark, sf).withColumn("a", (F.col("value") > 40).cast("int")).withColumn("b", (F.col("value") > 60).cast("int"))
    w = Window.partitionBy("record").orderBy("i")
    for c in ("a", "b"):
        rows = rows.withColumn(f"{c}1", F.col(c) - F.min(c).over(w.rowsBetween(-1, 1)))
        rows = rows.withColumn(f"{c}2", F.max(f"{c}1").over(w.rowsBetween(-2, 2)))
    both, either = F.count_if((F.col("a2") == 1) & (F.col("b2") == 1)), F.count_if((F.col("a2") == 1) | (F.col("b2") == 1))
    return rounded(rows.groupBy("record").agg((both / either).alias("iou")), "iou")


def ensemble_mean(spark, sf):
    """Mean chance over the members of an ensemble, the waveforms of one label, and how far they disagree."""
    rows = samples(spark, sf).groupBy("label", "i").agg(F.avg(stats.sigmoid(F.col("x"))).alias("p"), F.stddev_pop(stats.sigmoid(F.col("x"))).alias("spread"), F.count(F.lit(1)).alias("members"))
    return rounded(rows, "p", "spread")


def fingerprint(spark, sf):
    q = F.percentile("x", F.array(F.lit(0.005), F.lit(0.5), F.lit(0.995)))
    rows = samples(spark, sf).where("x > 0").groupBy("label").agg(q.alias("q"), F.avg("x").alias("mean"), F.min("x").alias("least"), F.max("x").alias("most"))
    return rounded(rows.select("label", F.get("q", 0).alias("low"), F.get("q", 1).alias("mid"), F.get("q", 2).alias("high"), "mean", "least", "most"), "low", "mid", "high", "mean", "least", "most")


def savitzky_golay(spark, sf):
    w = Window.partitionBy("record").orderBy("i")
    at = lambda k: F.lag("x", -k).over(w)
    smooth = sum((at(k) * SAVGOL[k + 2] for k in (-1, 0, 1, 2)), at(-2) * SAVGOL[0])
    return rounded(samples(spark, sf).withColumn("y", F.coalesce(smooth, F.col("x"))).select("record", "i", "y"), "y")


def baseline_removed(spark, sf):
    rows = sequence.median_filter(samples(spark, sf), "x", 3).withColumnRenamed("median", "m1")
    rows = sequence.median_filter(rows, "m1", 7)
    return rounded(rows.select("record", "i", (F.col("x") - F.col("median")).alias("y")), "y")


def region_interpolated(spark, sf):
    """Samples 20 to 40 replaced by the line between their ends."""
    x = F.transform("x", lambda v, i: F.when(i.between(20, 40), F.get("x", 20) + (i - 20) / 20 * (F.get("x", 40) - F.get("x", 20))).otherwise(v))
    return rounded(_waves(spark, sf).select("record", F.posexplode(x).alias("i", "y")), "y")


def log_transform(spark, sf):
    return rounded(samples(spark, sf).select("record", "i", F.log(F.abs("x") + 0.0001).alias("y")), "y")


def one_hot(spark, sf):
    codes = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: (k == F.col("label")).cast("int"))
    return table(spark, sf, "embeddings").select("vec_id", F.array_join(codes, "").alias("code"))


def min_max_scaled(spark, sf):
    w = Window.partitionBy("record")
    rows = samples(spark, sf).withColumn("y", (F.col("x") - F.min("x").over(w)) / (F.max("x").over(w) - F.min("x").over(w)))
    return rounded(rows.select("record", "i", "y"), "y")


def prominence(spark, sf):
    """Height of each local maximum over the higher of the lowest points around it, within ten beats either way."""
    w = Window.partitionBy("record").orderBy("i")
    rows = beats(spark, sf).withColumn("left", F.min("value").over(w.rowsBetween(-10, 0))).withColumn("right", F.min("value").over(w.rowsBetween(0, 10)))
    peaks = sequence.local_maxima(rows, "value", 100.0)
    return rounded(peaks.select("record", "i", (F.col("value") - F.greatest("left", "right")).alias("prominence")), "prominence")


def prominence_whole(spark, sf):
    """Height of each local maximum over the higher of the lowest points around it, up to a higher one or the record's end."""
    return rounded(sequence.peak_prominence(beats(spark, sf), "value", 100.0), "prominence")


def chunk_mean(spark, sf):
    return beats(spark, sf).groupBy("record", F.floor(F.col("i") / 8).alias("chunk")).agg((F.avg((F.col("kind") == "V").cast("double")) > 0.5).alias("odd"))


def trimmed(spark, sf):
    rows = beats(spark, sf).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("record")))
    return rows.where((F.col("i") >= 5) & (F.col("i") < F.col("n") - 5)).select("record", "i")


def guards(spark, sf):
    rows = samples(spark, sf).groupBy("record").agg(F.count_if(F.isnan("x") | F.col("x").isNull()).alias("missing"), F.max(F.abs("x")).alias("peak"))
    return rows.select("record", "missing", (F.col("peak") == 0).alias("flat"))


def paging(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.floor(F.col("c_custkey") / 64).alias("page"))
    return rows.groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first"), F.max("c_custkey").alias("last"))


def exact_synonyms(spark, sf):
    names = spark.createDataFrame([(1, "SINUS", "click"), (2, "SINUS", "view"), (3, "VENTRICULAR", "error"), (4, "OTHER", "error")], "seq int, name string, synonym string")
    first = names.groupBy("synonym").agg(F.min_by("name", "seq").alias("name"))
    return beats(spark, sf).join(F.broadcast(first), F.col("event_type") == F.col("synonym"), "left").groupBy("event_type", F.coalesce("name", F.lit("-")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


def star_join(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rounded(rows.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), "total", places=2)


def rate_in_range(spark, sf):
    rows = sequence.rr_intervals(beats(spark, sf)).where("i BETWEEN 11 AND 30")
    return rounded(rows.groupBy("record").agg((60 / F.avg(F.col("rr_raw") / HOUR)).alias("rate")), "rate")


def nearest_label_error(spark, sf):
    """Mean and deviation of the distance from each click to its nearest purchase within a day."""
    rows = beats(spark, sf)
    near = joins.nearest(rows.where("event_type = 'click'"), rows.where("event_type = 'purchase'"), 24 * HOUR).where("t2 is not null")
    gap = (F.col("t2") - F.col("t")) / HOUR
    return rounded(near.groupBy("record").agg(F.count(F.lit(1)).alias("n"), F.avg(gap).alias("mean"), F.stddev_pop(gap).alias("sd")), "mean", "sd", places=3)


def junctional_flag(spark, sf):
    rows = sequence.rr_intervals(beats(spark, sf))
    flag = F.when((F.col("kind") == "V") | (F.col("event_type") == "view"), False).otherwise((F.col("value") < 20) | (F.col("rr_raw") < HOUR))
    return rows.withColumn("j", flag).where("j").select("record", "i")


def tachycardia(spark, sf):
    rows = sequence.rr_intervals(beats(spark, sf)).withColumn("m", (F.col("rr_raw") < 6 * HOUR).cast("int"))
    rows = regions.closing_shifted(regions.opening_shifted(rows, "m", 4).withColumn("m2", F.col("opened")), "m2", 2)
    return regions.regions(rows, F.col("closed") == 1).where("end - start >= 3")


def wenckebach(spark, sf):
    """Ends of at least three growing intervals that a shorter one follows."""
    w = Window.partitionBy("record").orderBy("i")
    rows = sequence.rr_intervals(beats(spark, sf))
    x = lambda k: F.lag("rr_raw", k).over(w)
    return rows.withColumn("m", (x(3) < x(2)) & (x(2) < x(1)) & (F.col("rr_raw") < x(1) * 0.5)).where("m").select("record", "i")


def initial_rate(spark, sf):
    """Median of intervals between normal neighbours, else of all."""
    w = Window.partitionBy("record").orderBy("i")
    rows = sequence.rr_intervals(beats(spark, sf)).withColumn("nn", (F.col("kind") == "N") & (F.lag("kind").over(w) == "N"))
    nn = F.percentile(F.when(F.col("nn"), F.col("rr_raw")), 0.5)
    return rounded(rows.groupBy("record").agg((60 / (F.coalesce(nn, F.percentile("rr_raw", 0.5)) / HOUR)).alias("rate")), "rate")


def poincare(spark, sf):
    """Deviations across and along the line of identity of successive intervals."""
    w = Window.partitionBy("record").orderBy("i")
    rows = sequence.rr_intervals(beats(spark, sf)).withColumn("y", F.lead("rr_raw").over(w)).where("y is not null")
    d, s = (F.col("y") - F.col("rr_raw")) / HOUR, (F.col("y") + F.col("rr_raw")) / HOUR
    return rounded(rows.groupBy("record").agg((F.stddev_pop(d) / F.sqrt(F.lit(2.0))).alias("sd1"), (F.stddev_pop(s) / F.sqrt(F.lit(2.0))).alias("sd2")), "sd1", "sd2")


def warped_distance(spark, sf):
    """Dynamic time warping of every waveform to that of the next id, in Arrow batches; no SQL twin."""
    rows = _waves(spark, sf)
    near = rows.select((F.col("record") - 1).alias("record"), F.col("x").alias("y"))

    @F.pandas_udf("double")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(waveform.dtw_of_pairs([np.asarray(v, float) for v in x], [np.asarray(v, float) for v in y]))

    return rounded(rows.join(near, "record").select("record", distance("x", "y").alias("d")), "d")


def entropy_bits(spark, sf):
    p = F.avg((F.col("kind") == "V").cast("double"))
    return rounded(beats(spark, sf).groupBy("record").agg(p.alias("p")).select("record", stats.binary_entropy(F.col("p")).alias("h")), "h")


def crop_nonzero(spark, sf):
    return samples(spark, sf).where("abs(x) > 0.1").groupBy("record").agg(F.min("i").alias("first"), F.max("i").alias("last"))


def haar_detail(spark, sf):
    """One level of the undecimated Haar transform."""
    w = Window.partitionBy("record").orderBy("i")
    rows = samples(spark, sf).withColumn("b", F.lead("x").over(w)).where("b is not null")
    return rounded(rows.select("record", "i", ((F.col("x") + F.col("b")) / 2).alias("smooth"), ((F.col("b") - F.col("x")) / 2).alias("detail")), "smooth", "detail")


_RRH = BEATS + ", h AS (SELECT *, rr_raw / 3600 AS x FROM rr)"
QUERIES = {
    "boundary_iou": (boundary_iou, BEATS + f""", m AS (SELECT record, i, (value > 40)::INT AS a, (value > 60)::INT AS b FROM beats),
e AS (SELECT record, i, a - min(a) {_frame('1 ' + P, '1 ' + N)} AS a, b - min(b) {_frame('1 ' + P, '1 ' + N)} AS b FROM m),
d AS (SELECT record, max(a) {_frame('2 ' + P, '2 ' + N)} AS a, max(b) {_frame('2 ' + P, '2 ' + N)} AS b FROM e)
SELECT record, round(count(*) FILTER (a = 1 AND b = 1) / count(*) FILTER (a = 1 OR b = 1), 4) AS iou FROM d GROUP BY record"""),
    "ensemble_mean": (ensemble_mean, SAMPLES + "SELECT label, i, round(avg(1 / (1 + exp(-x))), 4) AS p, round(stddev_pop(1 / (1 + exp(-x))), 4) AS spread, count(*) AS members FROM samples GROUP BY label, i"),
    "fingerprint": (fingerprint, SAMPLES + "SELECT label, round(quantile_cont(x, 0.005), 4) AS low, round(quantile_cont(x, 0.5), 4) AS mid, round(quantile_cont(x, 0.995), 4) AS high, round(avg(x), 4) AS mean, round(min(x), 4) AS least, round(max(x), 4) AS most FROM samples WHERE x > 0 GROUP BY label"),
    "savitzky_golay": (savitzky_golay, SAMPLES + "SELECT record, i, round(coalesce((-3 * lag(x, 2) OVER w + 12 * lag(x) OVER w + 17 * x + 12 * lead(x) OVER w - 3 * lead(x, 2) OVER w) / 35, x), 4) + 0.0 AS y FROM samples WINDOW w AS (PARTITION BY record ORDER BY i)"),
    "baseline_removed": (baseline_removed, SAMPLES + f""", a AS (SELECT *, list_sort(list(x) {_frame('3 ' + P, '3 ' + N)}) AS l FROM samples), b AS (SELECT record, i, x, l[len(l) // 2 + 1] AS m FROM a),
c AS (SELECT *, list_sort(list(m) {_frame('7 ' + P, '7 ' + N)}) AS l FROM b) SELECT record, i, round(x - l[len(l) // 2 + 1], 4) + 0.0 AS y FROM c"""),
    "region_interpolated": (region_interpolated, SAMPLES + ", e AS (SELECT record AS r, max(x) FILTER (i = 20) AS a, max(x) FILTER (i = 40) AS b FROM samples GROUP BY record) SELECT record, i, round(CASE WHEN i BETWEEN 20 AND 40 THEN a + (i - 20) / 20 * (b - a) ELSE x END, 4) + 0.0 AS y FROM samples JOIN e ON r = record"),
    "log_transform": (log_transform, SAMPLES + "SELECT record, i, round(ln(abs(x) + 0.0001), 4) + 0.0 AS y FROM samples"),
    "one_hot": (one_hot, "SELECT vec_id, array_to_string([(k = label)::INT FOR k IN range(10)], '') AS code FROM embeddings"),
    "min_max_scaled": (min_max_scaled, SAMPLES + "SELECT record, i, round((x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w), 4) + 0.0 AS y FROM samples WINDOW w AS (PARTITION BY record)"),
    "prominence": (prominence, BEATS + f", m AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b, min(value) {_frame('10 ' + P, 'CURRENT ROW')} AS l, min(value) {_frame('CURRENT ROW', '10 ' + N)} AS r FROM beats WINDOW w AS (PARTITION BY record ORDER BY i)) SELECT record, i, round(value - greatest(l, r), 4) AS prominence FROM m WHERE value > a AND value > b AND value > 100"),
    "prominence_whole": (prominence_whole, BEATS + """, m AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM beats WINDOW w AS (PARTITION BY record ORDER BY i)), p AS (SELECT record, i, value FROM m WHERE value > a AND value > b AND value > 100),
h AS (SELECT p.record, p.i, p.value, coalesce(max(o.i) FILTER (o.i < p.i AND o.value > p.value), -1) AS l, min(o.i) FILTER (o.i > p.i AND o.value > p.value) AS r FROM p JOIN beats o USING (record) GROUP BY ALL)
SELECT h.record, h.i, round(h.value - greatest(min(o.value) FILTER (o.i BETWEEN l + 1 AND h.i), min(o.value) FILTER (o.i >= h.i AND (r IS NULL OR o.i < r))), 4) AS prominence FROM h JOIN beats o ON o.record = h.record GROUP BY h.record, h.i, h.value"""),
    "chunk_mean": (chunk_mean, BEATS + "SELECT record, i // 8 AS chunk, avg((kind = 'V')::INT) > 0.5 AS odd FROM beats GROUP BY 1, 2"),
    "trimmed": (trimmed, BEATS + ", n AS (SELECT *, count(*) OVER (PARTITION BY record) AS n FROM beats) SELECT record, i FROM n WHERE i >= 5 AND i < n - 5"),
    "guards": (guards, SAMPLES + "SELECT record, count(*) FILTER (x IS NULL OR isnan(x)) AS missing, max(abs(x)) = 0 AS flat FROM samples GROUP BY record"),
    "paging": (paging, "SELECT c_custkey // 64 AS page, count(*) AS n, min(c_custkey) AS first, max(c_custkey) AS last FROM customer GROUP BY 1"),
    "exact_synonyms": (exact_synonyms, BEATS + "SELECT event_type, CASE event_type WHEN 'click' THEN 'SINUS' WHEN 'view' THEN 'SINUS' WHEN 'error' THEN 'VENTRICULAR' ELSE '-' END AS name, count(*) AS n FROM beats GROUP BY 1, 2"),
    "star_join": (star_join, "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"),
    "rate_in_range": (rate_in_range, _RRH + "SELECT record, round(60 / avg(x), 4) AS rate FROM h WHERE i BETWEEN 11 AND 30 GROUP BY record"),
    "nearest_label_error": (nearest_label_error, BEATS + """, a AS (SELECT record, t FROM beats WHERE event_type = 'click'), b AS (SELECT record, t FROM beats WHERE event_type = 'purchase'),
p AS (SELECT a.record, a.t, b.t AS t2 FROM a JOIN b ON a.record = b.record AND abs(a.t - b.t) < 86400), n AS (SELECT record, t, first(t2 ORDER BY abs(t - t2), t2) AS t2 FROM p GROUP BY record, t)
SELECT record, count(*) AS n, round(avg((t2 - t) / 3600), 3) AS mean, round(stddev_pop((t2 - t) / 3600), 3) AS sd FROM n GROUP BY record"""),
    "junctional_flag": (junctional_flag, BEATS + "SELECT record, i FROM rr WHERE kind <> 'V' AND event_type <> 'view' AND (value < 20 OR rr_raw < 3600)"),
    "tachycardia": (tachycardia, BEATS + f""", m AS (SELECT record, i, (rr_raw < 21600)::INT AS m FROM rr), a AS (SELECT *, min(m) {_frame('2 ' + P, '1 ' + N)} AS e FROM m), b AS (SELECT *, max(e) {_frame('2 ' + P, '1 ' + N)} AS o FROM a),
c AS (SELECT *, max(o) {_frame('1 ' + P, 'CURRENT ROW')} AS d FROM b), f AS (SELECT *, min(d) {_frame('1 ' + P, 'CURRENT ROW')} AS c FROM c), g AS (SELECT *, i - row_number() OVER (PARTITION BY record, c ORDER BY i) AS g FROM f)
SELECT record, min(i) AS start, max(i) + 1 AS "end" FROM g WHERE c = 1 GROUP BY record, g HAVING count(*) >= 3"""),
    "wenckebach": (wenckebach, BEATS + ", x AS (SELECT record, i, rr_raw AS d, lag(rr_raw) OVER w AS a, lag(rr_raw, 2) OVER w AS b, lag(rr_raw, 3) OVER w AS c FROM rr WINDOW w AS (PARTITION BY record ORDER BY i)) SELECT record, i FROM x WHERE c < b AND b < a AND d < a * 0.5"),
    "initial_rate": (initial_rate, _RRH + ", p AS (SELECT *, kind = 'N' AND lag(kind) OVER (PARTITION BY record ORDER BY i) = 'N' AS nn FROM h) SELECT record, round(60 / coalesce(median(x) FILTER (nn), median(x)), 4) AS rate FROM p GROUP BY record"),
    "poincare": (poincare, _RRH + ", p AS (SELECT record, x, lead(x) OVER (PARTITION BY record ORDER BY i) AS y FROM h) SELECT record, round(stddev_pop(y - x) / sqrt(2), 4) AS sd1, round(stddev_pop(y + x) / sqrt(2), 4) AS sd2 FROM p WHERE y IS NOT NULL GROUP BY record"),
    "warped_distance": (warped_distance, None),
    "entropy_bits": (entropy_bits, BEATS + ", p AS (SELECT record, avg((kind = 'V')::INT) AS p FROM beats GROUP BY record) SELECT record, round(-(p * log2(p) + (1 - p) * log2(1 - p)), 4) AS h FROM p"),
    "crop_nonzero": (crop_nonzero, SAMPLES + "SELECT record, min(i) AS first, max(i) AS last FROM samples WHERE abs(x) > 0.1 GROUP BY record"),
    "haar_detail": (haar_detail, SAMPLES + ", b AS (SELECT *, lead(x) OVER (PARTITION BY record ORDER BY i) AS b FROM samples) SELECT record, i, round((x + b) / 2, 4) + 0.0 AS smooth, round((b - x) / 2, 4) + 0.0 AS detail FROM b WHERE b IS NOT NULL"),
}
