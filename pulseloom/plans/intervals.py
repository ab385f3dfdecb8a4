"""Queries on masks, regions and interval joins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import joins, regions
from ..sources.tables import beats, samples
from .sequences import BEATS, HOUR, rounded

HIGH = 60.0
SAMPLES = """WITH samples AS (
  SELECT vec_id AS record, label, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
"""
FRAME = "OVER (PARTITION BY record ORDER BY i ROWS BETWEEN {} AND {})"
_MASK = "CASE WHEN value > 60 THEN 1 ELSE 0 END"
RUNS = f"""
, s AS (SELECT *, CASE WHEN value > 60 AND NOT coalesce(lag(value) OVER w > 60, false) THEN 1 ELSE 0 END AS s, count(*) OVER (PARTITION BY record) AS n FROM beats WINDOW w AS (PARTITION BY record ORDER BY i)),
g AS (SELECT *, sum(s) OVER (PARTITION BY record ORDER BY i) AS g FROM s),
runs AS (SELECT record, min(i) AS start, max(i) + 1 AS "end", max(n) AS n FROM g WHERE value > 60 GROUP BY record, g)
"""


def _high(rows):
    return rows.withColumn("m", (F.col("value") > HIGH).cast("int"))


def mask_regions(spark, sf):
    return regions.regions(beats(spark, sf), F.col("value") > HIGH)


def regions_closed(spark, sf):
    return regions.regions(beats(spark, sf), F.col("value") > HIGH, closed=True)


def regions_to_mask(spark, sf):
    rows = beats(spark, sf)
    return regions.to_mask(regions.regions(rows, F.col("value") > HIGH), rows.groupBy("record").agg(F.count(F.lit(1)).alias("n")))


def closing3(spark, sf):
    return regions.closing_shifted(_high(beats(spark, sf)), "m", 3).select("record", "i", "m", "closed")


def opening5(spark, sf):
    return regions.opening_shifted(_high(beats(spark, sf)), "m", 5).select("record", "i", "m", "opened")


def closing_sym(spark, sf):
    return regions.closing_symmetric(_high(beats(spark, sf)), "m", 5).select("record", "i", "m", "closed")


def causal_morphology(spark, sf):
    out = regions.causal_morphology(samples(spark, sf), "x", 5)
    return rounded(out.select("record", "i", "opened", "closed", "top_hat", "bottom_hat"), "opened", "closed", "top_hat", "bottom_hat")


def largest_region(spark, sf):
    return regions.largest(regions.regions(beats(spark, sf), F.col("value") > HIGH))


def session_merge(spark, sf):
    spans = beats(spark, sf).select("record", F.col("t").alias("start"), (F.col("t") + HOUR).alias("end"))
    return rounded(regions.merged(spans, 5 * HOUR), "start", "end", places=3)


def mask_union(spark, sf):
    rows = beats(spark, sf).withColumn("both", (F.col("value") > HIGH) | (F.col("kind") == "V")).withColumn("product", (F.col("value") > HIGH) & (F.col("kind") == "V"))
    return rows.groupBy("record").agg(F.count_if("both").alias("any_mask"), F.count_if("product").alias("both_masks"))


def _kinds(spark, sf):
    rows = beats(spark, sf)
    return rows.where("event_type = 'click'").select("record", "t"), rows.where("event_type = 'purchase'").select("record", "t")


_KINDS = BEATS + ", a AS (SELECT record, t FROM beats WHERE event_type = 'click'), b AS (SELECT record, t FROM beats WHERE event_type = 'purchase')"


def nearest_within_tol(spark, sf):
    return rounded(joins.nearest(*_kinds(spark, sf), 4 * HOUR).select("record", "t", F.coalesce("t2", F.lit(-1.0)).alias("t2")), "t", "t2", places=3)


def tp_fp_fn(spark, sf):
    return joins.match_counts(*_kinds(spark, sf), 4 * HOUR)


def asof_last_before(spark, sf):
    return rounded(joins.last_before(*_kinds(spark, sf)).select("record", "t", F.coalesce("t2", F.lit(-1.0)).alias("t2")), "t", "t2", places=3)


def first_after(spark, sf):
    return rounded(joins.first_after(*_kinds(spark, sf), 12 * HOUR).select("record", "t", F.coalesce("t2", F.lit(-1.0)).alias("t2")), "t", "t2", places=3)


def window_peak_match(spark, sf):
    return joins.window_match(*_kinds(spark, sf), 24 * HOUR, 4 * HOUR)


def diagnosis_last_writer(spark, sf):
    rows = beats(spark, sf)
    found = regions.regions(rows, F.col("value") > HIGH).select("record", F.lit("HIGH").alias("name"), F.lit(1).alias("seq"), F.col("start").alias("first"), (F.col("end") - 1).alias("last"))
    odd = regions.regions(rows, F.col("kind") == "V").select("record", F.lit("VENTRICULAR").alias("name"), F.lit(2).alias("seq"), F.col("start").alias("first"), (F.col("end") - 1).alias("last"))
    return joins.label_beats(rows, found.unionByName(odd)).select("record", "i", F.coalesce("diagnosis", F.lit("-")).alias("diagnosis"))


def interval_clip(spark, sf):
    rows = beats(spark, sf)
    labels = regions.regions(rows, F.col("value") > HIGH).withColumn("name", F.lit("HIGH"))
    sizes = rows.groupBy("record").agg(F.count(F.lit(1)).alias("n"))
    cuts = sizes.select("record", F.explode(F.expr("sequence(0L, n - 1, 10L)")).alias("s0")).select("record", (F.col("s0") / 10).cast("long").alias("seg"), "s0", (F.col("s0") + 10).alias("s1"))
    return joins.clip(labels, cuts)


def interval_overlap(spark, sf):
    rows = beats(spark, sf)
    high = regions.regions(rows, F.col("value") > HIGH)
    odd = regions.regions(rows, F.col("kind") == "V").select(F.col("record").alias("r2"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    both = high.join(odd, (F.col("record") == F.col("r2")) & (F.col("start") < F.col("e2")) & (F.col("end") > F.col("s2")))
    return rounded(both.withColumn("share", joins.overlap_share(F.col("start"), F.col("end"), F.col("s2"), F.col("e2"))).select("record", "start", "s2", "share"), "share")


def non_overlapping(spark, sf):
    spans = beats(spark, sf).groupBy("record").agg(F.avg("value").alias("m"), (F.stddev_pop("value") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    spans = spans.select("record", (F.col("m") - F.col("se")).alias("low"), (F.col("m") + F.col("se")).alias("high"))
    return joins.disjoint(spans.where("low IS NOT NULL"), "record", "low", "high")


def seen_elsewhere(spark, sf):
    docs = spark.read.parquet(f"{sf}/orders.parquet")
    urgent = docs.where("o_orderstatus = 'F'").select("o_custkey").distinct()
    return docs.join(urgent, "o_custkey", "left_semi").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))


def not_in_anti(spark, sf):
    customers, orders = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("customer", "orders"))
    return customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def pair_exclusion(spark, sf):
    clicks, purchases = _kinds(spark, sf)
    near = joins.within(clicks, purchases.withColumnRenamed("t", "t2"), 4 * HOUR).select("record", "t").distinct()
    return clicks.join(near, ["record", "t"], "left_anti").groupBy("record").agg(F.count(F.lit(1)).alias("n"))


def pairwise_rmse(spark, sf):
    from ..functions.waveform import rmse

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    near = rows.select((F.col("vec_id") - 1).alias("v"), F.col("vec_id").alias("v2"), F.col("x").alias("y"))
    pairs = rows.join(near, F.col("vec_id") == F.col("v"))
    return rounded(pairs.select("vec_id", "v2", rmse(F.col("x"), F.col("y")).alias("rmse")), "rmse")


def pairwise_rmse_all(spark, sf):
    """All pairs of waveforms within a label; `pairwise_rmse` has those of neighbouring ids only."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("record"), "label", F.col("embedding").cast("array<double>").alias("x"))
    return rounded(joins.all_pairs_rmse(rows, "label").withColumnsRenamed({"record": "vec_id", "record2": "v2"}), "rmse")


def _frame(a, b):
    return FRAME.format(a, b)


P, N = "PRECEDING", "FOLLOWING"
_GRID = ", m AS (SELECT record, i, " + _MASK + " AS m FROM beats)"
_NEAR = _KINDS + ", p AS (SELECT a.record, a.t, b.t AS t2 FROM a JOIN b ON a.record = b.record AND abs(a.t - b.t) < 14400)"
QUERIES = {
    "mask_regions": (mask_regions, BEATS + RUNS + 'SELECT record, start, "end" FROM runs'),
    "regions_closed": (regions_closed, BEATS + RUNS + 'SELECT record, start, CASE WHEN "end" = n THEN n - 1 ELSE "end" END AS "end" FROM runs'),
    "regions_to_mask": (regions_to_mask, BEATS + "SELECT record, i, value > 60 AS mask FROM beats"),
    "closing3": (closing3, BEATS + _GRID + f", d AS (SELECT *, max(m) {_frame('1 ' + P, 'CURRENT ROW')} AS d FROM m) SELECT record, i, m, min(d) {_frame('1 ' + P, 'CURRENT ROW')} AS closed FROM d"),
    "opening5": (opening5, BEATS + _GRID + f", d AS (SELECT *, min(m) {_frame('2 ' + P, '1 ' + N)} AS d FROM m) SELECT record, i, m, max(d) {_frame('2 ' + P, '1 ' + N)} AS opened FROM d"),
    "closing_sym": (closing_sym, BEATS + _GRID + f", d AS (SELECT *, max(m) {_frame('2 ' + P, '2 ' + N)} AS d FROM m) SELECT record, i, m, min(d) {_frame('2 ' + P, '2 ' + N)} AS closed FROM d"),
    "causal_morphology": (causal_morphology, SAMPLES + f""", a AS (SELECT *, max(x) {_frame('4 ' + P, 'CURRENT ROW')} AS d, min(x) {_frame('CURRENT ROW', '4 ' + N)} AS e FROM samples),
b AS (SELECT *, max(e) {_frame('4 ' + P, 'CURRENT ROW')} AS o, min(d) {_frame('CURRENT ROW', '4 ' + N)} AS c FROM a)
SELECT record, i, round(o, 4) + 0.0 AS opened, round(c, 4) + 0.0 AS closed, round(x - o, 4) + 0.0 AS top_hat, round(c - x, 4) + 0.0 AS bottom_hat FROM b"""),
    "largest_region": (largest_region, BEATS + RUNS + ', r AS (SELECT *, row_number() OVER (PARTITION BY record ORDER BY start - "end", start) AS rn FROM runs) SELECT record, start, "end" FROM r WHERE rn = 1'),
    "session_merge": (session_merge, BEATS + """, g AS (SELECT *, CASE WHEN t - lag(t) OVER w - 3600 >= 18000 OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS g FROM beats WINDOW w AS (PARTITION BY record ORDER BY i)),
s AS (SELECT *, sum(g) OVER (PARTITION BY record ORDER BY i) AS s FROM g) SELECT record, round(min(t), 3) AS start, round(max(t) + 3600, 3) AS "end", count(*) AS parts FROM s GROUP BY record, s"""),
    "mask_union": (mask_union, BEATS + "SELECT record, count(*) FILTER (value > 60 OR kind = 'V') AS any_mask, count(*) FILTER (value > 60 AND kind = 'V') AS both_masks FROM beats GROUP BY record"),
    "nearest_within_tol": (nearest_within_tol, _NEAR + ", n AS (SELECT record, t, first(t2 ORDER BY abs(t - t2), t2) AS t2 FROM p GROUP BY record, t) SELECT a.record, round(a.t, 3) AS t, round(coalesce(t2, -1), 3) AS t2 FROM a LEFT JOIN n ON a.record = n.record AND a.t = n.t"),
    "tp_fp_fn": (tp_fp_fn, _KINDS + """, x AS (SELECT record, count(*) FILTER (EXISTS (FROM b WHERE b.record = a.record AND abs(a.t - b.t) < 14400)) AS tp, count(*) AS n FROM a GROUP BY record),
y AS (SELECT record, count(*) AS fp FROM b WHERE NOT EXISTS (FROM a WHERE b.record = a.record AND abs(a.t - b.t) <= 14400) GROUP BY record)
SELECT coalesce(x.record, y.record) AS record, coalesce(tp, 0) AS tp, coalesce(n - tp, 0) AS fn, coalesce(fp, 0) AS fp FROM x FULL JOIN y ON x.record = y.record"""),
    "asof_last_before": (asof_last_before, _KINDS + "SELECT a.record, round(a.t, 3) AS t, round(coalesce(b.t, -1), 3) AS t2 FROM a ASOF LEFT JOIN b ON a.record = b.record AND a.t > b.t"),
    "first_after": (first_after, _KINDS + "SELECT a.record, round(a.t, 3) AS t, round(coalesce(CASE WHEN b.t - a.t < 43200 THEN b.t END, -1), 3) AS t2 FROM a ASOF LEFT JOIN b ON a.record = b.record AND a.t < b.t"),
    "window_peak_match": (window_peak_match, _KINDS + """, x AS (SELECT *, CAST(floor(t / 86400) AS BIGINT) AS win FROM a), y AS (SELECT *, CAST(floor(t / 86400) AS BIGINT) AS win FROM b),
xs AS (SELECT record, win, count(*) AS n, count(*) FILTER (EXISTS (FROM y WHERE y.record = x.record AND y.win = x.win AND abs(x.t - y.t) <= 14400)) AS tp FROM x GROUP BY ALL),
ys AS (SELECT record, win, count(*) FILTER (NOT EXISTS (FROM x WHERE y.record = x.record AND y.win = x.win AND abs(x.t - y.t) <= 14400)) AS fp FROM y GROUP BY ALL)
SELECT coalesce(xs.record, ys.record) AS record, coalesce(xs.win, ys.win) AS win, coalesce(tp, 0) AS tp, coalesce(n - tp, 0) AS fn, coalesce(fp, 0) AS fp FROM xs FULL JOIN ys ON xs.record = ys.record AND xs.win = ys.win"""),
    "diagnosis_last_writer": (diagnosis_last_writer, BEATS + "SELECT record, i, CASE WHEN kind = 'V' THEN 'VENTRICULAR' WHEN value > 60 THEN 'HIGH' ELSE '-' END AS diagnosis FROM beats"),
    "interval_clip": (interval_clip, BEATS + RUNS + """, c AS (SELECT record, unnest(generate_series(0, n - 1, 10)) AS s0 FROM (SELECT record, count(*) AS n FROM beats GROUP BY record))
SELECT runs.record, s0 // 10 AS seg, 'HIGH' AS name, greatest(start, s0) - s0 AS start, least("end", s0 + 10) - s0 AS "end" FROM runs JOIN c ON runs.record = c.record AND start < s0 + 10 AND "end" > s0"""),
    "interval_overlap": (interval_overlap, BEATS + RUNS + """, vs AS (SELECT *, CASE WHEN kind = 'V' AND NOT coalesce(lag(kind) OVER w = 'V', false) THEN 1 ELSE 0 END AS s FROM beats WINDOW w AS (PARTITION BY record ORDER BY i)),
vg AS (SELECT *, sum(s) OVER (PARTITION BY record ORDER BY i) AS g FROM vs), v AS (SELECT record, min(i) AS s2, max(i) + 1 AS e2 FROM vg WHERE kind = 'V' GROUP BY record, g)
SELECT runs.record, start, s2, round((least("end", e2) - greatest(start, s2)) / (e2 - s2) * 100, 4) AS share FROM runs JOIN v ON runs.record = v.record AND start < e2 AND "end" > s2"""),
    "non_overlapping": (non_overlapping, BEATS + """, s AS (SELECT record, avg(value) - stddev_pop(value) / sqrt(count(*)) AS low, avg(value) + stddev_pop(value) / sqrt(count(*)) AS high FROM beats GROUP BY record)
SELECT record FROM s a WHERE NOT EXISTS (FROM s b WHERE b.record <> a.record AND b.low <= a.high AND b.high >= a.low)"""),
    "seen_elsewhere": (seen_elsewhere, "SELECT o_custkey, count(*) AS orders FROM orders o WHERE EXISTS (FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderstatus = 'F') GROUP BY o_custkey"),
    "not_in_anti": (not_in_anti, "SELECT c_custkey FROM customer WHERE NOT EXISTS (FROM orders WHERE o_custkey = c_custkey)"),
    "pair_exclusion": (pair_exclusion, _KINDS + "SELECT record, count(*) AS n FROM a WHERE NOT EXISTS (FROM b WHERE a.record = b.record AND abs(a.t - b.t) < 14400) GROUP BY record"),
    "pairwise_rmse": (pairwise_rmse, SAMPLES + "SELECT a.record AS vec_id, b.record AS v2, round(sqrt(avg((a.x - b.x) ** 2)), 4) AS rmse FROM samples a JOIN samples b ON b.record = a.record + 1 AND a.i = b.i GROUP BY ALL"),
    "pairwise_rmse_all": (pairwise_rmse_all, SAMPLES + "SELECT a.record AS vec_id, b.record AS v2, round(sqrt(avg((a.x - b.x) ** 2)), 4) AS rmse FROM samples a JOIN samples b ON b.label = a.label AND b.record > a.record AND a.i = b.i GROUP BY ALL"),
}
