"""Queries on beats in order: intervals, neighbourhoods, filters, runs, folds, patterns."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns, stats
from ..operators import sequence
from ..sources.tables import beats

HOUR = 3600.0

#: The beats of a record in DuckDB's SQL, before the queries below.
BEATS = """WITH RECURSIVE beats AS (
  SELECT user_id AS record, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i, epoch_us(ts) / 1e6 AS t,
         CASE WHEN event_type IN ('error', 'signup') THEN 'V' ELSE 'N' END AS kind, value, event_type FROM events),
rr AS (
  SELECT *, coalesce(t - lag(t) OVER w, lead(t) OVER w - t) AS rr_raw,
         CASE WHEN kind = 'N' THEN coalesce(t - lag(t) OVER w, lead(t) OVER w - t) END AS rr
  FROM beats WINDOW w AS (PARTITION BY record ORDER BY i))
"""


def rounded(df, *names, places=4):
    return df.withColumns({n: F.round(F.col(n).cast("double"), places) for n in names})


def rr_raw(spark, sf):
    return rounded(sequence.rr_intervals(beats(spark, sf)).select("record", "i", "rr_raw"), "rr_raw")


def rr_masked(spark, sf):
    return rounded(sequence.rr_intervals(beats(spark, sf)).select("record", "i", "rr"), "rr")


def rr_smooth(spark, sf):
    return rounded(sequence.smooth_in_place(beats(spark, sf), "value"), "smooth")


def neighbourhood_ratio(spark, sf):
    out = sequence.neighbourhood(beats(spark, sf), F.col("kind") == "V")
    return rounded(out.select("record", "i", "near_n", "near_flagged", "near_share"), "near_share").withColumn("mostly", F.col("near_share") > 0.5)


def box_sum5(spark, sf):
    return sequence.box_sum(beats(spark, sf), F.col("kind") == "N").select("record", "i", "box", (F.col("box") >= 4).alias("regular"))


def median_filter(spark, sf):
    return sequence.median_filter(beats(spark, sf), "value", 2).select("record", "i", "median")


def rolling_stats(spark, sf):
    return rounded(sequence.rolling(beats(spark, sf), "value", 5).select("record", "i", "roll_mean", "roll_sum", "roll_max", "roll_range"), "roll_mean", "roll_sum", "roll_range")


def derivative5(spark, sf):
    return rounded(sequence.derivative5(beats(spark, sf), "value", 250.0).select("record", "i", "d5"), "d5")


def close_pairs(spark, sf):
    return sequence.close_pairs(beats(spark, sf), HOUR).select("record", "i", "double")


def label_change_points(spark, sf):
    return sequence.change_points(beats(spark, sf), "kind")


def streak_search(spark, sf):
    return sequence.streak(beats(spark, sf), "value")


def refractory_suppression(spark, sf):
    return rounded(sequence.refractory(beats(spark, sf), 6 * HOUR), "last_kept", places=3)


def local_maxima(spark, sf):
    return sequence.local_maxima(beats(spark, sf), "value", 60.0).select("record", "i", "value")


def page_hinkley(spark, sf):
    return sequence.page_hinkley(beats(spark, sf), "value", 1.0, 150.0).select("record", F.coalesce("change_at", F.lit(-1)).alias("change_at"))


def wave_ids(spark, sf):
    rows = beats(spark, sf)
    return rows.select("record", "i", F.row_number().over(Window.partitionBy("record", "kind").orderBy("i")).alias("wave_id"))


def rmssd_per_record(spark, sf):
    return rounded(stats.rmssd(sequence.rr_intervals(beats(spark, sf)), "rr"), "rmssd")


def interval_summary(spark, sf):
    rows = sequence.rr_intervals(beats(spark, sf)).where("rr is not null").groupBy("record").agg(*stats.summary("rr"))
    return rounded(rows, *[c for c in rows.columns if c not in ("record", "n")], places=3)


def argmin_argmax(spark, sf):
    return stats.arg_extremes(beats(spark, sf), "value")


def iqr_filter(spark, sf):
    return stats.outliers(beats(spark, sf), "value").select("record", "i", "value")


def cosen(spark, sf):
    rows = sequence.rr_intervals(beats(spark, sf)).withColumn("h", F.col("rr_raw") / HOUR)
    return rounded(stats.cosen(rows, "h", 2.0), "cosen")


def mode_of_kind(spark, sf):
    n = beats(spark, sf).groupBy("record", "event_type").count()
    return n.groupBy("record").agg(F.max_by("event_type", F.struct("count", F.lit(0) - F.ascii("event_type"), F.lit(0) - F.ascii(F.substring("event_type", 2, 1)))).alias("mode"), F.max("count").alias("n"))


def weighted_history(spark, sf):
    w = Window.partitionBy("record").orderBy("i")
    rows = sequence.rr_intervals(beats(spark, sf))
    lags = [F.lag("rr_raw", k).over(w) for k in (3, 2, 1)]
    out = rows.withColumn("expected", (lags[0] + 2 * lags[1] + 3 * lags[2]) / 6).where("expected is not null")
    return rounded(out.select("record", "i", "expected"), "expected")


def beat_string(spark, sf):
    return patterns.beat_string(beats(spark, sf))


def repaired_string(spark, sf):
    return patterns.repaired(patterns.beat_string(beats(spark, sf)))


def _pattern(name):
    def run(spark, sf):
        return patterns.find_all(patterns.beat_string(beats(spark, sf)), name, patterns.PATTERNS[name])

    return run


def _pattern_sql(name):
    p = patterns.PATTERNS[name]
    return BEATS + f"""
, s AS (SELECT record, string_agg(kind, '' ORDER BY i) AS b FROM beats GROUP BY record),
m AS (SELECT record, regexp_extract_all(b, '{p}') AS m, string_split_regex(b, '{p}') AS g FROM s),
h AS (SELECT record, m, g, unnest(generate_series(1, len(m))) AS k FROM m)
SELECT record, '{name}' AS name,
  CAST(list_sum([len(x) FOR x IN g[1:k]]) + coalesce(list_sum([len(x) FOR x IN m[1:k - 1]]), 0) AS BIGINT) AS first,
  CAST(list_sum([len(x) FOR x IN g[1:k]]) + coalesce(list_sum([len(x) FOR x IN m[1:k - 1]]), 0) + len(m[k]) - 1 AS BIGINT) AS last
FROM h"""


W = "WINDOW w AS (PARTITION BY record ORDER BY i)"
QUERIES = {
    "rr_raw": (rr_raw, BEATS + "SELECT record, i, round(rr_raw, 4) AS rr_raw FROM rr"),
    "rr_masked": (rr_masked, BEATS + "SELECT record, i, round(rr, 4) AS rr FROM rr"),
    "rr_smooth_fold": (rr_smooth, BEATS + """, n AS (SELECT record, max(i) AS last FROM beats GROUP BY record),
f AS (SELECT record, i, value AS smooth FROM beats WHERE i = 0
  UNION ALL SELECT b.record, b.i, CASE WHEN b.i = n.last THEN b.value ELSE (f.smooth + b.value + a.value) / 3 END
  FROM f JOIN beats b ON b.record = f.record AND b.i = f.i + 1 JOIN n ON n.record = b.record
  LEFT JOIN beats a ON a.record = b.record AND a.i = b.i + 1)
SELECT record, i, round(smooth, 4) AS smooth FROM f"""),
    "neighbourhood_ratio": (neighbourhood_ratio, BEATS + f"""SELECT record, i, count(*) OVER f AS near_n, sum((kind = 'V')::INT) OVER f AS near_flagged,
 round(sum((kind = 'V')::INT) OVER f / count(*) OVER f, 4) AS near_share, round(sum((kind = 'V')::INT) OVER f / count(*) OVER f, 4) > 0.5 AS mostly
FROM beats WINDOW f AS (PARTITION BY record ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"""),
    "box_sum5": (box_sum5, BEATS + """SELECT record, i, sum((kind = 'N')::INT) OVER f + 5 - count(*) OVER f AS box, sum((kind = 'N')::INT) OVER f + 5 - count(*) OVER f >= 4 AS regular
FROM beats WINDOW f AS (PARTITION BY record ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"""),
    "median_filter": (median_filter, BEATS + """, f AS (SELECT record, i, list_sort(list(value) OVER (PARTITION BY record ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS l FROM beats)
SELECT record, i, l[len(l) // 2 + 1] AS median FROM f"""),
    "rolling_stats": (rolling_stats, BEATS + """SELECT record, i, round(avg(value) OVER f, 4) AS roll_mean, round(sum(value) OVER f, 4) AS roll_sum, max(value) OVER f AS roll_max, round(max(value) OVER f - min(value) OVER f, 4) AS roll_range
FROM beats WINDOW f AS (PARTITION BY record ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"""),
    "derivative5": (derivative5, BEATS + f"SELECT record, i, round((-lag(value, 2) OVER w - 2 * lag(value) OVER w + 2 * lead(value) OVER w + lead(value, 2) OVER w) * 31.25, 4) + 0.0 AS d5 FROM beats {W}"),
    "close_pairs": (close_pairs, BEATS + f"SELECT record, i, coalesce(t - lag(t) OVER w < 3600, false) OR coalesce(lead(t) OVER w - t < 3600, false) AS double FROM beats {W}"),
    "label_change_points": (label_change_points, BEATS + f""", c AS (SELECT *, coalesce((kind <> lag(kind) OVER w)::INT, 0) AS c FROM beats {W}),
r AS (SELECT *, sum(c) OVER w AS run FROM c {W})
SELECT record, run, first(kind) AS label, min(i) AS first, max(i) AS last FROM r GROUP BY record, run"""),
    "streak_search": (streak_search, BEATS + f""", m AS (SELECT record, median(value) AS m FROM beats GROUP BY record),
n AS (SELECT b.*, abs(value - m) <= 0.25 * m AS near FROM beats b JOIN m USING (record)),
c AS (SELECT *, coalesce((near <> lag(near) OVER w)::INT, 0) AS c FROM n {W}),
r AS (SELECT *, sum(c) OVER w AS run FROM c {W}),
s AS (SELECT record, run, min(i) AS first, max(i) AS last FROM r WHERE near GROUP BY record, run HAVING count(*) >= 3)
SELECT record, min(first) AS first, min_by(last, first) AS last, min_by(last - first + 1, first) AS length FROM s GROUP BY record"""),
    "refractory_suppression": (refractory_suppression, BEATS + """, f AS (SELECT record, i, t AS kept, 1 AS k FROM beats WHERE i = 0
  UNION ALL SELECT b.record, b.i, CASE WHEN b.t - f.kept >= 21600 THEN b.t ELSE f.kept END, f.k + (b.t - f.kept >= 21600)::INT
  FROM f JOIN beats b ON b.record = f.record AND b.i = f.i + 1)
SELECT record, count(*) AS n, max(k)::BIGINT AS n_kept, round(max(kept), 3) AS last_kept FROM f GROUP BY record"""),
    "local_maxima": (local_maxima, BEATS + f", m AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM beats {W}) SELECT record, i, value FROM m WHERE value > a AND value > b AND value > 60"),
    "page_hinkley": (page_hinkley, BEATS + f""", d AS (SELECT *, value - avg(value) OVER w - 1 AS d FROM beats {W}), m AS (SELECT *, sum(d) OVER w AS m FROM d {W}),
g AS (SELECT *, m - min(m) OVER w AS g FROM m {W}) SELECT record, coalesce(min(CASE WHEN g > 150 THEN i END), -1) AS change_at FROM g GROUP BY record"""),
    "wave_ids": (wave_ids, BEATS + "SELECT record, i, row_number() OVER (PARTITION BY record, kind ORDER BY i) AS wave_id FROM beats"),
    "rmssd_per_record": (rmssd_per_record, BEATS + f", d AS (SELECT record, rr - lag(rr) OVER w AS d FROM rr WHERE rr IS NOT NULL {W}) SELECT record, round(coalesce(sqrt(avg(d * d)), 0), 4) AS rmssd FROM d GROUP BY record"),
    "interval_summary": (interval_summary, BEATS + """, x AS (SELECT record, rr AS x FROM rr WHERE rr IS NOT NULL), c AS (SELECT *, avg(x) OVER (PARTITION BY record) AS mu FROM x)
SELECT record, count(*) AS n, round(min(x), 3) AS least, round(max(x), 3) AS most, round(avg(x), 3) AS mean, round(sum(x), 3) AS total, round(max(abs(x)), 3) AS abs_most, round(min(abs(x)), 3) AS abs_least,
 round(median(x), 3) AS median, round(stddev_pop(x), 3) AS sd, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 3) AS iqr, round(stddev_pop(x) / avg(x), 3) AS cv,
 round(avg((x - mu) ** 3) / stddev_pop(x) ** 3, 3) AS skew, round(avg((x - mu) ** 4) / var_pop(x) ** 2 - 3, 3) AS kurt FROM c GROUP BY record"""),
    "argmin_argmax": (argmin_argmax, BEATS + "SELECT record, first(i ORDER BY value, i) AS argmin, first(i ORDER BY value DESC, i) AS argmax FROM beats GROUP BY record"),
    "iqr_filter": (iqr_filter, BEATS + """, q AS (SELECT record, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM beats GROUP BY record)
SELECT record, i, value FROM beats JOIN q USING (record) WHERE value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)"""),
    "cosen": (cosen, BEATS + f""", x AS (SELECT record, i, rr_raw / 3600 AS x, lead(rr_raw / 3600) OVER w AS y FROM rr {W}),
p AS (SELECT a.record, count(*) AS b, count(*) FILTER (abs(a.y - b.y) <= 2) AS a FROM x a JOIN x b ON a.record = b.record AND a.i < b.i AND abs(a.x - b.x) <= 2 WHERE a.y IS NOT NULL AND b.y IS NOT NULL GROUP BY a.record),
m AS (SELECT record, avg(x) AS m FROM x GROUP BY record)
SELECT record, a, b, round(CASE WHEN a > 0 THEN -ln(a / b) ELSE 0 END + ln(4.0) - ln(m), 4) + 0.0 AS cosen FROM p JOIN m USING (record)"""),
    "mode_of_kind": (mode_of_kind, BEATS + ", c AS (SELECT record, event_type, count(*) AS n FROM beats GROUP BY ALL) SELECT record, first(event_type ORDER BY n DESC, event_type) AS mode, max(n) AS n FROM c GROUP BY record"),
    "weighted_history": (weighted_history, BEATS + f", e AS (SELECT record, i, (lag(rr_raw, 3) OVER w + 2 * lag(rr_raw, 2) OVER w + 3 * lag(rr_raw) OVER w) / 6 AS e FROM rr {W}) SELECT record, i, round(e, 4) AS expected FROM e WHERE e IS NOT NULL"),
    "beat_string": (beat_string, BEATS + "SELECT record, string_agg(kind, '' ORDER BY i) AS beats FROM beats GROUP BY record"),
    "repaired_string": (repaired_string, BEATS + "SELECT record, replace(string_agg(kind, '' ORDER BY i), 'VVVNVVV', 'VVVVVVV') AS beats FROM beats GROUP BY record"),
    "v_streaks": (_pattern("V_RUN"), _pattern_sql("V_RUN")),
    "bigeminy_intervals": (_pattern("BIGEMINY"), _pattern_sql("BIGEMINY")),
    "trigeminy_intervals": (_pattern("TRIGEMINY"), _pattern_sql("TRIGEMINY")),
    "quadrigeminy_intervals": (_pattern("QUADRIGEMINY"), _pattern_sql("QUADRIGEMINY")),
}
