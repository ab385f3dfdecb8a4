"""Queries of the rule engine, the detectors and the window operators of streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect, rhythm, rules, sequence
from ..sources.tables import beats, heart_waves, table
from ..streaming import streams
from .intervals import P, _frame
from .measures import _waves
from .sequences import BEATS, HOUR, rounded

SCALE = 3600.0


def _rated(spark, sf):
    """Beats with intervals in units that make rates of tens a minute: hours stand for seconds."""
    return sequence.rr_intervals(beats(spark, sf).withColumn("t", F.col("t") / HOUR / 10))


_RATED = BEATS + ", rated AS (SELECT record, i, kind, value, event_type, rr_raw / 36000 AS rr FROM rr)"


def noise_rule(spark, sf):
    return rules.mask_rule(_rated(spark, sf), (F.col("value") > 100) & (F.col("kind") != "V"), "NOISE", 1)


def ventricular_rule(spark, sf):
    return rules.ventricular_runs(_rated(spark, sf), 3)


def sudden_brady_rule(spark, sf):
    return rules.rate_rule(_rated(spark, sf), "SUDDEN_BRADY", 7, below=60.0, opening=2)


def premature_rule(spark, sf):
    return rules.premature_beats(_rated(spark, sf), 9).select("record", "name", "first")


def rule_engine(spark, sf):
    """All rules in order over the events as recordings; held against recordings made for each rule, as SQL has no ordered fold
    that writes labels."""
    return rhythm.diagnose(heart_waves(spark, sf))


def rule_engine_patterns(spark, sf):
    """The rules whose labels do not depend on one another, by the same engine with the others switched off."""
    off = dict.fromkeys(("VT", "SVT", "AVB", "CHB", "WENCKEBACH", "EAR", "NSR", "PVC"), False)
    return rhythm.diagnose(heart_waves(spark, sf), off).select("record", "name", "first", "last")


def _pattern_rule(name, pattern):
    return f"""SELECT record, '{name}' AS name, list_sum([len(x) FOR x IN g[1:k]]) + coalesce(list_sum([len(x) FOR x IN m[1:k - 1]]), 0) AS f, len(m[k]) AS n
FROM (SELECT record, m, g, unnest(generate_series(1, len(m))) AS k FROM (SELECT record, regexp_extract_all(b, '{pattern}') AS m, string_split_regex(b, '{pattern}') AS g FROM strings))"""


def p_polarity(spark, sf):
    rows = _waves(spark, sf).select("record", F.array_max("x").alias("hi"), F.array_min("x").alias("lo"))
    kind = F.when(F.col("hi") - F.col("lo") < 0.02, "flat").when(F.col("hi") > -2 * F.col("lo"), "positive").when(-F.col("lo") > 2 * F.col("hi"), "negative").otherwise("biphasic")
    return rows.select("record", kind.alias("polarity"))


def threshold_search(spark, sf):
    """The highest threshold that makes the intervals of the beats above it steadiest."""
    from pyspark.sql.window import Window

    grid = beats(spark, sf).withColumn("thr", F.explode(F.array(*[F.lit(v) for v in (80, 60, 40, 20)]))).where(F.col("value") > F.col("thr"))
    d = grid.withColumn("d", F.col("t") - F.lag("t").over(Window.partitionBy("record", "thr").orderBy("i"))).where("d is not null")
    cost = d.groupBy("record", "thr").agg((F.stddev_pop("d") / F.avg("d")).alias("c"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    return cost.groupBy("record").agg(F.min_by("thr", F.struct(F.round("c", 9), -F.col("thr"))).alias("thr"))


def adaptive_detector(spark, sf):
    """No SQL twin: an adaptive recurrence over samples."""
    return detect.detect(_waves(spark, sf), 60.0).select("record", F.size("peaks").alias("n"))


def leader_clusters(spark, sf):
    """No SQL twin: an ordered fold with waveforms as state."""
    return detect.cluster_members(_waves(spark, sf), "label")


def _events(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("record"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type").isin("error", "signup"), "V").otherwise("N").alias("kind"))


def _started(df):
    return df.select("record", F.unix_seconds("start").alias("start"), "n", "v")


def tumbling_30(spark, sf):
    return _started(streams.tumbling(_events(spark, sf)))


def sliding_tiles(spark, sf):
    return _started(streams.sliding(_events(spark, sf), "2 days", "1 day"))


def session_windows(spark, sf):
    return streams.sessions(_events(spark, sf)).select("record", F.unix_micros("start").alias("start"), "n", "v")


def hour_segments(spark, sf):
    return _started(streams.tumbling(_events(spark, sf), "1 hour"))


def deduplicated(spark, sf):
    return streams.deduplicated(_events(spark, sf).withColumn("day", F.floor(F.unix_seconds("ts") / 86400)), ["record", "day"]).groupBy("record").agg(F.count(F.lit(1)).alias("days"))


def queue_claim(spark, sf):
    rows = table(spark, sf, "orders").where("o_orderstatus = 'O'").select("o_orderkey", F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("h"))
    return rows.orderBy("h", "o_orderkey").limit(50).select("o_orderkey")


_E = "WITH e AS (SELECT user_id AS record, epoch_us(ts) AS us, event_type IN ('error', 'signup') AS v FROM events)\n"
QUERIES = {
    "noise_rule": (noise_rule, _RATED + """, s AS (SELECT *, value > 100 AND kind <> 'V' AS m, lag(value > 100 AND kind <> 'V') OVER (PARTITION BY record ORDER BY i) AS b FROM rated),
g AS (SELECT *, sum((m AND NOT coalesce(b, false))::INT) OVER (PARTITION BY record ORDER BY i) AS g FROM s)
SELECT record, 'NOISE' AS name, min(i) AS first, max(i) AS last, 1 AS seq FROM g WHERE m GROUP BY record, g"""),
    "ventricular_rule": (ventricular_rule, _RATED + """, s AS (SELECT record, replace(string_agg(kind, '' ORDER BY i), 'VVVNVVV', 'VVVVVVV') AS b FROM rated GROUP BY record),
k AS (SELECT r.record, r.i, r.rr, substr(b, r.i::INT + 1, 1) AS k FROM rated r JOIN s USING (record)),
g AS (SELECT *, i - row_number() OVER (PARTITION BY record, k ORDER BY i) AS g FROM k),
q AS (SELECT record, g, min(i) AS first, max(i) AS last FROM g WHERE k = 'V' GROUP BY record, g HAVING count(*) >= 3),
a AS (SELECT q.record, first, last, 60 / avg(k.rr) AS rate FROM q JOIN k ON k.record = q.record AND k.i > q.first AND k.i <= q.last GROUP BY ALL)
SELECT record, CASE WHEN rate >= 100 THEN 'VT' WHEN rate >= 50 THEN 'AIVR' ELSE 'IVR' END AS name, first, last, 3 AS seq FROM a"""),
    "sudden_brady_rule": (sudden_brady_rule, _RATED + f""", m AS (SELECT record, i, (60 / rr < 60)::INT AS m FROM rated), e AS (SELECT *, min(m) {_frame('1 ' + P, 'CURRENT ROW')} AS e FROM m),
o AS (SELECT *, max(e) {_frame('1 ' + P, 'CURRENT ROW')} AS o FROM e), g AS (SELECT *, i - row_number() OVER (PARTITION BY record, o ORDER BY i) AS g FROM o)
SELECT record, 'SUDDEN_BRADY' AS name, min(i) AS first, max(i) AS last, 7 AS seq FROM g WHERE o = 1 GROUP BY record, g"""),
    "premature_rule": (premature_rule, _RATED + """, x AS (SELECT *, (3 * lag(rr) OVER w + 2 * lag(rr, 2) OVER w + lag(rr, 3) OVER w) / 6 - rr AS d, stddev_pop(rr) OVER (PARTITION BY record ORDER BY i ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS s FROM rated WINDOW w AS (PARTITION BY record ORDER BY i))
SELECT record, CASE WHEN kind = 'V' THEN 'PVC' ELSE 'PAC' END AS name, i AS first FROM x WHERE d > 1.6449 * s"""),
    "rule_engine": (rule_engine, None),
    "rule_engine_patterns": (rule_engine_patterns, """WITH e AS (SELECT user_id AS record, epoch_us(ts) / 3.6e10 AS t, event_type, value, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) = 'view' AS led FROM events),
b AS (SELECT record, row_number() OVER (PARTITION BY record ORDER BY t) - 1 AS i, t, event_type IN ('error', 'signup') AS v, value > 150 AS noise, value BETWEEN 30 AND 40 AS afib,
 NOT ((event_type IN ('error', 'signup') AND 0.06 + (floor(value)::BIGINT % 30) / 200 > 0.12) OR value BETWEEN 30 AND 40 OR 10 + value % 40 < 20)
 AND (NOT coalesce(led, false) OR (t - 0.04) - (t - 0.05 - (floor(value)::BIGINT % 30) / 100) < 0.075 OR value % 60 > 50) AS j FROM e WHERE event_type <> 'view'),
strings AS (SELECT record, replace(replace(string_agg(CASE WHEN v THEN 'V' ELSE 'N' END, '' ORDER BY i), 'VVVNVVV', 'VVVVVVV'), 'VVVNNVVV', 'VVVVVVVV') AS b FROM b GROUP BY record),
js AS (SELECT record, replace(replace(string_agg(CASE WHEN j THEN 'J' WHEN v THEN 'V' ELSE 'N' END, '' ORDER BY i), 'JJJVJJJ', 'JJJJJJJ'), 'JJJNJJJ', 'JJJJJJJ') AS b FROM b GROUP BY record),
m AS (SELECT record, i, 'NOISE' AS name FROM b WHERE noise AND NOT afib UNION ALL SELECT record, i, 'AFIB' FROM b WHERE afib
 UNION ALL SELECT b.record, b.i, 'JUNCTIONAL' FROM b JOIN js USING (record) WHERE substr(js.b, b.i::INT + 1, 1) = 'J'),
r AS (SELECT record, name, min(i) AS first, max(i) AS last FROM (SELECT *, i - row_number() OVER (PARTITION BY record, name ORDER BY i) AS g FROM m) GROUP BY record, name, g),
p AS (SELECT record, name, f::BIGINT AS first, (f + n - 1)::BIGINT AS last FROM (""" + " UNION ALL ".join(_pattern_rule(n, p) for n, p in (("BIGEMINY", "(?:NV){3,}|(?:VN){3,}"), ("TRIGEMINY", "(?:NNV){3,}|(?:VNN){3,}"), ("QUADRIGEMINY", "(?:NNNV){3,}|(?:VNNN){3,}"))) + """))
SELECT * FROM p UNION ALL SELECT r.* FROM r WHERE name <> 'JUNCTIONAL'
UNION ALL SELECT r.* FROM r JOIN b x ON x.record = r.record AND x.i = first JOIN b y ON y.record = r.record AND y.i = last WHERE name = 'JUNCTIONAL' AND last - first >= 2 AND 60 * (last - first) / (y.t - x.t) < 100"""),
    "p_polarity": (p_polarity, "WITH x AS (SELECT vec_id AS record, list_max(embedding)::DOUBLE AS hi, list_min(embedding)::DOUBLE AS lo FROM embeddings) SELECT record, CASE WHEN hi - lo < 0.02 THEN 'flat' WHEN hi > -2 * lo THEN 'positive' WHEN -lo > 2 * hi THEN 'negative' ELSE 'biphasic' END AS polarity FROM x"),
    "threshold_search": (threshold_search, BEATS + """, g AS (SELECT record, i, t, thr FROM beats, (SELECT unnest([80, 60, 40, 20]) AS thr) WHERE value > thr),
d AS (SELECT record, thr, t - lag(t) OVER (PARTITION BY record, thr ORDER BY i) AS d FROM g),
c AS (SELECT record, thr, round(stddev_pop(d) / avg(d), 9) AS c FROM d WHERE d IS NOT NULL GROUP BY ALL HAVING count(*) >= 3)
SELECT record, first(thr ORDER BY c, thr DESC) AS thr FROM c GROUP BY record"""),
    "adaptive_detector": (adaptive_detector, None),
    "leader_clusters": (leader_clusters, None),
    "tumbling_30": (tumbling_30, _E + "SELECT record, us // 1800000000 * 1800 AS start, count(*) AS n, count(*) FILTER (v) AS v FROM e GROUP BY 1, 2"),
    "sliding_tiles": (sliding_tiles, _E + "SELECT record, (us // 86400000000 - k) * 86400 AS start, count(*) AS n, count(*) FILTER (v) AS v FROM e, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2"),
    "session_windows": (session_windows, _E + ", g AS (SELECT *, (us - lag(us) OVER w >= 18000000000 OR lag(us) OVER w IS NULL)::INT AS g FROM e WINDOW w AS (PARTITION BY record ORDER BY us)), s AS (SELECT *, sum(g) OVER (PARTITION BY record ORDER BY us) AS s FROM g) SELECT record, min(us) AS start, count(*) AS n, count(*) FILTER (v) AS v FROM s GROUP BY record, s"),
    "hour_segments": (hour_segments, _E + "SELECT record, us // 3600000000 * 3600 AS start, count(*) AS n, count(*) FILTER (v) AS v FROM e GROUP BY 1, 2"),
    "deduplicated": (deduplicated, _E + "SELECT record, count(DISTINCT us // 86400000000) AS days FROM e GROUP BY record"),
    "queue_claim": (queue_claim, "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY md5(o_orderkey::VARCHAR), o_orderkey LIMIT 50"),
}
