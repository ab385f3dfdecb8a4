"""Queries on channels, masks, intervals between waves, entropies over a grid, text fields and the feature store."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats
from ..functions import waveform as wave
from ..operators import sequence, waves
from ..sources import recordings
from ..sources.tables import beats, samples, table
from .intervals import SAMPLES
from .measures import _waves
from .rhythms import _RATED, _rated
from .sequences import BEATS, rounded

#: Places of the channels that a model of one and of three leads takes from twelve.
ONE_LEAD, THREE_LEADS = (1,), (1, 6, 11)


def channel_slice(spark, sf):
    """The channels of a three-lead model, by their places among twelve."""
    return samples(spark, sf).where(F.col("i").isin(*THREE_LEADS)).select("record", "i", "x")


def uncertain_reset(spark, sf):
    """Abnormal beats with a normal interval and an uncertain mask count as normal."""
    rows = sequence.rr_intervals(beats(spark, sf)).withColumn("pr", F.col("rr_raw") / 1e6).withColumn("unsure", F.log(F.col("value") / 100 + 0.0001))
    doubtful = F.col("pr").between(0.075, 0.2) & (F.col("pr") > 0.075) & (F.col("pr") < 0.2) & (F.col("unsure") > -1)
    return rows.select("record", "i", ((F.col("kind") == "V") & ~doubtful).alias("abnormal"))


def noise_reflected(spark, sf):
    """The noise mask: a high chance, or a high logarithm of the uncertainty where the chance is low; gaps closed."""
    rows = beats(spark, sf).withColumn("chance", F.least(F.col("value") / 100, F.lit(1.0))).withColumn("doubt", F.pmod("value", F.lit(1.0)))
    sure = F.col("chance") > 0.5
    rows = rows.withColumn("m", (sure | (F.log(F.when(sure, 0.0).otherwise(F.col("doubt")) + 0.0001) > -1)).cast("int"))
    from ..operators import regions

    return regions.closing_shifted(rows, "m", 4).select("record", "i", F.col("closed").alias("noise"))


def pp_pr_series(spark, sf):
    """Of each P wave (a view): the time since the one before, and to the first beat (a click) after it."""
    rows = beats(spark, sf).where(F.col("event_type").isin("view", "click"))
    p = F.col("event_type") == "view"
    follow = Window.partitionBy("record").orderBy("i").rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("pr", F.first(F.when(~p, F.col("t")), ignorenulls=True).over(follow) - F.col("t")).where(p)
    rows = rows.withColumn("pp", F.col("t") - F.lag("t").over(sequence.ordered()))
    return rounded(rows.select("record", "i", "pp", "pr"), "pp", "pr")


def threshold_search_46(spark, sf):
    """Of 46 thresholds, from the highest, the first whose P waves follow each other and lead their beats most steadily."""
    rows = beats(spark, sf).withColumn("next", F.lead("t").over(sequence.ordered()))
    grid = rows.withColumn("thr", F.explode(F.sequence(F.lit(50), F.lit(5), F.lit(-1)))).where(F.col("value") > F.col("thr"))
    w = Window.partitionBy("record", "thr").orderBy("i")
    grid = grid.withColumn("pp", F.col("t") - F.lag("t").over(w)).withColumn("pr", F.when(F.lead("i").over(w).isNotNull(), F.col("next") - F.col("t")))
    change = lambda c: F.col(c) - F.lag(c).over(w)
    grid = grid.withColumn("dpp", change("pp")).withColumn("dpr", change("pr"))
    root = lambda c: F.coalesce(F.sqrt(F.avg(F.col(c) * F.col(c))), F.lit(0.0))
    cost = grid.groupBy("record", "thr").agg(F.round(root("dpp") + root("dpr"), 6).alias("c"), F.count("pp").alias("n")).where("n > 0")
    return cost.groupBy("record").agg(F.min_by("thr", F.struct("c", -F.col("thr"))).alias("thr"))


RADII = stats.radii()


def cosen_grid(spark, sf):
    return rounded(stats.cosen_grid(_rated(spark, sf), "rr_raw", RADII), "cosen")


def fuzzy_entropy(spark, sf):
    return rounded(stats.fuzzy_entropy(_rated(spark, sf), "rr_raw"), "entropy")


def taper_blend(spark, sf):
    """Two neighbouring halves put together over 16 samples by a straight taper."""
    left, right = F.slice("x", 1, 40), F.slice("x", 25, 40)
    share = lambda k: (k + 0.5) / 16
    middle = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.get(left, k + 24) * (1 - share(k)) + F.get(right, k) * 0.5 * share(k))
    whole = F.concat(F.slice(left, 1, 24), middle, F.transform(F.slice(right, 17, 24), lambda v: v * 0.5))
    return rounded(_waves(spark, sf).select("record", F.posexplode(whole).alias("i", "y")), "y")


def reversed_signal(spark, sf):
    """Waveforms turned over where any sample falls into the inverse class."""
    inverse = F.exists("x", lambda v: v < -0.45)
    return rounded(_waves(spark, sf).select("record", F.posexplode(F.transform("x", lambda v: F.when(inverse, -v).otherwise(v))).alias("i", "y")), "y")


def binary_resample(spark, sf):
    """A mask of 64 samples at 48 places: the change points move in proportion."""
    mask = F.transform("x", lambda v: (v > 0).cast("int"))
    return _waves(spark, sf).select("record", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(47)), lambda k: F.get(mask, F.floor(k * 64 / 48).cast("int")))).alias("i", "m"))


def noise_level(spark, sf):
    """Root mean square of what a five-sample mean leaves of a waveform."""
    w = Window.partitionBy("record").orderBy("i").rowsBetween(-2, 2)
    rows = samples(spark, sf).withColumn("d", F.col("x") - F.avg("x").over(w))
    return rounded(rows.groupBy("record").agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("noise")), "noise")


def std_normalised(spark, sf):
    """Waveforms over their deviation alone, the mean left in."""
    rows = _waves(spark, sf).withColumn("s", wave.sd_of(F.col("x")))
    return rounded(rows.select("record", F.posexplode(F.transform("x", lambda v: F.when(F.col("s") > 0, v / F.col("s")).otherwise(v))).alias("i", "y")), "y", places=3)


def softmax(spark, sf):
    """Chances of the first eight classes, the class with the highest and its chance."""
    z = F.slice("x", 1, 8)
    e = F.transform(z, lambda v: F.exp(v - F.array_max(z)))
    rows = _waves(spark, sf).select("record", e.alias("e"))
    p = F.transform("e", lambda v: v / F.aggregate("e", F.lit(0.0), lambda a, b: a + b))
    return rounded(rows.select("record", (F.array_position("e", F.array_max("e")) - 1).alias("best"), F.array_max(p).alias("p")), "p")


def annotation_capture(spark, sf):
    """Annotations written `name s -e s` and read back by one pattern."""
    note = F.concat_ws(" ", "event_type", F.concat(F.col("i").cast("string"), F.lit(" -")), (F.col("i") + 5).cast("string"))
    got = [F.regexp_extract("note", r"^([a-z]+) ([0-9]+) -? ?([0-9]+)$", k) for k in (1, 2, 3)]
    rows = beats(spark, sf).withColumn("note", note)
    return rows.select("record", got[0].alias("name"), got[1].cast("long").alias("start"), got[2].cast("long").alias("stop"))


def run_stamps(spark, sf):
    """Names of result files by the minute of their record's last event."""
    last = table(spark, sf, "events").groupBy(F.col("user_id").alias("record")).agg(F.max(F.col("ts").cast("timestamp")).alias("last"))
    return last.select("record", F.date_format("last", "yyyyMMdd-HHmm").alias("stamp"))


def json_exists(spark, sf):
    """Events whose JSON field is among some values."""
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf, "events").where(F.exists(F.array(k), lambda v: v.isin(3, 5, 69))).select("event_id", k.alias("k"))


def feature_store_find(spark, sf):
    """The store's lookup: records with a diagnosis, at least some abnormal beats and a rate within limits."""
    store = beats(spark, sf).groupBy("record").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "V").alias("abnormal"), F.array_sort(F.collect_set("event_type")).alias("diagnoses"), F.avg("value").alias("level"))
    return rounded(find(store, diagnosis="error", min_abnormal=10, level=(20.0, 60.0)).select("record", "n", "abnormal", F.array_join("diagnoses", ",").alias("diagnoses"), "level"), "level")


def find(store, diagnosis: str | None = None, min_abnormal: int = 0, level: tuple[float, float] | None = None):
    """Rows of a store that meet all criteria given; each is a filter that the scan of a Parquet store takes over."""
    if diagnosis is not None:
        store = store.where(F.array_contains("diagnoses", diagnosis))
    if min_abnormal:
        store = store.where(F.col("abnormal") >= min_abnormal)
    return store if level is None else store.where(F.col("level").between(*level))


def validated_sources(spark, sf):
    """Records made in memory, checked as the scan checks them: empty ones and ones without samples are named, not dropped."""
    rows = _waves(spark, sf).select("record", F.when(F.col("record") % 50 == 0, F.slice("x", 1, 0)).otherwise(F.col("x")).alias("x"))
    fault = F.when(F.size("x") == 0, "no samples").when(F.exists("x", lambda v: v.isNull() | F.isnan(v)), "not a number")
    return rows.select("record", F.coalesce(fault, F.lit("ok")).alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def _recorded(spark, sf):
    """A folder, shared by all executors, with the waveforms as recordings of sixteen leads."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), f"pulseloom-{os.getuid()}")
    folder = f"{root.rstrip('/')}/recordings-{uuid.uuid4().hex}"
    rows = _waves(spark, sf).select((F.col("record") / 16).cast("long").alias("record"), F.format_string("L%02d", F.col("record") % 16).alias("lead"), F.col("x").alias("sig"))
    recordings.write_records(rows, folder, 64.0)
    return folder


def recording_files(spark, sf):
    """Waveforms written as recordings of sixteen leads and scanned again, in thousandths."""
    rows = recordings.signals(spark, _recorded(spark, sf))
    return rounded(rows.select(F.col("record").cast("long").alias("record"), "lead", F.posexplode("sig").alias("i", "y")), "y")


def recording_ranges(spark, sf):
    """The same, a quarter of a second around the middle of each: a ranged read."""
    rows = recordings.signals(spark, _recorded(spark, sf), middle_seconds=0.25)
    return rounded(rows.select(F.col("record").cast("long").alias("record"), "lead", F.posexplode("sig").alias("i", "y")), "y")


def recording_headers(spark, sf):
    rows = recordings.headers(spark, f"{_recorded(spark, sf)}/*.hea")
    return rows.select(F.col("record").cast("long").alias("record"), "n_signals", "fs", "n_samples", F.array_join(F.transform("signals", lambda s: s["lead"]), ",").alias("leads"))


#: Events as samples, so many a second.
FS = 50


def _sampled(spark, sf):
    """Events as samples with chances of a complex, masks of P and T waves, and noise."""
    rows = beats(spark, sf).withColumn("noise", F.col("value") > 120)
    rows = rows.withColumn("normal", F.least(F.col("value") / 200, F.lit(0.2))).withColumn("abnormal", F.when(F.col("kind") == "V", F.pmod("value", F.lit(1.0)) / 2).otherwise(0.0))
    return rows.withColumn("p", F.col("event_type").isin("view", "click")).withColumn("t", F.col("event_type").isin("click", "purchase"))


def qrs_waves(spark, sf):
    return waves.qrs_waves(_sampled(spark, sf), FS)


def p_waves(spark, sf):
    return waves.p_waves(_sampled(spark, sf), FS / 5)


def peak_check(spark, sf):
    """Views against clicks, as two detectors' peaks, a day for a window and an hour for the tolerance."""
    rows = beats(spark, sf)
    return waves.peak_check(rows.where("event_type = 'view'"), rows.where("event_type IN ('click', 'view') AND value > 20"), 86400.0, 3600.0)


def suspicious_records(spark, sf):
    rows = _rated(spark, sf).withColumn("t", F.col("t"))
    return waves.suspicious(rows, 8.0, 3.2)


def fibrillation_corrected(spark, sf):
    """No SQL twin: a chain of steps on the mask; held against a plain walk over samples on small recordings."""
    rows = beats(spark, sf).withColumns({"afib": F.col("value") < 80, "noise": F.col("value") > 250, "doubt": F.pmod("value", F.lit(1.0)) / 100, "beat": F.col("event_type") != "view", "abnormal": F.col("kind") == "V", "has_p": F.col("event_type") == "click"})
    return waves.fibrillation(rows, 4.0)


_SAMPLED = BEATS + """, s AS (SELECT record, i, least(value / 200, 0.2) + CASE WHEN kind = 'V' THEN value % 1 / 2 ELSE 0 END AS both, (least(value / 200, 0.2) + CASE WHEN kind = 'V' THEN value % 1 / 2 ELSE 0 END > 0.25)::INT AS m,
 CASE WHEN kind = 'V' THEN value % 1 / 2 ELSE 0 END AS abnormal, event_type IN ('view', 'click') AS p, event_type IN ('click', 'purchase') AS tw,
 value > 120 OR coalesce(lead(value) OVER (PARTITION BY record ORDER BY i) > 120, false) AS noisy, count(*) OVER (PARTITION BY record) AS n FROM beats)"""
_ARRAY = "[" + ", ".join(map(str, RADII)) + "]"
QUERIES = {
    "recording_files": (recording_files, SAMPLES + "SELECT record // 16 AS record, format('L{:02d}', record % 16) AS lead, i, round(floor(x * 1000 + 0.5) / 1000, 4) + 0.0 AS y FROM samples"),
    "recording_ranges": (recording_ranges, SAMPLES + "SELECT record // 16 AS record, format('L{:02d}', record % 16) AS lead, i - 24 AS i, round(floor(x * 1000 + 0.5) / 1000, 4) + 0.0 AS y FROM samples WHERE i BETWEEN 24 AND 39"),
    "recording_headers": (recording_headers, "SELECT vec_id // 16 AS record, count(*)::INT AS n_signals, 64.0::DOUBLE AS fs, 64 AS n_samples, string_agg(format('L{:02d}', vec_id % 16), ',' ORDER BY vec_id) AS leads FROM embeddings GROUP BY 1"),
    "qrs_waves": (qrs_waves, _SAMPLED + """, d AS (SELECT *, max(m) OVER (PARTITION BY record ORDER BY i ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS d FROM s),
c AS (SELECT *, min(d) OVER (PARTITION BY record ORDER BY i ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS c, max(abnormal) OVER (PARTITION BY record ORDER BY i ROWS BETWEEN 5 PRECEDING AND 9 FOLLOWING) AS most FROM d),
g AS (SELECT *, i - row_number() OVER (PARTITION BY record, c ORDER BY i) AS g FROM c),
r AS (SELECT record, min(i) AS start, max(i) + 1 AS "end", bool_or(noisy) AS dirty, max(n) AS n FROM g WHERE c = 1 GROUP BY record, g)
SELECT r.record, r.start, r."end", i - 5 AS first, i + 10 AS last, r."end" - r.start + 1 AS width, most > 0.1 AS abnormal FROM r JOIN c ON c.record = r.record AND c.i = (r.start + r."end") // 2
WHERE NOT dirty AND r.start > 5 AND r."end" < r.n - 10"""),
    "p_waves": (p_waves, _SAMPLED + """, g AS (SELECT *, i - row_number() OVER (PARTITION BY record, p ORDER BY i) AS g, lead(tw) OVER (PARTITION BY record ORDER BY i) AS tn FROM s),
r AS (SELECT record, min(i) AS start, max(i) + 1 AS "end", bool_or(noisy) AS dirty, max(n) AS n, min_by(tw, i) AS t1, max_by(coalesce(tn, false), i) AS t2 FROM g WHERE p GROUP BY record, g),
k AS (SELECT record, start, "end", (start + "end") // 2 - 1 AS first, (start + "end") // 2 + 1 AS last FROM r WHERE NOT dirty AND start > 1 AND "end" < n - 1 AND NOT (t1 AND t2))
SELECT record, start, "end", first, last, coalesce(last + 1 > lead(first) OVER w - 1, false) OR coalesce(lag(last) OVER w + 1 > first - 1, false) AS double FROM k WINDOW w AS (PARTITION BY record ORDER BY start)"""),
    "peak_check": (peak_check, BEATS + """, a AS (SELECT record, t, floor(t / 86400) AS part FROM beats WHERE event_type = 'view'), o AS (SELECT record, t, floor(t / 86400) AS part FROM beats WHERE event_type IN ('click', 'view') AND value > 20),
x AS (SELECT record, part, true AS mine, EXISTS (SELECT 1 FROM o WHERE o.record = a.record AND o.part = a.part AND abs(o.t - a.t) <= 3600) AS hit FROM a
 UNION ALL SELECT record, part, false, EXISTS (SELECT 1 FROM a WHERE o.record = a.record AND o.part = a.part AND abs(o.t - a.t) <= 3600) FROM o),
c AS (SELECT record, part::BIGINT AS part, count(*) FILTER (mine AND hit) AS tp, count(*) FILTER (mine AND NOT hit) AS fp, count(*) FILTER (NOT mine AND NOT hit) AS fn FROM x GROUP BY ALL),
s AS (SELECT *, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS se, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pp FROM c)
SELECT record, part, tp, fp, fn, se < 0.5 OR pp < 0.5 OR CASE WHEN se + pp > 0 THEN 2 * se * pp / (se + pp) ELSE 0 END < 0.5 AS mismatch FROM s"""),
    "suspicious_records": (suspicious_records, BEATS + """, d AS (SELECT record, rr_raw / 36000 AS x, floor(t / 36000 / 30) AS part, rr_raw / 36000 - lag(rr_raw / 36000) OVER (PARTITION BY record, floor(t / 36000 / 30) ORDER BY t) AS d FROM rr),
p AS (SELECT record, part, max(x) AS most, sqrt(avg(d * d)) AS r FROM d GROUP BY ALL) SELECT record FROM p GROUP BY record HAVING max(most) > 8 OR max(r) > 3.2"""),
    "fibrillation_corrected": (fibrillation_corrected, None),
    "channel_slice": (channel_slice, SAMPLES + "SELECT record, i, x FROM samples WHERE i IN (1, 6, 11)"),
    "uncertain_reset": (uncertain_reset, BEATS + "SELECT record, i, kind = 'V' AND NOT (rr_raw / 1e6 > 0.075 AND rr_raw / 1e6 < 0.2 AND ln(value / 100 + 0.0001) > -1) AS abnormal FROM rr"),
    "noise_reflected": (noise_reflected, BEATS + """, m AS (SELECT record, i, (least(value / 100, 1) > 0.5 OR ln(CASE WHEN least(value / 100, 1) > 0.5 THEN 0 ELSE value % 1 END + 0.0001) > -1)::INT AS m FROM beats),
d AS (SELECT record, i, max(m) OVER f AS d FROM m WINDOW f AS (PARTITION BY record ORDER BY i ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING))
SELECT record, i, min(d) OVER f AS noise FROM d WINDOW f AS (PARTITION BY record ORDER BY i ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)"""),
    "pp_pr_series": (pp_pr_series, BEATS + """SELECT p.record, p.i, round(t - lag(t) OVER (PARTITION BY record ORDER BY i), 4) AS pp,
 round((SELECT min(b.t) FROM beats b WHERE b.record = p.record AND b.i > p.i AND b.event_type = 'click') - t, 4) AS pr FROM beats p WHERE event_type = 'view'"""),
    "threshold_search_46": (threshold_search_46, BEATS + """, n AS (SELECT *, lead(t) OVER (PARTITION BY record ORDER BY i) AS next FROM beats),
g AS (SELECT record, i, t, thr, t - lag(t) OVER w AS pp, CASE WHEN lead(i) OVER w IS NOT NULL THEN next - t END AS pr FROM n, (SELECT unnest(range(5, 51)) AS thr) WHERE value > thr WINDOW w AS (PARTITION BY record, thr ORDER BY i)),
d AS (SELECT *, pp - lag(pp) OVER w AS dpp, pr - lag(pr) OVER w AS dpr FROM g WINDOW w AS (PARTITION BY record, thr ORDER BY i)),
c AS (SELECT record, thr, round(coalesce(sqrt(avg(dpp * dpp)), 0) + coalesce(sqrt(avg(dpr * dpr)), 0), 6) AS c FROM d GROUP BY ALL HAVING count(pp) > 0)
SELECT record, first(thr ORDER BY c, thr DESC)::INT AS thr FROM c GROUP BY record"""),
    "cosen_grid": (cosen_grid, _RATED + f""", x AS (SELECT record, i, rr AS x, lead(rr) OVER (PARTITION BY record ORDER BY i) AS y FROM rated WHERE rr IS NOT NULL),
p AS (SELECT a.record, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy FROM x a JOIN x b ON a.record = b.record AND a.i < b.i AND abs(a.x - b.x) <= 0.5),
g AS (SELECT record, unnest({_ARRAY})::DOUBLE AS r, avg(x) AS m FROM x GROUP BY record),
c AS (SELECT g.record, r, m, 2 * count(dx) FILTER (dx <= r) AS b, 2 * count(dx) FILTER (dx <= r AND dy <= r) AS a FROM g LEFT JOIN p USING (record) GROUP BY ALL),
s AS (SELECT record, m, min_by(struct_pack(r := r, a := a, b := b), r) AS s FROM c WHERE a >= 5 OR r = 0.5 GROUP BY ALL)
SELECT record, s.r AS r, s.a AS a, s.b AS b, round(CASE WHEN s.b = 0 THEN 'inf'::DOUBLE ELSE CASE WHEN s.a > 0 THEN -ln(s.a / s.b) ELSE 0 END + ln(2 * s.r) - ln(m) END, 4) + 0.0 AS cosen FROM s"""),
    "fuzzy_entropy": (fuzzy_entropy, _RATED + """, x AS (SELECT record, i, rr AS x, lead(rr) OVER (PARTITION BY record ORDER BY i) AS y FROM rated WHERE rr IS NOT NULL),
m AS (SELECT record, avg(x) AS m FROM x GROUP BY record), v AS (SELECT * FROM x WHERE y IS NOT NULL), n AS (SELECT record, count(*) AS n FROM v GROUP BY record),
d AS (SELECT a.record, abs(abs(a.x - b.x) - abs(a.y - b.y)) / (abs(a.x - b.x) + abs(a.y - b.y) + 1e-5) AS d FROM v a JOIN v b ON a.record = b.record),
s AS (SELECT record, avg(exp(-(d ** n) / 0.05)) AS a FROM d JOIN n USING (record) GROUP BY record)
SELECT record, round(-ln(a) + ln(0.1) - 0.8 * ln(m), 4) + 0.0 AS entropy FROM s JOIN m USING (record)"""),
    "taper_blend": (taper_blend, SAMPLES + """SELECT record, i, round(CASE WHEN i < 24 THEN x WHEN i < 40 THEN x * (1 - (i - 23.5) / 16) + x * 0.5 * (i - 23.5) / 16 ELSE x * 0.5 END, 4) + 0.0 AS y FROM samples"""),
    "reversed_signal": (reversed_signal, SAMPLES + "SELECT record, i, round(CASE WHEN min(x) OVER (PARTITION BY record) < -0.45 THEN -x ELSE x END, 4) + 0.0 AS y FROM samples"),
    "binary_resample": (binary_resample, "SELECT vec_id AS record, k AS i, (embedding[k * 64 // 48 + 1] > 0)::INT AS m FROM embeddings, (SELECT unnest(range(48)) AS k)"),
    "noise_level": (noise_level, SAMPLES + """, d AS (SELECT record, x - avg(x) OVER (PARTITION BY record ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS d FROM samples)
SELECT record, round(sqrt(avg(d * d)), 4) AS noise FROM d GROUP BY record"""),
    "std_normalised": (std_normalised, SAMPLES + "SELECT record, i, round(x / stddev_pop(x) OVER (PARTITION BY record), 3) + 0.0 AS y FROM samples"),
    "softmax": (softmax, SAMPLES + """, e AS (SELECT record, i, exp(x - max(x) OVER (PARTITION BY record)) AS e FROM samples WHERE i < 8)
SELECT record, first(i ORDER BY e DESC, i) AS best, round(max(e) / sum(e), 4) AS p FROM e GROUP BY record"""),
    "annotation_capture": (annotation_capture, BEATS + "SELECT record, event_type AS name, i AS start, i + 5 AS stop FROM beats"),
    "run_stamps": (run_stamps, "SELECT user_id AS record, strftime(max(ts), '%Y%m%d-%H%M') AS stamp FROM events GROUP BY user_id"),
    "json_exists": (json_exists, "SELECT event_id, (props->>'k')::INT AS k FROM events WHERE (props->>'k')::INT IN (3, 5, 69)"),
    "feature_store_find": (feature_store_find, BEATS + """SELECT record, count(*) AS n, count(*) FILTER (kind = 'V') AS abnormal, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS diagnoses, round(avg(value), 4) AS level
FROM beats GROUP BY record HAVING count(*) FILTER (event_type = 'error') > 0 AND count(*) FILTER (kind = 'V') >= 10 AND avg(value) BETWEEN 20 AND 60"""),
    "validated_sources": (validated_sources, "SELECT CASE WHEN vec_id % 50 = 0 THEN 'no samples' ELSE 'ok' END AS state, count(*) AS n FROM embeddings GROUP BY 1"),
}
