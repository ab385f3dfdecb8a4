"""Queries on waveforms, evaluation, sampling, labels and reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats
from ..functions import waveform as wave
from ..operators import evaluate
from ..sources.tables import beats, samples, table
from .intervals import SAMPLES
from .sequences import BEATS, HOUR, rounded


def _waves(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("record"), "label", F.col("embedding").cast("array<double>").alias("x"))


def mean_waveform(spark, sf):
    return rounded(samples(spark, sf).groupBy("label", "i").agg(F.avg("x").alias("x")), "x")


def zscore_wave(spark, sf):
    rows = _waves(spark, sf).select("record", F.posexplode(wave.zscore(F.col("x"))).alias("i", "z"))
    return rounded(rows, "z")


def resample_lerp(spark, sf):
    rows = _waves(spark, sf).select("record", F.posexplode(wave.resample(F.col("x"), 50)).alias("i", "y"))
    return rounded(rows, "y")


def overlap_add(spark, sf):
    """Tiles whose values are off by a hundredth of the tile's number, put together by weighted means."""
    starts, weights = wave.tiles(64, 16, 0.9), wave.gaussian(16)
    off = lambda s: F.array_position(F.array(*map(F.lit, starts)), s) / 100
    return rounded(wave.overlap_add(_waves(spark, sf), starts, weights, off), "y", places=6)


def detrend(spark, sf):
    return rounded(_waves(spark, sf).select("record", F.posexplode(wave.detrend(F.col("x"))).alias("i", "y")), "y")


def pad_and_crop(spark, sf):
    """Waveforms padded to a multiple of 48, cropped to 50 to 90 of that."""
    rows = _waves(spark, sf).select("record", F.slice(wave.pad(F.col("x"), 48), 51, 40).alias("c"))
    return rounded(rows.select("record", F.posexplode("c").alias("i", "y")), "y")


def convolve_lag(spark, sf):
    return rounded(_waves(spark, sf).select("record", F.posexplode(wave.convolve(F.col("x"), [0.25, 0.5, 0.25])).alias("i", "y")), "y")


def shifted_difference(spark, sf):
    return rounded(_waves(spark, sf).select("record", wave.rmse(F.col("x"), wave.shift(F.col("x"), 1)).alias("d")), "d")


def snr_db(spark, sf):
    return rounded(_waves(spark, sf).select("record", wave.snr_db(F.slice("x", 1, 32), F.slice("x", 33, 32)).alias("snr")), "snr")


def bald(spark, sf):
    chances = F.transform(F.slice("x", 1, 8), lambda v: stats.sigmoid(v))
    return rounded(_waves(spark, sf).select("record", wave.bald(chances).alias("bald"), stats.binary_entropy(stats.sigmoid(F.get("x", 0))).alias("entropy")), "bald", "entropy")


def argmax_softmax(spark, sf):
    return _waves(spark, sf).select("record", (F.array_position("x", F.array_max("x")) - 1).alias("argmax"), F.round(stats.algebraic_sigmoid(F.get("x", 1)), 4).alias("alg"))


def threshold_mask(spark, sf):
    rows = _waves(spark, sf).select("record", F.transform("x", lambda v: v > 0.25).alias("m"), F.transform("x", lambda v: v > 0.5).alias("s"))
    return rows.select("record", F.size(F.filter("m", lambda v: v)).alias("n"), F.size(F.filter(F.zip_with("m", "s", lambda a, b: a & ~b), lambda v: v)).alias("kept"))


def lowpass_energy(spark, sf):
    """Zero-phase low-pass in an Arrow UDF; no SQL twin."""
    low = wave.filtered(wave.butterworth(4, 30, 250))
    return rounded(_waves(spark, sf).select("record", low("x").alias("y")).select("record", wave.dot(F.col("y"), F.col("y")).alias("energy")), "energy")


def correlation(spark, sf):
    rows = table(spark, sf, "lineitem")
    return rounded(rows.groupBy("l_returnflag").agg(F.corr("l_quantity", "l_extendedprice").alias("r"), F.stddev_pop("l_discount").alias("sd")), "r", "sd")


def _judged(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return rows.select("doc_id", "lang", (F.col("quality") == 1).alias("truth"), (F.col("n_chars") > 1000).alias("found"), F.least(F.lit(1.0), F.col("n_chars") / 5000).alias("score"))


_JUDGED = "WITH j AS (SELECT doc_id, lang, quality = 1 AS truth, n_chars > 1000 AS found, least(1.0, n_chars / 5000) AS score FROM labels JOIN documents USING (doc_id))\n"
_COUNTS = "count(*) FILTER (truth AND found) AS tp, count(*) FILTER (NOT truth AND found) AS fp, count(*) FILTER (truth AND NOT found) AS fn, count(*) FILTER (NOT truth AND NOT found) AS tn"
_RATES = {"se": ("tp", "tp + fn"), "sp": ("tn", "tn + fp"), "ppv": ("tp", "tp + fp"), "npv": ("tn", "tn + fp"), "npv_true": ("tn", "tn + fn"), "f1": ("2 * tp", "2 * tp + fp + fn"), "acc": ("(tp + tn)", "tp + fp + fn + tn"), "fnr": ("fn", "fn + tp"), "iou": ("tp", "tp + fp + fn")}


def set_metrics(spark, sf):
    rows = evaluate.set_metrics(_judged(spark, sf), "truth", "found", ["lang"])
    return rounded(rows, *_RATES)


def macro_micro(spark, sf):
    rows = evaluate.micro_macro(_judged(spark, sf), "truth", "found", "lang")
    return rounded(rows, *rows.columns)


def confusion(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    rows = rows.select(F.array_compact(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic"), "lang")).alias("truth"), F.array("source").alias("found"))
    return evaluate.confusion(rows, "truth", "found")


def threshold_grid(spark, sf):
    return rounded(evaluate.threshold_grid(_judged(spark, sf), "truth", "score", 19), "threshold", "balanced")


def best_threshold(spark, sf):
    return rounded(evaluate.best_threshold(_judged(spark, sf), "truth", "score", 19), "threshold", "balanced")


def threshold_grid_99(spark, sf):
    """The grid of the reference; `threshold_grid` and `best_threshold` have every fifth threshold of it."""
    return rounded(evaluate.threshold_grid(_judged(spark, sf), "truth", "score"), "threshold", "balanced")


def best_threshold_99(spark, sf):
    return rounded(evaluate.best_threshold(_judged(spark, sf), "truth", "score"), "threshold", "balanced")


def bootstrap_ci(spark, sf):
    """Poisson bootstrap by hash; no SQL twin."""
    return rounded(evaluate.bootstrap_mean(_judged(spark, sf).select("doc_id", F.col("truth").cast("double").alias("y")), "y", replicates=1000), "mean", "low", "high")


def rollup_average(spark, sf):
    rows = table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.avg("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))
    return rounded(rows.select(F.coalesce("l_returnflag", F.lit("Average")).alias("flag"), F.coalesce("l_linestatus", F.lit("Average")).alias("status"), "q", "n"), "q")


def class_mapper(spark, sf):
    names = F.create_map(*[F.lit(x) for pair in (("click", "N"), ("view", "N"), ("error", "V")) for x in pair])
    return beats(spark, sf).select(F.coalesce(F.get(F.array(F.try_element_at(names, F.col("event_type"))), 0), F.col("event_type")).alias("cls")).groupBy("cls").count()


SYNONYMS = (("ATRIAL", "steel"), ("SINUS", "brass|tin"), ("NOISE", "copper"), ("SINUS", "nickel"))


def synonym_regex(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    hits = [F.when(F.lower("p_name").rlike(rx), F.lit(name)) for name, rx in SYNONYMS]
    return parts.select("p_partkey", F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*hits)))), ",").alias("classes"))


def top_share(spark, sf):
    rows = beats(spark, sf).withColumn("d", F.lead("t").over(Window.partitionBy("record").orderBy("i")) - F.col("t")).where("d is not null")
    share = rows.groupBy("record", "kind").agg((F.sum("d") / HOUR).alias("hours"))
    return rounded(share.groupBy("record").agg(F.max_by("kind", F.struct("hours", "kind")).alias("kind"), F.max("hours").alias("hours")), "hours", places=3)


def duration_rules(spark, sf):
    rows = beats(spark, sf).withColumn("d", (F.lead("t").over(Window.partitionBy("record").orderBy("i")) - F.col("t")) / HOUR).where("d is not null")
    label = F.when((F.col("event_type") == "error") & (F.col("d") >= 27), "AFIB").when((F.col("event_type") == "signup") & (F.col("d") >= 10), "VT").when(F.col("event_type") == "signup", "NSVT").when(F.col("event_type") == "view", "NSR")
    return rows.withColumn("label", label).where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("d"), 3).alias("hours"))


def rhythm_class(spark, sf):
    n = beats(spark, sf).groupBy("record").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "V").alias("v"), F.count_if(F.col("event_type") == "error").alias("e"))
    return n.select("record", F.when(F.col("e") / F.col("n") > 0.3, "noise").when(F.col("v") / F.col("n") > 0.45, "afib").when(F.col("v") / F.col("n") < 0.35, "normal").otherwise("other").alias("cls"))


def lead_routing(spark, sf):
    leads = beats(spark, sf).groupBy("record").agg(F.collect_set("event_type").alias("leads"))
    has = lambda *x: F.size(F.array_intersect("leads", F.array(*map(F.lit, x)))) == len(x)
    return leads.select("record", F.when(~has("view"), "error").when(has("view", "click", "purchase"), "three").otherwise("one").alias("model"))


def cap_per_class(spark, sf):
    rows = beats(spark, sf).withColumn("rn", F.row_number().over(Window.partitionBy("event_type").orderBy("value", "record", "i"))).where("rn <= 25")
    return rows.select("event_type", "record", "i", "rn")


def kth_window(spark, sf):
    w = Window.partitionBy("record")
    rows = beats(spark, sf).withColumn("n", F.count(F.lit(1)).over(w))
    return rows.where(F.abs(F.col("i") - F.floor(F.col("n") / 2)) <= 10).select("record", "i")


def fold_split(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.pmod(F.crc32(F.concat(F.lit("12345:"), F.col("doc_id").cast("string")).cast("binary")), F.lit(5)).alias("fold")).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


def model_rank(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_linestatus", "l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("score"))
    return n.select("l_linestatus", "l_returnflag", F.rank().over(Window.partitionBy("l_returnflag").orderBy(F.desc("score"))).alias("place"))


def unwind_group_push(spark, sf):
    n = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf, "events").select("user_id", "event_id", n.alias("k")).where("k > 50")
    return rows.groupBy("user_id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string"))).alias("ids"), F.max("k").alias("k"))


def chunk_majority(spark, sf):
    n = beats(spark, sf).groupBy("record", F.floor(F.col("i") / 8).alias("chunk"), "kind").count()
    out = n.groupBy("record", "chunk").agg(F.max_by("kind", F.struct("count", F.col("kind") == "N")).alias("kind"))
    return out


def union_all(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.lit("c").alias("src"))
    b = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("s").alias("src"))
    return a.unionByName(b).groupBy("k", "src").count()


def set_difference(spark, sf):
    a, b = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    return a.exceptAll(b.distinct()).withColumn("side", F.lit("without")).unionByName(a.intersect(b).withColumn("side", F.lit("with")))


def label_cells(spark, sf):
    cells = F.transform(F.split("p_name", " "), lambda x: F.trim(F.lower(x)))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.array_distinct(cells), "|").alias("cells"), F.element_at(F.split("p_name", " "), -1).alias("base"), F.substring("p_name", 1, 2).alias("prefix"))


def feature_vector(spark, sf):
    rows = beats(spark, sf).groupBy("record").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("kind") == "V").cast("double")).alias("v_share"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"),
        F.skewness("value").alias("skew"), F.kurtosis("value").alias("kurt"), F.percentile("value", 0.5).alias("median"), F.max("value").alias("most"),
    )
    return rounded(rows, "v_share", "mean", "sd", "skew", "kurt", "median")


def explanation(spark, sf):
    rows = beats(spark, sf).where("value > 150").select("record", F.struct("i", F.concat(F.lit("beat "), F.col("i").cast("string"), F.lit(" is high")).alias("e")).alias("s"))
    return rows.groupBy("record").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["e"]), "; ").alias("text"))


def nested_export(spark, sf):
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("name"), F.struct(F.col("r_name").alias("name")).alias("region"))).alias("doc"))


_X = "JOIN (SELECT record AS r, avg(x) AS mu, stddev_pop(x) AS sd FROM samples GROUP BY record) q ON q.r = record"
_SIG = "1 / (1 + exp(-x))"
QUERIES = {
    "mean_waveform": (mean_waveform, SAMPLES + "SELECT label, i, round(avg(x), 4) + 0.0 AS x FROM samples GROUP BY label, i"),
    "zscore_wave": (zscore_wave, SAMPLES + f"SELECT record, i, round(CASE WHEN sd > 0 THEN (x - mu) / sd ELSE 0 END, 4) + 0.0 AS z FROM samples {_X}"),
    "resample_lerp": (resample_lerp, SAMPLES + """, k AS (SELECT unnest(generate_series(0, 49)) AS k), p AS (SELECT record, k, k * 63 / 49.0 AS p FROM (SELECT DISTINCT record FROM samples), k)
SELECT p.record, k AS i, round(a.x + (p - floor(p)) * (b.x - a.x), 4) + 0.0 AS y FROM p JOIN samples a ON a.record = p.record AND a.i = CAST(floor(p) AS BIGINT) JOIN samples b ON b.record = p.record AND b.i = least(CAST(floor(p) AS BIGINT) + 1, 63)"""),
    "overlap_add": (overlap_add, SAMPLES + """, tile AS (SELECT unnest(range(5)) AS k), s AS (SELECT k, 12 * k AS s FROM tile),
w AS (SELECT unnest(range(16)) AS j), g AS (SELECT j, 10 * greatest(exp(-0.5 * ((j - 7.5) / 2) ** 2), 1e-6) AS g FROM w)
SELECT record, i, round(sum((x + (k + 1) / 100) * g) / sum(g), 6) + 0.0 AS y FROM samples JOIN s ON i BETWEEN s AND s + 15 JOIN g ON g.j = i - s GROUP BY record, i"""),
    "detrend": (detrend, SAMPLES + "SELECT record, i, round(x - (first_value(x) OVER w + i * (last_value(x) OVER w - first_value(x) OVER w) / 63), 4) + 0.0 AS y FROM samples WINDOW w AS (PARTITION BY record ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    "pad_and_crop": (pad_and_crop, "SELECT vec_id AS record, k AS i, round(coalesce(embedding[k + 51], 0)::DOUBLE, 4) + 0.0 AS y FROM embeddings, (SELECT unnest(range(40)) AS k)"),
    "convolve_lag": (convolve_lag, SAMPLES + ", k AS (SELECT unnest([0, 1, 2]) AS j, unnest([0.25, 0.5, 0.25]) AS w) SELECT record, i + j AS i, round(sum(x * w), 4) + 0.0 AS y FROM samples, k GROUP BY ALL"),
    "shifted_difference": (shifted_difference, SAMPLES + ", d AS (SELECT record, x - coalesce(lag(x) OVER (PARTITION BY record ORDER BY i), 0) AS d FROM samples) SELECT record, round(sqrt(avg(d * d)), 4) AS d FROM d GROUP BY record"),
    "snr_db": (snr_db, SAMPLES + "SELECT record, round(10 * log10(avg(x * x) FILTER (i < 32) / avg(x * x) FILTER (i >= 32)), 4) AS snr FROM samples GROUP BY record"),
    "bald": (bald, SAMPLES + f", p AS (SELECT record, i, {_SIG} AS p FROM samples WHERE i < 8) SELECT record, round(-avg(p) * ln(avg(p)) - avg(-p * ln(p)), 4) AS bald, round(max(CASE WHEN i = 0 THEN -(p * log2(p) + (1 - p) * log2(1 - p)) END), 4) AS entropy FROM p GROUP BY record"),
    "argmax_softmax": (argmax_softmax, SAMPLES + "SELECT record, first(i ORDER BY x DESC, i) AS argmax, round(max(CASE WHEN i = 1 THEN 1 - 4 * x / sqrt(1 + 16 * x * x) END), 4) AS alg FROM samples GROUP BY record"),
    "threshold_mask": (threshold_mask, SAMPLES + "SELECT record, count(*) FILTER (x > 0.25) AS n, count(*) FILTER (x > 0.25 AND NOT x > 0.5) AS kept FROM samples GROUP BY record"),
    "lowpass_energy": (lowpass_energy, None),
    "correlation": (correlation, "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 4) AS r, round(stddev_pop(l_discount), 4) AS sd FROM lineitem GROUP BY l_returnflag"),
    "set_metrics": (set_metrics, _JUDGED + f", c AS (SELECT lang, {_COUNTS} FROM j GROUP BY lang) SELECT lang, tp, fp, fn, tn, " + ", ".join(f"round(CASE WHEN {b} <> 0 THEN {a} / ({b}) END, 4) AS {k}" for k, (a, b) in _RATES.items()) + " FROM c"),
    "macro_micro": (macro_micro, _JUDGED + f", c AS (SELECT lang, {_COUNTS} FROM j GROUP BY lang), p AS (SELECT {_COUNTS} FROM j) SELECT * FROM (SELECT " + ", ".join(f"round(avg(CASE WHEN {b} <> 0 THEN {a} / ({b}) END), 4) AS mean_{k}" for k, (a, b) in _RATES.items() if k in ("se", "sp", "ppv", "f1")) + " FROM c), (SELECT " + ", ".join(f"round({a} / ({b}), 4) AS pooled_{k}" for k, (a, b) in _RATES.items() if k in ("se", "sp", "ppv", "f1")) + " FROM p)"),
    "confusion": (confusion, "WITH r AS (SELECT [CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END, lang] AS t, source FROM labels JOIN documents USING (doc_id)), u AS (SELECT unnest(t) AS truth, source AS found FROM r) SELECT truth, found, count(*) AS n FROM u WHERE truth IS NOT NULL GROUP BY ALL"),
    "threshold_grid": (threshold_grid, _JUDGED + ", g AS (SELECT unnest(generate_series(1, 19)) AS k) SELECT round(k / 20, 4) AS threshold, round((count(*) FILTER (truth AND score > k / 20) / count(*) FILTER (truth) + count(*) FILTER (NOT truth AND NOT score > k / 20) / count(*) FILTER (NOT truth)) / 2, 4) AS balanced FROM j, g GROUP BY k"),
    "best_threshold": (best_threshold, _JUDGED + ", g AS (SELECT unnest(generate_series(1, 19)) AS k), b AS (SELECT k / 20 AS t, (count(*) FILTER (truth AND score > k / 20) / count(*) FILTER (truth) + count(*) FILTER (NOT truth AND NOT score > k / 20) / count(*) FILTER (NOT truth)) / 2 AS b FROM j, g GROUP BY k) SELECT round(t, 4) AS threshold, round(b, 4) AS balanced FROM b ORDER BY b DESC, t LIMIT 1"),
    "threshold_grid_99": (threshold_grid_99, _JUDGED + ", g AS (SELECT unnest(generate_series(1, 99)) AS k) SELECT round(k / 100, 4) AS threshold, round((count(*) FILTER (truth AND score > k / 100) / count(*) FILTER (truth) + count(*) FILTER (NOT truth AND NOT score > k / 100) / count(*) FILTER (NOT truth)) / 2, 4) AS balanced FROM j, g GROUP BY k"),
    "best_threshold_99": (best_threshold_99, _JUDGED + ", g AS (SELECT unnest(generate_series(1, 99)) AS k), b AS (SELECT k / 100 AS t, (count(*) FILTER (truth AND score > k / 100) / count(*) FILTER (truth) + count(*) FILTER (NOT truth AND NOT score > k / 100) / count(*) FILTER (NOT truth)) / 2 AS b FROM j, g GROUP BY k) SELECT round(t, 4) AS threshold, round(b, 4) AS balanced FROM b ORDER BY b DESC, t LIMIT 1"),
    "bootstrap_ci": (bootstrap_ci, None),
    "rollup_average": (rollup_average, "SELECT coalesce(l_returnflag, 'Average') AS flag, coalesce(l_linestatus, 'Average') AS status, round(avg(l_quantity), 4) AS q, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    "class_mapper": (class_mapper, BEATS + "SELECT CASE event_type WHEN 'click' THEN 'N' WHEN 'view' THEN 'N' WHEN 'error' THEN 'V' ELSE event_type END AS cls, count(*) AS count FROM beats GROUP BY 1"),
    "synonym_regex": (synonym_regex, "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(p_name), '{rx}') THEN '{n}' END" for n, rx in SYNONYMS) + "], lambda x: x IS NOT NULL))), ',') AS classes FROM part"),
    "top_share": (top_share, BEATS + ", d AS (SELECT record, kind, lead(t) OVER (PARTITION BY record ORDER BY i) - t AS d FROM beats), s AS (SELECT record, kind, sum(d) / 3600 AS h FROM d WHERE d IS NOT NULL GROUP BY ALL) SELECT record, first(kind ORDER BY h DESC, kind DESC) AS kind, round(max(h), 3) AS hours FROM s GROUP BY record"),
    "duration_rules": (duration_rules, BEATS + ", d AS (SELECT event_type AS e, (lead(t) OVER (PARTITION BY record ORDER BY i) - t) / 3600 AS d FROM beats), l AS (SELECT d, CASE WHEN e = 'error' AND d >= 27 THEN 'AFIB' WHEN e = 'signup' AND d >= 10 THEN 'VT' WHEN e = 'signup' THEN 'NSVT' WHEN e = 'view' THEN 'NSR' END AS label FROM d WHERE d IS NOT NULL) SELECT label, count(*) AS n, round(sum(d), 3) AS hours FROM l WHERE label IS NOT NULL GROUP BY label"),
    "rhythm_class": (rhythm_class, BEATS + ", n AS (SELECT record, count(*) AS n, count(*) FILTER (kind = 'V') AS v, count(*) FILTER (event_type = 'error') AS e FROM beats GROUP BY record) SELECT record, CASE WHEN e / n > 0.3 THEN 'noise' WHEN v / n > 0.45 THEN 'afib' WHEN v / n < 0.35 THEN 'normal' ELSE 'other' END AS cls FROM n"),
    "lead_routing": (lead_routing, BEATS + ", l AS (SELECT record, list(DISTINCT event_type) AS l FROM beats GROUP BY record) SELECT record, CASE WHEN NOT list_contains(l, 'view') THEN 'error' WHEN list_has_all(l, ['view', 'click', 'purchase']) THEN 'three' ELSE 'one' END AS model FROM l"),
    "cap_per_class": (cap_per_class, BEATS + ", r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, record, i) AS rn FROM beats) SELECT event_type, record, i, rn FROM r WHERE rn <= 25"),
    "kth_window": (kth_window, BEATS + ", n AS (SELECT *, count(*) OVER (PARTITION BY record) AS n FROM beats) SELECT record, i FROM n WHERE abs(i - n // 2) <= 10"),
    "fold_split": (fold_split, None),
    "model_rank": (model_rank, "WITH n AS (SELECT l_linestatus, l_returnflag, round(avg(l_quantity), 6) AS s FROM lineitem GROUP BY ALL) SELECT l_linestatus, l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY s DESC) AS place FROM n"),
    "unwind_group_push": (unwind_group_push, "WITH r AS (SELECT user_id, event_id, CAST(props->>'$.k' AS INT) AS k FROM events) SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids, max(k) AS k FROM r WHERE k > 50 GROUP BY user_id"),
    "chunk_majority": (chunk_majority, BEATS + "SELECT record, i // 8 AS chunk, CASE WHEN count(*) FILTER (kind = 'V') > count(*) FILTER (kind = 'N') THEN 'V' ELSE 'N' END AS kind FROM beats GROUP BY 1, 2"),
    "union_all": (union_all, "SELECT k, src, count(*) AS count FROM (SELECT c_nationkey AS k, 'c' AS src FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier) GROUP BY ALL"),
    "set_difference": (set_difference, "SELECT n_nationkey AS k, CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier) THEN 'with' ELSE 'without' END AS side FROM nation"),
    "label_cells": (label_cells, "WITH c AS (SELECT *, [trim(lower(x)) FOR x IN string_split(p_name, ' ')] AS c FROM part) SELECT p_partkey, array_to_string(list_filter(c, lambda x, k: list_position(c, x) = k), '|') AS cells, string_split(p_name, ' ')[-1] AS base, substr(p_name, 1, 2) AS prefix FROM c"),
    "feature_vector": (feature_vector, BEATS + ", m AS (SELECT *, avg(value) OVER (PARTITION BY record) AS mu FROM beats) SELECT record, count(*) AS n, round(avg((kind = 'V')::INT), 4) AS v_share, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS sd, round(avg((value - mu) ** 3) / stddev_pop(value) ** 3, 4) AS skew, round(avg((value - mu) ** 4) / var_pop(value) ** 2 - 3, 4) AS kurt, round(median(value), 4) AS median, max(value) AS most FROM m GROUP BY record"),
    "explanation": (explanation, BEATS + "SELECT record, string_agg('beat ' || i || ' is high', '; ' ORDER BY i) AS text FROM beats WHERE value > 150 GROUP BY record"),
    "nested_export": (nested_export, "SELECT n_nationkey, '{\"name\":\"' || n_name || '\",\"region\":{\"name\":\"' || r_name || '\"}}' AS doc FROM nation JOIN region ON n_regionkey = r_regionkey"),
}
