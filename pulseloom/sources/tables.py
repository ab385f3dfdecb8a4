"""Views of stored tables as recordings, beats, waveforms and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import rhythm

#: Event types that stand for an abnormal (ventricular) beat.
VENTRICULAR = ("error", "signup")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record, i, t, kind, value, event_type): the ordered beats of every record; `t` in seconds."""
    ts = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("record"), ts.alias("t"), F.when(F.col("event_type").isin(*VENTRICULAR), "V").otherwise("N").alias("kind"), "value", "event_type"
    )
    return rows.withColumn("i", (F.row_number().over(Window.partitionBy("record").orderBy("t")) - 1).cast("long"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record, label, i, x): the waveform samples of every record, in long form."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x"))
    return rows.select(F.col("vec_id").alias("record"), "label", F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x"))


def heart_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as recordings of beats and P waves, as `operators.rhythm` takes them: ten hours stand for a second, a view is
    a P wave and the other events are beats; one scan and one sort by record."""
    event = table(spark, sf_dir, "events").select(F.col("user_id").alias("record"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3.6e10)).alias("t"), "event_type", "value")
    w = Window.partitionBy("record").orderBy("t")
    beat = F.col("event_type") != "view"
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    rows = event.withColumns(
        {
            "last": F.last(F.when(beat, F.col("t")), ignorenulls=True).over(before), "next": F.first(F.when(beat, F.col("t")), ignorenulls=True).over(after),
            "led": F.coalesce(F.lag("event_type").over(w) == "view", F.lit(False)), "leads": F.coalesce(F.lead("event_type").over(w) != "view", F.lit(False)),
        }
    )
    tenth = F.pmod(F.floor("value").cast("long"), F.lit(30)) / 100  # of a second, from 0 to 0.29
    rows = rows.withColumns({"rr_raw": F.coalesce(F.col("t") - F.col("last"), F.col("next") - F.col("t")), "p_onset": F.when(F.col("led"), F.col("t") - 0.05 - tenth), "abnormal": F.col("event_type").isin(*VENTRICULAR)})
    rows = rows.withColumns({"onset": F.col("t") - 0.04, "width": 0.06 + tenth / 2, "snr": 10 + F.pmod("value", F.lit(40.0)), "afib": F.col("value").between(30, 40), "noise": F.col("value") > 150})
    flag = rhythm.junctional_flag(F.col("abnormal"), F.col("width"), F.col("afib"), F.col("snr"), F.col("onset"), F.col("p_onset"), F.pmod("value", F.lit(60.0)))
    number, unset = F.lit(None).cast("double"), F.lit(False)
    whole = F.struct(
        F.lit("beat").alias("wave"), F.col("t").alias("r"), F.col("onset"), (F.col("t") + 0.06).alias("offset"), F.col("width"), F.col("abnormal"), flag.alias("junctional"), unset.alias("double_p"),
        (F.col("t") - F.col("p_onset")).alias("pr"), F.when(~F.col("abnormal"), F.col("rr_raw")).alias("rr"), F.col("rr_raw"), F.col("rr_raw").alias("rr_smooth"), F.col("snr"), F.col("p_onset"),
        (F.pmod("value", F.lit(7.0)) < 2).alias("p_inverted"), F.col("value").alias("p_height"), (F.col("t") + 0.2).alias("t_offset"),
        F.when(F.col("p_onset").isNotNull(), F.floor(F.pmod("value", F.lit(3.0))).cast("double")).alias("p_cluster"), F.col("noise"), F.col("afib"), unset.alias("unmatched"), number.alias("snr_db"),
    )
    filled = {"wave": F.lit("p"), "offset": number, "snr_db": F.lit(0.0)}

    def p_wave(onset: Column, unmatched: bool) -> Column:
        own = {**filled, "onset": onset, "unmatched": F.lit(unmatched)}
        return F.struct(*[own.get(f, unset if f in ("abnormal", "junctional", "double_p", "p_inverted", "noise", "afib") else number).alias(f) for f in WAVE_FIELDS])

    made = F.when(beat & F.col("p_onset").isNotNull(), F.array(whole, p_wave(F.col("p_onset"), False))).when(beat, F.array(whole)).when(~F.col("leads"), F.array(p_wave(F.col("t"), True)))
    return rows.select("record", F.explode(made).alias("s")).select("record", "s.*")


WAVE_FIELDS = (
    "wave", "r", "onset", "offset", "width", "abnormal", "junctional", "double_p", "pr", "rr", "rr_raw", "rr_smooth", "snr", "p_onset", "p_inverted", "p_height", "t_offset", "p_cluster", "noise", "afib",
    "unmatched", "snr_db",
)
