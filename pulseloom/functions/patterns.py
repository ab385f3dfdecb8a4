"""Beat strings and regular expressions with positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Named patterns over beat strings of N and V.
PATTERNS = {
    "V_RUN": "V{3,}",
    "BIGEMINY": "(?:(?:NV){3,}|(?:VN){3,})",
    "TRIGEMINY": "(?:(?:VNN){3,}|(?:NNV){3,})",
    "QUADRIGEMINY": "(?:(?:VNNN){3,}|(?:NNNV){3,})",
}


def beat_string(beats: DataFrame) -> DataFrame:
    """(record, beats): one letter for each beat, in order."""
    letters = F.transform(F.array_sort(F.collect_list(F.struct("i", "kind"))), lambda s: s["kind"])
    return beats.groupBy("record").agg(F.concat_ws("", letters).alias("beats"))


def repaired(strings: DataFrame) -> DataFrame:
    """A single N between runs of V is read as V."""
    return strings.withColumn("beats", F.replace("beats", F.lit("VVVNVVV"), F.lit("VVVVVVV")))


def find_all(strings: DataFrame, name: str, pattern: str) -> DataFrame:
    """(record, name, first, last): the matches of a pattern, left to right, by the lengths of matches and gaps."""
    matched = strings.select("record", F.expr(f"regexp_extract_all(beats, '{pattern}', 0)").alias("m"), F.split("beats", pattern, -1).alias("g"))
    hits = matched.select("record", "m", "g", F.posexplode("m").alias("k", "hit"))
    length = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + F.length(x))
    first = length(F.slice("g", F.lit(1), F.col("k") + 1)) + length(F.slice("m", F.lit(1), F.col("k")))
    return hits.select("record", F.lit(name).alias("name"), first.cast("long").alias("first"), (first + F.length("hit") - 1).cast("long").alias("last"))
