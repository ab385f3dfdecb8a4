"""Language identification by compression: the zstandard dictionary that makes a text smallest names its language.

Each language has a raw-content dictionary, the end of a bounded sample of labelled texts (`SAMPLE_ROWS` rows a language,
`SAMPLE_BYTES` of each row, chosen by a hash of id and text). A text is cut into blocks of `BLOCK` bytes, so what a long text
says earlier does not stand in for the dictionary, and every block is compressed with every dictionary; sizes add up
over the whole text. Every block follows a run of line feeds, which keeps the library from storing a short one as it is;
level and framing are the same for texts of all sizes. The prediction is the smallest total; the margin is the share of
the second smallest that it saves, the score grows with the margin, and a text whose margin is under `MARGIN` is rejected.

Defined cases: a null text, or one without a letter, is `und` with score 0; with no labelled row every text is `und`;
with one language it scores 1; ties go to the language with more labelled rows, then to the one that sorts first, with
margin 0; rows without lang are not learned from; a null doc_id is never held out; repeated rows are predicted alike; an
empty table gives an empty result; extra columns are ignored by `classify` and carried along by `accepted`, whatever
their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common

SAMPLE_ROWS = 400
SAMPLE_BYTES = 1_000
DICTIONARY_BYTES = 112_000
BLOCK = 4_096
LEVEL = 6
LEAD = b"\n" * 256
#: Least share of the second smallest size that the smallest must save for a prediction not to be rejected.
MARGIN = 0.002
UNDETERMINED = "und"

_LETTER = re.compile(r"[^\W\d_]")
_BLANK = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(common.crc32_of_id(doc_id) % 5 == 0, F.lit(False))


def folded(text: str) -> bytes:
    """Lower-case letters with single spaces between words: digits and marks say little about a language."""
    return _BLANK.sub(b" ", text.lower().encode("utf-8", "ignore"))


def dictionaries(docs: DataFrame) -> dict[str, bytes]:
    """Raw dictionary content of each language that `docs` labels, the language with most rows first."""
    labelled = {r["lang"]: r["count"] for r in docs.where("lang is not null").groupBy("lang").count().collect()}
    if not labelled:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in sorted(labelled.items()) for x in (lang, 2 * SAMPLE_ROWS / n)])
    order = Window.partitionBy("lang").orderBy("h")
    # Twice as many as are wanted are drawn by chance and equal rows count once, so no task sends more than its part; then the
    # first are taken.
    drawn = docs.where(F.col("lang").isNotNull()).where(common.chance(F.lit("language"), "doc_id", "text") < F.element_at(share, F.col("lang"))).where(F.col("text").rlike("\\p{L}"))
    rows = drawn.select("lang", F.substring("text", 1, SAMPLE_BYTES).alias("t"), F.xxhash64(F.lit("sample"), "doc_id", "text").alias("h"))
    rows = rows.groupBy("lang", "h").agg(F.min("t").alias("t")).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= SAMPLE_ROWS)
    by: dict[str, list[tuple[int, str]]] = {}
    for r in rows.collect():
        by.setdefault(r["lang"], []).append((r["rn"], r["t"]))
    return {lang: b" ".join(folded(t) for _, t in sorted(by[lang], reverse=True))[-DICTIONARY_BYTES:] for lang in sorted(by, key=lambda x: (-labelled[x], x))}


class Compressors:
    def __init__(self, contents: dict[str, bytes]):
        import zstandard

        self.langs, self.codecs = list(contents), []
        for content in contents.values():
            made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=LEVEL)
            self.codecs.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False))

    def classify(self, text: str | None) -> tuple[str, float, float]:
        """Language, score, margin."""
        if not self.langs or not text or not _LETTER.search(text):
            return UNDETERMINED, 0.0, 0.0
        data = folded(text)
        blocks = [LEAD + data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        sizes = sorted((sum(len(codec.compress(b)) for b in blocks), k) for k, codec in enumerate(self.codecs))
        if len(sizes) == 1:
            return self.langs[0], 1.0, 1.0
        margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        return self.langs[sizes[0][1]], margin / (margin + 0.05), margin


def classify(docs: DataFrame, contents: dict[str, bytes], keep: list[str]) -> DataFrame:
    """The columns `keep` of `docs`, with lid_lang, lid_score and lid_margin of each text."""
    found = _classify(docs, contents, keep)
    return found.select(*[F.col(f"k_{c}").alias(c) for c in keep], "lid_lang", "lid_score", "lid_margin")


def _classify(docs: DataFrame, contents: dict[str, bytes], keep: list[str]) -> DataFrame:
    """`classify` with `k_` before the names kept, so that none can clash; a text that is kept is sent once."""
    spark = docs.sparkSession
    common.arrow_batches(spark)
    sent = spark.sparkContext.broadcast(contents)  # at most DICTIONARY_BYTES a language
    columns = [F.col(c).alias(f"k_{c}") for c in keep]
    source = "k_text" if "text" in keep else "lid_text"
    plain = docs.select(*columns) if "text" in keep else docs.select(*columns, F.col("text").alias("lid_text"))
    names = [f"k_{c}" for c in keep]
    schema = T.StructType([*plain.schema.fields[: len(keep)], T.StructField("lid_lang", T.StringType()), T.StructField("lid_score", T.DoubleType()), T.StructField("lid_margin", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = Compressors(sent.value)
        for batch in batches:
            found = [compressors.classify(t.as_py()) for t in batch.column(source)]
            made = [pa.array([f[0] for f in found], pa.string()), *[pa.array([f[k] for f in found], pa.float64()) for k in (1, 2)]]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *made], names=[*names, "lid_lang", "lid_score", "lid_margin"])
        common.trim()

    return plain.mapInArrow(run, schema)


def accepted(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """The rows of `docs` whose language is told with some margin, with all their columns."""
    contents = dictionaries(docs.where(~held_out(F.col("doc_id"))))
    found = _classify(docs, contents, docs.columns)
    return found.where((F.col("lid_lang") != UNDETERMINED) & (F.col("lid_margin") >= margin)).select(*[F.col(f"k_{c}").alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the language of every document, learned from the documents that are not held out."""
    docs = common.table(spark, sf_dir, "documents")
    found = classify(docs, dictionaries(docs.where(~held_out(F.col("doc_id")))), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("lid_lang").alias("lang_pred"), F.col("lid_score").alias("score"))
