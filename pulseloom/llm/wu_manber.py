"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of the benchmark items. A matcher moves a window over a document's words: the block of two words
at its end looks up how far it can shift without missing a pattern, which for most blocks is the whole window; at shift
zero the block's bucket lists the patterns that end in it, those that also begin with the window's first word are
compared word by word. Patterns of one length share a matcher, so a short item does not shorten the shifts of the rest.

The benchmark is broadcast in parts of bounded size (`PART_BYTES`); beyond one part the documents are read once for each
part, and no part is left out. All passes but the last write only the texts with hits, by 128 bits of the text; the last
one adds them to its own.

Defined cases: null and wordless texts have no words, no hits and no items; an item without words has no window; of
repeated item rows one counts; a null item_id is written as an empty string; an empty benchmark leaves all documents
clean; an empty table gives an empty result; extra columns pass through `search`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW = 10
#: Text of the benchmark that one matcher holds; its tables take some fifty times as much in a Python worker.
PART_BYTES = 2_000_000

#: ASCII letters and digits and all that is not ASCII make words; A-Z in lower case, every other ASCII character parts.
_FOLD = bytes(c | 0x20 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Matcher:
    """Wu-Manber over patterns of `m` words each; a pattern is (item, first word)."""

    def __init__(self, m: int, patterns: list[tuple[int, int]], items: list[list[bytes]]):
        self.m, self.items, self.block = m, items, min(2, m)
        self.far = m - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = {}
        for item, at in patterns:
            pattern = items[item][at : at + m]
            for end in range(self.block, m + 1):
                key = self._key(pattern, end - 1)
                self.shift[key] = min(self.shift.get(key, self.far), m - end)
            self.bucket.setdefault(self._key(pattern, m - 1), {}).setdefault(pattern[0], []).append((item, at))

    def _key(self, w: list[bytes], end: int):
        return (w[end - 1], w[end]) if self.block == 2 else w[end]

    def find(self, w: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(index of the last word, patterns that occur there), by ascending index."""
        m, far, items, shift, bucket = self.m, self.far, self.items, self.shift.get, self.bucket
        at, n, two = m - 1, len(w), self.block == 2
        while at < n:
            key = (w[at - 1], w[at]) if two else w[at]
            by = shift(key, far)
            if by:
                at += by
                continue
            window = w[at - m + 1 : at + 1]
            found = [p for p in bucket[key].get(window[0], ()) if items[p[0]][p[1] : p[1] + m] == window]
            if found:
                yield at, found
            at += 1


class Benchmark:
    def __init__(self, rows: list[tuple[str, bytes | None]], window: int = WINDOW):
        rows = sorted({(i, t or b"") for i, t in rows})
        self.ids = [i for i, _ in rows]
        items = [words(t) for _, t in rows]
        by_length: dict[int, list] = {}
        for k, w in enumerate(items):
            m = min(window, len(w))
            if m:
                by_length.setdefault(m, []).extend((k, at) for at in range(len(w) - m + 1))
        self.matchers = [Matcher(m, p, items) for m, p in sorted(by_length.items())]

    def scan(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged ranges [first, end) of words that are hit, and the items with occurring windows."""
        ranges, found = [], set()
        for matcher in self.matchers:
            for at, patterns in matcher.find(w):
                ranges.append((at - matcher.m + 1, at + 1))
                found.update(self.ids[k] for k, _ in patterns)
        return merged(ranges), found


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def search(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """The columns `keep` of `docs`, with wm_words, wm_ranges ([first, end) of hit words) and wm_items of each text."""
    found = _search(docs, benchmark, keep, window, part_bytes)
    return found.select(*[F.col(f"k_{c}").alias(c) for c in keep], "wm_words", "wm_ranges", "wm_items")


def _matching(spark: SparkSession, items: DataFrame, window: int, source: str, names: list[str], only_hits: bool):
    """A function over batches: `names` and wm_words, wm_ranges, wm_items of the text in `source`, with those that an earlier
    pass found, if the batch has them."""
    rows = spark.sparkContext.broadcast([(r["item"], bytes(r["text"]) if r["text"] is not None else None) for r in items.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = Benchmark(rows.value, window)
        for batch in batches:
            n_words, ranges, hit, rest = [], [], [], []
            before = [batch.column(c).to_pylist() for c in ("wm_before", "wm_found")] if "wm_before" in batch.schema.names else None
            for k, text in enumerate(batch.column(source)):
                data = text.as_py()
                w = words(data.encode() if isinstance(data, str) else data)
                r, found = matchers.scan(w)
                if before and before[0][k] is not None:
                    r = merged(r + list(zip(before[0][k][::2], before[0][k][1::2], strict=True)))
                    found |= set(before[1][k])
                if r or not only_hits:
                    rest.append(k)
                    n_words.append(len(w))
                    ranges.append([x for pair in r for x in pair])
                    hit.append(sorted(found))
            kept = [batch.column(c) for c in names]
            kept = [c.take(pa.array(rest, pa.int64())) for c in kept] if len(rest) < batch.num_rows else kept
            made = [pa.array(n_words, pa.int64()), pa.array(ranges, pa.list_(pa.int64())), pa.array(hit, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[*names, "wm_words", "wm_ranges", "wm_items"])

    return run


_FOUND = [T.StructField("wm_words", T.LongType()), T.StructField("wm_ranges", T.ArrayType(T.LongType())), T.StructField("wm_items", T.ArrayType(T.StringType()))]


def _search(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """`search` with `k_` before the names kept, so that none can clash; a text that is kept is sent once."""
    spark = docs.sparkSession
    common.arrow_batches(spark)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    names = [f"k_{c}" for c in keep]
    source = "k_text" if "text" in keep else "wm_text"
    plain = docs.select(*[F.col(c).alias(f"k_{c}") for c in keep], *([] if "text" in keep else [F.col("text").alias("wm_text")]))
    of = lambda part: items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
    if parts == 1:
        return plain.mapInArrow(_matching(spark, items, window, source, names, False), T.StructType([*plain.schema.fields[: len(keep)], *_FOUND]))

    texts = docs.select(common.row_key(F.col("text")).alias("wm_key"), F.col("text").alias("wm_text"))
    schema = T.StructType([T.StructField("wm_key", T.BinaryType()), *_FOUND])
    with common.scratch() as keep_hits:
        earlier = [common.materialize(texts.mapInArrow(_matching(spark, of(p), window, "wm_text", ["wm_key"], True), schema), "wu-manber-part") for p in range(parts - 1)]
        hits = earlier[0]
        for more in earlier[1:]:
            hits = hits.unionByName(more)
        # Rows of one text have one find each; copies of a text count once.
        hits = hits.groupBy("wm_key").agg(F.flatten(F.collect_set("wm_ranges")).alias("wm_before"), F.array_distinct(F.flatten(F.collect_set("wm_items"))).alias("wm_found"))
        hits = keep_hits(common.materialize(hits, "wu-manber-hits"))
    plain = plain.withColumn("wm_key", common.row_key(F.col(source))).join(common.small(hits, hits.count()), "wm_key", "left").drop("wm_key")
    return plain.mapInArrow(_matching(spark, of(parts - 1), window, source, names, False), T.StructType([*plain.schema.fields[: len(keep)], *_FOUND]))


def hit_words() -> Column:
    """Number of words in the merged ranges."""
    return F.aggregate(F.sequence(F.lit(1), (F.size("wm_ranges") / 2).cast("int")), F.lit(0).cast("long"), lambda total, k: total + F.element_at("wm_ranges", (2 * k).cast("int")) - F.element_at("wm_ranges", (2 * k - 1).cast("int")))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` without an occurrence of a benchmark window, with all their columns."""
    found = _search(docs, benchmark, docs.columns)
    return found.where(F.size("wm_ranges") == 0).select(*[F.col(f"k_{c}").alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: hit words and benchmark items of every document."""
    found = search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), ["doc_id"])
    n_hit = F.when(F.size("wm_ranges") > 0, hit_words()).otherwise(F.lit(0).cast("long"))
    ids = F.sha2(F.array_join("wm_items", ",").cast("binary"), 256)
    out = found.select("doc_id", F.col("wm_words").alias("n_words"), n_hit.alias("n_hit"), F.size("wm_items").cast("long").alias("n_items"), ids.alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT item_id, least(len(w), 10) AS m, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i
  FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS s FROM bw),
dw AS (
  SELECT rid, m, w, unnest(generate_series(1, len(w) - m + 1)) AS i
  FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m),
h AS (
  SELECT rid, i, dw.m, item_id FROM dw JOIN p
  ON dw.m = p.m AND array_to_string(list_slice(w, i, i + dw.m - 1), ' ') = p.s),
hw AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + m - 1)) AS j FROM h) GROUP BY rid),
hi AS (
  SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items
  FROM h GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""
