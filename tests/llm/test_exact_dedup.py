import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from pulseloom.llm import exact_dedup
from pulseloom.llm.fuse import BinaryFuse

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, batch int"


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, None, "s", 0, "clash", 9) for i, t in enumerate(texts)], SCHEMA)


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        norm = re.sub("[\x20\x09-\x0d]", "", text or "")
        groups.setdefault(norm, []).append((-len(text or ""), doc_id))
    return sorted((i, min(g)[1], len(g), (c, i) == min(g)) for g in groups.values() for c, i in g)


def test_filter_holds_all_keys_and_few_others():
    keys = np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64)
    made = BinaryFuse.from_bytes(BinaryFuse.build(keys).to_bytes())
    assert made.contains(keys).all()
    assert made.contains(keys + np.uint64(1)).mean() < 0.01
    assert len(made.table) < 1.4 * len(keys)
    for n in (0, 1, 2, 3, 17):
        few = BinaryFuse.build(keys[:n])
        assert few.contains(keys[:n]).all()


def test_groups_against_brute_force(spark):
    texts = [None, "", " \n", "a b", "ab", "a\tb ", "é", "é", "x" * 100_000, "x" * 50_000 + " " + "x" * 50_000, " ", "A B"] + ["hot text"] * 40 + ["hot  text"]
    docs = frame(spark, texts)
    got = exact_dedup.exact_duplicates(docs)
    rows = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect())
    assert rows == brute(list(enumerate(texts)))
    for r in got.join(docs, "doc_id").select(got["digest"], "text").collect():
        assert bytes(r.digest) == hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", r.text or "").encode()).digest()


def test_byte_checks_part_texts_of_one_digest(spark):
    texts = ["aa", "a a", "bb", "b b", "bb", "cc", None]
    got = exact_dedup.exact_duplicates(frame(spark, texts), digest=lambda c: F.lit("same").cast("binary"))
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()) == brute(list(enumerate(texts)))


def test_many_batches_and_empty_table(spark):
    texts = [f"t{i % 7}" for i in range(50)]
    got = exact_dedup.exact_duplicates(frame(spark, texts), batches=4)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()) == brute(list(enumerate(texts)))
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0


def test_deduplicate_keeps_one_row_of_a_group(spark):
    docs = frame(spark, ["a", "a ", None, "", "b"])
    stay = exact_dedup.deduplicate(docs.unionByName(docs))
    assert stay.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in stay.collect()) == [(1, "a "), (2, None), (4, "b")]


def test_deduplicate_keeps_a_variant_under_one_id_and_under_none(spark):
    rows = [(None, "a b"), (None, "ab"), (5, "c  d"), (5, "cd"), (5, "c d"), (6, "cd"), (7, "e f"), (7, " ef"), (8, "g")] + [(None, "hot " + " " * (k % 3) + "text") for k in range(30)]
    docs = spark.createDataFrame([(i, t, None, "s", 0, "clash", 9) for i, t in rows], SCHEMA)
    stay = sorted((r.text.replace(" ", ""), len(r.text), r.doc_id) for r in exact_dedup.deduplicate(docs).collect())
    assert stay == [("ab", 3, None), ("cd", 4, 5), ("ef", 3, 7), ("g", 1, 8), ("hottext", 10, None)]


def test_places_hold_all_ids(spark):
    ids = [None, 0, 1, -1, 2**63 - 1, -(2**63), 10**18]
    rows = spark.createDataFrame([(i, c) for i in ids for c in (0, 5, 2**31 - 1)], "doc_id long, chars int")
    place = exact_dedup._place(F.col("chars"), F.col("doc_id"))
    back = rows.select("doc_id", "chars", place.alias("p")).select("*", exact_dedup._place_id(F.col("p")).alias("i"), exact_dedup._place_chars(F.col("p")).alias("c"))
    got = back.orderBy("p").collect()
    assert all(r.i == r.doc_id and r.c == r.chars for r in got)
    assert [(r.chars, r.doc_id) for r in got] == sorted(((r.chars, r.doc_id) for r in got), key=lambda x: (-x[0], x[1] is not None, x[1] or 0))


def test_deduplicate_with_clashing_names(spark):
    names = ["doc_id", "text", "_id", "_digest", "_chars", "_norm_digest", "digest", "chars", "kept", "k_text", "n", "best"]
    rows = [(1, "a b", *range(10)), (2, "ab", *range(10)), (None, None, *range(10)), (None, None, *range(10)), (3, "x" * 2_000_000, *range(10)), (5, "t", *range(1, 11)), (5, "t", *range(10))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} long" for c in names[2:]))
    stay = exact_dedup.deduplicate(docs)
    assert stay.columns == docs.columns
    got = sorted((tuple(r) for r in stay.collect()), key=lambda r: r[0] or 0)
    assert got == [rows[2], rows[0], rows[4], rows[6]]  # of two rows alike, the one whose other columns sort first


def test_a_snapshot_screens_and_stays_as_it_is(spark):
    digests = lambda a, b: spark.range(a, b).select(F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("digest"), F.lit(1).cast("long").alias("n"), F.lit(0).cast("decimal(38,0)").alias("best"))
    made = exact_dedup.Snapshot.publish(digests(0, 5000))
    positive = made.screen(digests(2500, 7500).select("digest"))
    n = positive.count()
    assert 2500 <= n <= 2600
    assert made.known(digests(2500, 7500).select("digest")).count() == 2500
    assert made.groups.count() == 5000 and made.filters.count() == made.shards == 1
