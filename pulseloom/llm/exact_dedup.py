"""Exact duplicates: binary-fuse filters over immutable snapshots screen incoming digests.

Rows are dealt into ingest batches. Within a batch equal digests are grouped first, map-side, so a text that a third of
all rows share is one row from then on. What is new in a batch becomes an immutable snapshot: its distinct digests are cut
into shards of bounded size, each shard gets a static binary-fuse filter, and neither digests nor filters are touched
again. An incoming digest that the filters of all snapshots reject is new; a positive joins the exact bucket of its digest in
that snapshot. Filters are as large as a byte for each digest of the corpus, so they are never sent to every task: the
incoming digests, 40 bytes each, go to their shard. Rows of buckets with several rows are then compared byte by byte:
the smallest and the largest normalised text of a bucket must be the same string, which partial aggregation settles
without gathering the group. A bucket whose texts differ is cut up by the texts themselves.

Defined cases: a null text counts as empty; empty and all-blank texts are equal; a null doc_id is a document like any
other and sorts before all others; of repeated rows (same doc_id and text) all point to the same keep_id and all are
marked kept, as the row that stays is one of them (`deduplicate` returns just one); an empty table gives an empty
result; extra columns are ignored here and carried along by `deduplicate`, whatever their names. Where several rows of a
group are alike in doc_id and size, `deduplicate` keeps the one whose other columns sort first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .fuse import BinaryFuse

#: Distinct digests per filter shard; a shard is built and probed in one task.
SHARD_KEYS = 100_000
BATCHES = 2


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), common.SPACE + "+", "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _shards(digests: DataFrame, n: int) -> DataFrame:
    """(shard, key) of each distinct digest."""
    return digests.select("digest", F.xxhash64("digest").alias("key")).withColumn("shard", F.pmod(F.shiftright("key", 7), F.lit(n)))


def build_filters(digests: DataFrame, n_shards: int) -> DataFrame:
    """One static filter per shard of a snapshot's distinct digests."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        made = BinaryFuse.build(rows["key"].to_numpy().astype(np.int64).view(np.uint64))
        return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "filter": [made.to_bytes()]})

    return _shards(digests, n_shards).select("shard", "key").groupBy("shard").applyInPandas(build, "shard long, filter binary")


@dataclass(frozen=True)
class Snapshot:
    """What was new in one batch: written once, with its filters, and only read from then on."""

    groups: DataFrame
    filters: DataFrame
    shards: int

    @classmethod
    def publish(cls, groups: DataFrame) -> Snapshot:
        groups = common.materialize(groups, "dedup-snapshot")
        shards = max(1, -(-groups.count() // SHARD_KEYS))
        return cls(groups, common.materialize(build_filters(groups.select("digest"), shards), "dedup-filters"), shards)

    def screen(self, digests: DataFrame) -> DataFrame:
        """The digests that the filters do not reject: all that the snapshot holds, and about one in 256 of the others."""

        def probe(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
            if not len(rows) or not len(found):
                return rows[["digest"]].iloc[:0]
            keys = rows["key"].to_numpy().astype(np.int64).view(np.uint64)
            return rows.loc[BinaryFuse.from_bytes(found["filter"].iloc[0]).contains(keys), ["digest"]]

        return _shards(digests, self.shards).groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(probe, "digest binary")

    def known(self, digests: DataFrame) -> DataFrame:
        """The digests that the snapshot holds: positives meet its exact buckets, a false one finds none there."""
        return self.screen(digests).join(self.groups.select("digest"), "digest", "left_semi")


#: A row's place among its equals as one number, so that hash aggregation finds the first: code points from many to few,
#: then doc_id from small to large with null before all.
_UNIT = "CAST('100000000000000000000' AS DECIMAL(21,0))"
_LEAST = "CAST('9223372036854775809' AS DECIMAL(20,0))"


def _place(chars: Column, doc_id: Column) -> Column:
    number = F.coalesce(doc_id.cast("decimal(20,0)") + F.expr(_LEAST), F.lit(0).cast("decimal(21,0)"))
    return ((F.lit(2**31) - chars).cast("decimal(12,0)") * F.expr(_UNIT) + number).cast("decimal(38,0)")


def _place_chars(place: Column) -> Column:
    return F.lit(2**31) - F.floor(place / F.expr(_UNIT)).cast("long")


def _place_id(place: Column) -> Column:
    number = place % F.expr(_UNIT)
    return F.when(number > 0, (number - F.expr(_LEAST)).cast("long"))


def _groups(rows: DataFrame) -> DataFrame:
    """Per digest: how many rows, and the place of the first by most code points, then smallest doc_id."""
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(_place(F.col("chars"), F.col("doc_id"))).alias("best"))


def _merge(rows: DataFrame, batches: int) -> DataFrame:
    """Groups over all batches: each batch's distinct digests are screened by the filters of the snapshots before it."""
    snapshots, again, last = [Snapshot.publish(_groups(rows.where("batch = 0")))], [], []
    for b in range(1, batches):
        incoming = common.materialize(_groups(rows.where(F.col("batch") == b)), "dedup-groups")
        known = [s.known(incoming.select("digest")) for s in snapshots]
        known = common.materialize(_union(known), "dedup-known")  # a digest is in one snapshot only
        again.append(incoming.join(known, "digest", "left_semi"))
        fresh = incoming.join(known, "digest", "left_anti")
        if b < batches - 1:
            snapshots.append(Snapshot.publish(fresh))
        else:
            last.append(fresh)
    first = _union([s.groups for s in snapshots] + last)
    if not again:
        return first
    more = common.materialize(_union(again).groupBy("digest").agg(F.sum("n").alias("n"), F.min("best").alias("best")), "dedup-again")
    both = first.join(more.select("digest"), "digest", "left_semi").unionByName(more).groupBy("digest").agg(F.sum("n").alias("n"), F.min("best").alias("best"))
    return common.materialize(first.join(more.select("digest"), "digest", "left_anti").unionByName(both), "dedup-groups")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def exact_duplicates(docs: DataFrame, batches: int = BATCHES, digest=sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, the digest and the code points of each row of `docs` (doc_id, text)."""
    base = docs.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).alias("chars"), normalised(F.col("text")).alias("norm"))
    base = base.withColumn("digest", digest(F.col("norm")))
    rows = base.select("doc_id", "chars", "digest", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(batches)).alias("batch"))
    rows = common.materialize(rows, "dedup-rows")
    groups = _merge(rows, batches)

    # Byte checks of the buckets with several rows, on the whole normalised texts.
    shared = groups.where("n > 1").select("digest")
    n_shared = shared.count()
    texts = base.join(common.small(shared, n_shared), "digest", "left_semi")
    checked = texts.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    unequal = common.materialize(checked.where("low <> high").select("digest"), "dedup-unequal")
    n_unequal = unequal.count()

    def result(rows: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
        kept = groups.select(*on, F.col("n").alias("group_size"), _place_id(F.col("best")).alias("keep_id"), _place_chars(F.col("best")).alias("c"))
        kept = rows.join(kept, on)
        return kept.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("c"))).alias("kept"), "digest", "chars")

    if not n_unequal:
        return result(rows, groups, ["digest"])
    clash = base.join(common.small(unequal, n_unequal), "digest", "left_semi")
    by_text = clash.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n"), F.min(_place(F.col("chars"), F.col("doc_id"))).alias("best"))
    rest = result(rows.join(unequal, "digest", "left_anti"), groups, ["digest"])
    return rest.unionByName(result(clash, by_text, ["digest", "norm"]))


def deduplicate(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The rows of `docs` that stay, one of each group, with all their columns."""
    found = common.materialize(exact_duplicates(docs, batches).select("doc_id", "digest", "chars", "kept"), "dedup-found")
    # With the code points, as rows of one doc_id or of none may be variants of one text: only what is not kept goes.
    drop = found.where("not kept").select("doc_id", "digest", "chars").distinct()
    # `k_` stands before the names carried along, so that none can clash.
    keyed = docs.select(*[F.col(c).alias(f"k_{c}") for c in docs.columns]).withColumn("digest", sha256(normalised(F.col("k_text"))))
    keyed = keyed.withColumn("chars", F.char_length(F.coalesce("k_text", F.lit(""))))
    on = F.col("k_doc_id").eqNullSafe(F.col("doc_id")) & (keyed["digest"] == drop["digest"]) & (keyed["chars"] == drop["chars"])
    stay = keyed.join(common.small(drop, drop.count()), on, "left_anti")
    one = found.agg(F.sum(F.col("kept").cast("long")).alias("k"), F.count_distinct("digest").alias("d")).first()
    names = [f"k_{c}" for c in docs.columns]
    if one["k"] and one["k"] > one["d"]:  # the same row several times over, or variants of one length under one doc_id
        stay = stay.groupBy("digest").agg(F.min(F.struct(*names)).alias("row")).select("row.*")
    return stay.select(*[F.col(f"k_{c}").alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every document with its group of equal texts."""
    found = exact_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS kept,
       text_sha256
FROM t
"""
