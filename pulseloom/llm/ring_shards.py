"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring has a fixed number of positions. Virtual nodes sit at hashed positions and a key belongs to the first node
clockwise of its own position. Keys are placed in ring order; where a shard is full, the key continues clockwise to the
next node whose shard has room. Only counts per ring position decide this, so the driver lays out a table of at most
`POSITIONS` counts and each row finds its shard by its position and its rank there. Capacities sum to the number of rows
and differ by at most one, which makes the law `rows`: every shard ends exactly at its capacity.

Equal texts are not held together: each document is a key of its own.

Defined cases: a null text has size 1 and the CRC-32 of no bytes; a null doc_id hashes like any other key; repeated rows
are separate keys at one ring position; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHARDS = 8
#: Virtual nodes of a shard and positions on the ring; both bound what the driver and the broadcast hold.
NODES = 128
POSITIONS = 1 << 14


def ring(shards: int, nodes: int = NODES, positions: int = POSITIONS) -> list[int]:
    """For each ring position the shard that owns the first virtual node at or clockwise of it."""
    at: dict[int, tuple[int, int]] = {}
    for shard in range(shards):
        for v in range(nodes):
            h = int.from_bytes(hashlib.blake2b(f"shard-{shard}/{v}".encode(), digest_size=8).digest(), "big")
            at[h % positions] = min(at.get(h % positions, (2**64, 0)), (h, shard))
    owner, current = [0] * positions, min(at.items())[1][1]
    for p in range(positions - 1, -1, -1):
        current = at[p][1] if p in at else current
        owner[p] = current
    return owner


def lay_out(counts: dict[int, int], owner: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(position, first rank, end rank, shard, first slot): where the keys of each position go."""
    total, positions = sum(counts.values()), len(owner)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    # The next position clockwise at which another shard begins, so a full shard's arcs are stepped over.
    step, following = [0] * positions, positions
    for p in range(2 * positions - 1, -1, -1):
        if owner[p % positions] != owner[(p + 1) % positions]:
            following = p + 1
        step[p % positions] = following - p
    out = []
    for p in sorted(counts):
        left, first, q = counts[p], 0, p
        while left:
            shard = owner[q]
            take = min(left, room[shard] - used[shard])
            if take:
                out.append((p, first, first + take, shard, used[shard]))
                used[shard] += take
                first += take
                left -= take
            q = (q + step[q]) % positions
    return out


def assign(rows: DataFrame, key: str, shards: int, others: list[str]) -> DataFrame:
    """Add shard and slot to materialised `rows`; `others` tell apart rows of one key."""
    spark = rows.sparkSession
    rows = common.placed(rows).withColumn("_position", F.pmod(F.shiftrightunsigned(F.xxhash64(F.lit("ring"), key), 11), F.lit(POSITIONS)))
    counts = {r["_position"]: r["count"] for r in rows.groupBy("_position").count().collect()}
    plan = lay_out(counts, ring(shards), shards)
    # At most one row per position and one more per shard that fills up.
    schema = "p long, first long, end long, shard int, slot0 long"
    plan = F.broadcast(spark.createDataFrame(plan, schema))
    ranked = common.rank_in_groups(rows, "_position", [key, *others], "_rank", counts)
    on = (F.col("_position") == F.col("p")) & (F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("end"))
    placed = ranked.join(plan, on).withColumn("slot", F.col("slot0") + F.col("_rank") - F.col("first"))
    return placed.drop("_position", "_rank", "p", "first", "end", "slot0")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every document's shard of eight and its slot there, under the law `rows`."""
    docs = common.table(spark, sf_dir, "documents")
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    placed = assign(common.materialize(rows, "ring-rows"), "doc_id", SHARDS, ["size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
