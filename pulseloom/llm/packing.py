"""Packing by minimum bin slack over the histogram of piece lengths.

Every document becomes token ids plus an end id and is cut into whole windows and one shorter tail. Only the number of
pieces of each length decides how they are packed: a window takes the longest length left, and a bitset subset-sum
dynamic program over the remaining multiset of lengths finds the sum closest to the room left; backtracking gives how
often each length is used. The pattern found is repeated as long as its lengths last, which leaves one of its lengths
with fewer pieces than a window takes and less than half of what it had; so a length limits a pattern at most a dozen
times and the number of patterns is bounded by the number of lengths, whatever the number of documents. A piece finds its
window by its rank among the pieces of its length.

Defined cases: a null or empty text is the end id alone; a document longer than a window has several pieces; repeated
rows are packed each on its own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
END_ID = 1


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, memory: int = tokens.MEMORY) -> DataFrame:
    """The token pieces of each document: start, length, checksum of the ids, tokens of the document."""
    common.arrow_batches(docs.sparkSession)
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary, memory).encode_all
        for batch in batches:
            out: list[list[int | None]] = [[], [], [], [], []]
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), encode(texts), strict=True):
                ids = memoryview(data + end)
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    for column, value in zip(out, (doc_id, start, len(part) // 4, zlib.crc32(part), total), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        common.trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def fill(left: dict[int, int], room: int) -> dict[int, int]:
    """How often to use each length so that the sum comes as close to `room` as it can without passing it."""
    mask, reach, layers = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in left if x <= room), reverse=True):
        copies, step = min(left[length], room // length), 1
        while copies and not reach >> room & 1:  # copies in powers of two, so few layers hold any number of them
            take = min(step, copies)
            layers.append((length, take, reach))
            reach |= reach << (take * length) & mask
            copies -= take
            step *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(layers):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= take * length
    return used


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(uses of each length in a window, number of such windows), until the lengths are used up."""
    left, out = dict(counts), []
    while left:
        longest = max(left)
        rest = {x: n - (x == longest) for x, n in left.items() if n > (x == longest)}
        used = fill(rest, capacity - longest)
        used[longest] = used.get(longest, 0) + 1
        times = min(left[x] // n for x, n in used.items())
        out.append((used, times))
        for x, n in used.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return out


def segments(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, uses, first sequence, offset of the first use)."""
    out, sequence, rank = [], 0, {}
    for used, times in plan:
        offset = 0
        for length in sorted(used, reverse=True):
            first = rank.get(length, 0)
            rank[length] = first + used[length] * times
            out.append((length, first, rank[length], used[length], sequence, offset))
            offset += used[length] * length
        sequence += times
    return out


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, memory: int = tokens.MEMORY) -> DataFrame:
    """Every piece of every document with its sequence and its offset there; workers remember `memory` vocabulary pieces."""
    spark = docs.sparkSession
    cut = common.materialize(pieces(docs, vocabulary, capacity, memory), "packing-pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = segments(patterns(counts, capacity))
    table = F.broadcast(spark.createDataFrame(plan, "_length long, _first long, _end long, _uses long, _sequence long, _offset long"))
    ranked = common.rank_in_groups(common.placed(cut), "length", ["doc_id", "start", "ids_crc32"], "_rank", counts)
    placed = ranked.join(table, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end")))
    at = F.col("_rank") - F.col("_first")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("_sequence") + F.floor(at / F.col("_uses"))).alias("sequence_id"),
        (F.col("_offset") + F.pmod(at, F.col("_uses")) * F.col("length")).alias("offset"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: all documents packed into sequences of at most 2048 tokens."""
    return pack(common.table(spark, sf_dir, "documents"))
