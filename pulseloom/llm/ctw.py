"""Language-model scores by context-tree weighting over bytes.

A text is its words in lower case (A-Z), parted by single spaces, and an end byte. Each byte is eight binary decisions,
each with a context tree of its own over the `DEPTH` bytes before; nodes hold Krichevsky-Trofimov estimates and the
weighted mixture of all depths gives the chance of each decision, so every text has a code length in bits.

A Krichevsky-Trofimov estimate depends on counts only, so training is counting. Documents are dealt into blocks of bounded
size; each block counts its distinct (context, byte) grams and its words, sorts them and sends them on as compressed
arrays, dealt out by the last two context bytes. A task that gets all grams of some such endings sums them over the
blocks and weights their subtrees; the two shallow levels are a table of at most 2^16 rows that every task gets. The log
probabilities return to each block as arrays in its own order and the whole texts are scored there. Tasks read sorted rows
as a stream: one holds its summed grams or words and a batch of rows, however many blocks there are and whichever of
them lack its endings. No table of grams or words is sent to every executor, and what is gathered grows with the corpus.

The chances of grams travel back as 32-bit floats, half of what doubles take of the shuffle; each is rounded by less than
one in 10^7, and they are added up as doubles. Beside the score stands the code length in bits for each byte coded.

Defined cases: null counts as empty; an empty text is the end token alone; without training rows all counts are zero;
a null doc_id is never held out; repeated rows count and score each on its own, though they are merged before all else; a
very long text is coded `SEGMENT` bytes at a time; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Mapping
from functools import cached_property
from itertools import batched
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays, common

#: Bytes of context; a gram is the context and the byte that follows, in one 64-bit integer.
DEPTH = 6
#: Bytes of text in a block.
BLOCK_BYTES = 18_000_000
#: The end of a text, a byte that no word has; it is coded like any other.
END = 10
#: Bytes of text for each task that sums and weights grams.
TASK_BYTES = 16_000_000
#: Grams whose subtrees are weighted at a time, or those of one context ending.
SLICE = 200_000
#: Runs of counted grams that are held before they are merged, and rows of a batch that is handed on.
RUNS, ROWS = 6, 64

#: Bytes of a text that are coded at a time.
SEGMENT = 2_000_000

GRAMS, WORDS, TEXTS = 0, 1, 2

_BLANK = re.compile(rb"[\x20\x09-\x0d]")


def folded(text: bytes | None) -> list[bytes]:
    """Words of a text; bytes.lower() and bytes.split() know ASCII only."""
    return (text or b"").lower().split()


def coded(text: bytes | None, segment: int = SEGMENT) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """(words, grams) of a text, a segment at a time: together the words and the grams of its coded bytes."""
    text, at, before, begun = text or b"", 0, bytes(DEPTH), False
    while True:
        blank = _BLANK.search(text, at + segment) if len(text) - at > segment else None
        stop = blank.start() if blank else len(text)
        words, last = folded(text[at:stop]), stop >= len(text)
        data = (b" " if begun and words else b"") + b" ".join(words) + (bytes([END]) if last else b"")
        for a in range(0, len(data), segment + 1):
            here = before + data[a : a + segment + 1]
            yield words if not a else [], grams(here)
            before = here[-DEPTH:]
        if last:
            return
        begun, at = begun or bool(words), stop


def grams(data: bytes) -> np.ndarray:
    """For each byte after the first DEPTH the DEPTH bytes before it and itself."""
    data = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = len(data) - DEPTH
    out = data[DEPTH:].copy()
    for back in range(1, DEPTH + 1):
        out |= data[DEPTH - back : DEPTH - back + n] << np.uint64(8 * back)
    return out.view(np.int64)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of any sequence with a zeros and b ones."""
    return _half_gamma(a) + _half_gamma(b) - _log_factorial(a + b)


_TABLE = 1 << 16
_half = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_TABLE - 1) + 0.5))])
_fact = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 2 * _TABLE)))])


def _half_gamma(n: np.ndarray) -> np.ndarray:
    """log of 0.5 * 1.5 * ... * (n - 0.5)."""
    n = n.astype(float)
    x = np.maximum(n, 1) + 0.5
    far = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) - 0.5 * np.log(np.pi)
    return np.where(n < _TABLE, _half[np.minimum(n, _TABLE - 1).astype(np.int64)], far)


def _log_factorial(n: np.ndarray) -> np.ndarray:
    n = n.astype(float)
    x = np.maximum(n, 1)
    far = x * np.log(x) - x + 0.5 * np.log(2 * np.pi * x) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < 2 * _TABLE, _fact[np.minimum(n, 2 * _TABLE - 1).astype(np.int64)], far)


class Nodes(NamedTuple):
    """The nodes of a level for one bit; `of` has the node of each of the level's codes, `starts` the first code of each node."""

    starts: np.ndarray
    of: np.ndarray
    keys: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    weighted: np.ndarray
    stay: np.ndarray


class Level:
    """The nodes of one depth over a set of grams: for each bit, a context of that depth and the bits decided before it.

    `codes` are the distinct grams cut to this depth, sorted, so that the grams of a node stand together; `up` tells for
    each which of the next shallower level's it belongs to. Nodes take many times the memory of codes, so they are made for
    one bit at a time and only the shallowest level's are kept.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, below: Level | None):
        self.codes, self.counts, self.below, self.up = codes, counts, below, None

    def bit(self, bit: int) -> list[Nodes]:
        """The nodes of a bit, of the deepest level first and of this one last."""
        deeper = self.below.bit(bit) if self.below else []
        codes, counts = self.codes, self.counts
        # A node's key: the context bytes and the bits of the byte decided so far, under a leading 1.
        key = codes >> np.uint64(8 - bit)
        new = np.ones(len(codes), bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        starts, of = np.flatnonzero(new), np.cumsum(new) - 1
        one = codes >> np.uint64(7 - bit) & np.uint64(1)
        total = np.bincount(of, counts, len(starts))
        ones = np.bincount(of, counts * one, len(starts))
        heads = codes[starts]
        keys = heads >> np.uint64(8) << np.uint64(8) | (heads & np.uint64(255)) >> np.uint64(8 - bit) | np.uint64(1 << bit)
        estimate = log_kt(total - ones, ones)
        if not deeper:
            return [Nodes(starts, of, keys, total - ones, ones, estimate, np.ones(len(starts)))]
        under = np.bincount(of[self.below.up[deeper[-1].starts]], deeper[-1].weighted, len(starts))
        weighted = np.logaddexp(estimate, under) - np.log(2)
        return [*deeper, Nodes(starts, of, keys, total - ones, ones, weighted, np.exp(estimate - np.log(2) - weighted))]

    @cached_property
    def nodes(self) -> list[Nodes]:
        """This level's nodes of each bit."""
        return [self.bit(bit)[-1] for bit in range(8)]

    keys = property(lambda self: [n.keys for n in self.nodes])
    zeros = property(lambda self: [n.zeros for n in self.nodes])
    ones = property(lambda self: [n.ones for n in self.nodes])
    weighted = property(lambda self: [n.weighted for n in self.nodes])


def subtrees(codes: np.ndarray, counts: np.ndarray, down_to: int) -> list[Level]:
    """Levels DEPTH, DEPTH - 1, ... down_to of the context trees of distinct, sorted grams."""
    levels = [Level(codes, counts, None)]
    for depth in range(DEPTH - 1, down_to - 1, -1):
        last = levels[-1]
        cut, last.up = np.unique(last.codes & np.uint64((1 << 8 * (depth + 1)) - 1), return_inverse=True)
        levels.append(Level(cut, np.bincount(last.up, last.counts, len(cut)), last))
    return levels


def by_ending(codes: np.ndarray) -> Iterator[np.ndarray]:
    """The places, in order, of sorted grams whose subtrees down to depth 2 are weighted together: those of whole endings."""
    ending = codes >> 8 & 0xFFFF
    order = np.argsort(ending, kind="stable")
    cuts = np.flatnonzero(np.diff(ending[order])) + 1
    at = 0
    for stop, after in zip([*cuts, len(codes)], [*cuts[1:], len(codes), len(codes)], strict=False):
        # A slice ends where the next ending would make it too large.
        if stop > at and (after - at > SLICE or stop == len(codes)):
            yield np.sort(order[at:stop])
            at = stop


def log10_chances(levels: list[Level], top: Mapping[str, np.ndarray]) -> np.ndarray:
    """log10 of each gram's byte given its context; `levels` come deepest first, `top` has the two shallow levels."""
    codes = levels[0].codes
    out = np.zeros(len(codes))
    byte = codes & np.uint64(255)
    for bit in range(8):
        one = (byte >> np.uint64(7 - bit) & np.uint64(1)).astype(bool)
        p, at = np.zeros(len(codes)), np.arange(len(codes))
        for k, (level, nodes) in enumerate(zip(levels, levels[-1].bit(bit), strict=True)):
            a, b = nodes.zeros, nodes.ones
            node = nodes.of[at]
            stay = nodes.stay[node]
            p = stay * ((b + 0.5) / (a + b + 1))[node] + (1 - stay) * p
            if k < len(levels) - 1:
                at = level.up[at]
        prefix = (byte >> np.uint64(8 - bit) | np.uint64(1 << bit)).astype(np.int64)
        for depth in (1, 0):
            key = prefix + (codes >> np.uint64(8) & np.uint64(255)).astype(np.int64) * 256 * depth
            stay = top[f"stay{depth}"][key]
            p = stay * top[f"one{depth}"][key] + (1 - stay) * p
        out += np.log10(np.where(one, p, 1 - p))
    return out


def shallow(nodes: Mapping[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The levels 1 and 0, as tables, from counts and weighted sums of the nodes at depth 2 by their key at depth 1."""
    size = 1 << 16
    zeros, ones, under = (np.bincount(nodes["key"], nodes[c], size) for c in ("zeros", "ones", "weighted"))
    out = {}
    for depth in (1, 0):
        if not depth:
            zeros, ones, under = (x.reshape(256, 256).sum(0) for x in (zeros, ones, weighted))
        own = log_kt(zeros, ones) - np.log(2)
        weighted = np.logaddexp(own, under - np.log(2))
        out[f"stay{depth}"] = np.exp(own - weighted)
        out[f"one{depth}"] = (ones + 0.5) / (zeros + ones + 1)
        weighted = np.where(zeros + ones > 0, weighted, 0.0)
    return out


def training(doc_id: Column) -> Column:
    return F.coalesce(common.crc32_of_id(doc_id) % 5 != 1, F.lit(True))


def _put_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b" ".join(words))


def _get_words(data: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split()


def gram_tasks(codes: np.ndarray, tasks: int) -> np.ndarray:
    """The task of each gram, by the last two bytes of its context."""
    with np.errstate(over="ignore"):
        return (((codes >> 8 & 0xFFFF).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % tasks


def _count(blocks: DataFrame, tasks: int) -> DataFrame:
    """(block, kind, task, keys, counts): each block's distinct grams and words, sorted within their task, and how often
    its training texts hold them."""

    def rows(block: int, distinct: arrays.Distinct, known: Counter, others: set) -> Iterator[tuple]:
        codes, n = distinct.finish()
        for task, part in arrays.by_task(gram_tasks(codes, tasks)):
            yield block, GRAMS, task, arrays.put_sorted(codes[part]), arrays.squeeze(n[part].astype(np.int64))
        words = sorted(others.union(known))
        for task, part in arrays.by_task(np.fromiter((crc32(w) % tasks for w in words), np.int64, len(words))):
            mine = [words[i] for i in part]
            yield block, WORDS, task, _put_words(mine), arrays.squeeze(np.fromiter((known[w] for w in mine), np.int64, len(mine)))

    def made(*block) -> Iterator[pa.RecordBatch]:
        for some in batched(rows(*block), ROWS):
            yield _batch(_PARTS, some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("block", "train", "copies")]
            for block, train, copies, text in zip(*columns, batch.column("text"), strict=True):
                if block != current:
                    if held:
                        yield from made(current, *held)
                    current, held = block, (arrays.Distinct(RUNS), Counter(), set())
                for words, codes in coded(text.as_py()):
                    held[0].add(codes, train, copies)
                    if not train:
                        held[2].update(words)
                    elif copies == 1:
                        held[1].update(words)
                    else:
                        held[1].update({w: n * copies for w, n in Counter(words).items()})
        if held:
            yield from made(current, *held)
        held = None
        common.trim()

    # Sorted, so that a task holds one block at a time even where several fall to it.
    return blocks.sortWithinPartitions("block").mapInArrow(run, _sql(_PARTS))


_PARTS = {"block": "long", "kind": "int", "task": "int", "keys": "binary", "counts": "binary"}
_TOTALS = {"kind": "int", "task": "int", "keys": "binary", "counts": "binary", "total": "long", "known": "long"}
_NODES = {"key": "long", "zeros": "double", "ones": "double", "weighted": "double"}
_BACK = {"block": "long", "kind": "int", "keys": "binary", "vals": "binary"}
_SCORES = {"doc_id": "long", "row_key": "binary", "held_out": "boolean", "n_tokens": "long", "n_known": "long", "train_tokens": "long", "base_score": "double", "score": "double", "bits_per_byte": "double"}

_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}


def _sql(columns: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


def _batch(columns: dict[str, str], rows: list[tuple]) -> pa.RecordBatch:
    values = zip(*rows, strict=True) if rows else [()] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(v, _ARROW[k]) for v, k in zip(values, columns.values(), strict=True)], names=list(columns))


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names), strict=True)


def _add_words(total: dict[bytes, int], keys: bytes, counts: bytes) -> None:
    for w, n in zip(_get_words(keys), arrays.spread(counts, np.int64).tolist(), strict=True):
        total[w] = total.get(w, 0) + n


def _summed(parts: DataFrame) -> DataFrame:
    """(kind, task, keys, counts, total, known) over all blocks; `total` adds up the counts, `known` tells how many are not
    zero."""

    def row(kind: int, task: int, grams: arrays.Distinct, words: dict[bytes, int]) -> tuple:
        if kind == GRAMS:
            codes, n = grams.finish()
            keys = arrays.put_sorted(codes)
        else:
            total = sorted(words.items())
            keys, n = _put_words([w for w, _ in total]), np.array([n for _, n in total], np.int64)
        return kind, task, keys, arrays.squeeze(n), int(n.sum()), int((n > 0).sum())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, None
        for kind, task, keys, counts in _rows(batches, "kind", "task", "keys", "counts"):
            if (kind, task) != current:
                if held:
                    yield _batch(_TOTALS, [row(*current, *held)])
                current, held = (kind, task), (arrays.Distinct(4 * RUNS), {})
            if kind == GRAMS:
                held[0].merge(arrays.get_sorted(keys), arrays.spread(counts, np.int64))
            else:
                _add_words(held[1], keys, counts)
        if held:
            yield _batch(_TOTALS, [row(*current, *held)])
        held = None
        common.trim()

    return parts.repartition("kind", "task").sortWithinPartitions("kind", "task").mapInArrow(add, _sql(_TOTALS))


def shallow_levels(totals: DataFrame) -> dict[str, np.ndarray]:
    """The two shallow levels of all trees."""

    def depth_two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _rows(batches, "keys", "counts"):
            codes, n = arrays.get_sorted(keys), arrays.spread(counts, np.int64).astype(float)
            for part in by_ending(codes):
                level = subtrees(codes[part].view(np.uint64), n[part], 2)[-1]
                found = ([k & np.uint64(0xFFFF) for k in level.keys], level.zeros, level.ones, level.weighted)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(f), _ARROW[t]) for f, t in zip(found, _NODES.values(), strict=True)], names=list(_NODES))
        common.trim()

    nodes = totals.where(F.col("kind") == GRAMS).select("keys", "counts").mapInArrow(depth_two, _sql(_NODES))
    nodes = nodes.groupBy("key").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("weighted"))
    found = np.array([tuple(r) for r in nodes.collect()], float).reshape(-1, len(_NODES))  # at most 2^16 rows: one context byte and the bits decided
    return shallow({"key": found[:, 0].astype(np.int64), "zeros": found[:, 1], "ones": found[:, 2], "weighted": found[:, 3]})


def _returned(parts: DataFrame, totals: DataFrame, top: dict[str, np.ndarray]) -> DataFrame:
    """(block, kind, keys, vals): for each key of a part, in its order, the gram's log10 chance or the word's count."""
    sent = parts.sparkSession.sparkContext.broadcast(top)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, chances, words = None, None, {}
        for batch in batches:
            out = []
            for block, kind, keys, counts in _rows([batch], "block", "kind", "keys", "counts"):
                if block is None:  # the sums of a task come before the parts of the blocks
                    codes, chances, words = None, None, {}
                    if kind == GRAMS:
                        codes, n = arrays.get_sorted(keys), arrays.spread(counts, np.int64).astype(float)
                        chances = np.zeros(len(codes), np.float32)
                        for part in by_ending(codes):
                            chances[part] = log10_chances(subtrees(codes[part].view(np.uint64), n[part], 2), sent.value)
                    else:
                        _add_words(words, keys, counts)
                elif kind == GRAMS:
                    out.append((block, kind, keys, arrays.squeeze(chances[np.searchsorted(codes, arrays.get_sorted(keys))])))
                else:
                    out.append((block, kind, keys, arrays.squeeze(np.array([words[w] for w in _get_words(keys)], np.int64))))
            yield _batch(_BACK, out)
        codes = chances = words = None
        common.trim()

    columns = ["block", "kind", "task", "keys", "counts"]
    sums = totals.withColumn("block", F.lit(None).cast("long")).select(columns)
    each = sums.union(parts.withColumn("counts", F.lit(None).cast("binary")).select(columns))
    return each.repartition("kind", "task").sortWithinPartitions("kind", "task", F.col("block").asc_nulls_first()).mapInArrow(look, _sql(_BACK))


class Lookup:
    """Values of 64-bit keys in an open hash table, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, values.dtype)
        for a in range(0, len(keys), SLICE):
            self._put(keys[a : a + SLICE], values[a : a + SLICE])

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        left = np.arange(len(keys))
        at = self._slot(keys)
        while len(left):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]  # of several keys for a slot the last one stays
            done = self.keys[at] == keys[left]
            self.values[at[done]] = values[left[done]]
            left, at = left[~done], (at[~done] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out = self.values[at]
        miss = np.flatnonzero(self.keys[at] != keys)
        at = at[miss]
        while len(miss):
            at = (at + 1) & ((1 << self.bits) - 1)
            hit = self.keys[at] == keys[miss]
            out[miss[hit]] = self.values[at[hit]]
            miss, at = miss[~hit], at[~hit]
        return out


class Values:
    """What the grams and words of a block are worth: log10 chances and counts, and `log` of the counts."""

    def __init__(self, log: Callable[[np.ndarray], np.ndarray]):
        self._log = log
        self.chances: list[tuple[np.ndarray, np.ndarray]] = []
        self.place: dict[bytes, int] = {}
        self._counts: list[np.ndarray] = [np.zeros(0, np.int64)]

    def take(self, kind: int, keys: bytes, vals: bytes) -> None:
        if kind == GRAMS:
            self.chances.append((arrays.get_sorted(keys), arrays.spread(vals, np.float32)))
        else:
            words = _get_words(keys)
            self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
            self._counts.append(arrays.spread(vals, np.int64))

    # The following are made when a block's first text comes, after all its grams and words.

    @cached_property
    def known(self) -> np.ndarray:
        return np.concatenate(self._counts) > 0

    @cached_property
    def log(self) -> np.ndarray:
        return self._log(np.concatenate(self._counts))

    @cached_property
    def lookup(self) -> Lookup:
        found = Lookup(*(np.concatenate(c) for c in zip(*self.chances, strict=True)))
        self.chances.clear()
        return found


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every whole text."""
    spark = docs.sparkSession
    common.arrow_batches(spark)
    rows, repeated = common.merge_copies(docs)
    rows = rows.withColumn("train", training(F.col("doc_id")))
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n_blocks, tasks = max(12, -(-size // block_bytes)), max(24, -(-size // TASK_BYTES))
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "row_key"), F.lit(n_blocks)))

    with common.scratch() as keep:
        parts = common.materialize(_count(blocks.repartition(n_blocks, "block"), tasks), "ctw-parts")
        common.release(spark)
        totals = common.materialize(_summed(parts), "ctw-totals")
        n_train = rows.where("train").agg(F.sum("copies")).first()[0] or 0
        known = totals.where(F.col("kind") == WORDS).agg(F.sum("total"), F.sum("known")).first()
        total, distinct = (known[0] or 0) + n_train, (known[1] or 0) + (n_train > 0)
        common.release(spark)
        back = keep(common.materialize(_returned(parts, totals, shallow_levels(totals)), "ctw-values"))
    common.release(spark)

    def chance(c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))

    def scored(block: Values, text: bytes) -> tuple:
        n_words, n_known, base, whole, n_bytes = 0, 0, 0.0, 0.0, 0
        for words, codes in coded(text):
            at = np.fromiter(map(block.place.__getitem__, words), np.int64, len(words))
            n_words += len(words)
            n_known += int(np.count_nonzero(block.known[at]))
            base += float(block.log[at].sum())
            whole += float(block.lookup(codes).sum(dtype=float))
            n_bytes += len(codes)
        return n_words + 1, n_known + (n_train > 0), total, base + float(chance(n_train)), whole, -whole * _BITS / n_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, None
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("block", "kind", "doc_id", "row_key", "train")]
            for block, kind, doc_id, row_key, train, keys, vals in zip(*columns, batch.column("keys"), batch.column("vals"), strict=True):
                if block != current:
                    held = None
                    common.trim()
                    current, held = block, Values(chance)
                if kind == TEXTS:
                    out.append((doc_id, row_key, not train, *scored(held, keys.as_py())))
                else:
                    held.take(kind, keys.as_py(), vals.as_py())
            yield _batch(_SCORES, out)
        held = None
        common.trim()

    nothing = {name: F.lit(None).cast(kind).alias(name) for name, kind in {"doc_id": "long", "row_key": "binary", "train": "boolean", "vals": "binary"}.items()}
    values = back.select("block", "kind", nothing["doc_id"], nothing["row_key"], nothing["train"], "keys", "vals")
    texts = blocks.select("block", F.lit(TEXTS).alias("kind"), "doc_id", "row_key", "train", F.col("text").alias("keys"), nothing["vals"])
    found = values.union(texts).repartition(n_blocks, "block").sortWithinPartitions("block", "kind").mapInArrow(run, _sql(_SCORES))
    return common.spread_copies(found, repeated).drop("row_key")


_BITS = float(np.log2(10))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: log10 probabilities of every document under the model of the training documents."""
    return score(common.table(spark, sf_dir, "documents"))
