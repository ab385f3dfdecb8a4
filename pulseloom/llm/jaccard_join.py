"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document is the set of its distinct word shingles. Shingles are ordered by how many documents hold them, rarest first;
two documents with Jaccard similarity t or more share at least k of the first |x| - ceil(t|x|) + k shingles of each. Every
document picks its own k: a longer prefix costs more postings but asks for k shared shingles before a pair is verified,
so documents whose prefixes hit frequent shingles lengthen them. A pair is a candidate when it shares min(k, k')
prefix shingles.

Document frequencies cover the whole corpus. Blocks of documents of bounded size send their distinct shingles, cut to as
many bits as the corpus needs, as compressed sorted arrays to tasks by range; the summed frequencies return to the blocks
(by salted sets of blocks where there are many). A collision of cut shingles only raises a frequency, which changes the
order for all documents alike. A prefix shingle that one document holds meets nobody and is not posted.

Documents with equal sets, by 128 bits, are one node, numbered when it is written. Nodes that share prefix shingles are not paired with each other at once: in each
posting list every node meets one hub first, best shared first, and verified links join them to components. Only lists
that still hold several components go on, with other hubs, until what is left is paired whole, between components.
No pair within a component is made, so a group of g near copies costs about g verifications. What is paired whole is cut
into bands of size, as similar sets differ little in it, and long lists into parts that go to tasks of their own. The first hub of a list is
its most typical document, the one with the smallest share of shingles of its own. Those bound a pair: two sets cannot
share what only one of them holds, so sizes and own shingles give a highest possible similarity, and what both share with
a common hub lowers it further; copies that were edited apart are thus not paired although they share most of their
original. Verification intersects the
whole shingle sets, so every link stands and none between different components is missed.

Defined cases: a null text, or one without words, has no shingles and is linked with nothing; with fewer words than a
shingle the whole sequence is one; repeated rows and equal texts are linked; a null doc_id takes part, and a component
of such rows alone has a null component_id; rows alike in doc_id and text are merged before all else and come back as often
as they were; a very long text is cut into shingles `SEGMENT` bytes at a time; an empty table gives an empty result; extra
columns are ignored here and carried along by `representatives`, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays, common
from .components import extended

#: Bytes of text in a block and for each task that sums frequencies; blocks whose arrays one task sums.
BLOCK_BYTES, TASK_BYTES, SALT_BLOCKS = 8_000_000, 16_000_000, 128
#: The longest multi-match, and what a verification costs against a posting, by shingles of the document.
MOST_MATCHES, VERIFY = 4, 0.1
#: Rounds of hubs before the rest is paired whole, and postings of one list and band that a task pairs with the others.
ROUNDS, PART = 2, 5_000
#: Bytes of a text whose shingles are made at a time.
SEGMENT = 4_000_000


def _splitmix(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


_BYTES = _splitmix(256)
_BASE = 0x5851F42D4C957F2D
_UNBASE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n - 1) modulo 2^64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, np.uint64)
        known[0] = 1
        with np.errstate(over="ignore"):
            known = np.cumprod(known)
        if len(known) <= 1 << 22:
            _powers[base] = known
    return known[:n]


_BLANK = re.compile(rb"[\x20\x09-\x0d]")


def shingles(text: bytes | None, width: int, segment: int = SEGMENT) -> np.ndarray:
    """The distinct word shingles of a text as 64-bit hashes, sorted."""
    text = text or b""
    if len(text) <= segment:
        return np.unique(_hashes(text.lower().split(), width))
    found, words, at = np.zeros(0, np.uint64), [], 0
    while at < len(text):
        blank = _BLANK.search(text, at + segment)
        end = blank.start() if blank else len(text)
        words += text[at:end].lower().split()
        at = end
        if len(words) >= width:
            found = np.unique(np.concatenate([found, _hashes(words, width)]))
            words = words[len(words) - width + 1 :]
    return found if len(found) else np.unique(_hashes(words, width))


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    """Of every shingle: polynomials of their bytes, mixed."""
    if not words:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(b" ".join(words), np.uint8)
    spaces = np.flatnonzero(data == 32)
    starts, ends = np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(data)]])
    width = min(width, len(words))
    first, last = starts[: len(starts) - width + 1], ends[width - 1 :]
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * _power(_BASE, len(data)))])
        h = (sums[last] - sums[first]) * _power(_UNBASE, len(data))[first]
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def identity(found: np.ndarray) -> bytes:
    """A digest of a whole set."""
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def prefix(found: np.ndarray, frequency: np.ndarray, num: int, den: int) -> tuple[int, np.ndarray]:
    """A document's number of matches and the prefix shingles that other documents hold too."""
    n = len(found)
    least = -(-num * n // den)  # shingles that any similar document shares
    order = np.argsort(frequency, kind="stable")  # equal frequencies by hash
    longest = min(n, n - least + min(MOST_MATCHES, least))
    others = np.cumsum(frequency[order[:longest]] - 1)
    best, cost = 1, np.inf
    for k in range(1, min(MOST_MATCHES, least) + 1):
        posted = int(others[n - least + k - 1])
        now = (n - least + k) + posted + VERIFY * n * posted / k
        if now < cost:
            best, cost = k, now
    kept = order[: n - least + best]
    return best, found[kept[frequency[kept] > 1]]


def _frequencies(blocks: DataFrame, width: int, tasks: int, bits: int, salts: int) -> DataFrame:
    """(block, task, vals): for each block's cut shingles, in order, how many documents hold them."""
    shift = np.uint64(64 - bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, None
        for batch in batches:
            for block, text in zip(batch.column("block").to_pylist(), batch.column("text"), strict=True):
                if block != current:
                    if held:
                        yield from made(current, held)
                    current, held = block, arrays.Distinct()
                held.add((shingles(text.as_py(), width) >> shift).view(np.int64))
        if held:
            yield from made(current, held)
        held = None
        common.trim()

    def made(block: int, distinct: arrays.Distinct) -> Iterator[pa.RecordBatch]:
        codes, n = distinct.finish()
        cuts = np.searchsorted(codes, _edges(tasks, bits))
        for task, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(codes)], strict=True)):
            if b > a:
                row = (block, task, arrays.put_sorted(codes[a:b]), arrays.squeeze(n[a:b]))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "task", "keys", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        codes, n = arrays.sum_sorted(rows)
        return pd.DataFrame({"task": [rows["task"].iloc[0]], "keys": [arrays.put_sorted(codes)], "counts": [arrays.squeeze(n)]})

    def look(rows: pd.DataFrame, total: pd.DataFrame) -> pd.DataFrame:
        codes, n = arrays.sum_sorted(total)
        n = np.minimum(n, 2**31 - 1).astype(np.int32)
        vals = [arrays.squeeze(n[np.searchsorted(codes, arrays.get_sorted(k))]) for k in rows["keys"]]
        return pd.DataFrame({"block": rows["block"], "task": rows["task"], "vals": vals})

    # Sorted, so that a task holds one block at a time even where several fall to it.
    parts = common.materialize(blocks.sortWithinPartitions("block").mapInArrow(count, "block long, task int, keys binary, counts binary"), "join-parts")
    common.release(blocks.sparkSession)
    parts = parts.withColumn("salt", (F.col("block") % salts).cast("int"))
    schema = "task int, keys binary, counts binary"
    totals = parts.groupBy("task", "salt").applyInPandas(add, schema)
    if salts > 1:
        totals = totals.groupBy("task").applyInPandas(add, schema)
    totals = common.materialize(totals, "join-totals").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return parts.drop("counts").groupBy("task", "salt").cogroup(totals.groupBy("task", "salt")).applyInPandas(look, "block long, task int, vals binary")


def _edges(tasks: int, bits: int) -> np.ndarray:
    """First code of each task but the first."""
    return np.array([(k << bits) // tasks for k in range(1, tasks)], np.int64)


def prefixes(rows: DataFrame, width: int, num: int, den: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, row_key, n, own, key, matches, prefix) of every row (doc_id, text, row_key); `own` counts the shingles that no
    other row holds."""
    common.arrow_batches(rows.sparkSession)
    rows = rows.select("doc_id", "text", "row_key")
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n_blocks, tasks = max(12, -(-size // block_bytes)), max(12, -(-size // TASK_BYTES))
    bits = min(62, max(24, (size // 6 * 64).bit_length()))
    salts = -(-n_blocks // SALT_BLOCKS)
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "row_key"), F.lit(n_blocks))).repartition(n_blocks, "block")
    back = common.materialize(_frequencies(blocks, width, tasks, bits, salts), "join-frequencies")
    common.release(rows.sparkSession)
    shift = np.uint64(64 - bits)

    def run(key, texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        sets = [shingles(t, width) for t in texts["text"]]
        distinct = arrays.Distinct()
        for s in sets:
            distinct.add((s >> shift).view(np.int64))
        codes = distinct.finish()[0]
        known = [arrays.spread(v, np.int32) for _, v in sorted(zip(found["task"], found["vals"], strict=True))]
        frequency = np.concatenate(known) if known else np.zeros(0, np.int32)
        out = []
        for s in sets:
            cut = (s >> shift).view(np.int64)
            matches, first = prefix(s, frequency[np.searchsorted(codes, cut)].astype(np.int64), num, den) if len(s) else (0, s)
            own = int(np.count_nonzero(frequency[np.searchsorted(codes, cut)] == 1)) if len(s) else 0
            out.append((len(s), own, identity(s), matches, first.view(np.int64)))
        made = pd.DataFrame(out, columns=["n", "own", "key", "matches", "prefix"])
        made.insert(0, "doc_id", texts["doc_id"].to_numpy())
        made.insert(1, "row_key", texts["row_key"].to_numpy())
        del sets, distinct, codes, known, frequency, out
        common.trim()
        return made.astype({"doc_id": "Int64"})

    return blocks.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(run, "doc_id long, row_key binary, n long, own long, key binary, matches int, prefix array<long>")


def _sets(rows: DataFrame, wanted: DataFrame, n_wanted: int, width: int) -> DataFrame:
    """(node, shingles) of the wanted (node, doc_id, row_key)."""
    ids = common.small(wanted.select("node", F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")), n_wanted)
    rows = rows.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_key") == F.col("_key"))).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), width).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])
        common.trim()

    return rows.mapInArrow(run, "node long, shingles array<long>")


def _fits(a: str, b: str, num: int, den: int) -> Column:
    """Whether two sets can be similar at all, by their sizes (n), their own shingles and what they share with a hub."""
    n_a, n_b, own_a, own_b = (F.col(f"{c}{k}") for c in ("n", "own") for k in (a, b))
    with_a, with_b = F.col(f"with_hub{a}"), F.col(f"with_hub{b}")
    most = F.least(n_a - own_a, n_b - own_b)
    # Inside the common hub and outside of it.
    split = F.least(with_a, with_b) + F.least(n_a - with_a - own_a, n_b - with_b - own_b)
    most = F.when(F.col(f"near{a}") == F.col(f"near{b}"), F.least(most, split)).otherwise(most)
    return most * den >= (n_a + n_b - most) * num


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, shared, linked) of candidate pairs (a, b), from their whole sets."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("shared"))
    return both.select("a", "b", "shared", (F.col("shared") * den >= (F.col("na") + F.col("nb") - F.col("shared")) * num).alias("linked"))


def _open_lists(posted: DataFrame, labels: DataFrame | None, turn: int) -> DataFrame:
    """The postings of lists that hold several components, with the list's hub."""
    placed = posted.withColumn("label", F.col("node")) if labels is None else posted.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    order = F.struct((F.col("own") / F.col("n") if turn == 0 else F.lit(0.0)).alias("own_share"), F.xxhash64(F.lit(turn), "node").alias("h"))
    lists = placed.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min_by(F.struct(F.col("node").alias("hub"), F.col("label").alias("hub_label")), order).alias("first"))
    return common.materialize(placed.join(lists.where("low <> high").select("shingle", "first.*"), "shingle"), "join-open")


def _hub_pairs(open_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each node with the hub that it shares most lists with, and those as pairs (a, b)."""
    best = open_.where("label <> hub_label").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("s"))
    best = common.materialize(best.groupBy("node").agg(F.max_by("hub", F.struct("s", "hub")).alias("hub")), "join-hubs")
    return best, best.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


_POSTED = ("node", "n", "own", "near", "with_hub", "matches", "label", "all")


def _all_pairs(posted: DataFrame, open_: DataFrame, num: int, den: int, part: int) -> DataFrame:
    """(a, b) of the candidates in the open lists, between components; lists of more than `part` postings in parts."""
    lists = posted.groupBy("node").agg(F.collect_list("shingle").alias("all"))
    rest = common.materialize(open_.join(lists, "node"), "join-rest")
    long = common.materialize(rest.groupBy("shingle").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > part).select("shingle"), "join-long")
    n_long = long.count()
    if not n_long:
        return _paired(rest, rest, ["shingle"], F.col("node1") < F.col("node2"), num, den)
    long = common.small(long, n_long)
    short = rest.join(long, "shingle", "left_anti")
    pairs = _paired(short, short, ["shingle"], F.col("node1") < F.col("node2"), num, den)
    return pairs.unionByName(_paired_in_parts(rest.join(long, "shingle", "left_semi"), num, den, part))


def _paired_in_parts(rest: DataFrame, num: int, den: int, part: int) -> DataFrame:
    """The same for long lists: the larger of two similar sets has at most den / num times the shingles of the smaller, so it
    lies in its band of size or the next; the smaller ones of a list and band are dealt into parts, each of which meets the
    larger ones in a task of its own."""
    band = F.floor(F.log(F.col("n").cast("double")) / (1.001 * math.log(den / num))).cast("int") if den > num else F.lit(0)
    rest = rest.withColumn("band", band)
    parts = rest.groupBy("shingle", "band").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
    smaller = rest.join(parts, ["shingle", "band"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    larger = rest.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") - 1))).join(parts, ["shingle", "band"])
    larger = larger.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    order = (F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("node1") < F.col("node2")))
    return _paired(smaller, larger, ["shingle", "band", "part"], order, num, den)


def _paired(one: DataFrame, two: DataFrame, keys: list[str], order: Column, num: int, den: int) -> DataFrame:
    """(a, b) of the postings that meet under `keys`: each pair comes out of its first shared list only, and with enough shared
    shingles."""
    one = one.select(*keys, *[F.col(c).alias(f"{c}1") for c in _POSTED])
    two = two.select(*[F.col(c).alias(f"{c}_") for c in keys], *[F.col(c).alias(f"{c}2") for c in _POSTED])
    both = F.array_intersect("all1", "all2")
    on = order & (F.col("label1") != F.col("label2")) & _fits("1", "2", num, den) & (F.array_min(both) == F.col("shingle")) & (F.size(both) >= F.least("matches1", "matches2"))
    for key in keys:
        on = (F.col(key) == F.col(f"{key}_")) & on
    return one.join(two, on).select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b"))


def components(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, component_id and row_key of every document."""
    spark = docs.sparkSession
    rows, copies = common.merge_copies(docs)
    with common.scratch() as keep:
        with common.scratch() as keep_prefixes:
            found = keep_prefixes(common.materialize(prefixes(rows, width, num, den), "join-prefixes"))
        keep(found)
        common.release(spark)
        first = F.min(F.struct("doc_id", "row_key")).alias("first")  # a row to read the set from, be its doc_id null
        classes = found.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), first, F.first("n").alias("n"), F.min("own").alias("own"), F.first("matches").alias("matches"), F.first("prefix").alias("prefix"))
        # Written with the rows, so the numbers stay; no two sets have one.
        classes = common.materialize(classes.withColumn("node", F.monotonically_increasing_id()), "join-classes")
        posted = classes.select("node", "n", "own", "matches", F.explode("prefix").alias("shingle"))
        shared = posted.groupBy("shingle").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("shingle")
        posted = common.materialize(posted.join(shared, "shingle", "left_semi"), "join-posted")
        wanted = common.materialize(classes.join(posted.select("node").distinct(), "node", "left_semi").select("node", "first.doc_id", "first.row_key"), "join-wanted")
        sets = common.materialize(_sets(rows, wanted, wanted.count(), width), "join-sets")
        common.release(spark)

        tested, labels = None, None
        for turn in range(ROUNDS + 1):
            with common.scratch() as keep_turn:
                open_ = _open_lists(posted, labels, turn)
                if not open_.limit(1).count():
                    break
                if turn < ROUNDS:
                    best, pairs = _hub_pairs(open_)
                else:
                    pairs = _all_pairs(posted, open_, num, den, PART)
                if tested is not None:
                    pairs = pairs.join(tested, ["a", "b"], "left_anti")
                new = keep_turn(common.materialize(_verified(pairs, sets, num, den), "join-verified"))
                tested = new.select("a", "b") if tested is None else tested.unionByName(new.select("a", "b"))
                if turn == 0:  # each node with the hub it met; one that met none is its own
                    met = best.join(new, (F.least("node", "hub") == F.col("a")) & (F.greatest("node", "hub") == F.col("b"))).select("node", F.col("hub").alias("near"), F.col("shared").alias("with_hub"))
                    posted = posted.join(met, "node", "left").withColumn("with_hub", F.coalesce("with_hub", "n")).withColumn("near", F.coalesce("near", "node"))
                    posted = keep_turn(common.materialize(posted, "join-posted"))
                links = new.where("linked").select("a", "b")
                if links.limit(1).count():
                    labels = keep_turn(common.materialize(extended(labels, links), "join-labels"))
                common.release(spark)

        of = classes.select("key", "node", "doc_id")
        of = of.withColumn("label", F.col("node")) if labels is None else of.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        of = common.materialize(of.select("key", "doc_id", "label"), "join-labels")
        least = of.groupBy("label").agg(F.min("doc_id").alias("component_id"))
        of = keep(common.materialize(of.join(least, "label").select("key", "component_id"), "join-components"))
    out = found.select("doc_id", "row_key", "n", "key").join(of, "key", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "row_key")
    return common.spread_copies(out, copies)


def representatives(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of `docs` with the smallest doc_id of their component, and those linked with nothing, with all columns.

    Rows with one doc_id but different texts are judged each on its own; a component without any doc_id stays whole.
    """
    out = common.materialize(components(docs, width, num, den).select("doc_id", "component_id", "row_key"), "join-found")
    drop = out.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "row_key").distinct()
    # `k_` stands before the names carried along, so that none can clash.
    keyed = docs.select(*[F.col(c).alias(f"k_{c}") for c in docs.columns])
    on = F.col("k_doc_id").eqNullSafe(F.col("doc_id")) & (common.row_key(F.col("k_text")) == F.col("row_key"))
    stay = keyed.join(common.small(drop, drop.count()), on, "left_anti")
    return stay.select(*[F.col(f"k_{c}").alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every document's component under four-word shingles and similarity 0.85."""
    return components(common.table(spark, sf_dir, "documents"), 4, 85, 100).drop("row_key")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT rid, array_to_string(list_slice(w, i, i + 3), ' ') AS g
  FROM (SELECT rid, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0)),
c AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (
  SELECT a.rid AS x, b.rid AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY a.rid, b.rid),
e AS (
  SELECT x, y FROM p JOIN c cx ON cx.rid = x JOIN c cy ON cy.rid = y WHERE 100 * o >= 85 * (cx.n + cy.n - o)),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles,
       least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id
FROM d LEFT JOIN c USING (rid)
LEFT JOIN (SELECT r.x, min(t.doc_id) AS low FROM r JOIN d t ON t.rid = r.y GROUP BY r.x) m ON m.x = d.rid
"""
