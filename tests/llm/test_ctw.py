import math
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulseloom.llm import ctw


class Tree:
    """One context tree, node by node: sequential Krichevsky-Trofimov estimates and weighting, as in the definition."""

    def __init__(self):
        self.nodes = {}

    def chance(self, context, bit, depth, learn):
        """Mixed chance of `bit`, by the ratio of weighted probabilities after and before it."""
        def weighted(d):
            a, b, kt, w = self.nodes.get(context[:d], (0, 0, 0.0, 0.0))
            own = (b if bit else a) + 0.5
            kt2 = kt + math.log(own / (a + b + 1))
            if d == depth:
                new, ratio = kt2, own / (a + b + 1)
            else:
                below_ratio = weighted(d + 1)
                under = sum(self.nodes[c][3] for c in self.nodes if len(c) == d + 1 and c[:d] == context[:d])
                stay = 0.5 * math.exp(kt - w)
                ratio = stay * own / (a + b + 1) + (1 - stay) * below_ratio
                new = w + math.log(ratio)
                del under
            if learn:
                self.nodes[context[:d]] = (a + (not bit), b + bit, kt2, new)
            return ratio
        return weighted(0)


def brute(train, texts, depth):
    trees = {}

    def code(text, learn):
        data = b" ".join((text or "").encode().lower().split()) + b"\n"
        past, total = bytes(depth), 0.0
        for byte in data:
            context = tuple(reversed(past[-depth:]))
            for k in range(8):
                bit = byte >> (7 - k) & 1
                tree = trees.setdefault((k, byte >> (8 - k)), Tree())
                total += math.log10(tree.chance(context, bit, depth, learn))
            past += bytes([byte])
        return total

    for t in train:
        code(t, True)
    return [code(t, False) for t in texts]


TEXTS = ["Hello  world", "hello there\tworld", "", None, "été été", "abc abc abd", "x", "the cat sat", "the CAT sat down", "zzz new 123"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, score double, train string")


def test_scores_against_the_definition(spark):
    rows = [(i, TEXTS[i % len(TEXTS)], 0.0, "x") for i in range(25)]
    docs = frame(spark, rows)
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i, *_ in rows]
    assert any(held) and not all(held)
    want = brute([r[1] for r, h in zip(rows, held, strict=True) if not h], [r[1] for r in rows], ctw.DEPTH)
    counts = {}
    for r, h in zip(rows, held, strict=True):
        for w in [] if h else [*(r[1] or "").encode().lower().split(), None]:
            counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values())
    got = {r.doc_id: r for r in ctw.score(docs, block_bytes=40).collect()}
    assert len(got) == len(rows)
    for (i, text, *_), h, w in zip(rows, held, want, strict=True):
        words = [*(text or "").encode().lower().split(), None]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, len(words), sum(x in counts for x in words), total)
        base = sum(math.log10((counts.get(x, 0) + 0.5) / (total + 0.5 * (len(counts) + 1))) for x in words)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(w, rel=1e-6)  # chances return to the blocks as 32-bit floats
        assert r.bits_per_byte == pytest.approx(-w * math.log2(10) / (len(b" ".join(words[:-1])) + 1), rel=1e-6)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "bcd", "E", " ", "\n", "  \t"]), max_size=60).map("".join), st.integers(1, 9))
def test_segments_code_the_same_bytes(text, segment):
    parts, whole = list(ctw.coded(text.encode(), segment)), list(ctw.coded(text.encode()))
    assert [w for words, _ in parts for w in words] == [w for words, _ in whole for w in words] == text.lower().encode().split()
    assert np.concatenate([g for _, g in parts]).tolist() == np.concatenate([g for _, g in whole]).tolist()


def test_rows_alike_count_each(spark):
    rows = [(None, "hot row text")] * 90 + [(3, "hot row text")] * 60 + [(i, TEXTS[i % len(TEXTS)]) for i in range(4, 24)] + [(1, None), (1, "")]
    docs = spark.createDataFrame([(i, t, 0.0, "x") for i, t in rows], "doc_id long, text string, score double, train string")
    got = ctw.score(docs, block_bytes=200).collect()
    assert len(got) == len(rows)
    train = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    assert {r.train_tokens for r in got} == {sum(len((t or "").split()) + 1 for t in train)}
    hot = {r.score for r in got if r.n_tokens == 4 and r.doc_id in (None, 3)}
    assert len(hot) == 1 and hot.pop() == pytest.approx(brute(train, ["hot row text"], ctw.DEPTH)[0], rel=1e-6)


def test_chances_of_a_context_sum_to_one():
    codes = np.unique(np.concatenate([g for t in ("abc abd abe", "the cat") for _, g in ctw.coded(t.encode())]))
    context = int(codes[5]) >> 8
    rows = np.unique(np.concatenate([codes, (context << 8) + np.arange(256)]))
    levels = ctw.subtrees(rows.view(np.uint64), np.isin(rows, codes).astype(float), 2)
    level = levels[-1]
    nodes = pd.DataFrame({"key": np.concatenate([k & np.uint64(0xFFFF) for k in level.keys]).astype(np.int64), "zeros": np.concatenate(level.zeros), "ones": np.concatenate(level.ones), "weighted": np.concatenate(level.weighted)})
    chances = 10 ** ctw.log10_chances(levels, ctw.shallow(nodes))
    assert chances[rows >> 8 == context].sum() == pytest.approx(1)


def test_lookup_and_estimates():
    keys = np.unique(np.random.default_rng(2).integers(0, 2**56, 5000))
    values = np.random.default_rng(3).random(len(keys))
    assert (ctw.Lookup(keys, values)(keys[::-1].copy()) == values[::-1]).all()
    n = np.array([0, 1, 5, 70_000, 200_000, 10**7])
    want = [math.lgamma(a + 0.5) - math.lgamma(0.5) + math.lgamma(3.5) - math.lgamma(0.5) - math.lgamma(a + 4) for a in n]
    assert np.allclose(ctw.log_kt(n, np.full(len(n), 3)), want, rtol=1e-9)


def test_edges(spark):
    docs = frame(spark, [(None, "a b", 0.0, ""), (1, "a b", 0.0, ""), (1, "a b", 0.0, ""), (2, "word " * 30_000, 0.0, "")])
    rows = ctw.score(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in rows) == [(False, 1, 3), (False, 1, 3), (False, 2, 30_001), (True, 0, 3)]
    assert ctw.score(docs.limit(0)).count() == 0
    alone = ctw.score(frame(spark, [(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1), "a", 0.0, "")])).first()
    assert alone.train_tokens == 0 and alone.n_known == 0 and alone.score == pytest.approx(2 * 8 * math.log10(0.5))


def test_held_out_scores_beat_the_base(spark):
    got = ctw.query(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    print(got)
    assert got.s > got.b


def test_rare_endings_in_a_few_of_many_blocks(spark):
    # More than 64 blocks, most of which lack the endings, and so the tasks, of the rare text.
    rows = [(i, "aaaa aaa", 0.0, "x") for i in range(100)] + [(100, "quick brown jumps éü 0123456789 ZYXWV", 0.0, "x"), (101, None, 0.0, "x")]
    got = ctw.score(frame(spark, rows), block_bytes=30).collect()
    assert sorted(r.doc_id for r in got) == [i for i, *_ in rows]
    train = [t for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    want = dict(zip(("aaaa aaa", rows[100][1], None), brute(train, ["aaaa aaa", rows[100][1], None], ctw.DEPTH), strict=True))
    assert all(r.score == pytest.approx(want[rows[r.doc_id][1]], rel=1e-6) for r in got)
    assert {r.train_tokens for r in got} == {sum(len((t or "").split()) + 1 for t in train)}


def test_slices_of_whole_endings_change_nothing(monkeypatch):
    codes = np.unique(np.concatenate([g for t in TEXTS for _, g in ctw.coded((t or "").encode())]))
    counts = np.arange(len(codes)) % 4.0
    top = {f"{what}{depth}": np.full(1 << 16, 0.5) for what in ("stay", "one") for depth in (0, 1)}
    whole = ctw.log10_chances(ctw.subtrees(codes.view(np.uint64), counts, 2), top)
    for size in (1, 7, len(codes)):
        monkeypatch.setattr(ctw, "SLICE", size)
        parts = list(ctw.by_ending(codes))
        assert sorted(np.concatenate(parts).tolist()) == list(range(len(codes)))
        ends = [set((codes[p] >> 8 & 0xFFFF).tolist()) for p in parts]
        assert sum(map(len, ends)) == len(set().union(*ends)) and all(len(p) <= size or len(e) == 1 for p, e in zip(parts, ends, strict=True))
        got = np.zeros(len(codes))
        for p in parts:
            got[p] = ctw.log10_chances(ctw.subtrees(codes[p].view(np.uint64), counts[p], 2), top)
        assert got == pytest.approx(whole, rel=1e-12)
