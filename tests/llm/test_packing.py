import itertools
import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pulseloom.llm import packing, tokens

TOKENIZER = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))


def whole(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aB é'sst1.,!\n\t\x0b\x1c\x1f\x85\xa0 ​́İΣ<|>endoftext"), max_size=40) | st.text(max_size=20))
def test_ids_by_chunk_are_the_ids_of_the_whole_text(text):
    assert tokens.encoder(packing.VOCABULARY).encode(text) == np.array(whole(text)[:-1], "<u4").tobytes()


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 9), st.integers(1, 3), max_size=4), st.integers(0, 20))
def test_fill_against_all_subsets(left, room):
    used = packing.fill(left, room)
    best = max(s for uses in itertools.product(*[range(n + 1) for n in left.values()]) if (s := sum(x * k for x, k in zip(left, uses, strict=True))) <= room)
    assert all(k <= left[x] for x, k in used.items())
    assert sum(x * k for x, k in used.items()) == best


def test_patterns_use_every_piece_once_with_little_padding():
    rng = random.Random(3)
    counts = {}
    for _ in range(20_000):
        n = min(2048, int(rng.lognormvariate(5.5, 1)) + 1)
        counts[n] = counts.get(n, 0) + 1
    plan = packing.patterns(counts)
    used = {}
    for pattern, times in plan:
        assert sum(x * k for x, k in pattern.items()) <= 2048
        for x, k in pattern.items():
            used[x] = used.get(x, 0) + k * times
    assert used == counts
    assert sum(t for _, t in plan) * 2048 <= 1.001 * sum(x * k for x, k in counts.items()) + 2048
    assert len(plan) <= 12 * len(counts)  # a length limits a pattern at most log2(2048) + 1 times


def test_pieces_read_back(spark):
    texts = [None, "", " \n", "Hello there, <|endoftext|> friend's 12 é", "word " * 9000, "one\x1ftwo"] + ["the same text"] * 50
    docs = spark.createDataFrame([(i // 2 if i > 50 else i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, start string, length int")
    got = packing.pack(docs).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    want = {}
    for r in docs.collect():
        want.setdefault(r.doc_id, []).append(whole(r.text))
    assert set(want) == set(by_doc)
    for doc_id, rows in by_doc.items():
        if len(want[doc_id]) > 1:
            assert len(rows) == sum(-(-len(ids) // 2048) for ids in want[doc_id])
            continue
        ids, at = want[doc_id][0], 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
