import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pulseloom.llm import common, components, jaccard_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long"


def sets(text, width):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    width = min(width, len(w))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(rows, width, num, den):
    """(doc_id, size, component) of each row, by all pairs."""
    found = [sets(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = found[i], found[j]
        if a and b and den * len(a & b) >= num * len(a | b):
            parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted(((doc_id, len(f), least.get(root(i))) for i, ((doc_id, _), f) in enumerate(zip(rows, found, strict=True))), key=str)


def corpus(seed, n=60):
    """Groups of near copies of every size of change, a chain, a common passage, exact copies and odd texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(words, k=60))
    out = [None, "", " \n\t", "a", "A", "a b", "a b c d", "a b c d e", "the same words " * 4, "x " * 5000, passage]
    for _ in range(n // 6):
        base = rng.choices(words, k=rng.randrange(4, 150))
        for _ in range(rng.randrange(1, 8)):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" ".join(w) + (" " + passage if rng.random() < 0.3 else ""))
    chain = rng.choices(words, k=100)
    for i in range(12):  # each links with the next ones only
        chain[rng.randrange(100)] = f"c{i}"
        out.append(" ".join(chain))
    out += rng.choices(out, k=n // 5)
    rng.shuffle(out)
    return list(enumerate(out))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é", "A"]), max_size=14).map(" ".join), st.integers(1, 5))
def test_shingles_are_the_distinct_sequences(text, width):
    got = jaccard_join.shingles(text.encode(), width)
    assert len(got) == len(sets(text, width)) and (np.diff(got.astype(object)) > 0).all()


def test_shingle_hashes_do_not_depend_on_place():
    a, b = jaccard_join.shingles(b"one two three four five", 3), jaccard_join.shingles(b"zero zero one two three", 3)
    assert len(np.intersect1d(a, b)) == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_all_pairs(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, None, "s", 0, 7) for i, t in rows], SCHEMA)
    for width, num, den in ((4, 85, 100), (5, 80, 100)):
        got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.components(docs, width, num, den).collect()]
        assert sorted(got, key=str) == brute(rows, width, num, den)


def test_small_blocks_and_rounds_of_hubs(spark, monkeypatch):
    rows = corpus(3, 90)
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 500)
    monkeypatch.setattr(jaccard_join, "SALT_BLOCKS", 16)
    monkeypatch.setattr(jaccard_join, "ROUNDS", 4)
    monkeypatch.setattr(jaccard_join, "PART", 2)
    docs = spark.createDataFrame([(i, t, None, "s", 0, 7) for i, t in rows], SCHEMA)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.components(docs, 4, 85, 100).collect()]
    assert sorted(got, key=str) == brute(rows, 4, 85, 100)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "A b c d e f"), (None, "z z z z y"), (2, None), (3, "")]
    docs = spark.createDataFrame([(i, t, None, "s", 0, 7) for i, t in rows], SCHEMA)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.components(docs, 4, 85, 100).collect()]
    assert sorted(got, key=str) == brute(rows, 4, 85, 100)
    assert jaccard_join.components(docs.limit(0), 4, 85, 100).count() == 0


def test_representatives_keep_one_row_of_a_component(spark):
    rows = corpus(4)
    docs = spark.createDataFrame([(i, t, None, "s", 0, 7) for i, t in rows], SCHEMA)
    stay = jaccard_join.representatives(docs)
    assert stay.columns == docs.columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted(i for i, _, c in brute(rows, 5, 80, 100) if i == c)


def test_representatives_tell_rows_apart(spark):
    rows = [(5, "a b c d e f g"), (7, "A b c d e f g"), (7, "quite another text of seven words"), (None, "a b c d e f G"), (None, "and one more without an id"), (None, None)]
    stay = jaccard_join.representatives(spark.createDataFrame([(i, t, None, "s", 0, 7) for i, t in rows], SCHEMA))
    assert sorted(((r.doc_id, r.text) for r in stay.collect()), key=str) == sorted([rows[0], rows[2], rows[4], rows[5]], key=str)


def test_connected_follows_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (400, 450)], "a long, b long")
    got = {r.node: r.label for r in components.connected(links).collect()}
    assert got == {i: 0 for i in range(201)} | {400: 400, 450: 400, 500: 400}


def test_labels_go_on_from_those_before(spark):
    frame = lambda links: spark.createDataFrame(links, "a long, b long")
    before = components.connected(frame([(1, 2), (5, 6), (8, 9)]))
    got = {r.node: r.label for r in components.extended(before, frame([(2, 6), (9, 20), (30, 31), (1, 2)])).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 6: 1, 8: 8, 9: 8, 20: 8, 30: 30, 31: 30}


def test_a_third_of_all_rows_alike(spark, monkeypatch):
    monkeypatch.setattr(common, "_SPREAD", 7)
    rows = [(None, "one hot row of seven words here")] * 200 + [(4, "one hot row of seven words here")] * 150 + corpus(5)
    docs = spark.createDataFrame([(i, t, None, "s", 0, 7) for i, t in rows], SCHEMA)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.components(docs, 4, 85, 100).collect()]
    assert sorted(got, key=str) == brute(rows, 4, 85, 100)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "cc", " ", "\n ", "  "]), max_size=60).map("".join), st.integers(1, 5), st.integers(1, 9))
def test_segments_make_the_same_shingles(text, width, segment):
    assert jaccard_join.shingles(text.encode(), width, segment).tolist() == jaccard_join.shingles(text.encode(), width).tolist()


def test_clashing_names_and_a_very_long_text(spark):
    names = ["_id", "_row", "_key", "_copies", "row_key", "node", "k_text", "component_id"]
    long = " ".join(f"w{i % 50_000}" for i in range(1_800_000))  # 10 MB
    rows = [(1, long, *range(8)), (2, long + " end", *range(8)), (3, "a b c d e f", *range(8)), (3, "a b c d e f", *range(8)), (None, None, *range(8))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} long" for c in names))
    stay = jaccard_join.representatives(docs)
    assert stay.columns == docs.columns
    assert sorted(((r.doc_id, len(r.text or "")) for r in stay.collect()), key=str) == sorted([(1, len(long)), (3, 11), (3, 11), (None, 0)], key=str)
