import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from pulseloom.llm import wu_manber

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower)


def brute(text, items, window):
    w, hit, ids = split(text), set(), set()
    for item, t in items:
        p = split(t)
        m = min(window, len(p))
        for i in range(len(p) - m + 1 if m else 0):
            for j in range(len(w) - m + 1):
                if w[j : j + m] == p[i : i + m]:
                    hit.update(range(j, j + m))
                    ids.add(str(item) if item is not None else "")
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


words = st.lists(st.sampled_from(["a", "b", "A", "é", "9", "x-y", "\x00"]), max_size=40).map(" ".join)


@settings(max_examples=200, deadline=None)
@given(words, st.lists(words, max_size=4), st.integers(1, 5))
def test_matcher_against_brute_force(text, items, window):
    found = wu_manber.Benchmark([(str(i), t.encode()) for i, t in enumerate(items)], window)
    w = wu_manber.words(text.encode())
    assert [x.decode() for x in w] == split(text)
    ranges, ids = found.scan(w)
    got = len(w), sum(b - a for a, b in ranges), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
    assert got == brute(text, list(enumerate(items)), window)


def test_shift_table_skips_whole_windows():
    items = [f"w{i}".encode() for i in range(10)]
    matcher = wu_manber.Matcher(10, [(0, 0)], [items])
    assert matcher.far == 9 and matcher.shift[(b"w8", b"w9")] == 0 and matcher.shift[(b"w0", b"w1")] == 8


DOCS = [
    (0, "One two three four five six seven eight nine ten eleven.", 1),
    (1, None, 1),
    (2, "", 2),
    (3, "zz " * 30_000 + "one two three four five six seven eight nine ten " + "zz " * 30_000, 3),
    (4, "short item! Short ITEM", 4),
    (4, "short item! Short ITEM", 4),
    (5, "nothing here", 5),
]
ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (1, "one two three four five six seven eight nine ten eleven twelve"), (12, "x one two three four five six seven eight nine ten"), (2, "short item"), (3, None), (None, "nothing"), (4, "!!")]


def frames(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, wm_words long"), spark.createDataFrame(ITEMS, "item_id long, text string")


def collected(found):
    return sorted((r.doc_id, r.wm_words, sum(b - a for a, b in zip(r.wm_ranges[::2], r.wm_ranges[1::2], strict=True)), len(r.wm_items)) for r in found.collect())


def test_search_in_one_part_and_in_many(spark):
    docs, items = frames(spark)
    want = sorted((i, *brute(t, ITEMS, 10)[:3]) for i, t, _ in DOCS)
    assert collected(wu_manber.search(docs, items, ["doc_id"])) == want
    assert collected(wu_manber.search(docs, items, ["doc_id"], part_bytes=60)) == want
    assert [r[:3] for r in collected(wu_manber.search(docs, items.limit(0), ["doc_id"]))] == [(i, n, 0) for i, n, _, _ in want]
    assert wu_manber.search(docs.limit(0), items, ["doc_id"]).count() == 0


def test_clean_documents_keeps_rows_and_columns(spark):
    docs, items = frames(spark)
    stay = wu_manber.clean_documents(docs, items)
    assert stay.columns == docs.columns
    assert sorted(r.doc_id for r in stay.collect()) == [1, 2]


def test_query_against_brute_force(spark, tmp_path):
    docs, items = frames(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in wu_manber.query(spark, str(tmp_path)).collect())
    want = sorted((i, *brute(t, ITEMS, 10), brute(t, ITEMS, 10)[1] > 0) for i, t, _ in DOCS)
    assert got == want
