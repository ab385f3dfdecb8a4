import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pulseloom.llm import license_scan as scan


def brute(rows):
    """(doc_id, template, containment) from the whole texts, by direct comparison."""
    out = {}
    for doc_id, text in rows:
        w = scan.template_words(text or "")
        here = {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}
        for name, template in scan.TEMPLATES.items():
            s = scan.template_shingles(template)
            share = sum(x in here for x in s) / len(s)
            if share >= 0.8:
                out[doc_id, name] = max(share, out.get((doc_id, name), 0))
    return out


def damaged(text, rng, n):
    w = text.split()
    for _ in range(n):
        w[rng.choice([0, len(w) - 1])] = "zzz"
    return " ".join(w)


def texts():
    rng, words = random.Random(9), [f"w{i}" for i in range(300)]
    out = [None, "", "a b", "released under the mit license", "Released under the MIT-License!", "é " * 50_000]
    for template in scan.TEMPLATES.values():
        for lead in range(0, 40, 7):
            out.append(" ".join(rng.choices(words, k=lead)) + " " + template + " " + " ".join(rng.choices(words, k=rng.randrange(40))))
        out.append(" ".join(rng.choices(words, k=200)) + "\n" + damaged(template, rng, 1) + "\n" + " ".join(rng.choices(words, k=200)))
        out.append((template + " ") * 3)
    out.append(" ".join(rng.choices(words, k=20_000)) + " " + scan.TEMPLATES["GPL-3.0/line"])
    return out


def test_against_brute_force(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows] + [(None, scan.TEMPLATES["MIT/line"], "x", 0)], "doc_id long, text string, words string, hashes int")
    got = {(r.doc_id, r.template): r.containment for r in scan.scan(docs).collect()}
    assert got.pop((None, "MIT/line")) == 1
    want = brute(rows)
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want), sorted(set(want) - set(got))
    assert all(got[k] == pytest.approx(want[k]) for k in got)


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {(r.doc_id, r.template): r.containment for r in scan.query(spark, "/root/testdata/sf0.01").collect()}
    assert got == pytest.approx(brute([(r.doc_id, r.text) for r in docs.collect()]))


def test_no_python_in_the_plan(spark):
    plan = scan.query(spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_empty_table(spark):
    assert scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 6000))
def test_parts_cover_a_template(n):
    made = scan.parts(n)
    assert {i for _, a, b in made for i in range(a, b)} == set(range(n))
    for k, a, b in made:
        most, window, step = scan.CLASSES[k]
        assert b - a <= most and (window == 1 or window % step == 0 and step % 2 == 0)


def test_long_texts_full_of_notices_and_without_any(spark):
    # 3 MB in the first; a chunk at a time, whatever it holds.
    full = "Released under the MIT License. " * 100_000
    mixed = " ".join(scan.TEMPLATES.values()) + " "
    rows = [(1, full), (2, "nothing to see in here at all " * 100_000), (3, mixed * 20), (4, "x " * 100_000 + scan.TEMPLATES["BSD-3-Clause/text"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.template): r.containment for r in scan.scan(docs).collect()}
    assert {t for i, t in got if i == 1} == {"MIT/line"}
    assert {t for i, t in got if i == 3} == set(scan.TEMPLATES)
    assert {t for i, t in got if i == 4} == {"BSD-3-Clause/notice", "BSD-3-Clause/text"}
    assert not any(i == 2 for i, _ in got)


def test_templates_longer_than_any_class(spark):
    rng = random.Random(4)
    long = " ".join(f"clause{rng.randrange(4000)}" for _ in range(3000))
    words = long.split()
    for k in rng.sample(range(3000), 60):  # one word in fifty changed: 0.9 of the shingles stay
        words[k] = "changed"
    rows = [(1, "before " * 3000 + long + " after" * 3000), (2, "y " * 5000 + " ".join(words)), (3, " ".join(words[:2000])), (4, "clause1 clause2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.containment for r in scan.scan(docs, {"long": long}).collect()}
    assert set(got) == {1, 2} and got[1] == 1 and 0.85 < got[2] < 1
    assert scan.scan(docs, {}).count() == 0


def test_repeated_rows_and_letters_beyond_ascii(spark):
    line = scan.TEMPLATES["MIT/line"]
    rows = [(1, line), (1, line), (1, "other"), (2, line.replace("L", "\u2112")), (3, "\u212a " + line), (4, line.replace("i", "\u0130"))]
    got = scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.template, r.containment) for r in got) == [(1, "MIT/line", 1.0), (3, "MIT/line", 1.0)]
