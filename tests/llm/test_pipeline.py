import re

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from test_jaccard_join import brute as components
from test_wu_manber import brute as contamination
from tokenizers import Tokenizer

from pulseloom.llm import language_id

SF = "/root/testdata/sf0.001"


def expected(docs, benchmark, dictionaries):
    """The ids and token counts that are left, by going through the rows one stage after the other."""
    codecs = language_id.Compressors(dictionaries)
    told = [codecs.classify(t) for _, t in docs]
    docs = [d for d, (lang, _, margin) in zip(docs, told, strict=True) if lang != "und" and margin >= language_id.MARGIN]
    groups = {}
    for doc_id, text in docs:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", text or ""), []).append((-len(text or ""), doc_id))
    kept = {min(g)[1] for g in groups.values()}
    docs = [d for d in docs if d[0] in kept]
    kept = {i for i, _, c in components(docs, 5, 80, 100) if i == c}
    docs = [d for d in docs if d[0] in kept and not contamination(d[1], benchmark, 10)[1]]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in docs}


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dictionaries = language_id.dictionaries(docs.where(~language_id.held_out(docs.doc_id)))
    want = expected([(r.doc_id, r.text) for r in docs.collect()], benchmark, dictionaries)
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.doc_tokens for r in got} == want
    tokens = np.array([r.length for r in got]).sum()
    assert tokens == sum(want.values())


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES) - 1))
def test_stages_keep_the_columns_and_take_empty_tables(spark, k):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    name, stage = corpus_pipeline.STAGES[k]
    some = stage(spark, docs.limit(20), SF)
    assert some.columns == docs.columns and some.count() > 0
    assert stage(spark, docs.limit(0), SF).count() == 0


CLASHING = ["_id", "_row", "_key", "_digest", "_chars", "_norm_digest", "_copies", "digest", "row_key", "chars", "node", "component_id", "lid_lang", "lid_text", "wm_text", "wm_key", "wm_items", "k_text", "k_doc_id"]


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES) - 1))
def test_stages_take_nulls_ties_long_texts_and_any_names(spark, k):
    line = "the house and the garden of the king and the people of the town "
    learn = [(i, f"{line} {i} " * 3, "en", "s", None) for i in range(30)] + [(100 + i, f"das haus und der garten des königs und die leute der stadt {i} " * 3, "de", None, 5) for i in range(30)]
    odd = [(None, None, None, None, None), (None, "", "en", "s", 0), (200, "   ", None, "s", 0), (201, line, "en", "s", 1), (201, line, "en", "s", 1), (None, line, "en", "s", 2), (None, line, "en", "s", 2)]
    odd += [(300, line * 60_000, "en", "s", 3), (301, line * 60_000, "en", "s", 3)]  # 4 MB, twice
    rows = [(*r, *range(len(CLASHING))) for r in learn + odd]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in CLASHING)).repartition(3)
    name, stage = corpus_pipeline.STAGES[k]
    stay = stage(spark, docs, SF)
    assert stay.columns == docs.columns
    got = [(r.doc_id, r.text) for r in stay.collect()]
    assert set(got) <= {r[:2] for r in rows}
    kept = {i for i, _ in got}
    assert 300 in kept and (name in ("language", "decontaminate")) == (301 in kept)
    if name == "language":
        assert not any((t or "").strip() == "" for _, t in got) and sum(t == line for _, t in got) == 4
    elif name == "exact_copies":
        assert sum(t == line for _, t in got) == 1 and sum((t or "").strip() == "" for _, t in got) == 1
    elif name == "near_copies":
        assert sum((t or "").strip() == "" for _, t in got) == 3
    else:
        assert len(got) == len(rows)
