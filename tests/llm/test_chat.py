import hashlib
import itertools

from hypothesis import given, settings
from hypothesis import strategies as st

from pulseloom.llm import chat, tokens

texts = st.text(st.sampled_from('ab\\<>/turn"# \n=é'), max_size=30)


@settings(max_examples=300, deadline=None)
@given(texts, texts)
def test_turns_come_back(role, text):
    made, start, end = chat.render(role, text)
    assert chat.read_back(made + made) == [(role, text, start, end), (role, text, len(made) + start, len(made) + end)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant"]), st.text("ab <", max_size=20)), min_size=1, max_size=25), st.integers(30, 150), st.integers(0, 90))
def test_windows_hold_every_turn_once(turns, budget, history):
    size = lambda t: len(chat.render(*t)[0])
    made = list(chat.windows(iter(turns), len, budget, history))
    new, trained = [], []
    has_system = turns[0][0] == "system"
    for k, w in enumerate(made):
        back = [(r, t) for r, t, _, _ in chat.read_back(w.text)]
        assert len(back) == w.turns
        shown, fresh = back[: w.repeated], back[w.repeated :]
        with_system = k and has_system and size(turns[0]) + size(fresh[0]) <= budget
        if with_system:
            assert shown[0] == turns[0]
        again = shown[1:] if with_system else shown
        first = len(new)
        assert again == turns[first - len(again) : first]
        assert not has_system or not k or len(again) < first
        assert sum(map(size, again)) <= history
        new += fresh
        assert len(w.text) <= budget or w.turns == 1
        trained += [chat.unescape(w.text[a:b]) for a, b in w.loss]
    assert new == turns
    assert trained == [t for r, t in turns if r == "assistant"]


def test_windows_keep_the_budget_of_the_rendered_text():
    encode = tokens.encoder(chat.VOCABULARY).encode
    count = lambda t: len(encode(t)) // 4
    system = ("system", "rule " * 1500)
    for turns in ([("user", "<" * 900), ("assistant", "< " * 900)] * 3, [system] + [("user", "word " * 600), ("assistant", "reply " * 600)] * 4, [("system", "be brief")] + [("user", "\\" * 700)] * 9):
        made = list(chat.windows(iter(turns), count))
        assert all(count(w.text) <= chat.BUDGET for w in made)
        assert sum(w.turns - w.repeated for w in made) == len(turns)
    assert all("be brief" in w.text for w in made)


def test_query_against_brute_force(spark, tmp_path):
    rows = [(1, 0, "system", "be <brief>"), (1, 1, "user", "hi"), (1, 2, "assistant", None), (2, 1, "assistant", "b"), (2, 0, None, "a"), (2, 1, "assistant", "a"), (2, 1, "assistant", "a"), (None, None, "user", "?")]
    rows += [(3, k, ("user", "assistant")[k % 2], f"turn {k} " * 400) for k in range(40)] + [(4, 0, "assistant", "long " * 30_000)]
    frame = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, window int")
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in chat.query(spark, str(tmp_path)).collect()}
    tricky = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)]
    rows = [(c, t, r or "user", x or "") for c, t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], r[3]))
    groups = {c: list(g) for c, g in itertools.groupby(rows, key=lambda r: r[0])}
    assert set(got) == set(groups)
    for c, turns in groups.items():
        said = "".join(x for _, _, r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        r = got[c]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(said))
        assert r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.formatted_chars >= len(whole)
    long = chat.format_conversations(frame.where("conv_id = 3")).orderBy("window").collect()
    assert len(long) > 5 and [w.window for w in long] == list(range(len(long)))


def test_empty_table(spark):
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
