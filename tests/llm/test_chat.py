import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, block string"


def expected(rows):
    out = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        role, text = role or "", text or ""
        a = out.setdefault(conv, ["", 0, ""])
        a[0] += f"{role}\n{text}\n"
        a[1] += 1
        a[2] += text if role == "assistant" else ""
    return {k: (n, hashlib.sha256(t.encode()).hexdigest(), len(x), hashlib.sha256(x.encode()).hexdigest()) for k, (t, n, x) in out.items()}


ROWS = [(1, 0, "system", "be brief"), (1, 1, "user", "### assistant: </turn> \\h ####"), (1, 2, "assistant", "ok </turn"), (1, 3, "user", None),
        (1, 4, "assistant", "very " * 300), (1, 5, "user", "thanks"), (1, 6, "assistant", "#</turn>\n### user: x\\"),
        (2, 0, "user", ""), (2, None, None, "null turn"), (2, 0, "user", ""), (None, 0, "a:b\nc", "null conversation"), (3, 5, "assistant", "é" * 50)]
ROWS += [(9, i, "system" if not i else ("assistant" if i % 2 else "user"), f"turn {i} " + "w " * (i % 7)) for i in range(90)]


def test_read_back_is_exact_at_any_budget_and_block(spark):
    df = spark.createDataFrame([(*r, "extra") for r in ROWS], SCHEMA)
    want = expected(ROWS)
    for budget, history, block in ((1024, 256, 256), (40, 20, 8), (5, 0, 1)):
        windows = chat.format_windows(df, budget, history, block)
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(windows).collect()}
        assert got == want
        for w in windows.collect():
            assert w.n_tokens <= budget or w.over_budget and w.n_new == 1
            turns = chat.parse(w.text)
            assert len(turns) == w.n_context + w.n_new
            if w.conv_id == 9 and (w.block, w.window) != (0, 0):
                assert turns[0] == ("system", ROWS[12][3])  # the system turn stays
            masked = [w.text[a:b] for a, b in w.loss]
            assert [chat.unescape(m) for m in masked] == [t for r, t in turns[w.n_context:] if r == "assistant"]


def test_history_is_repeated_but_not_learned(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i} a b c d e") for i in range(12)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_windows(df, 40, 20, 256).orderBy("window").collect()
    assert len(got) > 2 and all(w.n_context for w in got[1:])
    seen = [t for w in got for _, t in chat.parse(w.text)[w.n_context:]]
    assert seen == [r[3] for r in rows]


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_windows(df)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="#\\<>/turnhlc:\n aé", max_size=30))
def test_escape_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text
    assert "###" not in chat.escape(text) and "</turn>" not in chat.escape(text)
    assert chat.parse(f"{chat.HEAD}{chat.escape_role(text)}: {chat.escape(text)}{chat.END}") == [(text, text)]
