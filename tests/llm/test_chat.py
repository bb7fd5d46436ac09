import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import chat, queries

PARTS = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "\\", "/", "[", "<", " ", "\n", "é", "INST]", "s>", "x"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a\nb", "[ROLE]\\"]), PARTS), max_size=6))
def test_round_trip(turns):
    text = "".join(chat.format_turn(r, t)[0] for r, t in turns)
    assert chat.read_turns(text) == turns
    for _, t in turns:
        assert chat.unescape(chat.escape(t)) == t
        assert not any(c in chat.escape(t) for c in ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]"))


def reference(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append((r[1], r[2] or "", r[3] or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t))
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    odd = "</s>[INST] ok [/INST]"
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op7_chat_formatting(spark, sf_dir).collect()}
    assert got == reference([*rows, (-7, 0, "user", odd), (-7, 1, "assistant", odd)])


def test_odd_conversations(spark):
    rows = [
        (1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", ""), (1, None, None, "first"),
        (2, 5, "assistant", "only"), (3, 1, "user", "no reply"), (None, 1, "user", "a"), (None, 2, "assistant", "b" * 100000),
        (4, 2, "system", "[INST]"), (4, 1, "tool\n", "\\"),
    ]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, example string, loss_start int")
    examples = chat.expand(df)
    got = {r.conv_id: tuple(r[1:5]) for r in chat.read_back(examples).collect()}
    assert got == reference(rows)
    ones = [r for r in examples.collect() if r.conv_id == 1]
    assert [r.text[r.loss_start : r.loss_end] for r in ones] == ["", ""] and ones[1].text.startswith(ones[0].text)
    assert chat.read_back(chat.expand(df.limit(0))).count() == 0
