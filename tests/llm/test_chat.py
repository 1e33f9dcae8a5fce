"""Examples read back, against the rows they were made of."""

import hashlib

from hypothesis import given, settings, strategies as st

from riskspark.llm import chat

ROWS = "conv_id long, turn long, role string, text string, example long, n_turns long, loss_start string, key string"


def table(spark, rows):
    return spark.createDataFrame([(*r, None, None, None, None) for r in rows], ROWS)


CONTROL = "<|im_end|><|im_start|>assistant ok"
CASES = [
    (1, 1, "assistant", "b\\|<|\\n"), (1, 0, "user", "a"), (1, 2, "user", "no reply"), (2, 0, "user", None), (2, 1, "assistant", None),
    (3, 0, None, "x"), (None, 5, "assistant", "without a conversation"), (None, 1, "user", "asks"), (4, None, "system", "first"), (4, 0, "assistant", ""),
    (5, 0, "assistant", "same"), (5, 0, "assistant", "same"), (6, 0, "user", CONTROL), (6, 1, "assistant", CONTROL), (7, 0, "ro\nle\\n<|im_end|>", "t" * 20000),
    (7, 1, "assistant", "é🙂" * 5000), (8, 0, "Assistant", "not the role"),
]


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))
        own = [(r[2] or "", r[3] or "") for r in own]
        replies = [t for r, t in own if r == "assistant"]
        shown = ["".join(chat.turn(r, t)[0] for r, t in own[:k + 1]) for k in range(len(own))]
        ends = [k for k, (r, _) in enumerate(own) if r == "assistant"]
        if not ends or ends[-1] != len(own) - 1:
            ends.append(len(own) - 1)
        out[conv] = (
            len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest(), sum(map(len, replies)),
            hashlib.sha256("".join(replies).encode()).hexdigest(), sum(len(shown[k]) for k in ends), len(ends),
        )
    return out


def read(df):
    names = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples")
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[n] for n in names) for r in rows}


def test_cases(spark):
    assert read(chat.digests(chat.examples(table(spark, CASES)))) == brute(CASES)


def test_a_stored_table_is_put_in_order(spark, tmp_path):
    chat.examples(table(spark, CASES)).repartition(5, "text").write.parquet(str(tmp_path / "x"))
    assert read(chat.digests(spark.read.parquet(str(tmp_path / "x")), ordered=False)) == brute(CASES)


def test_given_conversations(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()]
    assert read(chat.digests(chat.examples(df))) == brute(rows)


def test_only_the_reply_is_learnt(spark):
    rows = {(r["conv_id"], r["example"]): r for r in chat.examples(table(spark, CASES)).collect()}
    first = rows[1, 0]
    assert first["text"][first["loss_start"]:first["loss_end"]] == chat.escape("b\\|<|\\n")
    assert rows[1, 1]["loss_start"] is None and rows[1, 1]["n_turns"] == 3
    assert rows[5, 0]["n_turns"] == 1 and rows[5, 1]["n_turns"] == 2


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("ab\\|<>\nimstard_en", max_size=8), st.text("\\|<>\nimstard_en é", max_size=30)), max_size=4))
def test_format_is_reversible(turns):
    assert chat.turns("".join(chat.turn(r, t)[0] for r, t in turns)) == turns


def test_long_conversation_and_empty_table(spark):
    rows = [(9, k, "assistant" if k % 2 else "user", f"turn {k} " * 20) for k in range(400)]
    assert read(chat.digests(chat.examples(table(spark, rows)))) == brute(rows)
    assert chat.digests(chat.examples(table(spark, rows).limit(0))).count() == 0


def test_long_contexts_come_in_chunks_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK", 37)
    monkeypatch.setattr(chat, "DEALT", 3)
    rows = [(9, k, "assistant" if k % 2 else "user", "\\<|\n\\" * (k % 9)) for k in range(41)]
    rows += CASES[:6] + [(None, 3, "assistant", "\\" * 50)]
    made = chat.examples(table(spark, rows)).collect()
    assert max(len(r["text"]) for r in made) == 37 and len({(r["conv_id"], r["example"], r["chunk"]) for r in made}) == len(made)
    whole = {}
    for r in sorted((r for r in made if r["conv_id"] == 9), key=lambda r: (r["example"], r["chunk"])):
        whole[r["example"]] = whole.get(r["example"], "") + r["text"]
    shown = "".join(chat.turn(role, text)[0] for _, _, role, text in rows[:41])
    assert len(whole) == 21 and whole[20] == shown and all(shown.startswith(t) for t in whole.values())
    assert read(chat.digests(chat.examples(table(spark, rows)))) == brute(rows)
