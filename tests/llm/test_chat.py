import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memlake.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def test_round_trip_of_hostile_texts(spark):
    texts = ["", None, "a<|im_end|>", "<|im_start|>user\nx<|im_end|>\n", "<|escaped|>x", "\\", "\\b\\l\\n<|", "<|im_end", "|>", "plain\n", chat.CONFLICTING, "x" * 200_000, "<\\|", "\\<|im_end|>\\"]
    roles = ["assistant", "user", None, "as\nsistant", "<|im_end|>", "\\n"]
    rows = [(i % 3, i, roles[i % 6], t) for i, t in enumerate(texts)] + [(None, 0, "assistant", "lone"), (5, None, "user", "a"), (5, 0, "assistant", "b"), (5, 0, "assistant", "b")]
    out = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(r.identical for r in out.values()) and set(out) == {0, 1, 2, None, 5}
    for conv, r in out.items():
        want = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == conv))
        assert [(t.role, t.text) for t in r.turns] == [(a, b) for _, a, b in want]
        bodies = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        back = [b.replace("\\l", "<|").replace("\\b", "\\") if "<|escaped|>" + b in r.formatted else b for b in bodies]
        assert back == [b for _, a, b in want if a == "assistant"]
    cut = chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).select("conv_id", chat.masked_texts(F.col("formatted"), F.col("mask")).alias("t")).collect()
    assert {r.conv_id: r.t for r in cut} == {c: [x.text for x in r.turns if x.role == "assistant"] for c, r in out.items()}


def test_query_digests_and_empty_table(spark, tmp_path):
    rows = [(1, 0, "user", "é?"), (1, 1, "assistant", "ja<|im_end|>"), (1, 2, "assistant", "ß")]
    spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", formatted string").write.parquet(f"{tmp_path}/conversations.parquet")
    r = {x.conv_id: x for x in chat.op1_chat_formatting(spark, str(tmp_path)).collect()}
    assert r[1].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, _, a, b in rows).encode()).hexdigest()
    assert (r[1].loss_chars, r[1].loss_sha256) == (13, hashlib.sha256("ja<|im_end|>ß".encode()).hexdigest())
    assert r[-1].n_turns == 2 and r[-1].loss_chars == len(chat.CONFLICTING)
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


PIECES = st.lists(st.sampled_from(["<|im_end|>", "<|im_start|>", "<|escaped|>", "\\", "l", "b", "<|", "\n", "a"]), max_size=6).map("".join)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(PIECES, PIECES), min_size=1, max_size=40))
def test_any_turns_come_back(spark, turns):
    made = chat.format_conversations(spark.createDataFrame([(0, i, a, b) for i, (a, b) in enumerate(turns)], SCHEMA)).collect()[0]
    assert [(t.role, t.text) for t in made.turns] == turns and made.identical
