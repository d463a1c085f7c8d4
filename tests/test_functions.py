import math

import pytest
from pyspark.sql import functions as F

from memlake.functions import scoring, text
from memlake.operators import lifecycle


def values(spark, column, rows, schema="t string"):
    return [r[0] for r in spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).select(column).collect()]


def test_private_parts(spark):
    rows = ["a <private>x</private> b", "<PRIVATE>x\ny</private>", "no", "<private>a</private> and <private>b</private>"]
    assert values(spark, text.redact(F.col("t")), rows) == ["a [REDACTED] b", "[REDACTED]", "no", "[REDACTED] and [REDACTED]"]
    assert values(spark, text.fully_private(F.col("t")), rows) == [False, True, False, False]


def test_noise(spark):
    noisy = ["hello!", "Good  morning", "你好！", "HEARTBEAT", "I don't have any information", "do you remember me", "你知道我吗", "thanks.", "好的", "   ", "search returned 0 results"]
    kept = ["hello world", "thanks for the book", "I prefer tea", "好的咖啡"]
    assert values(spark, text.is_noise(F.col("t")), noisy + kept) == [True] * len(noisy) + [False] * len(kept)


def test_slots(spark):
    rows = ["I like latte from Starbucks", "我喜欢星巴克的拿铁", "I love Apple's MacBook, truly", "my favorite phone is from Acme.", "nothing here"]
    out = values(spark, text.preference_slot(F.col("t")), rows)
    assert [(s.brand, s.item) if s else None for s in out] == [("Starbucks", "latte"), ("星巴克", "拿铁"), ("Apple", "MacBook"), ("Acme", "phone"), None]


def test_two_jaccards(spark):
    a, b = F.col("a"), F.col("b")
    rows = [("a b c", "a b d"), ("", ""), ("Hi, there", "hi there"), ("Hi, there", "Hi there")]
    plain = values(spark, text.jaccard(text.word_set(a), text.word_set(b), 1.0), rows, "a string, b string")
    trimmed = values(spark, text.jaccard(text.trimmed_word_set(a), text.trimmed_word_set(b), 0.0), rows, "a string, b string")
    assert plain == [0.5, 1.0, pytest.approx(1 / 3), pytest.approx(1 / 3)] and trimmed == [0.5, 0.0, pytest.approx(1 / 3), 1.0]


def test_ttl_markers(spark):
    rows = ["Meeting TOMORROW at 3", "明天下午三点开会", "exam next week", "下周五有考试", "this month", "finish today", "I like Rust", "", "today, not next week"]
    assert values(spark, lifecycle.ttl_days(F.col("t")), rows) == [2, 2, 10, 10, 35, 2, None, None, 2]


def test_content_types_and_labels(spark):
    rows = ["short", "# head", "x\nuser: a\nAssistant: b\nAI: c", "w " * 600, "é" * 40_001]
    assert values(spark, text.content_type(F.col("t")), rows) == ["short_note", "structured_doc", "conversation", "structured_doc", "large_doc"]
    now = F.lit("2024-04-03").cast("timestamp")
    ages = ["2024-04-02 12:00:00", "2024-04-02", "2024-03-20", "2024-03-01", "2023-12-01", "2023-03-01", "2021-01-01"]
    assert values(spark, text.age_label(F.col("t").cast("timestamp"), now), ages) == ["today", "1 day ago", "14 days ago", "1 month ago", "4 months ago", "1 year ago", "3 years ago"]
    assert values(spark, text.space_id(F.col("t")), ["team:x:y", "org:1", "other:1"]) == ["team/x:y", "org/1", "other:1"]
    assert values(spark, text.language_of(F.col("t")), ["a.py", "b.MJS", "c.txt", "d"]) == ["python", "javascript", None, None]
    assert values(spark, text.has_keyword(F.col("t")), ["please Remember it", "记住这个", "no"]) == [True, True, False]
    assert values(spark, text.strip_fence(F.col("t")), ["```json\n{}\n```", "{}"]) == ["{}", "{}"]
    assert values(spark, text.similarity_label(F.col("t").cast("double")), ["0.876"]) == ["similarity:0.88"]


def test_decay_and_tiers(spark):
    row = [("core", 0.5, 0.5, 10, "2024-03-04", None), ("peripheral", 1.0, 1.0, 0, "2024-04-03", None), ("working", 0.9, 0.9, 12, "2024-04-03", None), ("working", 0.1, 0.1, 1, "2024-01-03", None)]
    df = spark.createDataFrame(row, "tier string, importance double, confidence double, access_count int, c string, l string").select("*", F.col("c").cast("timestamp").alias("created_at"), F.col("l").cast("timestamp").alias("last_accessed_at"))
    now = F.lit("2024-04-03").cast("timestamp")
    out = df.select(scoring.recency(now).alias("r"), scoring.composite(now).alias("c"), scoring.next_tier(scoring.composite(now), now).alias("t")).collect()
    rate = math.log(2) / (30 * math.exp(0.75))
    assert out[0].r == pytest.approx(math.exp(-rate * 30**0.8)) and out[0].c >= 0.9
    assert out[1].r == 1.0 and [r.t for r in out] == ["core", "peripheral", "core", "peripheral"]


def test_utility_and_decision(spark):
    rows = ["hi", "a short text here", "this text is long enough", "this has 3 numbers in it ok", "we met Alice in the morning"]
    assert values(spark, scoring.utility(F.col("t")), rows) == [0.2, 0.3, 0.7, 0.85, 0.8]
    out = values(spark, scoring.decision(F.col("s"), F.col("m")), [(0.4, 0.0), (0.7, 0.1), (0.7, 0.9), (0.5, 0.0)], "s double, m double")
    assert out == ["reject", "add", "update_or_merge", "update_or_merge"]
