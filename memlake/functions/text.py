"""Text functions as Column expressions: redaction, noise, slots, similarity, content types, labels."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIVATE = r"(?si)<private>.*?</private>"

#: Patterns of messages that carry nothing to remember.
NOISE = (
    r"(?i)^(hello|hi|hey|greetings|good\s+(morning|afternoon|evening))[\s!.,?]*$",
    r"(?i)^(你好|嗨|早上好|下午好|晚上好|新的一天开始了)[\s!.,?！。？]*$",
    r"(?i)^HEARTBEAT[\s]*$",
    r"(?i)(I\s+don'?t\s+have\s+any\s+information|no\s+relevant\s+memories?\s+found|I\s+couldn'?t\s+find\s+any)",
    r"(?i)(I\s+don'?t\s+have\s+(?:specific\s+)?(?:details?|data|records?)\s+(?:about|on|for))",
    r"(?i)^(do\s+you\s+remember|what\s+do\s+you\s+know\s+about|can\s+you\s+recall)",
    r"(?i)(你还记得|你知道.*吗|你记得.*吗)",
    r"(?i)^(我没有相关的记忆|我没有.*的信息|没有找到相关)[\s]*",
    r"(?i)(query\s*->\s*none|no\s+explicit\s+solution|search\s+returned\s+0\s+results)",
    r"(?i)^(thanks|thank\s+you|ok|okay|sure|got\s+it|understood)[\s!.,?]*$",
    r"(?i)^(谢谢|好的|明白了|收到|了解)[\s!.,?！。？]*$",
)
#: Envelope metadata of chat channels.
ENVELOPES = (
    r"(?m)^(?:\w+:\s*)?System:\s*\[.*?\]\s*Channel.*$",
    r"(?ms)Conversation info \(untrusted metadata\):\s*\{.*?\}",
    r"(?ms)Sender \(untrusted metadata\):\s*\{.*?\}",
)
#: Patterns of stated preferences, and the groups that hold brand and item.
SLOTS = (
    (r"(?:喜欢|爱吃|偏爱|爱喝|爱用|常喝|常吃|常用|最爱)\s*(.+?)\s*的\s*(.+?)(?:\s*$|[，。,.])", 1, 2),
    (r"(?i)(?:prefer|like|love|enjoy|drink|eat|use)s?\s+(.+?)\s+from\s+(.+?)(?:\s*$|[,.])", 2, 1),
    (r"(?i)(?:prefer|like|love|enjoy|drink|eat|use)s?\s+(.+?)'s\s+(.+?)(?:\s*$|[,.])", 1, 2),
    (r"(?i)favorite\s+(.+?)\s+(?:is\s+from|is)\s+(.+?)(?:\s*$|[,.])", 2, 1),
)
#: What asks for something to be remembered.
KEYWORDS = ("remember", "save this", "don't forget", "keep in mind", "note that", "store this", "memorize", "记住", "记一下", "保存", "记下来", "别忘了")
#: How the lines of a pasted conversation begin.
ROLE_MARKS = ("\nuser:", "\nUser:", "\nassistant:", "\nAssistant:", "\nHuman:", "\nhuman:", "\nAI:", "\nsystem:")


def strip(text: Column) -> Column:
    """Without white space at the ends; trim() knows spaces alone."""
    return F.btrim(text, F.lit(" \t\n\r\f\v\u00a0\u3000"))


def last_bytes(text: Column, n: int) -> Column:
    """The last characters of a text that take n bytes at most."""
    raw = F.substring(text.cast("binary"), F.greatest(F.octet_length(text) - n + 1, F.lit(1)), F.lit(n))
    cut = F.regexp_extract(F.hex(F.substring(raw, F.lit(1), F.lit(3))), "^((?:[89AB][0-9A-F])*)", 1)  # what is left of a character that was cut: three bytes at most
    return F.substring(raw, (F.length(cut) / 2 + 1).cast("int"), F.lit(n)).cast("string")


def redact(text: Column) -> Column:
    return F.regexp_replace(text, PRIVATE, "[REDACTED]")


def fully_private(text: Column) -> Column:
    return strip(F.replace(redact(text), F.lit("[REDACTED]"), F.lit(""))) == ""


def strip_envelope(text: Column) -> Column:
    for pattern in ENVELOPES:
        text = F.regexp_replace(text, pattern, "")
    return text


#: What noise is compared with by meaning before any has been learned.
NOISE_TEXTS = (
    "Do you remember what I told you?",
    "你还记得我喜欢什么吗",
    "I don't have any information about that",
    "我没有相关的记忆",
    "Hello, how are you doing today?",
    "新的一天开始了",
    "No relevant memories found for this query",
    "I couldn't find any matching records",
    "What do you know about me?",
    "你知道我是谁吗",
    "Thanks for letting me know",
    "好的，我知道了",
    "HEARTBEAT",
    "query -> none, no results",
    "I don't have specific details about that topic",
    "没有找到相关的信息",
)


def is_noise(text: Column) -> Column:
    t = strip(text)
    out = t == ""
    for pattern in NOISE:
        out = out | t.rlike(pattern)
    return out


def preference_slot(text: Column) -> Column:
    """struct(brand, item) of the first pattern that matches, else null."""
    out = None
    for pattern, brand, item in SLOTS:
        found = F.struct(F.trim(F.regexp_extract(text, pattern, brand)).alias("brand"), F.trim(F.regexp_extract(text, pattern, item)).alias("item"))
        hit = (found["brand"] != "") & (found["item"] != "")
        out = F.when(hit, found) if out is None else out.when(hit, found)
    return out


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_set(text: Column) -> Column:
    return F.array_distinct(words(text))


def trimmed_word_set(text: Column) -> Column:
    cut = F.transform(words(text), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.array_distinct(F.filter(cut, lambda w: w != ""))


def jaccard(a: Column, b: Column, both_empty: float) -> Column:
    """Of two arrays of distinct words."""
    both, shared = F.size(a) + F.size(b), F.size(F.array_intersect(b, a))
    return F.when(both == 0, both_empty).otherwise(shared / (both - shared))


def content_type(text: Column) -> Column:
    marks = sum(((F.length(text) - F.length(F.replace(text, F.lit(m), F.lit("")))) / len(m) for m in ROLE_MARKS), F.lit(0))
    headings = F.contains(text, F.lit("\n## ")) | F.contains(text, F.lit("\n# ")) | text.startswith("## ") | text.startswith("# ")
    short = (F.size(words(text)) < 500) & ~headings
    return F.when(F.octet_length(text) > 80_000, "large_doc").when(marks >= 3, "conversation").when(short, "short_note").otherwise("structured_doc")


def category_or(text: Column, otherwise: str) -> Column:
    name = F.lower(F.trim(text))
    return F.when(name.isin("profile", "preferences", "entities", "events", "cases", "patterns"), name).otherwise(otherwise)


def preview(text: Column) -> Column:
    return F.when(F.octet_length(text) > 100, F.concat(F.substring(text, 1, 97), F.lit("..."))).otherwise(text)


def age_label(created: Column, now: Column) -> Column:
    days = F.floor((F.unix_seconds(now) - F.unix_seconds(created)) / 86400)
    months = F.floor(days / 30)
    years = F.floor(months / 12)
    many = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}s ago"))
    return (
        F.when(created.isNull(), "unknown").when(days < 1, "today").when(days == 1, "1 day ago").when(days < 30, many(days, "day"))
        .when(months == 1, "1 month ago").when(months < 12, many(months, "month")).when(years == 1, "1 year ago").otherwise(many(years, "year"))
    )


def relative_age(created: Column, now: Column) -> Column:
    minutes = F.floor((F.unix_seconds(now) - F.unix_seconds(created)) / 60)
    unit = lambda n, s: F.concat(F.floor(n).cast("string"), F.lit(s))
    return F.when(minutes < 60, unit(minutes, "m")).when(minutes < 1440, unit(minutes / 60, "h")).when(minutes < 43200, unit(minutes / 1440, "d")).otherwise(unit(minutes / 43200, "mo"))


def strip_fence(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*|\s*```$", ""))


def container_tag(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"{kind}_"), F.substring(F.sha2(value.cast("binary"), 256), 1, 16))


def has_keyword(text: Column) -> Column:
    low = F.lower(text)
    return F.greatest(*(F.contains(low, F.lit(k)) for k in KEYWORDS))


def strip_context(text: Column, tag: str = "memory-context") -> Column:
    return F.trim(F.regexp_replace(text, rf"(?s)<{tag}>.*?</{tag}>\s*", ""))


def space_id(text: Column) -> Column:
    return F.regexp_replace(text, "^(team|org|personal):", "$1/")


def language_of(filename: Column) -> Column:
    ends = {"rs": "rust", "py": "python", "js": "javascript", "mjs": "javascript", "ts": "typescript", "mts": "typescript", "go": "go"}
    ext = F.lower(F.substring_index(filename, ".", -1))
    return F.coalesce(*(F.when(ext == k, v) for k, v in ends.items()))


def signed_by(payload: Column, signature: Column, secret: str) -> Column:
    """Whether a signature "sha256=<hex>" is the HMAC-SHA256 of a payload. The key is known, so its two pads are literals and only sha2 runs."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in key))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), payload.cast("binary")), 256))
    made = F.sha2(F.concat(pad(0x5C), inner), 256)
    return F.coalesce((F.substring(signature, 1, 7) == "sha256=") & (F.lower(F.substring(signature, F.lit(8), F.char_length(signature))) == made), F.lit(False))


def session_hash(session: Column, role: Column, content: Column) -> Column:
    return F.sha2(F.concat(session, role, content).cast("binary"), 256)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def similarity_label(score: Column) -> Column:
    return F.concat(F.lit("similarity:"), F.format_number(score, 2))
