"""Relations of the memory store, derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-04-03 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def _pick(mod: int, names: dict[int, str], otherwise):
    out = None
    for k, v in names.items():
        c = F.col("i") % mod == k
        out = F.when(c, F.lit(v)) if out is None else out.when(c, F.lit(v))
    return out.otherwise(otherwise)


def _days(n):
    return F.timestamp_add("DAY", n.cast("int"), F.lit("2024-01-01").cast("timestamp"))


def memories(spark: SparkSession, sf_dir: str, vector: bool = False) -> DataFrame:
    """One memory for each document. The vector is joined only if asked for, so other plans never read it."""
    docs = read(spark, sf_dir, "documents")
    n = docs.count()  # answered from Parquet metadata
    i = F.col("i")
    m = docs.select(F.col("doc_id").alias("i"), F.col("text"), F.col("lang"), F.col("source").alias("src"))
    m = m.select(
        "i",
        F.concat(F.lit("m"), i).alias("id"),
        F.concat("text", _pick(20, {3: " see you tomorrow", 7: " due next week", 11: " this month"}, F.lit(""))).alias("content"),
        F.substring("text", 1, 80).alias("l0_abstract"),
        F.get(F.array(*map(F.lit, ("profile", "preferences", "entities", "events", "cases", "patterns"))), (i % 6).cast("int")).alias("category"),
        F.when(i % 10 == 0, "pinned").when(i % 3 == 0, "session").otherwise("insight").alias("memory_type"),
        F.when(i % 17 == 5, "deleted").when(i % 13 == 4, "archived").otherwise("active").alias("state"),
        F.get(F.array(*map(F.lit, ("core", "working", "peripheral"))), (i % 3).cast("int")).alias("tier"),
        ((i % 11) / F.lit(10.0)).alias("importance"),
        ((i % 7) / F.lit(6.0)).alias("confidence"),
        (i % 15).cast("int").alias("access_count"),
        F.array("lang", "src", F.concat(F.lit("t"), i % 8)).alias("tags"),
        F.concat(F.lit("u"), i % 5).alias("tenant_id"),
        F.when(i % 4 == 0, "team/a").when(i % 4 == 1, "org/x").otherwise(F.concat(F.lit("personal/u"), i % 5)).alias("space_id"),
        F.when(i % 5 == 0, "private").when(i % 5 == 1, "shared:team/a").otherwise("global").alias("visibility"),
        F.concat(F.lit("agent-"), i % 9).alias("owner_agent_id"),
        F.col("src").alias("source"),
        F.when(i % 16 == 2, F.concat(F.lit("m"), (i + 1) % n)).alias("superseded_by"),
        _days((i * 7) % 90).alias("created_at"),
        F.when(i % 4 != 1, _days((i * 7) % 90 + i % 5)).alias("last_accessed_at"),
        (1 + i % 4).cast("long").alias("version"),
        F.when(i % 12 == 6, F.concat(F.lit("m"), i - 1)).alias("provenance_source_id"),
        F.when(i % 12 == 6, (1 + F.floor(i / 12) % 3).cast("long")).alias("source_version"),
        F.when(i % 12 == 6, F.when(i % 5 == 0, F.concat(F.lit("personal/u"), i % 5)).otherwise("org/x")).alias("shared_from_space"),
        F.when(i % 9 == 4, F.array(F.struct(F.lit("supports").alias("relation_type"), F.concat(F.lit("m"), (i + 5) % n).alias("target_id"), F.lit(None).cast("string").alias("context_label")))).otherwise(F.array().cast("array<struct<relation_type:string,target_id:string,context_label:string>>")).alias("relations"),
    )
    if not vector:
        return m
    vectors = read(spark, sf_dir, "embeddings")
    e = vectors.count()
    return m.withColumn("vec_id", i % e).join(vectors.select("vec_id", F.col("embedding").alias("vector")), "vec_id", "left").drop("vec_id")


MEMORIES_SQL = """memories AS (
  SELECT i, 'm' || i AS id, text || CASE i % 20 WHEN 3 THEN ' see you tomorrow' WHEN 7 THEN ' due next week' WHEN 11 THEN ' this month' ELSE '' END AS content,
    left(text, 80) AS l0_abstract,
    ['profile', 'preferences', 'entities', 'events', 'cases', 'patterns'][i % 6 + 1] AS category,
    CASE WHEN i % 10 = 0 THEN 'pinned' WHEN i % 3 = 0 THEN 'session' ELSE 'insight' END AS memory_type,
    CASE WHEN i % 17 = 5 THEN 'deleted' WHEN i % 13 = 4 THEN 'archived' ELSE 'active' END AS state,
    ['core', 'working', 'peripheral'][i % 3 + 1] AS tier,
    CAST(i % 11 AS DOUBLE) / 10 AS importance, CAST(i % 7 AS DOUBLE) / 6 AS confidence, CAST(i % 15 AS INTEGER) AS access_count,
    [lang, source, 't' || (i % 8)] AS tags, 'u' || (i % 5) AS tenant_id,
    CASE WHEN i % 4 = 0 THEN 'team/a' WHEN i % 4 = 1 THEN 'org/x' ELSE 'personal/u' || (i % 5) END AS space_id,
    CASE WHEN i % 5 = 0 THEN 'private' WHEN i % 5 = 1 THEN 'shared:team/a' ELSE 'global' END AS visibility,
    'agent-' || (i % 9) AS owner_agent_id, source,
    CASE WHEN i % 16 = 2 THEN 'm' || ((i + 1) % (SELECT count(*) FROM documents)) END AS superseded_by,
    TIMESTAMP '2024-01-01' + to_days(CAST(i * 7 % 90 AS INTEGER)) AS created_at,
    CASE WHEN i % 4 <> 1 THEN TIMESTAMP '2024-01-01' + to_days(CAST(i * 7 % 90 + i % 5 AS INTEGER)) END AS last_accessed_at,
    1 + i % 4 AS version,
    CASE WHEN i % 12 = 6 THEN 'm' || (i - 1) END AS provenance_source_id,
    CASE WHEN i % 12 = 6 THEN 1 + (i // 12) % 3 END AS source_version,
    CASE WHEN i % 12 = 6 THEN CASE WHEN i % 5 = 0 THEN 'personal/u' || (i % 5) ELSE 'org/x' END END AS shared_from_space,
    CASE WHEN i % 9 = 4 THEN 'm' || ((i + 5) % (SELECT count(*) FROM documents)) END AS supports_id,
    i % (SELECT count(*) FROM embeddings) AS vec_id
  FROM (SELECT doc_id AS i, text, lang, source FROM documents) d)"""

SHARE_TYPES = {"signup": "share", "click": "pull", "view": "unshare", "purchase": "batch_share", "error": "reshare"}


def sharing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    action = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in SHARE_TYPES.items()), F.lit("share"))
    return e.select(
        F.col("event_id").alias("id"), action.alias("action"), F.concat(F.lit("u"), F.col("user_id") % 7).alias("user_id"),
        F.concat(F.lit("agent-"), F.col("user_id") % 9).alias("agent_id"),
        F.concat(F.lit("personal/u"), F.col("user_id") % 5).alias("from_space"),
        F.when(F.col("event_id") % 2 == 0, "team/a").otherwise("org/x").alias("to_space"), F.col("ts").alias("timestamp"),
    )


EVENTS_SQL = """share_events AS (
  SELECT event_id AS id, CASE event_type WHEN 'signup' THEN 'share' WHEN 'click' THEN 'pull' WHEN 'view' THEN 'unshare' WHEN 'purchase' THEN 'batch_share' WHEN 'error' THEN 'reshare' ELSE 'share' END AS action,
    'u' || (user_id % 7) AS user_id, 'agent-' || (user_id % 9) AS agent_id, 'personal/u' || (user_id % 5) AS from_space,
    CASE WHEN event_id % 2 = 0 THEN 'team/a' ELSE 'org/x' END AS to_space, ts AS "timestamp" FROM events)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    return c.select(F.concat_ws("-", F.lit("s"), "conv_id", "turn").alias("id"), F.col("conv_id").cast("string").alias("session_id"), "conv_id", "turn", "role", F.col("text").alias("content"), F.sha2(F.concat(F.col("conv_id").cast("string"), "role", "text").cast("binary"), 256).alias("content_hash"))


SESSIONS_SQL = """sess AS (
  SELECT 's-' || conv_id || '-' || turn AS id, CAST(conv_id AS VARCHAR) AS session_id, conv_id, turn, role, text AS content, sha256(conv_id || role || text) AS content_hash FROM conversations)"""

INJECTED = {0: None, 1: "hello!", 2: "I like latte from Starbucks", 3: "thanks"}


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns with private parts, greetings, preferences and thanks put in by turn."""
    t = F.col("turn") % 7
    text = F.when(t == 0, F.concat("content", F.lit(" <private>secret</private>"))).when(t == 1, "hello!").when(t == 2, "I like latte from Starbucks").when(t == 3, "thanks").otherwise(F.col("content"))
    return sessions(spark, sf_dir).withColumn("content", text)


MESSAGES_SQL = SESSIONS_SQL + """, msgs AS (
  SELECT id, session_id, conv_id, turn, role, CASE turn % 7 WHEN 0 THEN content || ' <private>secret</private>' WHEN 1 THEN 'hello!' WHEN 2 THEN 'I like latte from Starbucks' WHEN 3 THEN 'thanks' ELSE content END AS content FROM sess)"""


def spaces(spark: SparkSession) -> DataFrame:
    rows = [
        ("team/a", "team", "Team A", "u0", [("u0", "admin"), ("u1", "member"), ("u2", "reader")]),
        ("org/x", "organization", "Org X", "u3", [("u3", "admin"), ("u1", "reader"), ("u4", "member")]),
        ("team/new", "team", "New", "u4", [("u4", "admin")]),  # holds no memory
        *((f"personal/u{i}", "personal", f"Own {i}", f"u{i}", [(f"u{i}", "admin")]) for i in range(5)),
    ]
    return spark.createDataFrame(rows, "id string, space_type string, name string, owner_id string, members array<struct<user_id:string,role:string>>")


SPACES_SQL = """members(space_id, space_type, owner_id, user_id, role) AS (VALUES
  ('team/a', 'team', 'u0', 'u0', 'admin'), ('team/a', 'team', 'u0', 'u1', 'member'), ('team/a', 'team', 'u0', 'u2', 'reader'),
  ('org/x', 'organization', 'u3', 'u3', 'admin'), ('org/x', 'organization', 'u3', 'u1', 'reader'), ('org/x', 'organization', 'u3', 'u4', 'member'),
  ('team/new', 'team', 'u4', 'u4', 'admin'), ('personal/u0', 'personal', 'u0', 'u0', 'admin'), ('personal/u1', 'personal', 'u1', 'u1', 'admin'), ('personal/u2', 'personal', 'u2', 'u2', 'admin'), ('personal/u3', 'personal', 'u3', 'u3', 'admin'), ('personal/u4', 'personal', 'u4', 'u4', 'admin'))"""


def rules(spark: SparkSession) -> DataFrame:
    rows = [
        (1, "r1", "team/a", "org/x", ["preferences", "events"], ["en"], 0.3, False),
        (2, "r2", "team/a", "org/x", [], ["de", "fr"], 0.0, False),
        (3, "r3", "org/x", "team/a", ["cases"], [], 0.5, False),
        (4, "r4", "org/x", "team/a", [], [], 0.9, True),
        (5, "r5", "personal/u2", "team/a", [], ["t2", "t7"], 0.2, False),
    ]
    return spark.createDataFrame(rows, "pos int, rule_id string, source_space string, to_space string, categories array<string>, tags array<string>, min_importance double, require_approval boolean")


RULES_SQL = """rules(pos, rule_id, source_space, to_space, categories, tags, min_importance, require_approval) AS (VALUES
  (1, 'r1', 'team/a', 'org/x', ['preferences', 'events'], ['en'], CAST(0.3 AS DOUBLE), false), (2, 'r2', 'team/a', 'org/x', CAST([] AS VARCHAR[]), ['de', 'fr'], 0.0, false),
  (3, 'r3', 'org/x', 'team/a', ['cases'], CAST([] AS VARCHAR[]), 0.5, false), (4, 'r4', 'org/x', 'team/a', CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), 0.9, true),
  (5, 'r5', 'personal/u2', 'team/a', CAST([] AS VARCHAR[]), ['t2', 't7'], 0.2, false))"""
