"""SQL for DuckDB that gives the rows of the queries of the same names."""

from __future__ import annotations

from memlake.functions.text import ENVELOPES, KEYWORDS, NOISE, PRIVATE, ROLE_MARKS, SLOTS
from memlake.sources.views import AS_OF, EVENTS_SQL, MEMORIES_SQL, MESSAGES_SQL, RULES_SQL, SESSIONS_SQL, SPACES_SQL

M = f"WITH {MEMORIES_SQL}"
LIVE = f"{M}, live AS (SELECT * FROM memories WHERE state <> 'deleted')"
NOW = f"TIMESTAMP '{AS_OF}'"
DAY = "strftime(created_at, '%Y-%m-%d')"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


LIST_FILTERED = f"{LIVE} SELECT id, category, round(importance, 6) AS importance FROM (SELECT * FROM live WHERE category = 'events' AND list_contains(tags, 'en') ORDER BY importance DESC, id LIMIT 40)"
LIST_PAGED = f"{LIVE} SELECT id, {DAY} AS day FROM (SELECT * FROM live ORDER BY created_at DESC, id LIMIT 25 OFFSET 50)"
COUNT_FILTERED = f"{LIVE} SELECT count(*) AS n FROM live WHERE tier = 'core' AND memory_type = 'session'"
POINT_LOOKUP = f"{M} SELECT id, state, content FROM memories WHERE id = 'm5'"
VECTOR_LOOKUP = f"{LIVE} SELECT id, round(CAST(embedding[1] AS DOUBLE), 6) AS v0, CAST(len(embedding) AS BIGINT) AS dims FROM live JOIN embeddings USING (vec_id) WHERE id = 'm7'"
PROVENANCE_LOOKUP = f"{LIVE} SELECT id, provenance_source_id FROM live WHERE provenance_source_id = 'm17'"
VISIBILITY = f"{LIVE} SELECT id, visibility, owner_agent_id FROM live WHERE visibility = 'global' OR (visibility = 'private' AND owner_agent_id = 'agent-1') OR visibility = 'shared:team/a'"
BATCH_DELETE = f"{LIVE} SELECT count(*) AS would_delete FROM live WHERE starts_with(source, 'src1') AND list_contains(tags, 'en') AND created_at < TIMESTAMP '2024-02-15'"
SOFT_DELETE = f"""{M} SELECT new_state AS state, count(*) AS n, CAST(sum(v) AS BIGINT) AS versions FROM (
  SELECT CASE WHEN hit THEN 'deleted' ELSE state END AS new_state, version + CASE WHEN hit THEN 1 ELSE 0 END AS v FROM (SELECT *, category = 'cases' AND state <> 'deleted' AS hit FROM memories)) GROUP BY new_state"""
UPSERT = f"""{M} SELECT id, CAST(length(content) AS BIGINT) AS n, version, sha256(content) AS sha FROM (
  SELECT id, CASE WHEN version = 2 THEN 'new ' || content ELSE content END AS content, CASE WHEN version = 2 THEN 3 ELSE version END AS version FROM memories)"""
SPACE_UNION = f"""{LIVE}, u AS (SELECT id, space_id FROM live UNION ALL SELECT id, 'org/x' FROM live WHERE space_id = 'team/a'),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY list_position(['personal/u0', 'team/a', 'org/x'], space_id)) AS n FROM u WHERE space_id IN ('personal/u0', 'team/a', 'org/x'))
SELECT id, space_id FROM r WHERE n = 1"""

BY_DIMENSION = LIVE + " ".join(
    ["", *(f"{'UNION ALL ' if i else ''}SELECT '{c}' AS dimension, {c} AS value, count(*) AS n FROM live GROUP BY {c}" for i, c in enumerate(("memory_type", "category", "tier", "state", "space_id", "visibility", "owner_agent_id")))]
)
AVERAGES = f"{LIVE} SELECT count(*) AS total, round(coalesce(avg(importance), 0), 6) AS avg_importance, round(coalesce(avg(confidence), 0), 6) AS avg_confidence, CAST(coalesce(sum(access_count), 0) AS BIGINT) AS total_access FROM live"
TIMELINE = f"""{LIVE} SELECT day, memory_type, n, CAST(sum(n) OVER (PARTITION BY day) AS BIGINT) AS day_total FROM (
  SELECT {DAY} AS day, memory_type, count(*) AS n FROM live WHERE {DAY} >= strftime({NOW} - INTERVAL 30 DAY, '%Y-%m-%d') GROUP BY 1, 2)"""
TAGS = f"""{LIVE}, c AS (SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM live) GROUP BY tag)
SELECT tag, n, (SELECT CAST(sum(n) AS BIGINT) FROM c) AS total_usages, (SELECT count(*) FROM c WHERE n >= 20) AS total_unique FROM c WHERE n >= 20 ORDER BY n DESC, tag LIMIT 15"""
CROSS_TAGS = f"{LIVE} SELECT tag, count(DISTINCT space_id) AS n_spaces FROM (SELECT unnest(tags) AS tag, space_id FROM live) GROUP BY tag HAVING count(DISTINCT space_id) >= 2"


def _top(by: str) -> str:
    return f"top_{by} AS (SELECT * FROM (SELECT {by}, category, n, row_number() OVER (PARTITION BY {by} ORDER BY n DESC, category) AS rank FROM (SELECT {by}, category, count(*) AS n FROM live GROUP BY 1, 2)) WHERE rank <= 3)"


TOP_CATEGORIES = f"{LIVE}, {_top('space_id')} SELECT space_id, category, n, rank FROM top_space_id"
SPACES = f"""{LIVE}, {_top("space_id")}, {SPACES_SQL},
t AS (SELECT space_id, string_agg(category, ',' ORDER BY rank) AS top FROM top_space_id GROUP BY 1), mm AS (SELECT space_id, count(*) AS n_members FROM members GROUP BY 1)
SELECT k.space_id, k.space_type, k.owner_id, n_members, coalesce(n, 0) AS n, coalesce(n_agents, 0) AS n_agents, coalesce(n_core, 0) AS n_core, coalesce(n_working, 0) AS n_working, coalesce(n_peripheral, 0) AS n_peripheral, last_created, coalesce(n_shared, 0) AS n_shared, t.top
FROM (SELECT DISTINCT space_id, space_type, owner_id FROM members) k JOIN mm USING (space_id) LEFT JOIN (
  SELECT space_id, count(*) AS n, count(DISTINCT owner_agent_id) AS n_agents, count(*) FILTER (tier = 'core') AS n_core, count(*) FILTER (tier = 'working') AS n_working, count(*) FILTER (tier = 'peripheral') AS n_peripheral,
    strftime(max(created_at), '%Y-%m-%d') AS last_created, count(provenance_source_id) AS n_shared FROM live GROUP BY space_id) s USING (space_id) LEFT JOIN t USING (space_id)"""
E_ = f"WITH {EVENTS_SQL}"
SHARED = "action IN ('share', 'batch_share', 'reshare')"
SHARING_SUMMARY = f"{E_} SELECT count(*) FILTER ({SHARED}) AS shares, count(*) FILTER (action = 'pull') AS pulls, count(*) FILTER (action = 'unshare') AS unshares, count(DISTINCT user_id) FILTER ({SHARED}) AS sharers FROM share_events"
SHARING_FLOW = f"{E_} SELECT from_space, to_space, count(*) AS n FROM share_events WHERE {SHARED} GROUP BY 1, 2"
SHARING_NODES = f"{E_} SELECT from_space AS space FROM share_events WHERE {SHARED} UNION SELECT to_space FROM share_events WHERE {SHARED}"
SHARING_TIMELINE = f"{E_} SELECT strftime(\"timestamp\", '%Y-%m-%d') AS day, count(*) FILTER (action IN ('share', 'batch_share')) AS shares, count(*) FILTER (action = 'pull') AS pulls FROM share_events GROUP BY 1"
RECENT = f'{E_} SELECT id, action, from_space, to_space FROM share_events ORDER BY "timestamp" DESC, id DESC LIMIT 20'
EVENT_LIST = f"{E_} SELECT id, action, to_space FROM share_events WHERE from_space = 'personal/u2' OR to_space = 'personal/u2' ORDER BY \"timestamp\" DESC, id DESC LIMIT 100"
AGENTS = f"""{LIVE}, {EVENTS_SQL}, {_top("owner_agent_id")},
t AS (SELECT owner_agent_id, string_agg(category, ',' ORDER BY rank) AS top FROM top_owner_agent_id GROUP BY 1),
sh AS (SELECT agent_id AS owner_agent_id, count(*) AS n_shares FROM share_events WHERE action IN ('share', 'batch_share') GROUP BY 1)
SELECT s.*, t.top, coalesce(n_shares, 0) AS n_shares FROM (SELECT owner_agent_id, CAST(sum(n) AS BIGINT) AS n, string_agg(space_id || ':' || n, ',' ORDER BY space_id) AS by_space, strftime(max(last), '%Y-%m-%d') AS last_active FROM (SELECT owner_agent_id, space_id, count(*) AS n, max(created_at) AS last FROM live GROUP BY 1, 2) GROUP BY 1) s JOIN t USING (owner_agent_id) LEFT JOIN sh USING (owner_agent_id)"""


def _edges(least: float) -> str:
    """Filtered memories only: their relations, what supersedes them, what they were shared from."""
    return f"""kept AS (SELECT * FROM live WHERE importance >= {least}), e AS (
  SELECT k.id AS source, k.supports_id AS target, 'supports' AS kind, NULL AS context_label, k.space_id <> '' AND coalesce(t.space_id, '') <> '' AND k.space_id <> t.space_id AS cross_space FROM kept k LEFT JOIN kept t ON t.id = k.supports_id WHERE k.supports_id IS NOT NULL
  UNION ALL SELECT superseded_by, id, 'supersedes', NULL, false FROM kept WHERE superseded_by IS NOT NULL
  UNION ALL SELECT provenance_source_id, id, 'shared_from', shared_from_space || ' → ' || space_id, shared_from_space <> space_id FROM kept WHERE provenance_source_id IS NOT NULL)"""


EDGES = f"{LIVE}, {_edges(0.2)} SELECT source, target, kind, context_label, coalesce(cross_space, false) AS cross_space FROM e"
NODES = f"{LIVE}, {_edges(0.5)}, touched AS (SELECT source AS id FROM e UNION SELECT target FROM e) SELECT id, CASE WHEN l0_abstract <> '' THEN l0_abstract ELSE content END AS label, category, round(importance, 6) AS importance FROM kept WHERE id IN (SELECT id FROM touched) ORDER BY kept.importance DESC, id LIMIT 60"

AGE = f"greatest(epoch({NOW} - coalesce(last_accessed_at, created_at)) / 86400.0, 0)"
RECENCY = f"exp(-(0.6931471805599453 / (30.0 * exp(1.5 * importance))) * pow({AGE}, CASE tier WHEN 'core' THEN 0.8 WHEN 'working' THEN 1.0 ELSE 1.3 END))"
BASE = "(1 - exp(-access_count / 5.0))"
GAP = "greatest(epoch(coalesce(last_accessed_at, created_at) - created_at) / 86400.0, 0) / (access_count - 1)"
FREQUENCY = f"CASE WHEN access_count > 1 THEN {BASE} * (0.5 + 0.5 * exp(-({GAP}) / 30)) ELSE {BASE} END"
RAW = f"(0.4 * {RECENCY} + 0.3 * ({FREQUENCY}) + 0.3 * importance * confidence)"
COMPOSITE_ = f"greatest({RAW}, CASE tier WHEN 'core' THEN 0.9 WHEN 'working' THEN 0.7 ELSE 0.5 END)"
COMPOSITE = f"{LIVE} SELECT id, round({RECENCY}, 6) AS recency, round({FREQUENCY}, 6) AS frequency, round({COMPOSITE_}, 6) AS composite FROM live"


def _curve(beta: float, floor: float) -> str:
    return f"round(greatest(exp(-(0.6931471805599453 / (30.0 * exp(1.5 * 0.5))) * pow(day, {beta})), {floor}), 6)"


CURVE = f"SELECT round(day, 6) AS day, {_curve(0.8, 0.9)} AS core, {_curve(1.0, 0.7)} AS working, {_curve(1.3, 0.5)} AS peripheral FROM (SELECT CAST(i AS DOUBLE) * 90.0 / 30 AS day FROM range(31) t(i))"
STALE = f"{LIVE} SELECT id, round(greatest({RAW}, 0), 6) AS composite FROM live WHERE greatest({RAW}, 0) < 0.3"
TIERS = f"""{LIVE}, c AS (SELECT *, {COMPOSITE_} AS c, greatest(epoch({NOW} - created_at) / 86400.0, 0) > 60 AS old FROM live),
n AS (SELECT id, tier, CASE tier
  WHEN 'peripheral' THEN CASE WHEN access_count >= 3 AND c >= 0.4 THEN 'working' ELSE 'peripheral' END
  WHEN 'working' THEN CASE WHEN access_count >= 10 AND c >= 0.7 AND importance >= 0.8 THEN 'core' WHEN c < 0.15 OR (old AND access_count < 3) THEN 'peripheral' ELSE 'working' END
  ELSE CASE WHEN c < 0.15 AND access_count < 3 THEN 'working' ELSE 'core' END END AS new_tier FROM c)
SELECT * FROM n WHERE tier <> new_tier"""


def _has(*words: str) -> str:
    return " OR ".join(f"contains(lower(content), '{w}')" for w in words)


TTL = f"""{M}, t AS (SELECT *, CASE WHEN {_has("today", "今天", "tomorrow", "明天")} THEN 2 WHEN {_has("next week", "下周")} THEN 10 WHEN {_has("this month", "这个月")} THEN 35 END AS ttl FROM memories WHERE state <> 'deleted')
SELECT id, CAST(ttl AS BIGINT) AS ttl FROM t WHERE created_at + to_days(CAST(ttl AS INTEGER)) < {NOW}"""
EXPIRED = f"""{M}, t AS (SELECT *, CASE WHEN {_has("today", "今天")} THEN 2 WHEN {_has("tomorrow", "明天")} THEN 2 WHEN {_has("next week", "下周")} THEN 10 WHEN {_has("this month", "这个月")} THEN 35 END AS ttl FROM memories),
x AS (SELECT id, version, state, state <> 'deleted' AND ttl IS NOT NULL AND created_at + to_days(CAST(ttl AS INTEGER)) < {NOW} AS hit FROM t)
SELECT id, CASE WHEN hit THEN 'deleted' ELSE state END AS state, version + CASE WHEN hit THEN 1 ELSE 0 END AS version FROM x"""
ARCHIVE = f"{M} SELECT s AS state, count(*) AS n FROM (SELECT CASE WHEN state <> 'deleted' AND superseded_by IS NOT NULL AND created_at + INTERVAL 30 DAY < {NOW} THEN 'archived' ELSE state END AS s FROM memories) GROUP BY s"

DOUBLES = "list_transform({}, lambda x: CAST(x AS DOUBLE))"
COSINE = f"round(list_cosine_similarity({DOUBLES.format('e.embedding')}, {DOUBLES.format('q.embedding')}), 6)"
SCORED = f"scored AS (SELECT id, space_id, {COSINE} AS score FROM live JOIN embeddings e USING (vec_id), (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"
VECTOR_TOPK = f"{LIVE}, {SCORED} SELECT id, score FROM (SELECT id, score FROM scored ORDER BY score DESC, id LIMIT 20) WHERE score >= 0"
VECTOR_TOPK_FILTERED = f"{LIVE}, {SCORED} SELECT id, score FROM (SELECT id, score FROM scored WHERE space_id = 'team/a' ORDER BY score DESC, id LIMIT 20) WHERE score >= 0.1"


def _bm25(f: str) -> str:
    """Scores of one field of all live memories: s_<field>(id, space_id, s)."""
    return f"""w_{f} AS (SELECT id, space_id, regexp_extract_all(lower({f}), '[\\p{{L}}\\p{{N}}]+') AS ws FROM live),
tf_{f} AS (SELECT id, space_id, len, t, count(*) AS tf FROM (SELECT id, space_id, len(ws) AS len, unnest(ws) AS t FROM w_{f}) JOIN asked USING (t) GROUP BY ALL),
df_{f} AS (SELECT t, count(*) AS df FROM tf_{f} GROUP BY t), st_{f} AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(ws)) AS a FROM w_{f}),
s_{f} AS (SELECT id, space_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a)) AS s FROM tf_{f} JOIN df_{f} USING (t), st_{f})"""


BM25_ALL = f"""
asked AS (SELECT DISTINCT t FROM (SELECT unnest(regexp_extract_all(lower(array_to_string(list_slice(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), 1, 5), ' ')), '[\\p{{L}}\\p{{N}}]+')) AS t FROM benchmark WHERE item_id = 0)),
{_bm25("content")}, {_bm25("l0_abstract")},
bm25 AS (SELECT id, any_value(space_id) AS space_id, round(sum(s), 6) AS score FROM (SELECT * FROM s_content UNION ALL SELECT * FROM s_l0_abstract) GROUP BY id)"""
BM25 = f"{LIVE}, {BM25_ALL} SELECT id, score FROM bm25 ORDER BY score DESC, id LIMIT 20"
BM25_POST = f"{LIVE}, {BM25_ALL} SELECT id, score FROM (SELECT id, score FROM bm25 ORDER BY score DESC, id LIMIT 20) JOIN memories USING (id) WHERE category = 'profile'"
LEGS = f"""{LIVE}, {SCORED}, {BM25_ALL},
v AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r, score FROM (SELECT * FROM scored ORDER BY score DESC, id LIMIT 30) WHERE score >= 0),
t AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r, score AS bm25 FROM (SELECT * FROM bm25 ORDER BY score DESC, id LIMIT 30)),
fused AS (SELECT id, bm25, coalesce(0.7 / (60 + v.r), 0) + coalesce(0.3 / (60 + t.r), 0) AS score FROM v FULL JOIN t USING (id))"""
FUSION = f"{LEGS} SELECT id, round(score, 9) AS score FROM fused"


def _normal(rows: str, by: str = "") -> str:
    w = f"OVER ({by})"
    return f"SELECT * REPLACE (CASE WHEN count(*) {w} = 1 THEN least(40 * score, 1) WHEN max(score) {w} > min(score) {w} THEN (score - min(score) {w}) / (max(score) {w} - min(score) {w}) WHEN score > 0 THEN 1 ELSE 0 END AS score) FROM {rows}"


NORMALISED = f"{LEGS} SELECT id, round(score, 6) AS score FROM ({_normal('fused')})"


def _pipeline(limit: int, by: str = "") -> str:
    p, e = (f"PARTITION BY {by} ", f"a.{by} = b.{by} AND ") if by else ("", "")
    c = f"{by}, " if by else ""
    words = "list_distinct(list_filter(regexp_split_to_array({}.content, '\\s+'), lambda w: w <> ''))"
    union = f"len(list_distinct(list_concat({words.format('a')}, {words.format('b')})))"
    near = f"(CASE WHEN {union} = 0 THEN 1.0 ELSE CAST(len(list_intersect({words.format('a')}, {words.format('b')})) AS DOUBLE) / {union} END) > 0.85"
    return f"""
s2 AS (SELECT {c}id, bm25, CASE WHEN memory_type = 'pinned' THEN score * 1.5 ELSE score END AS score FROM fused JOIN memories m USING (id{', ' + by if by else ''})),
s3 AS ({_normal('s2', p)}), s4 AS (SELECT * FROM s3 WHERE score >= 0.3),
s5 AS (SELECT * FROM (SELECT *, row_number() OVER ({p}ORDER BY score DESC, id) AS n FROM s4) WHERE n <= {2 * limit}), s6 AS (SELECT *, score AS pre FROM s5),
s7 AS (SELECT * REPLACE (CASE WHEN bm25 >= 0.75 THEN greatest(score, 0.95 * pre) ELSE score END AS score) FROM s6),
s8 AS (SELECT s7.{c + 's7.' if by else ''}id, s7.score * (0.3 + 0.7 * {COMPOSITE_}) AS score, content, importance FROM s7 JOIN memories m ON m.id = s7.id),
s9 AS (SELECT * REPLACE (score * (0.7 + 0.3 * importance) AS score) FROM s8),
s10 AS (SELECT * REPLACE (score / CASE WHEN strlen(content) = 0 THEN 1 ELSE greatest(1, 1 + log2(strlen(content) / 500.0)) END AS score) FROM s9),
s11 AS (SELECT *, row_number() OVER ({p}ORDER BY score DESC, id) AS rk FROM s10 WHERE score >= 0.005),
s12a AS (SELECT {c}id, CASE WHEN EXISTS (SELECT 1 FROM s11 b WHERE {e}b.rk < a.rk AND {near}) THEN score * 0.5 ELSE score END AS score FROM s11 a),
s12 AS (SELECT {c}id, score FROM (SELECT *, row_number() OVER ({p}ORDER BY score DESC, id) AS n FROM s12a) WHERE n <= {limit})"""


HYBRID = f"{LEGS}, {_pipeline(10)} SELECT id, round(score, 6) AS score FROM s12"
STAGES = ("parallel_search", "rrf_fusion", "rrf_normalize", "min_score_filter", "topk_cap", "cross_encoder_rerank", "bm25_floor", "decay_boost", "importance_weight", "length_normalization", "hard_cutoff", "mmr_diversity")
TRACE = f"{LEGS}, s1 AS (SELECT score FROM v UNION ALL SELECT bm25 FROM t), {_pipeline(10)} " + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS pos, '{n}' AS stage, count(*) AS output_count, round(min(score), 6) AS low, round(max(score), 6) AS high FROM s{i}" for i, n in enumerate(STAGES, 1))
WORDS = "list_distinct(list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> ''))"
DIVERSITY = f"""{LIVE}, t AS (SELECT * FROM (SELECT id, category, content, importance + confidence + 0.1 AS score, row_number() OVER (PARTITION BY category ORDER BY importance + confidence + 0.1 DESC, id) AS rk FROM live) WHERE rk <= 20),
r AS (SELECT *, {WORDS.format("content")} AS w FROM t)
SELECT category, id, round(CASE WHEN EXISTS (SELECT 1 FROM r b WHERE b.category = a.category AND b.rk < a.rk AND (CASE WHEN len(a.w) + len(b.w) = 0 THEN 1.0 ELSE CAST(len(list_intersect(a.w, b.w)) AS DOUBLE) / len(list_distinct(list_concat(a.w, b.w))) END) > 0.85) THEN score * 0.5 ELSE score END, 6) AS score FROM r a"""
CROSS_SPACE = f"""{LIVE}, {SCORED}, {BM25_ALL}, {SPACES_SQL},
v AS (SELECT * FROM (SELECT space_id, id, score, row_number() OVER (PARTITION BY space_id ORDER BY score DESC, id) AS r FROM scored) WHERE r <= 30),
t AS (SELECT * FROM (SELECT space_id, id, score AS bm25, row_number() OVER (PARTITION BY space_id ORDER BY score DESC, id) AS r FROM bm25) WHERE r <= 30),
fused AS (SELECT space_id, id, bm25, coalesce(0.7 / (60 + v.r), 0) + coalesce(0.3 / (60 + t.r), 0) AS score FROM v FULL JOIN t USING (space_id, id)), {_pipeline(10, "space_id")},
x AS (SELECT space_id, id, round(score, 6) AS score FROM s12), k AS (SELECT DISTINCT space_id, space_type FROM members)
SELECT space_id, id, score FROM (SELECT space_id, id, round(CASE WHEN max(score) OVER (PARTITION BY space_id) > 0 THEN score / max(score) OVER (PARTITION BY space_id) ELSE 0 END * CASE space_type WHEN 'personal' THEN 1.0 WHEN 'team' THEN 0.8 ELSE 0.6 END, 6) AS score
  FROM x JOIN k USING (space_id)) ORDER BY score DESC, space_id, id LIMIT 20"""

S = f"WITH {SESSIONS_SQL}"
MSG = f"WITH {MESSAGES_SQL}"
DEDUP = f"""{S}, incoming AS (SELECT id, CASE WHEN turn % 3 = 0 THEN sha256(session_id || role || content || ' again') ELSE content_hash END AS content_hash FROM sess)
SELECT id, content_hash FROM incoming WHERE content_hash NOT IN (SELECT content_hash FROM sess)"""
SESSION_DELETE = f"{S} SELECT session_id, count(*) AS n FROM sess WHERE conv_id % 5 <> 2 GROUP BY 1"
HASHES = f"{S} SELECT content_hash, true AS stored FROM sess UNION SELECT sha256(content_hash), false FROM sess"
SESSION_COUNTS = f"{S} SELECT session_id, count(*) AS n, count(DISTINCT role) AS roles FROM sess GROUP BY 1"
BUDGET = f"""{S} SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER w AS n, sum(strlen(content)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS b FROM sess WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC))
WHERE n <= 20 AND (n = 1 OR b <= 200000)"""
REDACTED = f"regexp_replace(content, '{PRIVATE}', '[REDACTED]', 'g')"
REDACT = f"{MSG} SELECT id, sha256({REDACTED}) AS sha FROM msgs WHERE trim(replace({REDACTED}, '[REDACTED]', '')) <> ''"
NOISE = f"{MSG} SELECT id FROM msgs WHERE trim(content) <> '' AND NOT (" + " OR ".join(f"regexp_matches(trim(content), {_quoted(p)})" for p in NOISE) + ")"
_ENVELOPED = "'bot: System: [10:00] Channel general' || chr(10) || content || chr(10) || 'Sender (untrusted metadata): {\"a\":' || chr(10) || ' 1}' || chr(10) || 'end'"
for _p in ENVELOPES:
    _ENVELOPED = f"regexp_replace({_ENVELOPED}, {_quoted(_p)}, '', 'g')"
ENVELOPE = f"{S} SELECT id, sha256({_ENVELOPED}) AS sha FROM sess"
TRANSCRIPT = f"""{S} SELECT conv_id, turn, CAST(length(left(content, 2000)) AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b, count(*) OVER (PARTITION BY conv_id) AS t FROM sess WHERE role IN ('user', 'assistant') AND trim(content) <> '') WHERE b <= 10 AND t >= 2"""
BLOCKS = f"""{S}, b AS (SELECT conv_id, string_agg(role || ': ' || content || chr(10), '' ORDER BY turn) AS b FROM sess GROUP BY 1),
c AS (SELECT conv_id, b, CASE WHEN strlen(b) <= 8000 THEN b ELSE right(b, list_max(list_filter(range(1, 8001), lambda k: strlen(right(b, CAST(k AS BIGINT))) <= 8000))) END AS t FROM b)
SELECT conv_id, sha256(CASE WHEN strlen(b) <= 8000 OR strpos(t, chr(10)) = length(t) THEN t ELSE substr(t, strpos(t, chr(10)) + 1) END) AS sha FROM c"""
FACTS = "facts AS (SELECT item_id AS fact_id, b.text AS l0, ['profile', 'preferences', 'entities', 'events', 'cases', 'patterns'][item_id % 6 + 1] AS category, b.text || ' and more words' AS source_text, e.embedding FROM benchmark b JOIN embeddings e ON e.vec_id = item_id)"
PAIRS = f"""pairs AS (SELECT fact_id, id, created_at, round(list_cosine_similarity({DOUBLES.format("f.embedding")}, {DOUBLES.format("e.embedding")}), 6) AS score FROM facts f, live JOIN embeddings e USING (vec_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY score DESC, id) AS rank FROM pairs WHERE score >= {{}})"""
GATHER = f"{LIVE}, {FACTS}, {PAIRS.format(0.3)} SELECT fact_id, id, score, rank FROM ranked WHERE rank <= 5"


def _leg(f: str) -> str:
    return f"""w_{f} AS (SELECT id, regexp_extract_all(lower({f}), '[\\p{{L}}\\p{{N}}]+') AS ws FROM live),
tf_{f} AS (SELECT id, len, t, count(*) AS tf FROM (SELECT id, len(ws) AS len, unnest(ws) AS t FROM w_{f}) SEMI JOIN words USING (t) GROUP BY ALL),
df_{f} AS (SELECT t, count(*) AS df FROM tf_{f} GROUP BY t), st_{f} AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(ws)) AS a FROM w_{f}),
s_{f} AS (SELECT id, t, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a)) AS s FROM tf_{f} JOIN df_{f} USING (t), st_{f})"""


GATHER_BOTH = f"""{LIVE}, {FACTS}, {PAIRS.format(0.3)}, words AS (SELECT DISTINCT fact_id, unnest(regexp_extract_all(lower(left(source_text, 200)), '[\\p{{L}}\\p{{N}}]+')) AS t FROM facts),
{_leg("content")}, {_leg("l0_abstract")},
hits AS (SELECT fact_id, id, round(sum(s), 6) AS score FROM words JOIN (SELECT * FROM s_content UNION ALL SELECT * FROM s_l0_abstract) USING (t) GROUP BY 1, 2),
legs AS (SELECT fact_id, id, 0 AS leg, rank FROM ranked WHERE rank <= 5 UNION ALL SELECT fact_id, id, 1, rank FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY score DESC, id) AS rank FROM hits) WHERE rank <= 5),
firsts AS (SELECT fact_id, id, min(leg * 10 + rank) AS place FROM legs GROUP BY 1, 2)
SELECT fact_id, id, row_number() OVER (PARTITION BY fact_id ORDER BY place, id) - 1 AS ordinal FROM firsts"""
TRIMMED = "list_distinct(list_filter(list_transform(regexp_split_to_array({}, '\\s+'), lambda w: regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')), lambda w: w <> ''))"


def _jaccard(a: str, b: str, empty: str) -> str:
    return f"(CASE WHEN len(list_concat({a}, {b})) = 0 THEN {empty} ELSE CAST(len(list_intersect({a}, {b})) AS DOUBLE) / len(list_distinct(list_concat({a}, {b}))) END)"


def _utility(c: str) -> str:
    words = f"(list_filter(regexp_split_to_array(trim({c}), '\\s+'), lambda w: w <> ''))[2:]"
    long = f"greatest(0.7, CASE WHEN regexp_matches(trim({c}), '[0-9]') THEN 0.85 ELSE 0 END, CASE WHEN len(list_filter({words}, lambda w: regexp_matches(w, '^\\p{{Lu}}'))) > 0 THEN 0.8 ELSE 0 END, CASE WHEN strlen(trim({c})) > 60 THEN 0.75 ELSE 0 END)"
    return f"CAST(CASE WHEN strlen(trim({c})) <= 5 THEN 0.2 WHEN strlen(trim({c})) <= 20 THEN 0.3 ELSE {long} END AS DOUBLE)"


ADMISSION = f"""{LIVE}, {FACTS}, {PAIRS.format(0.0)},
best AS (SELECT fact_id, max(score) AS max_sim, arg_min(created_at, (-score, id)) AS best_at FROM ranked WHERE rank <= 5 GROUP BY 1),
a AS (SELECT f.fact_id, coalesce(max_sim, 0) AS sim, round(0.1 * ({_utility("l0")} + {_jaccard(TRIMMED.format("l0"), TRIMMED.format("source_text"), "0.0")} + 1 - coalesce(max_sim, 0) +
    CASE WHEN best_at IS NULL THEN 1 ELSE 1 - exp(-floor(greatest(epoch({NOW} - best_at) / 86400, 0)) / 30.0) END)
  + 0.6 * CASE category WHEN 'profile' THEN 0.95 WHEN 'preferences' THEN 0.90 WHEN 'entities' THEN 0.75 WHEN 'events' THEN 0.45 WHEN 'cases' THEN 0.80 WHEN 'patterns' THEN 0.85 ELSE 0.45 END, 6) AS score FROM facts f LEFT JOIN best USING (fact_id))
SELECT fact_id, score, CASE WHEN score < 0.45 THEN 'reject' WHEN score >= 0.60 AND sim < 0.55 THEN 'add' ELSE 'update_or_merge' END AS decision FROM a"""


def _slot(c: str, which: int) -> str:
    out = []
    for p, brand, item in SLOTS:
        got = [f"trim(regexp_extract({c}, {_quoted(p)}, {g}))" for g in (brand, item)]
        out.append(f"WHEN {got[0]} <> '' AND {got[1]} <> '' THEN {got[which]}")
    return f"CASE {' '.join(out)} END"


SLOTS_ = f"{_slot('content', 0)} AS brand, {_slot('content', 1)} AS item"
SLOTS_OF = f"slots AS (SELECT id, conv_id, {SLOTS_} FROM msgs)"
GUARD = f"""{MSG}, {SLOTS_OF}, h AS (SELECT DISTINCT lower(brand) AS brand, lower(item) AS item FROM slots WHERE brand IS NOT NULL),
n AS (SELECT id AS fact_id, 'starbucks' AS brand, CASE WHEN conv_id % 2 = 0 THEN 'mocha' ELSE 'latte' END AS item FROM msgs)
SELECT fact_id FROM n WHERE EXISTS (SELECT 1 FROM h WHERE h.brand = n.brand AND h.item <> n.item)"""
SLOTS = f"{MSG}, {SLOTS_OF} SELECT id, brand, item FROM slots WHERE brand IS NOT NULL"

RECONCILE = f"""{M}, f AS (SELECT 'd' || item_id AS decision_id, ['create', 'merge', 'skip', 'supersede', 'support', 'contextualize', 'contradict', 'unknown'][item_id % 8 + 1] AS action,
  text AS l0, ['profile', 'preferences', 'entities', 'events', 'cases', 'odd'][item_id % 6 + 1] AS f_category, 'm' || (item_id * 37 % (SELECT count(*) FROM documents)) AS match_id, 'merged ' || text AS merged FROM benchmark),
j AS (SELECT f.*, m.memory_type AS tt, CASE WHEN action = 'unknown' THEN 'create' WHEN action = 'contradict' AND f_category IN ('preferences', 'entities') THEN 'supersede' ELSE action END AS a FROM f LEFT JOIN memories m ON m.id = match_id),
r AS (SELECT *, CASE WHEN tt IS NULL AND a NOT IN ('create', 'skip') THEN 'create' WHEN a IN ('merge', 'supersede') AND tt = 'pinned' THEN 'create' ELSE a END AS ap FROM j),
c AS (SELECT match_id AS id, arg_max(merged, decision_id) FILTER (ap = 'merge') AS mc, max(decision_id) FILTER (ap = 'supersede') AS ov, count(*) FILTER (ap = 'support') AS su, count(*) FILTER (ap IN ('support', 'contradict')) AS li, count(*) AS n
  FROM r WHERE ap IN ('merge', 'supersede', 'support', 'contradict') GROUP BY 1)
SELECT id, sha256(coalesce(mc, content)) AS sha, category, state, round(least(confidence + 0.1 * coalesce(su, 0), greatest(1.0, confidence)), 6) AS confidence, CASE WHEN ov IS NOT NULL THEN 'n' || ov ELSE superseded_by END AS superseded_by, ov IS NOT NULL AS invalidated,
  CAST(CASE WHEN supports_id IS NOT NULL THEN 1 ELSE 0 END + coalesce(li, 0) AS BIGINT) AS n_relations, version + coalesce(n, 0) AS version FROM memories LEFT JOIN c USING (id)
UNION ALL SELECT 'n' || decision_id, sha256(l0), CASE WHEN f_category = 'odd' THEN 'profile' ELSE f_category END, 'active', 0.5, NULL, false, CASE WHEN ap IN ('contextualize', 'contradict') THEN 1 ELSE 0 END, CASE WHEN ap IN ('contextualize', 'contradict') THEN 2 ELSE 1 END
  FROM r WHERE ap IN ('create', 'supersede', 'contextualize', 'contradict')"""
CROSS_RECONCILE = f"""WITH p AS (SELECT 'm' || a.vec_id AS source_id, 'm' || b.vec_id AS target_id, round(list_cosine_similarity({DOUBLES.format("a.embedding")}, {DOUBLES.format("b.embedding")}), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id)
SELECT source_id, target_id, score, printf('similarity:%.2f', score) AS label FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, target_id) AS n FROM p WHERE score >= 0.3) WHERE n <= 5"""

ACCESS = f"WITH {SPACES_SQL} SELECT space_id, user_id, true AS can_read, bool_or(role IN ('admin', 'member') OR owner_id = user_id) AS can_write FROM members GROUP BY 1, 2"
SPACES_OF = f"WITH {SPACES_SQL} SELECT DISTINCT space_id AS id, space_type FROM members WHERE owner_id = 'u1' OR user_id = 'u1'"
STAMP = f"CAST(epoch({NOW}) AS BIGINT)"


def _copied(space: str, visibility: str, user: str, source: str) -> str:
    """Copies of the rows of `source` in a space."""
    return f"""SELECT id || '@' || {space} || '#' || {STAMP} AS id, {space} AS space_id, id AS provenance_source_id, version AS source_version, space_id AS from_space, '{user}' AS by_user, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS original_created_at,
  CAST(0 AS BIGINT) AS access_count, CAST(1 AS BIGINT) AS version, '{visibility}' AS visibility, CAST(NULL AS VARCHAR) AS superseded_by, strftime({NOW}, '%Y-%m-%d') AS created FROM {source}"""


SHARE_FILTERED = f"""{LIVE}, w AS (SELECT * FROM live WHERE space_id = 'personal/u2' AND category IN ('preferences', 'events', 'cases') AND list_has_any(tags, ['en', 't6']) AND importance >= 0.3
  AND id NOT IN (SELECT provenance_source_id FROM live WHERE space_id = 'team/a' AND provenance_source_id IS NOT NULL)) {_copied("'team/a'", "global", "u2", "w")}"""
PULL = f"{M}, w AS (SELECT * FROM memories WHERE space_id = 'org/x' AND version = 2) {_copied(repr('personal/u1'), 'private', 'u1', 'w')}"
SHARE_EVENTS = f"""{LIVE}, w AS (SELECT * FROM live WHERE space_id = 'personal/u2')
SELECT 'share:' || id || '@team/a#' || {STAMP} AS id, 'share' AS action, space_id AS from_space, 'team/a' AS to_space, 'u2' AS user_id, CASE WHEN strlen(content) > 100 THEN left(content, 97) || '...' ELSE content END AS preview FROM w"""
UNSHARED = f"""{M}, f AS (SELECT min(id) AS id FROM memories WHERE space_id = 'personal/u2' AND state <> 'deleted' AND provenance_source_id IS NOT NULL GROUP BY provenance_source_id)
SELECT m.id, CASE WHEN f.id IS NOT NULL THEN 'deleted' ELSE state END AS state, version + CASE WHEN f.id IS NOT NULL THEN 1 ELSE 0 END AS version FROM memories m LEFT JOIN f USING (id)"""
RESHARED = f"""{M}, o AS (SELECT c.id AS copy, c.space_id AS target, s.id, s.version FROM memories c JOIN memories s ON s.id = c.provenance_source_id WHERE c.state <> 'deleted' AND s.state <> 'deleted')
SELECT id, CASE WHEN id IN (SELECT copy FROM o) THEN 'deleted' ELSE state END AS state, CAST(source_version AS BIGINT) AS source_version FROM memories
UNION ALL SELECT id || '@' || target || '#' || {STAMP}, 'active', version FROM o"""
BRIDGE = f"WITH {SPACES_SQL} SELECT DISTINCT space_id AS id, space_type, owner_id FROM members UNION ALL SELECT 'team/u2-u4', 'team', 'u2'"
TENANTS = "SELECT 'u' || i AS id, i < 6 AND i % 3 <> 2 AS allowed FROM range(8) t(i)"
TASKS = f"""SELECT 't' || conv_id AS id, CASE conv_id % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' WHEN 2 THEN 'completed' ELSE 'failed' END AS status, conv_id % 4 = 1 AS stamped FROM (SELECT DISTINCT conv_id FROM conversations)"""
TASK_RECORDS = """WITH c AS (SELECT conv_id, turn, max(coalesce(length(text), 0) % 3) AS f FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
t AS (SELECT conv_id AS k, count(*) AS chunks, coalesce(sum(f) FILTER (turn % 4 <> 3), 0) AS facts, coalesce(max(turn + 1) FILTER (turn % 4 <> 3), 0) AS progress, count(*) FILTER (turn % 4 = 3) AS bad, conv_id % 7 = 3 AS skipped FROM c GROUP BY conv_id),
w AS (SELECT max(k * 60 + CASE WHEN k % 11 = 0 THEN 40 WHEN k % 3 < 2 THEN 30 WHEN k % 13 = 5 THEN 25 ELSE 20 END) - 601 AS mark FROM t),
s AS (SELECT *, CASE WHEN skipped OR facts = 0 THEN 'completed' WHEN k % 13 = 5 THEN 'failed' WHEN k % 3 < 2 THEN 'completed' WHEN k % 11 <> 0 AND k * 60 + 20 + 3600 <= mark THEN 'timed out' ELSE 'processing' END AS state FROM t, w)
SELECT CAST(k AS VARCHAR) AS task_id, CASE WHEN k % 11 = 0 THEN 'rolled_back' WHEN state = 'timed out' THEN 'failed' ELSE state END AS status, CASE WHEN skipped THEN 'skipped' ELSE 'completed' END AS extraction_status, CASE WHEN skipped THEN 0 ELSE chunks END AS extraction_chunks,
  CAST(CASE WHEN skipped THEN 0 ELSE facts END AS BIGINT) AS extraction_facts, CASE WHEN skipped THEN 0 ELSE progress END AS extraction_progress, CASE WHEN skipped OR facts = 0 THEN 'skipped' WHEN state = 'completed' THEN 'completed' ELSE 'running' END AS reconcile_status,
  CASE WHEN NOT skipped AND facts > 0 AND state = 'completed' AND k % 3 = 0 THEN k % 5 ELSE 0 END AS reconcile_merged, CASE WHEN skipped THEN 0 ELSE bad + CAST(state IN ('failed', 'timed out') OR (state = 'completed' AND facts > 0 AND k % 3 = 1) AS BIGINT) END AS n_errors FROM s"""
CODEC = f"{M} SELECT id, category, CASE WHEN i % 10 = 9 THEN 'memory_type' END AS bad, CASE WHEN i % 10 <> 9 THEN CAST(len(tags) AS BIGINT) END AS n_tags FROM memories"
SELF_DEDUP = f"""WITH f AS (SELECT item_id AS fact_id, item_id // 10 AS request, CASE WHEN item_id % 5 = 4 THEN 'the same words each time' ELSE text END AS l0 FROM benchmark)
SELECT fact_id FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.request = a.request AND b.fact_id < a.fact_id AND {_jaccard(TRIMMED.format("a.l0"), TRIMMED.format("b.l0"), "0.0")} > 0.85)"""
UPDATED = f"""{M} SELECT id, CASE WHEN i % 3 = 1 AND state <> 'deleted' THEN 'cases' ELSE category END AS category, version + CASE WHEN i % 3 = 1 AND state <> 'deleted' THEN 1 ELSE 0 END AS version FROM memories"""
AUTO_SHARE = f"""{LIVE}, {RULES_SQL}
SELECT id || '@' || to_space || '#' || {STAMP} AS id, id AS source_id, to_space, rule_id FROM (SELECT id, to_space, rule_id, row_number() OVER (PARTITION BY id, to_space ORDER BY pos) AS n FROM live m JOIN rules r ON m.space_id = r.source_space AND (len(r.categories) = 0 OR list_contains(r.categories, m.category))
  AND (len(r.tags) = 0 OR list_has_any(m.tags, r.tags)) AND m.importance >= r.min_importance AND NOT require_approval) WHERE n = 1"""
IDEMPOTENT = f"{LIVE} SELECT id FROM live WHERE space_id = 'org/x' AND id NOT IN (SELECT provenance_source_id FROM live WHERE space_id = 'team/a' AND provenance_source_id IS NOT NULL)"
OUTCOME = f"""{LIVE}, ids AS (SELECT id FROM memories UNION ALL SELECT id || '?' FROM memories WHERE i % 7 = 0),
k AS (SELECT ids.id, ids.id IN (SELECT id FROM live) AS known, ids.id IN (SELECT provenance_source_id FROM live WHERE space_id = 'personal/u1' AND provenance_source_id IS NOT NULL) AS held FROM ids)
SELECT count(*) FILTER (known AND NOT held) AS shared, count(*) FILTER (known AND held) AS skipped_existing, count(*) FILTER (NOT known) AS failed FROM k"""
STALE_COPIES = f"{LIVE} SELECT c.id, c.provenance_source_id AS source_id, s.id IS NULL OR coalesce(c.source_version, 0) < coalesce(s.version, 0) AS stale, s.id IS NULL AS source_deleted FROM live c LEFT JOIN memories s ON s.id = c.provenance_source_id WHERE c.provenance_source_id IS NOT NULL"

PROFILE_STATIC = f"{M} SELECT id, round(importance, 6) AS importance FROM memories WHERE state = 'active' AND category IN ('profile', 'preferences') ORDER BY memories.importance DESC, id LIMIT 20"
PROFILE_DYNAMIC = f"{M} SELECT id, {DAY} AS day FROM memories WHERE state = 'active' AND category IN ('events', 'cases', 'patterns') AND created_at + INTERVAL 7 DAY >= {NOW} ORDER BY created_at DESC, id LIMIT 10"
CONTEXT = f"""{LIVE}, t AS (SELECT id, category, importance, '- ' || CASE WHEN l0_abstract <> '' THEN l0_abstract ELSE content END AS line FROM live)
SELECT * FROM (SELECT id, category, CAST(sum(ceil(length(line) / 4.0)) OVER (ORDER BY importance DESC, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM t) WHERE spent <= 600"""
LABELS = f"""{LIVE}, a AS (SELECT *, CAST(floor(epoch({NOW} - created_at) / 86400) AS BIGINT) AS d, CAST(floor(epoch({NOW} - created_at) / 60) AS BIGINT) AS mi FROM live)
SELECT id, CASE WHEN d < 1 THEN 'today' WHEN d = 1 THEN '1 day ago' WHEN d < 30 THEN d || ' days ago' WHEN d // 30 = 1 THEN '1 month ago' WHEN d // 30 < 12 THEN (d // 30) || ' months ago' ELSE 'years' END AS age,
  CASE WHEN mi < 60 THEN mi || 'm' WHEN mi < 1440 THEN (mi // 60) || 'h' WHEN mi < 43200 THEN (mi // 1440) || 'd' ELSE (mi // 43200) || 'mo' END AS short_age,
  CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens, CAST(CASE WHEN strlen(content) > 100 THEN length(left(content, 97)) + 3 ELSE length(content) END AS BIGINT) AS preview_chars, round({_utility("l0_abstract")}, 6) AS utility FROM a"""
TAGS_OF = f"{M} SELECT DISTINCT tenant_id, 'user_' || left(sha256(tenant_id), 16) AS tag, 'team/' || tenant_id || ':x' AS space_id FROM memories"
SIMILAR = f"SELECT a.item_id AS a, round({_jaccard(WORDS.format('a.text'), WORDS.format('b.text'), '1.0')}, 6) AS plain, round({_jaccard(TRIMMED.format('a.text'), TRIMMED.format('b.text'), '0.0')}, 6) AS trimmed FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1"

_MARKS = " + ".join(f"(length(t) - length(replace(t, chr(10) || {_quoted(m[1:])}, ''))) / {len(m)}" for m in ROLE_MARKS)
CONTENT_TYPE = f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '# ' || text WHEN doc_id % 7 = 1 THEN text || chr(10) || 'user: a' || chr(10) || 'assistant: b' || chr(10) || 'user: c' ELSE text END AS t FROM documents)
SELECT doc_id, CASE WHEN strlen(t) > 80000 THEN 'large_doc' WHEN {_MARKS} >= 3 THEN 'conversation'
  WHEN len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '')) < 500 AND NOT (contains(t, chr(10) || '## ') OR contains(t, chr(10) || '# ') OR starts_with(t, '## ') OR starts_with(t, '# ')) THEN 'short_note' ELSE 'structured_doc' END AS kind FROM d"""
SECTIONS = """WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\n(The|And|A)', '\n# \\1', 'g'), '\n$', '') AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM d),
h AS (SELECT *, (starts_with(line, '# ') OR starts_with(line, '## ')) AS hd, max(CASE WHEN trim(line, ' ') <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM l),
g AS (SELECT *, sum(CASE WHEN hd AND seen = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS part FROM h),
p AS (SELECT doc_id, part, sum(length(line) + 1) AS len FROM g GROUP BY 1, 2)
SELECT doc_id, count(*) AS parts, CAST(max(len) AS BIGINT) AS longest FROM p GROUP BY 1"""
WEBHOOK = """WITH e AS (SELECT 'r' || (user_id % 3) AS repo, sha256(CAST(event_id AS VARCHAR)) AS sha, 'u' || user_id AS author, 'fix ' || event_type AS msg, 'src/a' || (event_id % 5) || '.py' AS file FROM events)
SELECT repo, 'commit' AS kind, 'Commit ' || left(sha, 8) || ' by ' || author || ': ' || msg || chr(10) || 'Changed files: ' || file || ', README.md' AS content, 'repo:' || repo || '|github:push|commit:' || left(sha, 8) AS tags FROM e
UNION ALL SELECT repo, 'file', '[File changed: ' || file || ' in commit ' || sha || ']', 'repo:' || repo || '|github:file_change|language:python|file:' || file FROM e"""

DISCUSSIONS = """WITH e AS (SELECT event_id % 5 AS k, event_id AS n, event_id % 2 = 1 AS odd, 'r' || (user_id % 3) AS repo, CASE WHEN event_id % 7 = 0 THEN 'Untitled' ELSE event_type END AS title, CASE WHEN event_id % 3 = 0 THEN 'unknown' ELSE 'u' || user_id END AS who, 'b' || user_id AS body FROM events),
m AS (SELECT repo, 'issue' AS kind, 'Issue #' || n || ': ' || title || chr(10) || 'By: ' || who || chr(10) || chr(10) || body AS content, 'issue:' || n AS tag FROM e WHERE k IN (0, 1)
UNION ALL SELECT repo, 'issue_comment', 'Comment on issue #' || n || ' by ' || who || ':' || chr(10) || body, 'issue:' || n FROM e WHERE k = 1
UNION ALL SELECT repo, 'pull_request', 'PR #' || n || ': ' || title || chr(10) || 'By: ' || who || chr(10) || 'Branch: f' || n || ' → main' || chr(10) || chr(10) || body, 'pr:' || n FROM e WHERE k IN (2, 3)
UNION ALL SELECT repo, 'review', 'Review on PR #' || n || ' by ' || who || ' (approved):' || chr(10) || body, 'pr:' || n FROM e WHERE k = 3 AND odd)
SELECT repo, kind, content, 'repo:' || repo || '|github:' || kind || '|' || tag AS tags, 'github:' || repo AS source FROM m"""
PROFILE = f"""{LIVE}, {BM25_ALL}, f AS (SELECT 'static_facts' AS section, row_number() OVER (ORDER BY importance DESC, id) AS place, id, CAST(NULL AS DOUBLE) AS score FROM memories WHERE state = 'active' AND category IN ('profile', 'preferences')),
c AS (SELECT 'dynamic_context' AS section, row_number() OVER (ORDER BY created_at DESC, id) AS place, id, CAST(NULL AS DOUBLE) AS score FROM memories WHERE state = 'active' AND category IN ('events', 'cases', 'patterns') AND created_at + INTERVAL 7 DAY >= {NOW}),
r AS (SELECT 'search_results' AS section, row_number() OVER (ORDER BY score DESC, id) AS place, id, score FROM bm25)
SELECT section, place, id, score FROM (SELECT * FROM f WHERE place <= 20 UNION ALL SELECT * FROM c WHERE place <= 10 UNION ALL SELECT * FROM r WHERE place <= 10)"""
SEARCH_FILTERS = f"{LIVE} SELECT id FROM live WHERE tier = 'core' AND list_contains(tags, 't3') AND source = (SELECT min(source) FROM documents) UNION ALL SELECT id || '/agent' FROM live WHERE owner_agent_id = 'agent-3' AND list_contains(tags, 'en') AND list_contains(tags, 't2')"
PROTOTYPES = f"SELECT e.vec_id FROM embeddings e WHERE EXISTS (SELECT 1 FROM embeddings p WHERE p.vec_id < 5 AND list_cosine_similarity({DOUBLES.format('e.embedding')}, {DOUBLES.format('p.embedding')}) >= 0.25)"
TEXT_MARKS = f"""WITH t AS (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' Please REMEMBER it' WHEN 1 THEN ' 别忘了' ELSE '' END AS said, '```json' || chr(10) || text || chr(10) || '```' AS fenced, '<memory-context>a' || chr(10) || 'b</memory-context>' || chr(10) || text || ' <memory-context></memory-context>' AS around FROM documents)
SELECT doc_id, {' OR '.join(f"contains(lower(said), {_quoted(k)})" for k in KEYWORDS)} AS keyword, sha256(trim(regexp_replace(trim(fenced), '^```[a-zA-Z]*\\s*|\\s*```$', '', 'g'))) AS fence, sha256(trim(regexp_replace(around, '<memory-context>.*?</memory-context>\\s*', '', 'gs'))) AS context FROM t"""
_BLEND = "s6 AS (SELECT * REPLACE (0.6 * CASE WHEN CAST(substr(id, 2) AS BIGINT) % 3 <> 0 THEN CAST(CAST(substr(id, 2) AS BIGINT) % 10 AS DOUBLE) / 10 ELSE 0 END + 0.4 * score AS score), score AS pre FROM s5)"
RERANKED = f"{LEGS}, {_pipeline(10).replace('s6 AS (SELECT *, score AS pre FROM s5)', _BLEND)} SELECT id, round(score, 6) AS score FROM s12"
