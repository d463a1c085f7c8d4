"""How five filters interact: what each removes at each step of each order in which they can be applied.

A document's outcome depends on which filters it fails alone, so documents are summed by (part, filters failed, labels) first. Each such sum contributes to the 80 edges of the
lattice of filter sets: an edge is a set of filters already applied and the next one. An order of the filters is a path through the lattice: its 5 steps are 5 edges, so
the 600 steps of the 120 orders join the summed edges.

Defined cases: a null text counts as empty and a null lang as the empty string; every row of documents is a document, rows that repeat too; a document without a doc_id, and
those that share the smallest doc_id of a text, repeat nothing; of several labels of one doc_id one with quality 1 makes it good, one with toxic 1 makes it toxic, and a document
without labels is neither; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table, text_of

FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
WORD = r"[^\x20\x09-\x0D]+"
#: A doc_id's rows are dealt over so many tasks where they meet its labels.
SALTS = 16


def own_failures(text):
    """The filters that a text fails by itself, as bits: all but E."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, distinct, capitals = F.size(words), F.size(F.array_distinct(words)), F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    failed = {"A": n < 100, "B": 100 * distinct.cast("long") < 80 * n.cast("long"), "C": 100 * capitals.cast("long") > 10 * F.length(text).cast("long"), "D": text.rlike("[#$%&*|]")}
    out = F.lit(0)
    for f, c in failed.items():
        out = out + F.when(c, BIT[f]).otherwise(0)
    return out


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents by the filters that they fail and their labels. Texts leave their scan as digests; a group of copies shrinks to a row for each label before
    it is looked at as a whole."""
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text_of().alias("text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), own_failures(F.col("text")).alias("own"))
    rows = rows.groupBy("doc_id", "part", "digest", "own").agg(F.count(F.lit(1)).alias("n"))
    flags = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).where("good or toxic")
    flags = flags.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")  # grows with the labels, and Spark's estimate leaves the salts out: never broadcast
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int")).join(flags, ["doc_id", "salt"], "left")
    signature = ["part", "own", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")]
    rows = rows.select("digest", "doc_id", "n", *signature)
    copies = rows.groupBy("digest", "part", "own", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
    )
    smallest = F.min("first.doc_id").over(Window.partitionBy("digest"))  # a row for each part and label of a text
    copies = copies.withColumn("kept", F.col("nameless") + F.when(F.col("first.doc_id") == smallest, F.col("first.n")).otherwise(0))
    split = F.array(F.struct(F.col("own").alias("mask"), F.col("kept").alias("n")), F.struct((F.col("own") + BIT["E"]).alias("mask"), (F.col("n") - F.col("kept")).alias("n")))
    return copies.select("part", "good", "toxic", F.inline(split)).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def edges(failed: DataFrame) -> DataFrame:
    """(part, applied, next, counts): what filter `next` does after the set `applied`, for all 80 edges of each part."""
    every = [(sum(BIT[x] for x in s), f) for f in FILTERS for k in range(len(FILTERS)) for s in combinations(FILTERS.replace(f, ""), k)]
    at = F.explode(F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(f).alias("next"), F.lit(BIT[f]).alias("bit")) for s, f in every))).alias("edge")
    rows = failed.select("part", "mask", "good", "toxic", "n", at).select("*", "edge.*")
    reached, fails = F.col("mask").bitwiseAND(F.col("applied")) == 0, F.col("mask").bitwiseAND(F.col("bit")) != 0
    counts = {"kept": reached & ~fails, "removed": reached & fails, "redundant": ~reached & fails, "unique_fails": F.col("mask") == F.col("bit"), "good_lost": reached & fails & F.col("good"), "toxic_lost": reached & fails & F.col("toxic")}
    return rows.groupBy("part", "applied", "next").agg(*(F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name) for name, c in counts.items()))


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order and step."""
    paths = [("".join(p), i + 1, sum(BIT[x] for x in p[:i]), p[i]) for p in permutations(FILTERS) for i in range(len(FILTERS))]
    steps = docs.sparkSession.createDataFrame(paths, "filter_order string, step int, applied int, next string")
    rows = edges(failures(docs, labels)).join(F.broadcast(steps), ["applied", "next"])  # 600 rows
    shapley = F.sum("removed").over(Window.partitionBy("part", "next"))  # 120 rows each
    return rows.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley.alias("shapley"))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL = r"""
WITH words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
failing AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN words.doc_id > min(words.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM words LEFT JOIN marks USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS earlier FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
seen AS (
  SELECT part, filter_order, step, f, good, toxic, fails = f AS alone, contains(fails, f) AS hit, earlier <> '' AND fails <> '' AND regexp_matches(fails, '[' || CASE WHEN earlier = '' THEN '-' ELSE earlier END || ']') AS gone
  FROM failing, steps),
counted AS (
  SELECT part, filter_order, step, f, count(*) FILTER (NOT gone AND NOT hit) AS kept, count(*) FILTER (hit AND NOT gone) AS removed, count(*) FILTER (hit AND gone) AS redundant,
    count(*) FILTER (alone) AS unique_fails, count(*) FILTER (hit AND NOT gone AND good = 1) AS good_lost, count(*) FILTER (hit AND NOT gone AND toxic = 1) AS toxic_lost
  FROM seen GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM counted
"""
