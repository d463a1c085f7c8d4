"""Webhook payloads of code hosts as memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions import text

PAYLOAD = """struct<action:string, ref:string, repository:struct<full_name:string>,
  commits:array<struct<id:string, message:string, author:struct<name:string>, added:array<string>, modified:array<string>, removed:array<string>>>,
  issue:struct<number:long, title:string, body:string, user:struct<login:string>>, comment:struct<body:string, user:struct<login:string>>,
  pull_request:struct<number:long, title:string, body:string, user:struct<login:string>, head:struct<ref:string>, base:struct<ref:string>>,
  review:struct<state:string, body:string, user:struct<login:string>>>"""


def parse(payloads: DataFrame, column: str = "payload") -> DataFrame:
    return payloads.withColumn("p", F.from_json(column, PAYLOAD)).withColumn("repo", F.coalesce("p.repository.full_name", F.lit("unknown")))


def commits(payloads: DataFrame) -> DataFrame:
    """(repo, kind, content, tags): a memory for each commit of a push, and one for each changed file in a known language. Removed files don't count."""
    c = parse(payloads).where("event = 'push'").select("repo", F.explode("p.commits").alias("c"))
    none = F.array().cast("array<string>")
    c = c.select("repo", F.coalesce("c.id", F.lit("unknown")).alias("sha"), F.coalesce("c.author.name", F.lit("unknown")).alias("author"), F.coalesce("c.message", F.lit("")).alias("message"), F.concat(F.coalesce("c.added", none), F.coalesce("c.modified", none)).alias("files"))
    short = F.substring("sha", 1, 8)
    said = F.concat(F.lit("Commit "), short, F.lit(" by "), F.col("author"), F.lit(": "), F.col("message"), F.lit("\nChanged files: "), F.array_join("files", ", "))
    tag = lambda *xs: F.array(F.concat(F.lit("repo:"), "repo"), *xs)
    events = c.select("repo", F.lit("commit").alias("kind"), said.alias("content"), tag(F.lit("github:push"), F.concat(F.lit("commit:"), short)).alias("tags"))
    files = c.select("repo", "sha", F.explode("files").alias("file")).withColumn("language", text.language_of(F.col("file"))).where("language is not null")
    changed = F.concat(F.lit("[File changed: "), "file", F.lit(" in commit "), "sha", F.lit("]"))
    return events.unionByName(files.select("repo", F.lit("file").alias("kind"), changed.alias("content"), tag(F.lit("github:file_change"), F.concat(F.lit("language:"), "language"), F.concat(F.lit("file:"), "file")).alias("tags")))


def discussions(payloads: DataFrame) -> DataFrame:
    """(repo, kind, content, tags, source): a memory for each issue, comment, pull request, and review that says something. One payload may hold two of them, a comment and its issue, say. Other events give no rows; what
    a payload leaves out is Untitled, unknown, 0 or empty."""
    said = lambda path, otherwise="": F.coalesce(F.col(f"p.{path}"), F.lit(otherwise))
    number = lambda c: F.coalesce(F.col(f"p.{c}.number"), F.lit(0)).cast("string")
    by = lambda c: said(f"{c}.user.login", "unknown")

    def memory(events: tuple[str, str], part: str, kind: str, tag: str, about: str, *content) -> Column:
        tags = F.array(F.concat(F.lit("repo:"), "repo"), F.lit(f"github:{kind}"), F.concat(F.lit(f"{tag}:"), number(about)))
        made = F.struct(F.lit(kind).alias("kind"), F.concat(*(F.lit(x) if isinstance(x, str) else x for x in content)).alias("content"), tags.alias("tags"))
        return F.when(F.col("event").isin(*events) & F.col(f"p.{part}").isNotNull(), made)

    issues, pulls = ("issues", "issue_comment"), ("pull_request", "pull_request_review")
    review = memory(pulls, "review", "review", "pr", "pull_request", "Review on PR #", number("pull_request"), " by ", by("review"), " (", said("review.state", "unknown"), "):\n", said("review.body"))
    found = F.array(
        memory(issues, "issue", "issue", "issue", "issue", "Issue #", number("issue"), ": ", said("issue.title", "Untitled"), "\nBy: ", by("issue"), "\n\n", said("issue.body")),
        memory(issues, "comment", "issue_comment", "issue", "issue", "Comment on issue #", number("issue"), " by ", by("comment"), ":\n", said("comment.body")),
        memory(pulls, "pull_request", "pull_request", "pr", "pull_request", "PR #", number("pull_request"), ": ", said("pull_request.title", "Untitled"), "\nBy: ", by("pull_request"), "\nBranch: ", said("pull_request.head.ref"), " → ", said("pull_request.base.ref"), "\n\n", said("pull_request.body")),
        F.when(said("review.body") != "", review),
    )
    rows = parse(payloads).select("repo", F.explode(F.array_compact(found)).alias("m"))
    return rows.select("repo", "m.kind", "m.content", "m.tags", F.concat(F.lit("github:"), "repo").alias("source"))


def memories(payloads: DataFrame) -> DataFrame:
    """(repo, kind, content, tags, source) of all events: commits, changed files, discussions."""
    return commits(payloads).withColumn("source", F.concat(F.lit("github:"), "repo")).unionByName(discussions(payloads))
