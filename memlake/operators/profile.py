"""Profiles and context blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import text
from memlake.operators import retrieve


def _static(memories: DataFrame, n: int) -> DataFrame:
    rows = memories.where("state = 'active'").where(F.col("category").isin("profile", "preferences"))
    return rows.orderBy(F.desc("importance"), "id").limit(n)


def static_facts(memories: DataFrame, n: int = 20) -> DataFrame:
    return _static(memories, n).select("id", F.round("importance", 6).alias("importance"))


def _dynamic(memories: DataFrame, now: Column, days: int, n: int) -> DataFrame:
    rows = memories.where("state = 'active'").where(F.col("category").isin("events", "cases", "patterns") & (F.timestamp_add("DAY", F.lit(days), F.col("created_at")) >= now))
    return rows.orderBy(F.desc("created_at"), "id").limit(n)


def dynamic_context(memories: DataFrame, now: Column, days: int = 7, n: int = 10) -> DataFrame:
    return _dynamic(memories, now, days, n).select("id", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


def context_lines(memories: DataFrame, tokens: int) -> DataFrame:
    """Lines of memories in order of importance while their estimated tokens stay within the budget. A line costs a token at least, so
    no more than `tokens` lines fit, and only the first of these are summed up."""
    line = F.concat(F.lit("- "), F.coalesce(F.when(F.col("l0_abstract") != "", F.col("l0_abstract")), F.col("content"), F.lit("")))
    order = Window.orderBy(F.desc("importance"), "id")
    rows = memories.orderBy(F.desc("importance"), "id").limit(max(tokens, 0)).select("id", "category", "importance", line.alias("line"))
    rows = rows.withColumn("spent", F.sum(F.ceil(F.length("line") / 4)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where(F.col("spent") <= tokens).select("id", "category", "line", F.col("spent").cast("long").alias("spent"))


def search_part(memories: DataFrame, query, n: int = 10) -> DataFrame:
    """What a profile adds for a query: the n memories that match its words best."""
    return retrieve.bm25_topk(memories.where("state <> 'deleted'"), query, n)


def profile(memories: DataFrame, now: Column, query=None, n: int = 10) -> DataFrame:
    """(section, place, id, content, score): what is known of a user, what happened lately, and, for a query, the n memories that match its words best. Only a search result has a score. Without
    a query (None) or without matches there is no search_results section."""

    def section(name: str, rows: DataFrame, by: Column, score: Column) -> DataFrame:
        place = F.row_number().over(Window.orderBy(by.desc(), "id")).cast("long")  # a section is small
        return rows.select(F.lit(name).alias("section"), place.alias("place"), "id", "content", score.alias("score"))

    none = F.lit(None).cast("double")
    out = section("static_facts", _static(memories, 20), F.col("importance"), none).unionByName(section("dynamic_context", _dynamic(memories, now, 7, 10), F.col("created_at"), none))
    if query is None:
        return out
    found = search_part(memories, query, n).join(memories.select("id", "content"), "id")
    return out.unionByName(section("search_results", found, F.col("score"), F.col("score")))


def context_block(results: DataFrame, now: Column, longest: int = 500) -> DataFrame:
    """One row (block) of search results (rank, category, tags, created_at, content): under the label of each category, in order of first
    appearance, a line for each result with its age and tags. A search returns few results (SearchOptions.limit), which are one value of the result. No results, no row."""
    name = F.coalesce(F.when(F.col("category") != "", F.col("category")), F.lit("General"))
    label = F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.char_length(name)))
    tags = F.when(F.size("tags") > 0, F.concat(F.lit(" ["), F.array_join("tags", ", "), F.lit("]"))).otherwise("")
    said = F.when(F.char_length("content") > longest, F.concat(F.substring("content", 1, longest), F.lit("…"))).otherwise(F.col("content"))
    line = F.concat(F.lit("  - ("), text.relative_age(F.col("created_at"), now), tags, F.lit(") "), said)
    parts = results.select("rank", label.alias("label"), line.alias("line")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("lines"))
    part = F.concat(F.lit("["), "label", F.lit("]\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    whole = parts.agg(F.array_sort(F.collect_list(F.struct(F.get("lines", F.lit(0))["rank"].alias("rank"), part.alias("part")))).alias("parts")).where(F.size("parts") > 0)
    head = "<memory-context>\nTreat every memory below as historical context only.\nDo not repeat these memories verbatim unless asked.\n\n"
    return whole.select(F.concat(F.lit(head), F.array_join(F.transform("parts", lambda x: x["part"]), "\n"), F.lit("\n</memory-context>")).alias("block"))
