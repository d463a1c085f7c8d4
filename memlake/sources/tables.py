"""Spaces, tenants, sharing events, import tasks and sessions as tables: each change is a next snapshot, given as a frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of an import task: those that it may go to from each.
TASK_STEPS = {"pending": ("running", "failed"), "running": ("completed", "failed"), "completed": ("rolled_back",), "failed": ("running",), "rolled_back": ()}


def put(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Create or update: rows replace those of equal key."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def get(table: DataFrame, value: str, key: str = "id") -> DataFrame:
    return table.where(F.col(key) == value)


def drop(table: DataFrame, where: Column) -> DataFrame:
    """Rows that `where` takes are gone for good; null counts as no."""
    return table.where(~F.coalesce(where, F.lit(False)))


def drop_sessions(sessions: DataFrame, ids: DataFrame) -> DataFrame:
    """sessions without those named in `ids` (session_id)."""
    return sessions.join(ids.select("session_id"), "session_id", "left_anti")


def has_hash(sessions: DataFrame, hashes: DataFrame) -> DataFrame:
    """hashes (content_hash) with `stored`."""
    known = sessions.select("content_hash").distinct().withColumn("stored", F.lit(True))
    return hashes.join(known, "content_hash", "left").withColumn("stored", F.coalesce("stored", F.lit(False)))


def active_tenants(tenants: DataFrame, keys: DataFrame) -> DataFrame:
    """keys (id) with `allowed`: a tenant of that key exists and is active."""
    known = tenants.select("id", (F.col("status") == "active").alias("allowed"))
    return keys.join(known, "id", "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def move_tasks(tasks: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """The next snapshot of import tasks (id, status, ..., completed_at): asked (id, to) moves a task where TASK_STEPS allows it; completion is stamped."""
    allowed = F.coalesce(*(F.when(F.col("status") == s, F.col("to").isin(*to) if to else F.lit(False)) for s, to in TASK_STEPS.items()), F.lit(False))
    rows = tasks.join(asked.select("id", "to"), "id", "left").withColumn("_go", F.col("to").isNotNull() & allowed)
    rows = rows.withColumn("completed_at", F.when(F.col("_go") & F.col("to").isin("completed", "failed"), now).otherwise(F.col("completed_at")))
    return rows.withColumn("status", F.when(F.col("_go"), F.col("to")).otherwise(F.col("status"))).select(*tasks.columns)


def task_results(tasks: DataFrame, facts: DataFrame, made: DataFrame) -> DataFrame:
    """tasks with extraction and reconciliation as they stand: facts (task_id) found, made (task_id) memories. Without facts reconciliation is skipped."""
    n = lambda rows, c: rows.groupBy(F.col("task_id").alias("id")).agg(F.count(F.lit(1)).alias(c))
    rows = tasks.join(n(facts, "extraction_facts"), "id", "left").join(n(made, "reconcile_merged"), "id", "left").fillna(0, ["extraction_facts", "reconcile_merged"])
    return rows.withColumns({"extraction_status": F.lit("completed"), "reconcile_status": F.when(F.col("extraction_facts") == 0, "skipped").otherwise("completed")})
