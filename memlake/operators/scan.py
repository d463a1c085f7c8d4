"""Scans, filters, pages, lookups and set-based changes of memories. All return DataFrames; nothing is written here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.schema import CATEGORIES, MEMORY, MEMORY_TYPES, STATES, TIERS


def live(memories: DataFrame) -> DataFrame:
    """Everything not deleted; archived rows stay visible."""
    return memories.where("state <> 'deleted'")


def list_filter(memories: DataFrame, state: str | None = None, category: str | None = None, tier: str | None = None, memory_type: str | None = None, tags: list[str] = ()) -> DataFrame:
    """An explicit state replaces the default of all live rows; every tag must be present."""
    out = memories.where(F.col("state") == state) if state else live(memories)
    for name, value in (("category", category), ("tier", tier), ("memory_type", memory_type)):
        out = out.where(F.col(name) == value) if value else out
    for tag in tags:
        out = out.where(F.array_contains("tags", tag))
    return out


def ordered(memories: DataFrame, by: str = "created_at", descending: bool = True) -> DataFrame:
    by = by if by in ("importance", "access_count", "updated_at") else "created_at"
    return memories.orderBy(F.desc(by) if descending else F.asc(by), "id")


def page(memories: DataFrame, limit: int, offset: int = 0, by: str = "created_at", descending: bool = True) -> DataFrame:
    """A page of a total order, so pages neither overlap nor leave gaps."""
    return ordered(memories, by, descending).offset(offset).limit(limit)


def by_id(memories: DataFrame, id_: str) -> DataFrame:
    """Deleted rows are found too."""
    return memories.where(F.col("id") == id_)


def vector_by_id(memories: DataFrame, id_: str) -> DataFrame:
    return live(memories).where(F.col("id") == id_).select("id", "vector")


def by_provenance(memories: DataFrame, source_id: str) -> DataFrame:
    if "provenance_source_id" not in memories.columns:
        return memories.limit(0)
    return live(memories).where(F.col("provenance_source_id") == source_id)


def visible_to(agent: str, shared_spaces: list[str]) -> Column:
    """Global rows, the agent's own private ones (if it has a name), and those shared with one of the spaces."""
    out = F.col("visibility") == "global"
    if agent:
        out = out | ((F.col("visibility") == "private") & (F.col("owner_agent_id") == agent))
    return out | F.col("visibility").isin([f"shared:{s}" for s in shared_spaces]) if shared_spaces else out


def batch_delete_filter(source_prefix: str | None = None, tags: list[str] = (), category: str | None = None, memory_type: str | None = None, state: str | None = None, before: str | None = None) -> Column:
    out = F.lit(True)
    if source_prefix:
        out = out & F.col("source").startswith(source_prefix)
    for tag in tags:
        out = out & F.array_contains("tags", tag)
    for name, value in (("category", category), ("memory_type", memory_type), ("state", state)):
        out = out & (F.col(name) == value) if value else out
    return out & (F.col("created_at") < F.lit(before).cast("timestamp")) if before else out


def soft_delete(memories: DataFrame, where: Column) -> DataFrame:
    """One conditional projection over the snapshot; versions grow, vectors stay."""
    hit = where & (F.col("state") != "deleted")
    return memories.withColumns({"state": F.when(hit, "deleted").otherwise(F.col("state")), "version": F.when(hit, F.col("version") + 1).otherwise(F.col("version"))})


def upsert(memories: DataFrame, changed: DataFrame) -> DataFrame:
    """The next snapshot: rows of `changed` replace those of equal id; a missing column counts as null."""
    return memories.join(changed.select("id"), "id", "left_anti").unionByName(changed, allowMissingColumns=True)


def space_rows(memories: DataFrame, spaces: list[str]) -> DataFrame:
    """Union of spaces; an id in several keeps the row of the first space named."""
    rank = F.array_position(F.array(*map(F.lit, spaces)), F.col("space_id"))
    rows = live(memories).where(F.col("space_id").isin(spaces)).withColumn("_rank", rank)
    first = Window.partitionBy("id").orderBy("_rank", "space_id")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_rank")


def evolve(table: DataFrame, schema) -> DataFrame:
    """table with columns of `schema` that it lacks added as nulls, in the schema's order; unknown columns go."""
    return table.select(*(F.col(f.name).cast(f.dataType) if f.name in table.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))


def space_weight(space_type: Column) -> Column:
    return F.when(space_type == "personal", 1.0).when(space_type == "team", 0.8).otherwise(0.6)


def encode(memories: DataFrame) -> DataFrame:
    """Rows for a store that knows strings only: arrays and structs as JSON."""
    flat = lambda f: F.to_json(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType)) and f.name != "vector" else F.col(f.name)
    return memories.select(*(flat(f).alias(f.name) for f in memories.schema.fields))


def decode(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memories, refused): encoded rows read back. A row whose category, type, state or tier isn't known is refused, with the name of the first such column
    as `bad`; a provenance or relations that don't parse are null."""
    types = {f.name: f.dataType for f in MEMORY.fields}
    read = lambda c: F.from_json(c, types[c]) if c in types and isinstance(types[c], (T.ArrayType, T.StructType)) and dict(rows.dtypes)[c] == "string" else F.col(c)
    known = (("category", CATEGORIES), ("memory_type", MEMORY_TYPES), ("state", STATES), ("tier", TIERS))
    bad = F.coalesce(*(F.when(~F.coalesce(F.col(c).isin(*values), F.lit(False)), F.lit(c)) for c, values in known if c in rows.columns))
    checked = rows.withColumn("bad", bad)
    return checked.where("bad is null").select(*(read(c).alias(c) for c in rows.columns)), checked.where("bad is not null")


def delete_all(memories: DataFrame) -> DataFrame:
    return soft_delete(memories, F.lit(True))


def update(memories: DataFrame, changed: DataFrame, now: Column) -> DataFrame:
    """The next snapshot: live rows named in `changed` (id and the columns to change) take its values, a higher version and `now` as updated_at. Vectors stay unless given."""
    new = [c for c in changed.columns if c != "id"]
    given = changed.select("id", F.lit(True).alias("_hit"), *(F.col(c).alias(f"_{c}") for c in new))
    rows = memories.join(given, "id", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)) & (F.col("state") != "deleted"))
    values = {c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in new}
    values["version"] = F.col("version") + F.col("_hit").cast("long")
    if "updated_at" in memories.columns:
        values["updated_at"] = F.when(F.col("_hit"), now).otherwise(F.col("updated_at"))
    return rows.withColumns(values).select(*memories.columns)
