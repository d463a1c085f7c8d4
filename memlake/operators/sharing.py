"""Sharing between spaces: access, rules, copies with provenance, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import text
from memlake.operators import scan
from memlake.schema import ROLES

BROADCAST_RULES = 10_000
#: What a request may ask for at most: a batch or a publication by ids, and all that a filter leaves.
BATCH_MOST, ALL_MOST = 500, 5000


def access(spaces: DataFrame) -> DataFrame:
    """(space_id, user_id, can_read, can_write), one row for each user that a space knows."""
    members = spaces.select(F.col("id").alias("space_id"), F.explode("members").alias("m")).select("space_id", F.col("m.user_id").alias("user_id"), F.col("m.role").isin("admin", "member").alias("w"))
    owners = spaces.select(F.col("id").alias("space_id"), F.col("owner_id").alias("user_id"), F.lit(True).alias("w"))
    return members.unionByName(owners).groupBy("space_id", "user_id").agg(F.lit(True).alias("can_read"), F.max("w").alias("can_write"))


def spaces_of(spaces: DataFrame, user: str) -> DataFrame:
    return spaces.where((F.col("owner_id") == user) | F.exists("members", lambda m: m["user_id"] == user))


def share_filter(categories: list[str] = (), tags: list[str] = (), min_importance: float | None = None) -> Column:
    out = F.lit(True)
    if categories:
        out = out & F.col("category").isin(*categories)
    if tags:
        out = out & F.arrays_overlap("tags", F.array(*map(F.lit, tags)))
    return out & (F.col("importance") >= min_importance) if min_importance is not None else out


def copies(memories: DataFrame, to_space: Column, now: Column, user: Column, agent: Column, visibility: str = "global") -> DataFrame:
    """Copies of memories for another space: an id of their own for each moment of sharing, counters and dates anew, nothing superseded, provenance filled."""
    never = lambda t: F.lit(None).cast(t)
    made = memories.withColumns({
        "provenance": F.struct(
            F.col("space_id").alias("shared_from_space"), F.col("id").alias("shared_from_memory"), user.alias("shared_by_user"), agent.alias("shared_by_agent"),
            F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("original_created_at"), now.alias("shared_at"), F.col("version").alias("source_version")),
        "provenance_source_id": F.col("id"), "source_version": F.col("version"), "shared_from_space": F.col("space_id"), "to_space": to_space,
    })
    anew = {
        "id": F.concat("id", F.lit("@"), "to_space", F.lit("#"), F.unix_seconds(now).cast("string")), "space_id": F.col("to_space"), "access_count": F.lit(0), "version": F.lit(1).cast("long"), "visibility": F.lit(visibility),
        "superseded_by": never("string"), "invalidated_at": never("timestamp"), "last_accessed_at": never("timestamp"), "created_at": now, "updated_at": now,
    }
    return made.withColumns(anew).drop("to_space")


def events_of(made: DataFrame, action: str) -> DataFrame:
    """The sharing events of copies just made: (id, action, memory_id, from_space, to_space, user_id, agent_id, preview, timestamp)."""
    p = lambda f: F.col(f"provenance.{f}")
    return made.select(
        F.concat(F.lit(f"{action}:"), "id").alias("id"), F.lit(action).alias("action"), F.col("id").alias("memory_id"), p("shared_from_space").alias("from_space"), F.col("space_id").alias("to_space"),
        p("shared_by_user").alias("user_id"), p("shared_by_agent").alias("agent_id"), text.preview(F.col("content")).alias("preview"), p("shared_at").alias("timestamp"),
    )


def at_most(rows: DataFrame, most: int | None, what: str) -> DataFrame:
    """The rows as they are, or an error if there are more than `most` (None: any number). No row is left out, and no more than most + 1 are counted."""
    if most is not None and rows.limit(most + 1).count() > most:
        raise ValueError(f"{what} limited to {most} memories")
    return rows


def shared(memories: DataFrame, wanted: DataFrame, space: str, now: Column, user: str, agent: str = "", most: int | None = None) -> DataFrame:
    """New copies in `space` of the memories in `wanted` (id): those of which it holds no live copy. One memory, a batch or all that a filter leaves are the same. More than `most` ids (BATCH_MOST, say) are an error."""
    at_most(wanted.select("id"), most, "a batch is")
    sources = not_yet_shared(memories, space).join(wanted.select("id").distinct(), "id", "left_semi")
    return copies(sources, F.lit(space), now, F.lit(user), F.lit(agent))


def shared_all(memories: DataFrame, user: str, space: str, now: Column, where: Column, agent: str = "", most: int | None = None) -> DataFrame:
    """share-all, and with a bridge space share-all-to-user: copies of the live memories in the user's own space that the filter takes. More than `most` of them (ALL_MOST, say) are an error."""
    own = memories.where((F.col("space_id") == f"personal/{user}") & (F.col("state") != "deleted")).where(where)
    return shared(memories, at_most(own, most, "share-all is"), space, now, user, agent)


def pulled(memories: DataFrame, wanted: DataFrame, source_space: str, user: str, now: Column, agent: str = "", visibility: str = "private") -> DataFrame:
    """Copies in the user's own space of memories in a space that they may read; made each time, whether there is one or not."""
    rows = memories.where(F.col("space_id") == source_space).join(wanted.select("id").distinct(), "id", "left_semi")
    return copies(rows, F.lit(f"personal/{user}"), now, F.lit(user), F.lit(agent), visibility)


def auto_copies(memories: DataFrame, rules: DataFrame, now: Column, user: str, agent: str = "") -> DataFrame:
    """A copy for each space whose rules a memory meets, whether it holds one or not."""
    hit = matched_rules(memories, rules).select("id", F.col("to_space").alias("_to"))
    return copies(memories.join(hit, "id"), F.col("_to"), now, F.lit(user), F.lit(agent)).drop("_to")


def may_unshare(spaces: DataFrame, user: str) -> DataFrame:
    """(space_id) where the user may take back what others shared: they own it or are an admin."""
    admin = (F.col("owner_id") == user) | F.exists("members", lambda m: (m["user_id"] == user) & (m["role"] == "admin"))
    return spaces.where(admin).select(F.col("id").alias("space_id"))


def unshared(memories: DataFrame, wanted: DataFrame, space: str, spaces: DataFrame, user: str) -> DataFrame:
    """The next snapshot: the first live copy in `space` of each source in `wanted` (id) is deleted, if the user shared it, owns the space or is its admin."""
    held = memories.where((F.col("space_id") == space) & (F.col("state") != "deleted") & F.col("provenance_source_id").isNotNull())
    first = held.groupBy("provenance_source_id").agg(F.min(F.struct("id", F.col("provenance.shared_by_user").alias("by"))).alias("copy"))
    first = first.join(wanted.select(F.col("id").alias("provenance_source_id")).distinct(), "provenance_source_id", "left_semi")
    allowed = may_unshare(spaces, user).where(F.col("space_id") == space).select(F.lit(True).alias("admin"))  # one row at most
    gone = first.join(allowed, F.lit(True), "left").where((F.col("copy.by") == user) | F.coalesce("admin", F.lit(False))).select(F.col("copy.id").alias("id"), F.lit(True).alias("_gone"))
    return scan.soft_delete(memories.join(gone, "id", "left"), F.coalesce("_gone", F.lit(False))).drop("_gone")


def not_yet_shared(memories: DataFrame, space: str) -> DataFrame:
    """Memories of which `space` holds no live copy."""
    held = memories.where((F.col("space_id") == space) & (F.col("state") != "deleted") & F.col("provenance_source_id").isNotNull())
    return memories.join(held.select(F.col("provenance_source_id").alias("id")), "id", "left_anti")


def matched_rules(memories: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, to_space, rule_id): the first rule for each target space that a memory meets. Rules are broadcast only if they are few."""
    asked = rules.where(~F.col("require_approval")).withColumnsRenamed({"categories": "r_categories", "tags": "r_tags"})
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_RULES else asked
    meets = (
        (F.col("space_id") == F.col("source_space"))
        & ((F.size("r_categories") == 0) | F.array_contains(F.col("r_categories"), F.col("category")))
        & ((F.size("r_tags") == 0) | F.arrays_overlap("tags", "r_tags"))
        & (F.col("importance") >= F.col("min_importance"))
    )
    first = Window.partitionBy("id", "to_space").orderBy("pos")
    hit = memories.join(asked, meets).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return hit.select("id", "to_space", "rule_id")


def stale_copies(memories: DataFrame) -> DataFrame:
    """(id, source_id, stale, source_deleted) of copies, against their sources as they are now."""
    source = memories.select(F.col("id").alias("provenance_source_id"), F.col("version").alias("now"), F.col("state").alias("source_state"))
    rows = memories.where("provenance_source_id is not null and state <> 'deleted'").select("id", "provenance_source_id", "source_version").join(source, "provenance_source_id", "left")
    gone = F.col("source_state").isNull()
    stale = gone | (F.coalesce("source_version", F.lit(0)) < F.coalesce("now", F.lit(0)))
    return rows.select("id", F.col("provenance_source_id").alias("source_id"), stale.alias("stale"), gone.alias("source_deleted"))


def bridge_space(spaces: DataFrame, a: str, b: str) -> DataFrame:
    """The first team space that holds both users, if there is one."""
    has = lambda u: (F.col("owner_id") == u) | F.exists("members", lambda m: m["user_id"] == u)
    return spaces.where((F.col("space_type") == "team") & has(a) & has(b)).orderBy("id").limit(1)


def with_bridge(spaces: DataFrame, a: str, b: str) -> DataFrame:
    """The next snapshot of spaces, with a team space for both users if none holds them."""
    low, high = sorted((a, b))
    new = spaces.sparkSession.createDataFrame([(f"team/{low}-{high}", "team", f"{a} & {b}", a, [(a, "admin"), (b, "member")])], "id string, space_type string, name string, owner_id string, members array<struct<user_id:string,role:string>>")
    held = bridge_space(spaces, a, b).select(F.lit(1).alias("held"))
    return spaces.unionByName(new.join(held, F.lit(True), "left_anti"), allowMissingColumns=True)


def org_setup(name: str, owner: str, asked: DataFrame, space_id: str) -> tuple[DataFrame, DataFrame]:
    """The new organisation as one row of spaces, and (user_id) whose role isn't known. asked: (user_id, role); the owner is an admin, once."""
    if not name:
        raise ValueError("name is required")
    asked = asked.where(F.col("user_id") != owner).withColumn("role", F.lower(F.trim("role")))
    good = asked.where(F.col("role").isin(*ROLES)).agg(F.array_sort(F.collect_list(F.struct("user_id", "role"))).alias("m"))
    me = F.array(F.struct(F.lit(owner).alias("user_id"), F.lit("admin").alias("role")))
    space = good.select(F.lit(space_id).alias("id"), F.lit("organization").alias("space_type"), F.lit(name).alias("name"), F.lit(owner).alias("owner_id"), F.concat(me, "m").alias("members"))
    return space, asked.where(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False))).select("user_id")


def share_outcome(memories: DataFrame, ids: DataFrame, space: str) -> DataFrame:
    """One row (shared, skipped_existing, failed) for a batch of ids."""
    known = ids.join(memories.where("state <> 'deleted'").select("id", F.lit(True).alias("known")), "id", "left")
    held = memories.where((F.col("space_id") == space) & (F.col("state") != "deleted")).select(F.col("provenance_source_id").alias("id"), F.lit(True).alias("held")).where("id is not null").distinct()
    rows = known.join(held, "id", "left")
    return rows.agg(F.count_if(F.col("known").isNotNull() & F.col("held").isNull()).alias("shared"), F.count_if(F.col("known").isNotNull() & F.col("held").isNotNull()).alias("skipped_existing"), F.count_if(F.col("known").isNull()).alias("failed"))


def reshared(memories: DataFrame, wanted: DataFrame, now: Column, user: str, agent: str = "") -> DataFrame:
    """The next snapshot: live copies named in `wanted` (id) are deleted and replaced by fresh copies of their sources, where these are still there."""
    old = memories.where("state <> 'deleted' and provenance_source_id is not null").join(wanted.select("id").distinct(), "id", "left_semi")
    again = old.select(F.col("id").alias("_copy"), F.col("provenance_source_id").alias("id"), F.col("space_id").alias("_to"))
    fresh = memories.where("state <> 'deleted'").join(again, "id")
    gone = fresh.select(F.col("_copy").alias("id"), F.lit(True).alias("_gone"))
    kept = scan.soft_delete(memories.join(gone, "id", "left"), F.coalesce("_gone", F.lit(False))).drop("_gone")
    return kept.unionByName(copies(fresh, F.col("_to"), now, F.lit(user), F.lit(agent)).drop("_to", "_copy"), allowMissingColumns=True)
