"""Keyed stream state: noise learned for each tenant, which needs the RocksDB state store (see rocksdb), and import tasks as state machines with timers."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from memlake.functions import text
from memlake.streaming import flows

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB; the session's own setting comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def noise_prototypes(spark: SparkSession, embed) -> list[list[float]]:
    """Vectors of the texts that stand for noise before any is learned (bounded: as many as text.NOISE_TEXTS)."""
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(text.NOISE_TEXTS)], "at int, t string")
    return [list(r.v) for r in rows.select("at", embed(F.col("t")).alias("v")).orderBy("at").collect()]


class _Noise(StatefulProcessor):
    def __init__(self, fixed: list[list[float]]):
        self.fixed = [np.array(v, dtype=float) for v in fixed]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getListState("known", "vector array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("seq", kind="stable")
        before = [np.array(v, dtype=float) for (v,) in self.known.get()]
        hits, known = flows.learn_noise(list(frame["vector"]), frame["noisy"].to_numpy(), before, self.fixed)
        if len(known) != len(before) or any(a is not b for a, b in zip(known, before, strict=True)):
            self.known.put([(v.tolist(),) for v in known])
        yield pd.DataFrame({"tenant_id": key[0], "seq": frame["seq"].to_numpy(), "noise": hits})

    def close(self) -> None:
        pass


def learned_noise(stream: DataFrame, fixed: list[list[float]] = ()) -> DataFrame:
    """(tenant_id, seq, noise) from a stream (tenant_id, seq, vector, noisy). What a tenant's rows have taught is kept from batch to batch and over restarts; `fixed` prototypes are known to all
    tenants and never forgotten.

    Rows count in the order of batches, and by seq within one, so the result is that of a loop if batches come in that order. Each batch's rows of a tenant meet in one task: the source's options (maxFilesPerTrigger, maxBytesPerTrigger)
    bound them. A null vector is noise if `noisy` says so, and teaches nothing; a null `noisy` counts as no."""
    rows = stream.select("tenant_id", "seq", "vector", F.coalesce("noisy", F.lit(False)).alias("noisy"))
    return rows.groupBy("tenant_id").transformWithStateInPandas(_Noise(list(fixed)), "tenant_id string, seq long, noise boolean", "append", "none")


#: A task's record; moments are milliseconds. `handled` counts chunks that gave facts or failed, `due` is when the task fails unless something happens.
RECORD = (
    "status string, extraction_status string, extraction_chunks long, extraction_facts long, extraction_progress long, reconcile_status string, reconcile_relations long, "
    "reconcile_merged long, reconcile_progress long, errors array<string>, created long, completed long, handled long, due long, version long"
)
_FIELDS = [f.split()[0] for f in RECORD.split(", ")]
_Event = namedtuple("_Event", "at, rank, part, n, message, kind")
EVENTS = "task_id string, kind string, part long, n long, message string, at timestamp"
#: Kinds of events, in the order in which those of one moment count.
KINDS = ("created", "chunked", "extracted", "chunk_failed", "reconciled", "reconcile_failed", "failed", "rolled_back")


#: Handled chunks are kept as bits, so many in one long.
BLOCK = 63
_STATE = f"{RECORD}, blocks map<long, long>"


class _Tasks:
    """The function of applyInPandasWithState: states travel with the rows, so a task takes no call of the state store from Python. (transformWithState takes three or more, and the time is that of their round trips.)"""

    def __init__(self, timeout_ms: int):
        self.timeout = timeout_ms

    def _read(self, state: GroupState) -> tuple[dict, dict[int, int]]:
        """A task's record, and the blocks of its handled chunks."""
        if state.exists:
            *held, blocks = state.get
            return dict(zip(_FIELDS, held, strict=True)) | {"errors": list(held[_FIELDS.index("errors")])}, dict(blocks)
        return dict.fromkeys(_FIELDS, 0) | {"status": "processing", "extraction_status": "pending", "reconcile_status": "pending", "errors": [], "created": None, "completed": None, "due": None}, {}

    def _end(self, task: dict, status: str, at: int) -> None:
        task["status"], task["completed"] = status, at

    def _step(self, task: dict, blocks: dict[int, int], e) -> None:
        """What an event does to a task and to the blocks of its handled chunks. Chunks count once each, however often and in whatever order their events come; a task that has ended only rolls back."""
        if e.kind == "rolled_back":
            task["status"] = "rolled_back"
            return
        if e.kind == "created" and task["created"] is None:
            task["created"] = e.at
        if task["status"] != "processing":
            return
        if e.kind == "created" and e.n == 0:
            task["extraction_status"] = task["reconcile_status"] = "skipped"
            self._end(task, "completed", e.at)
        elif e.kind == "chunked" and task["extraction_status"] == "pending":
            task["extraction_status"], task["extraction_chunks"] = "running", e.n
        elif e.kind in ("extracted", "chunk_failed"):
            block, bit = e.part // BLOCK, 1 << e.part % BLOCK
            if not blocks.get(block, 0) & bit:
                blocks[block] = blocks.get(block, 0) | bit
                task["handled"] += 1
                if e.kind == "extracted":
                    task["extraction_facts"] += e.n
                    task["extraction_progress"] = max(task["extraction_progress"], e.part + 1)
                else:
                    task["errors"].append(f"chunk {e.part} extraction failed: {e.message}")
        elif e.kind in ("reconciled", "reconcile_failed") and task["reconcile_status"] == "running":
            if e.kind == "reconciled":
                task["reconcile_relations"], task["reconcile_merged"], task["reconcile_progress"] = task["extraction_facts"], e.n, task["extraction_facts"]
            else:
                task["errors"].append(f"reconciliation failed: {e.message}")
            task["reconcile_status"] = "completed"
            self._end(task, "completed", e.at)
        elif e.kind == "failed":
            task["errors"].append(e.message)
            self._end(task, "failed", e.at)
        if task["status"] == "processing" and task["extraction_status"] == "running" and task["handled"] >= task["extraction_chunks"]:
            task["extraction_status"] = "completed"
            if task["extraction_facts"]:
                task["reconcile_status"] = "running"
            else:
                task["reconcile_status"] = "skipped"
                self._end(task, "completed", e.at)

    def _time_out(self, task: dict) -> None:
        task["errors"].append("timed out")
        self._end(task, "failed", task["due"])

    def __call__(self, key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        task, blocks = self._read(state)
        if state.hasTimedOut:
            self._time_out(task)
        else:
            events = sorted(_Event(**e) for frame in frames for e in frame["event"])
            for e in events:
                self._step(task, blocks, e)
            if task["status"] == "processing":
                task["due"] = max(events[-1].at + self.timeout, task["due"] or 0)
                if task["due"] <= state.getCurrentWatermarkMs():
                    self._time_out(task)
        if task["status"] == "processing":
            state.setTimeoutTimestamp(task["due"] - 1)  # it comes once the watermark is beyond that
        else:  # a task that has ended counts no more chunks
            task["due"], blocks = None, {}
        task["version"] += 1
        row = tuple(task[f] for f in _FIELDS)
        state.update((*row, blocks))
        yield pd.DataFrame([(*key, *row)], columns=["task_id", *_FIELDS], dtype=object)


def task_records(events: DataFrame, timeout: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Import tasks (task_id, RECORD's columns; created and completed as timestamps) as they change, from a stream of EVENTS: one row for each task that a batch has changed, the one of the highest version being
    the task as it stands.

    A task is processing until it is completed, failed or rolled back. `created` with n = 0 asks for no processing; `chunked` says in n how many chunks there are (none: the task is completed); each chunk is `extracted`
    (n facts) or `chunk_failed`, and after the last of them the task waits for reconciliation, or is completed where no facts were found; `reconciled` (n memories) and `reconcile_failed` complete it; `failed` ends it; `rolled_back`
    counts at any time. A task that hears nothing for `timeout` of event time fails. Events of a batch count by time and kind; ones that come again change nothing; events more than `late` behind the newest are left out by
    the watermark. Events without a task, kind or time are left out; a null n or part counts as 0, a null message as empty."""
    ms = events.sparkSession.sql(f"SELECT CAST(unix_millis(timestamp_millis(0) + INTERVAL {timeout}) AS BIGINT) AS ms").first()["ms"]
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    rows = events.where("task_id IS NOT NULL AND at IS NOT NULL").where(F.col("kind").isin(*KINDS)).withWatermark("at", late)
    zero, none = F.lit(0).cast("long"), F.lit("")
    event = F.struct(F.unix_millis("at").alias("at"), rank.alias("rank"), F.coalesce("part", zero).alias("part"), F.coalesce("n", zero).alias("n"), F.coalesce("message", none).alias("message"), "kind")
    rows = rows.select("task_id", "at", event.alias("event"))  # few columns, as each is converted for each task
    out = rows.groupBy("task_id").applyInPandasWithState(_Tasks(ms), f"task_id string, {RECORD}", _STATE, "update", GroupStateTimeout.EventTimeTimeout)
    return out.withColumns({c: F.timestamp_millis(c) for c in ("created", "completed")})


def chunk_events(chunks: DataFrame, id_: str, facts: Column, at: Column) -> DataFrame:
    """EVENTS of import tasks from the chunks of their texts (chunk.import_chunks): how many there are, and the facts found in each; null facts mean that the extraction failed. A task without chunks has no rows here. The
    chunks of a task that has only one and whose extraction failed end it as failed, as a whole document is one request."""
    null = F.lit(None).cast("string")
    one = chunks.select(F.col(id_).cast("string").alias("task_id"), F.col("part").cast("long").alias("part"), facts.cast("long").alias("n"), (F.col("hint") == "short_note").alias("whole"), at.alias("at"))
    kind = F.when(F.col("n").isNotNull(), "extracted").when(F.col("whole"), "failed").otherwise("chunk_failed")
    each = one.select("task_id", kind.alias("kind"), "part", "n", F.when(F.col("n").isNull(), "no answer").alias("message"), "at")
    total = one.groupBy("task_id").agg(F.countDistinct("part").alias("n"), F.min("at").alias("at")).select("task_id", F.lit("chunked").alias("kind"), F.lit(None).cast("long").alias("part"), "n", null.alias("message"), "at")
    return total.unionByName(each)


def finished(stream: DataFrame, checkpoint: str, out: str, schema=None) -> DataFrame:
    """The rows a stream of records gives until its source is read to the end, written below `out` batch by batch, so a batch that runs again replaces its own."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    spark = stream.sparkSession
    with rocksdb(spark):
        query = stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema or stream.schema).parquet(out)


def latest(records: DataFrame) -> DataFrame:
    """Each task as it stands: its row of the highest version."""
    columns = [c for c in records.columns if c not in ("task_id", "batch")]
    return records.groupBy("task_id").agg(F.max_by(F.struct(*columns), "version").alias("r")).select("task_id", "r.*")
