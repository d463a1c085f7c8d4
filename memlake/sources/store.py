"""Tables of the store on disk: snapshots partitioned by space, append-only logs, imports."""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from memlake.operators.scan import evolve, soft_delete
from memlake.sources.tables import drop


def uri(options: dict) -> str:
    """Where tables are kept: an OSS bucket if one is set, else an S3 bucket, else a local folder."""
    if options.get("oss_bucket"):
        return f"oss://{options['oss_bucket']}"
    return f"s3a://{options['s3_bucket']}" if options.get("s3_bucket") else options.get("path", "./memlake-data")


class Table:
    """A Parquet table of a declared schema. A snapshot (v=N) or what is appended to it (a=N) is written to a folder of its own, which counts once its mark is there, so readers see a change whole
    or not at all. N is claimed by creating a file, so two writers never share a folder. A snapshot can have parts besides its rows (a ledger, say), which count with it."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, partition: str | None = None):
        self.spark, self.path, self.schema, self.partition = spark, path, schema, partition
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self) -> list[tuple[int, str]]:
        """Numbers and names of all folders and claims."""
        if not self._fs.exists(self._at(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self.path))]
        return sorted((int(n.partition("=")[2]), n) for n in names if n.startswith(("v=", "a=", "_claim=")))

    def _done(self) -> list[tuple[int, str]]:
        """The latest whole snapshot and what was appended since."""
        whole = [(n, name) for n, name in self._names() if name[0] in "va" and self._fs.exists(self._at(f"{self.path}/{name}/_DONE"))]
        first = max((n for n, name in whole if name[0] == "v"), default=0)
        return [(n, name) for n, name in whole if n >= first]

    def _claim(self) -> int:
        n = max((n for n, _ in self._names()), default=0) + 1
        while not self._fs.createNewFile(self._at(f"{self.path}/_claim={n}")):  # another writer has it
            n += 1
        return n

    def _write(self, name: str, rows: DataFrame | Iterable[DataFrame], parts: dict[str, DataFrame]) -> None:
        for each in [rows] if isinstance(rows, DataFrame) else rows:
            out = evolve(each, self.schema).write.mode("append")
            (out.partitionBy(self.partition) if self.partition else out).parquet(f"{self.path}/{name}/rows")
        for part, frame in parts.items():
            frame.write.parquet(f"{self.path}/{name}/{part}")
        self._fs.createNewFile(self._at(f"{self.path}/{name}/_DONE"))

    def read(self) -> DataFrame:
        """The latest snapshot with what was appended to it; columns that its files lack are null."""
        done = self._done()
        if not done:
            return self.spark.createDataFrame([], self.schema)
        each = [evolve(self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/{name}/rows"), self.schema) for _, name in done]
        return functools.reduce(DataFrame.unionByName, each)

    def part(self, name: str) -> DataFrame | None:
        """A part of the latest snapshot and of what was appended to it, if they have one of that name."""
        each = [f"{self.path}/{folder}/{name}" for _, folder in self._done()]
        each = [self.spark.read.parquet(at) for at in each if self._fs.exists(self._at(at))]
        return functools.reduce(DataFrame.unionByName, each) if each else None

    def bytes(self) -> int:
        """Of the files that read() reads."""
        return sum(self._fs.getContentSummary(self._at(f"{self.path}/{name}/rows")).getLength() for _, name in self._done())

    def replace(self, rows: DataFrame | Iterable[DataFrame], **parts: DataFrame) -> None:
        """The next snapshot; of several frames, each is asked for when the one before is written. The snapshot before stays for those who read it; older ones, and folders of writers that failed before it, go."""
        before = self._done()
        n = self._claim()
        self._write(f"v={n}", rows, parts)
        for old, name in self._names():
            if before and old < before[0][0]:
                self._fs.delete(self._at(f"{self.path}/{name}"), True)

    def append(self, rows: DataFrame, **parts: DataFrame) -> None:
        if not self._done():
            return self.replace(rows, **parts)
        return self._write(f"a={self._claim()}", rows, parts)


def files(spark: SparkSession, glob: str, longest: int = 50 << 20) -> DataFrame:
    """(path, kind, content, size) of files within the size limit."""
    f = spark.read.format("binaryFile").load(glob).where(F.col("length") <= longest)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = (
        F.when(ext == "pdf", "pdf").when(ext.isin("png", "jpg", "jpeg", "gif", "webp", "bmp"), "image").when(ext.isin("mp4", "mov", "avi", "mkv", "webm"), "video")
        .when(ext.isin("rs", "py", "js", "mjs", "ts", "mts", "go"), "code").otherwise("text")
    )
    return f.select("path", kind.alias("kind"), "content", F.col("length").alias("size"))


def imports(spark: SparkSession, glob: str, stored: DataFrame, force: bool = False) -> DataFrame:
    """(path, content, content_hash) of text files whose content isn't stored yet."""
    rows = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    rows = rows.withColumn("content_hash", F.sha2(F.col("content").cast("binary"), 256))
    return rows if force else rows.join(stored.select("content_hash"), "content_hash", "left_anti")


def rollback(memories: DataFrame, sessions: DataFrame, task: str, started) -> tuple[DataFrame, DataFrame]:
    """The next snapshots of memories and sessions without what an import task made since it started."""
    hit = (F.col("source") == "intelligence") & (F.col("created_at") >= started)
    return soft_delete(memories, F.coalesce(hit, F.lit(False))), drop(sessions, F.col("session_id") == f"import-{task}")
