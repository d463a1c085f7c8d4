"""Reading tables, writing intermediate tables to the shared folder, and labelled samples."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
#: Of each thread: the paths that each settled() under way has written so far, the innermost last.
_calls = threading.local()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only where none is set, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = getattr(spark, "_memlake_folder", None) or tempfile.mkdtemp(prefix="memlake-")
        spark._memlake_folder = folder
    return folder.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/memlake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    for call in getattr(_calls, "open", []):
        call.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """cut(make()), after which the tables that make() wrote on its way, in this thread, are deleted."""
    own: list[str] = []
    _calls.open = [*getattr(_calls, "open", []), own]
    try:
        out = cut(make(), name)
    finally:
        _calls.open = _calls.open[:-1]
    for item in [x for x in _written if x[1] in own[:-1]]:
        _delete(*item)
        _written.remove(item)
    return out


def remove(df: DataFrame) -> None:
    """Delete the files of a cut() table that nothing will read again."""
    files = df.inputFiles()
    for item in list(_written):
        spark, path = item
        if files and path.rpartition("/")[2] in files[0]:
            _delete(spark, path)
            _written.remove(item)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone at exit; then the folder's owner cleans it
            return


def text_of(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def fold(column: str = "doc_id"):
    """crc32 of the id as text, modulo 4; 2 marks held-out rows. Spark's crc32 is the unsigned IEEE checksum."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 4


def bounded_sample(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """About `bound` rows at most, picked by a hash of the key; all rows if there are fewer. Every run picks the same."""
    n = rows.count()
    if n <= bound:
        return rows
    share = bound / n
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) < int(share * (1 << 30)))


def small_batches(spark: SparkSession, rows: int = 1024, most: int = 4 << 20) -> None:
    """Arrow batches of so many rows and bytes at most, as single texts may be long. These are bounds of memory alone: no result depends on them, and lower ones of the
    session's own stay."""
    for key, bound in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", most)):
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= bound:
            spark.conf.set(key, str(bound))
