"""Running totals over groups of any size. Rows are cut into ranges of their order; a first pass totals each range, a second adds to each row's total within its range what the
ranges of its group before it hold. A group of all rows so runs on as many tasks as there are ranges, and no task needs more of a group than its own range."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What can be totalled: the aggregate, and how the totals of two runs of rows give that of both. All are associative and have a neutral value (0).
KINDS: dict[str, tuple[Callable, Callable]] = {"sum": (F.sum, lambda a, b: a + b), "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b))}


def ranged(rows: DataFrame, by: list[str], order: list[Column], keep: list, hold: Callable[[DataFrame, str], DataFrame], parts: int | None = None) -> DataFrame:
    """The columns `keep` of rows with _range and _row, both ascending in (by, order). Where ranges end is told by a sample, which another run may draw otherwise, so the result is
    written once by `hold` and read back."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*(F.col(c) for c in by), *order]
    placed = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return hold(placed.select(*keep, F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_row")), "ranged")


def running(rows: DataFrame, by: list[str], order: list, totals: dict[str, tuple[str, Column]]) -> DataFrame:
    """rows (with _range, which ascends in the order within each group `by`) with the running total of each column of `totals` (name: kind and column), this row included.
    Null keys form groups of their own; null values count as 0."""
    values = {name: F.coalesce(column, F.lit(0)) for name, (_, column) in totals.items()}
    inner = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumns({name: KINDS[kind][0](values[name]).over(inner) for name, (kind, _) in totals.items()})
    each = rows.groupBy("_range", *by).agg(*(KINDS[kind][0](values[name]).alias(name) for name, (kind, _) in totals.items()))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range that holds a part of the group
    offsets = each.select(F.col("_range").alias("_r"), *(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), *(F.coalesce(KINDS[kind][0](name).over(before), F.lit(0)).alias(f"_before_{name}") for name, (kind, _) in totals.items()))
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    joined = local.join(offsets, same)
    joined = joined.withColumns({name: KINDS[kind][1](F.col(name), F.col(f"_before_{name}")) for name, (kind, _) in totals.items()})
    return joined.drop("_r", *(f"_by{i}" for i in range(len(by))), *(f"_before_{name}" for name in totals))
