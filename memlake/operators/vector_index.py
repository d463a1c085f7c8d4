"""An approximate vector index: cells around centres found by k-means, each cell's vectors as eight-bit codes in a partition of its own. A search reads the cells nearest to each query,
ranks their codes, and ranks the best of these again by the original vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.functions import scoring
from memlake.operators.knn import BLOCK, matrix, meet, units
from memlake.sources.store import Table

#: Centres are fitted on about so many vectors at most; all vectors are in the index. There are CELLS cells at most.
FIT, CELLS = 100_000, 4096
LISTS = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("id", T.StringType()), T.StructField("code", T.BinaryType())])


class VectorIndex:
    """An index in a folder over string ids and vectors of one length, by cosine. Null and zero vectors aren't in it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.lists = Table(spark, f"{path}/lists", LISTS, "cell")

    @staticmethod
    def _usable(rows: DataFrame) -> DataFrame:
        return rows.where("vector is not null").where(F.exists("vector", lambda x: x != 0))

    def build(self, rows: DataFrame, cells: int | None = None, seed: int = 7) -> None:
        """Index rows (id, vector) in place of what was there. There are as many cells as the root of the number of rows, unless told otherwise."""
        rows = self._usable(rows.select(F.col("id").cast("string").alias("id"), "vector"))
        n = rows.count()
        k = max(2, min(CELLS, cells or int(n**0.5)))
        sample = rows if n <= FIT else rows.where(F.pmod(F.xxhash64(F.lit("fit"), "id"), F.lit(1 << 30)) < int((1 << 30) * FIT / n))
        fitted = KMeans(k=k, maxIter=8, seed=seed, distanceMeasure="cosine", featuresCol="v").fit(sample.select(array_to_vector(F.col("vector").cast("array<double>")).alias("v"))) if n >= 2 else None
        centres = [c.tolist() for c in fitted.clusterCenters()] if fitted else [r["vector"] for r in rows.collect()]  # CELLS at most
        frame = self.spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell int, centre array<double>")
        self.lists.replace(self._coded(rows, np.array(centres, dtype=np.float64)), centres=frame, vectors=rows)

    def append(self, rows: DataFrame) -> None:
        """More rows, in the cells that are there."""
        rows = self._usable(rows.select(F.col("id").cast("string").alias("id"), "vector"))
        self.lists.append(self._coded(rows, self._centres()), vectors=rows)

    def _centres(self) -> np.ndarray:
        return np.array([r["centre"] for r in self.lists.part("centres").orderBy("cell").collect()], dtype=np.float64)  # CELLS at most

    def _coded(self, rows: DataFrame, centres: np.ndarray) -> DataFrame:
        points = units(centres)

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = units(matrix(batch.column("vector")))
                codes = np.round(x / np.abs(x).max(1, keepdims=True) * 127).astype(np.int8)  # a row's scale doesn't matter to its cosine
                yield pa.RecordBatch.from_arrays([pa.array((x @ points.T).argmax(1).astype(np.int32)), batch.column("id"), pa.array([c.tobytes() for c in codes], pa.binary())], names=["cell", "id", "code"])

        return rows.select("id", "vector").mapInArrow(code, "cell int, id string, code binary").repartition("cell")

    def probed(self, queries: DataFrame, probes: int) -> DataFrame:
        """(key, vector, cell): the cells nearest to each query (key, vector)."""
        points = units(self._centres())
        kinds = f"key {queries.schema['key'].dataType.simpleString()}, vector {queries.schema['vector'].dataType.simpleString()}, cells array<int>"

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scores = units(matrix(batch.column("vector"))) @ points.T
                cells = np.argsort(-scores, axis=1, kind="stable")[:, :probes].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(cells), pa.list_(pa.int32()))], names=["key", "vector", "cells"])

        return self._usable(queries.select("key", "vector")).mapInArrow(near, kinds).select("key", "vector", F.explode("cells").alias("cell"))

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8, again: int = 4, report: list | None = None) -> DataFrame:
        """(key, id, score, rank): about the k nearest of each query (key, vector), by exact cosines rounded to six places; `again` times k are ranked by their vectors. `report` gets the share of
        rows that a query's cells hold, on average."""
        asked = self.probed(queries, probes)
        sizes = self.lists.read().groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each cell
        if report is not None:
            held, total = {r["cell"]: r["n"] for r in sizes}, sum(r["n"] for r in sizes)
            count = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
            report.append(sum(held.get(c, 0) * n for c, n in count.items()) / max(1, total) / max(1, queries.count()))
        layout = self.spark.createDataFrame([(r["cell"], -(-r["n"] // BLOCK)) for r in sizes], "cell int, parts int")
        wanted = [r["cell"] for r in asked.select("cell").distinct().collect()]
        lists = self.lists.read().where(F.col("cell").isin(wanted))  # their partitions alone are read
        data = lists.join(F.broadcast(layout), "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("way"), "id", "code")
        asked = asked.join(F.broadcast(layout), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("way"), "key", "vector", F.lit(-2.0).alias("least"))
        read = lambda batch: units(np.array([np.frombuffer(c, dtype=np.int8) for c in batch.column("code").to_pylist()], dtype=np.float64))
        order = Window.partitionBy("key").orderBy(F.desc("score"), "id")
        top = lambda rows, n: rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
        found = top(meet(data, asked, again * k, read), again * k).select("key", "id")
        found = found.join(self.lists.part("vectors").withColumnRenamed("vector", "own"), "id").join(queries.select("key", "vector"), "key")
        return top(found.select("key", "id", F.round(scoring.cosine(F.col("own"), F.col("vector")), 6).alias("score")), k)
