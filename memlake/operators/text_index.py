"""A stored inverted index for BM25: postings are written once, a search reads those of its terms alone.

Tasks invert some thousand documents at a time. Postings of a term and field are kept in blocks of equal level: alike in how often the term occurs and how long the text is, so alike in weight. A block is a row with its documents,
their counts and lengths, and the bounds of both. Tables are partitioned by a hash of the term and sorted by it. What is added later is a segment of its own; merge() makes one of all.

A search first reads the levels of its terms (at most LEVELS a term and field). They tell how many texts have a term, the most that a level can give, and a score that k documents have at least:
levels whose most, with the most that all other terms can give, stays under that score hold none of the k best and aren't read (max-score).
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.operators.retrieve import B, FIELDS, K1, tokens
from memlake.sources.store import Table

#: A task inverts so many documents, or so many bytes of them, at a time, which bounds a block and its memory.
SHARD, BYTES = 4096, 8 << 20
#: Counts from TOP on are one class, and lengths go by powers of two: a term and field has LEVELS levels at most.
TOP, LENGTHS = 7, 32
LEVELS = (TOP + 1) * LENGTHS + 1
#: Fewer postings of a term among the documents that a task inverts at a time are one block, of level -1.
RARE = 32
#: So many removed documents are a set that a merge compares with; more are joined.
FEW = 5000
#: A merge takes so many bytes of files at a time, but a bucket at least; and sends so many removed ids to all tasks at most.
SLICE, SENT = 64 << 20, 1_000_000
#: What stands for all texts of a field: no text holds the empty term.
ALL = ""
POST = T.StructType([T.StructField("id", T.StringType()), T.StructField("tf", T.IntegerType()), T.StructField("len", T.IntegerType())])
FIGURES = ("min_tf", "max_tf", "min_len", "max_len")
POSTINGS = T.StructType([
    T.StructField("bucket", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("field", T.IntegerType()), T.StructField("level", T.IntegerType()), T.StructField("shard", T.LongType()),
    T.StructField("posts", T.ArrayType(POST)), T.StructField("n", T.LongType()), T.StructField("total", T.LongType()), *(T.StructField(c, T.IntegerType()) for c in FIGURES),
])


def inverted(batches: Iterator[pa.RecordBatch], fields: int) -> Iterator[pa.RecordBatch]:
    """Rows of POSTINGS (without bucket) of documents (id, words of each field, joined by blanks), some thousands at a time."""
    kind = pa.struct([("id", pa.string()), ("tf", pa.int32()), ("len", pa.int32())])

    def rows(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        ids = table.column(0).combine_chunks()
        shard = zlib.crc32((ids[0].as_py() or "").encode())  # of all blocks of these documents
        for f in range(fields):
            words = [t.split() for t in table.column(1 + f).to_pylist()]
            lengths = np.array([len(w) for w in words], dtype=np.int64)
            codes, terms = pd.factorize(np.array([*itertools.chain.from_iterable(words)], dtype=object))
            pairs, tf = np.unique(np.repeat(np.arange(len(words)), lengths) * max(1, len(terms)) + codes, return_counts=True)
            doc, term = np.append(pairs // max(1, len(terms)), np.arange(len(words))), np.append(pairs % max(1, len(terms)), np.full(len(words), len(terms)))
            tf, names = np.append(tf, np.zeros(len(words), dtype=np.int64)), pa.array([*terms, ALL], pa.string())
            level = np.minimum(tf, TOP) * LENGTHS + np.minimum(np.floor(np.log2(lengths[doc] + 1)).astype(np.int64), LENGTHS - 1)
            level[np.bincount(term)[term] < RARE] = -1
            level[len(pairs) :] = 0
            order = np.lexsort((doc, level, term))
            doc, term, tf, level = doc[order], term[order], tf[order], level[order]
            start = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (level[1:] != level[:-1])]))
            size, length = np.diff(np.append(start, len(doc))), lengths[doc]
            posts = pa.StructArray.from_arrays([ids.take(pa.array(doc)), pa.array(tf.astype(np.int32)), pa.array(length.astype(np.int32))], fields=list(kind))
            posts = pa.ListArray.from_arrays(pa.array(np.append(start, len(doc)).astype(np.int32)), posts)
            ends = [op.reduceat(c, start).astype(np.int32) for c in (tf, length) for op in (np.minimum, np.maximum)]
            columns = [names.take(pa.array(term[start])), pa.array(np.full(len(start), f, dtype=np.int32)), pa.array(level[start].astype(np.int32)), pa.array(np.full(len(start), shard, dtype=np.int64)), posts, pa.array(size.astype(np.int64)), pa.array(np.add.reduceat(length, start).astype(np.int64)), *map(pa.array, ends)]
            out = pa.RecordBatch.from_arrays(columns, names=["term", "field", "level", "shard", "posts", "n", "total", *FIGURES])
            yield from (out.slice(x, 4096) for x in range(0, len(out), 4096))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        for x in range(0, len(batch), 256):
            held.append(batch.slice(x, 256))
            if sum(map(len, held)) >= SHARD or sum(b.nbytes for b in held) >= BYTES:
                yield from rows(held)
                held = []
    if held:
        yield from rows(held)


class TextIndex:
    """An index in a folder over string ids and text fields. Null texts count as empty; ids are unique: one that was removed may be added again after a merge."""

    def __init__(self, spark: SparkSession, path: str, fields: tuple[str, ...] = FIELDS, buckets: int = 16):
        self.spark, self.fields, self.buckets = spark, fields, buckets
        self.table, self.removed = Table(spark, f"{path}/postings", POSTINGS, "bucket"), Table(spark, f"{path}/removed", T.StructType([T.StructField("id", T.StringType())]))

    def _placed(self, blocks: DataFrame) -> DataFrame:
        """Blocks sorted by bucket and term."""
        blocks = blocks.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))
        return blocks.sortWithinPartitions("bucket", "term", "field", "level")

    def add(self, docs: DataFrame) -> None:
        """Documents (id and the fields) as a new segment: one pass over their texts without any exchange; each task writes a file for each bucket, and merge() fewer."""
        n = len(self.fields)
        rows = docs.select(F.col("id").cast("string").alias("id"), *(F.array_join(tokens(F.coalesce(F.col(f), F.lit(""))), " ").alias(f"w{i}") for i, f in enumerate(self.fields)))
        schema = T.StructType([f for f in POSTINGS.fields if f.name != "bucket"])
        self.table.append(self._placed(rows.mapInArrow(lambda batches: inverted(batches, n), schema)))

    def remove(self, ids: DataFrame) -> None:
        """Documents (id) that no search finds from now on. Statistics count them until the next merge."""
        self.removed.append(ids.select(F.col("id").cast("string").alias("id")))

    def merge(self) -> None:
        """One segment of all, without what was removed. Some buckets are merged at a time, and what was exchanged for them is deleted when they are written, so a merge takes the disk of the
        merged table and of a slice."""
        gone = self.removed.read().distinct()
        few = [r["id"] for r in gone.limit(FEW + 1).collect()]
        table, lost = self.table.read(), None
        if len(few) > FEW:
            # blocks of all texts tell which documents a shard has, so a shard's blocks meet the few that it loses, and no posting is dealt by itself
            shard = F.coalesce("shard", F.lit(0).cast("long")).alias("shard")
            own = table.where(F.col("bucket").isin(self._buckets([ALL])) & (F.col("term") == ALL) & (F.col("field") == 0)).select(shard, F.explode("posts.id").alias("id"))
            lost = own.join(gone, "id", "left_semi").groupBy("shard").agg(F.collect_list("id").alias("_gone")).persist()
            lost = F.broadcast(lost) if self.removed.read().count() <= SENT else lost
        parts = max(1, -(-int(table.where(F.col("bucket").isin(self._buckets([ALL])) & (F.col("term") == ALL)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // (SHARD * len(self.fields))))
        slices = min(self.buckets, max(1, -(-self.table.bytes() // SLICE)))
        cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(cleanup, None)
        self.spark.conf.set(cleanup, "true")
        try:
            self.table.replace(self._merged(table.where(F.col("bucket").isin(list(range(x, self.buckets, slices)))), few, lost, parts) for x in range(slices))
        finally:
            self.spark.conf.unset(cleanup) if before is None else self.spark.conf.set(cleanup, before)
            if lost is not None:
                lost.unpersist()
        self.removed.replace(gone.limit(0))

    def _merged(self, rows: DataFrame, few: list[str], lost: DataFrame | None, parts: int) -> DataFrame:
        """Blocks of some buckets without the removed documents: those of `few`, or of `lost` (shard, _gone)."""
        rows = rows.select("term", "field", "level", F.coalesce("shard", F.lit(0).cast("long")).alias("shard"), "posts")
        if lost is not None:
            rows = rows.join(lost, "shard", "left")
            meets = F.col("_gone").isNotNull() & F.arrays_overlap(F.transform("posts", lambda p: p["id"]), "_gone")
            rows = rows.withColumn("posts", F.when(F.coalesce(meets, F.lit(False)), F.filter("posts", lambda p: ~F.array_contains("_gone", p["id"]))).otherwise(F.col("posts"))).where(F.size("posts") > 0).drop("_gone")
        elif few:
            rows = rows.withColumn("posts", F.filter("posts", lambda p: ~p["id"].isin(few))).where(F.size("posts") > 0)
        rows = rows.groupBy("term", "field", "level", F.pmod(F.xxhash64("shard"), F.lit(parts)).cast("long").alias("shard")).agg(F.flatten(F.collect_list("posts")).alias("posts"))  # a few shards
        ends = [op(F.col(f"posts.{c}")).alias(f"{name}_{c}") for c in ("tf", "len") for name, op in (("min", F.array_min), ("max", F.array_max))]
        total = F.aggregate("posts", F.lit(0).cast("long"), lambda a, p: a + p["len"]).alias("total")
        return self._placed(rows.select("term", "field", "level", "shard", "posts", F.size("posts").cast("long").alias("n"), total, *ends))

    def plan(self, asked: list[str], k: int) -> tuple[DataFrame, float, int, int]:
        """(term, field, level, df, most, read) of each level of the asked terms; the score that k documents have at least; the number of documents, and of blocks that are there. A level isn't
        read if its documents can't be among the k best."""
        found = self._asked([*asked, ALL]).groupBy("term", "field", "level").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.count(F.lit(1)).alias("blocks"), *(getattr(F, c[:3])(c).alias(c) for c in FIGURES)).collect()  # LEVELS rows for each term and field
        every_text = {r["field"]: r for r in found if r["term"] == ALL}
        if not every_text:
            return self.spark.createDataFrame([], "term string, field int, level int, df long, average double, read boolean"), 0.0, 0, 0
        found = [r for r in found if r["term"] != ALL]
        n, average = every_text[0]["n"], {f: max(r["total"] / r["n"], 1e-9) for f, r in every_text.items()}
        df: dict = {}
        for r in found:
            df[r["term"], r["field"]] = df.get((r["term"], r["field"]), 0) + r["n"]
        value = lambda r, tf, length: math.log(1 + (n - df[r["term"], r["field"]] + 0.5) / (df[r["term"], r["field"]] + 0.5)) * r[tf] * (K1 + 1) / (r[tf] + K1 * (1 - B + B * r[length] / average[r["field"]]))
        most, lists = {}, {}
        for r in found:
            key = r["term"], r["field"]
            most[key] = max(most.get(key, 0.0), value(r, "max_tf", "min_len"))
            lists.setdefault(key, []).append((value(r, "min_tf", "max_len"), r["n"]))
        enough, least = k + self.removed.read().count(), 0.0
        for own in lists.values():
            seen = 0
            for floor, count in sorted(own, reverse=True):
                seen += count
                if seen >= enough:
                    least = max(least, floor)
                    break
        every = sum(most.values())
        rows = [(r["term"], r["field"], r["level"], df[r["term"], r["field"]], average[r["field"]], value(r, "max_tf", "min_len") + every - most[r["term"], r["field"]] >= least - 1e-5) for r in found]
        return self.spark.createDataFrame(rows, "term string, field int, level int, df long, average double, read boolean"), least, n, sum(r["blocks"] for r in found)

    def _buckets(self, asked: list[str]) -> list[int]:
        row = self.spark.range(1).select(*(F.pmod(F.xxhash64(F.lit(t)), F.lit(self.buckets)).cast("int").alias(f"b{i}") for i, t in enumerate(asked))).first()
        return sorted(set(row))

    def _asked(self, asked: list[str]) -> DataFrame:
        """Blocks of the asked terms: their buckets are partitions, their terms a filter that the scan knows."""
        return self.table.read().where(F.col("bucket").isin(self._buckets(asked)) & F.col("term").isin(asked))

    def search(self, query: str | list[str], k: int) -> DataFrame:
        """(id, score) of the k best documents, scores summed over the fields and rounded to six places; of equal ones the smaller id."""
        asked = sorted({t for t in (query if isinstance(query, list) else [query])})
        asked = sorted({r[0] for r in self.spark.createDataFrame([(t,) for t in asked], "t string").select(F.explode(tokens(F.col("t")))).collect()}) if asked else []  # the words of one query
        none = self.spark.createDataFrame([], "id string, score double")
        if not asked:
            return none
        levels, _, n, _ = self.plan(asked, k)
        if not n:
            return none
        posts = self._asked(asked).join(F.broadcast(levels.where("read")), ["term", "field", "level"]).select("df", "average", F.inline("posts"))
        idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        own = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("average")))
        scores = posts.select("id", own.alias("w")).join(F.broadcast(self.removed.read().distinct()) if self._few_removed() else self.removed.read().distinct(), "id", "left_anti")
        return scores.groupBy("id").agg(F.round(F.sum("w"), 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(k)

    def _few_removed(self, most: int = 100_000) -> bool:
        return self.removed.read().count() <= most
