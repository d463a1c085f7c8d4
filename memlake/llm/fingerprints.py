"""Canonical exact digests of documents, with byte comparison inside equal buckets. DataFrame and SQL functions only.

A text is put into Unicode NFKC, its case folded in full, each run of white space made one space and its ends trimmed; 128 bits
of xxhash64 (two differently salted passes) name its bucket. Whether the members of a bucket are equal is then decided
by grouping them by their canonical bytes: of the different texts in a bucket (a collision) all but the smallest get a
suffix, so two fingerprints are equal exactly if the canonical texts are.

Defined cases: a null text counts as empty; empty texts share one fingerprint; rows that repeat a doc_id are rows
of their own, ordered by a hash of their text, then the text; any ids, however far apart; null ids come last; an empty table gives an empty result; other columns
are ignored by the query and kept by fingerprint().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, remove, table, text_of

#: Up to so many members of shared buckets are sent to every task as ids (24 bytes a row); more are joined by a shuffle.
BROADCAST_ROWS = 400_000
#: Rows of a range of doc_ids, and how many ranges there are at most (this bounds the broadcast of their ends).
RANGE_ROWS, MAX_RANGES = 4096, 8192


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again (folding may undo it), white space folded. Texts of ASCII only need lower()."""
    icu = "com.ibm.icu."
    nfkc = lambda x: F.call_function("reflect", F.lit(icu + "text.Normalizer"), F.lit("compose"), x, F.lit(True))
    folded = F.call_function("reflect", F.lit(icu + "lang.UCharacter"), F.lit("foldCase"), nfkc(text), F.lit(True))
    plain = F.octet_length(text) == F.char_length(text)
    return F.trim(F.regexp_replace(F.when(plain, F.lower(text)).otherwise(nfkc(folded)), r"[\s\u0085   -     　]+", " "))


def bucket_key(canonical_text: Column, bits: int = 128) -> Column:
    """Hex name of a text's bucket. Fewer bits than 128 are for tests that want collisions."""
    key = F.concat(F.lpad(F.lower(F.hex(F.xxhash64(canonical_text))), 16, "0"), F.lpad(F.lower(F.hex(F.xxhash64(F.lit("wide"), canonical_text))), 16, "0"))
    return F.substring(key, 1, bits // 4)


def _suffixes(keyed: DataFrame, texts) -> DataFrame | None:
    """keyed: (id, kind, key), kind 0 or 1 for which text of the row; texts(members) gives (id, kind, key, canonical) of such rows.
    Returns (id, kind, suffix, canonical_hash) of the rows whose canonical text isn't the smallest of its bucket; None if all members of each bucket are equal.

    Members are grouped by their bytes, and equal ones are counted together before they are dealt, so no bucket is ever gathered in one task."""
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    members = cut(keyed.join(shared, "key"), "members")
    if members.isEmpty():
        return None
    held = texts(members)
    different = held.select("key", "canonical").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    different = cut(different, "differing")  # collisions alone are left
    if different.isEmpty():
        remove(members)
        return None
    odd = held.join(F.broadcast(different.select("key")) if different.count() <= BROADCAST_ROWS else different.select("key"), "key").select("id", "kind", "key", "canonical")
    odd = cut(odd, "collisions")
    ranks = odd.select("key", "canonical").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("canonical"))).where("rank > 1")
    out = odd.join(ranks, ["key", "canonical"]).select("id", "kind", F.concat(F.lit("-"), F.col("rank").cast("string")).alias("suffix"), F.xxhash64(F.lit("third"), "canonical").alias("canonical_hash"))
    out = cut(out.distinct(), "suffixes")
    remove(members)
    return out


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are computed after what makes the rows: a generator of one element, which no filter, join or projection moves past."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _canonical_of(docs: DataFrame, members: DataFrame, bits: int) -> DataFrame:
    """(id, kind, key, canonical) of members: documents are found by id first, so that only they are made canonical again; a repeated id's other texts go by their key."""
    wanted = members.select("id", "kind", "key").dropDuplicates(["id", "key"])
    wanted = F.broadcast(wanted) if members.count() <= BROADCAST_ROWS else wanted
    own = docs.select(F.col("doc_id").alias("own_id"), text_of().alias("own_text"))
    rows = own.join(wanted, own["own_id"].eqNullSafe(wanted["id"])).select("id", "kind", "key", "own_text")
    return _once(rows, canonical=canonical(F.col("own_text"))).where(bucket_key(F.col("canonical"), bits) == F.col("key")).select("id", "kind", "key", "canonical")


def fingerprint(docs: DataFrame, bits: int = 128) -> DataFrame:
    """docs with a column `fingerprint`, equal exactly for rows whose canonical texts are equal."""
    kept = [c for c in docs.columns if c not in ("fingerprint", "canonical_hash", "odd_id", "suffix", "_c")]
    named = _once(docs.select(*kept), _c=canonical(text_of()))
    keyed = cut(named.select(F.col("doc_id").alias("id"), F.lit(0).alias("kind"), bucket_key(F.col("_c"), bits).alias("key")), "keys")
    odd = _suffixes(keyed, lambda members: _canonical_of(docs, members, bits))
    with_key = named.select(*kept, bucket_key(F.col("_c"), bits).alias("fingerprint"), F.xxhash64(F.lit("third"), "_c").alias("canonical_hash"))
    if odd is None:
        return with_key.drop("canonical_hash")
    odd = odd.where("kind = 0").select(F.col("id").alias("odd_id"), "suffix", F.col("canonical_hash").alias("odd_hash"))
    same = with_key["doc_id"].eqNullSafe(odd["odd_id"]) & (with_key["canonical_hash"] == odd["odd_hash"])
    joined = with_key.join(odd, same, "left")
    return joined.withColumn("fingerprint", F.concat("fingerprint", F.coalesce("suffix", F.lit("")))).select(*kept, "fingerprint")


def _range(id_: Column, order: Column, ends: list, id_type: str) -> Column:
    """The place of a row among the ends of ranges, which ascend: how many lie under its id, found in two steps of about sqrt(len(ends)) comparisons. An id that
    fills several ranges is dealt over them by its `order`, from 0 up to 1."""
    none = F.lit(-1).cast("long")
    if not ends:
        return F.when(id_.isNull(), none).otherwise(0)
    step = max(1, int(len(ends) ** 0.5))
    as_array = lambda xs: F.array(*(F.lit(x) for x in xs)).cast(f"array<{id_type}>")
    below = lambda xs, test: F.size(F.filter(xs, test))
    coarse, fine = as_array(ends[::step]), as_array(ends)
    at = F.greatest(below(coarse, lambda x: x < id_) - 1, F.lit(0)) * step
    under = at + below(F.slice(fine, at + 1, F.lit(step)), lambda x: x < id_)
    held = {x: ends.count(x) for x in set(ends) if ends.count(x) > 1}
    if not held:
        return F.when(id_.isNull(), none).otherwise(under)
    several = F.coalesce(*(F.when(id_ == F.lit(x), F.lit(n)) for x, n in sorted(held.items())), F.lit(0))  # an id that holds several quantiles: there are few
    return F.when(id_.isNull(), none).otherwise(under + F.floor(order * (several + 1)))


def with_next(docs: DataFrame, beside: Callable[[DataFrame], DataFrame], names: tuple[str, ...]) -> DataFrame:
    """(doc_id, text, next_text, next_id, and each of `names` with its next_): beside each row the next one by descending doc_id, the first after the last. `beside` adds
    the columns `names` to rows (doc_id, text); it sees each row once.

    Rows go to ranges of doc_id with about RANGE_ROWS rows, whose ends are quantiles, so that neither gaps nor outliers matter; an id with very many rows is dealt over several by a
    hash of its texts. Inside a range, lead() finds the next row; the first row of the following range stands in as a last row. Null ids come last. One shuffle moves the texts once."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", text_of().alias("text")).withColumn("h", F.xxhash64("text"))
    n = docs.count()
    ranges = max(1, min(MAX_RANGES, -(-n // RANGE_ROWS)))
    shares = [(i + 1) / ranges for i in range(ranges - 1)]
    ends = sorted(docs.agg(F.percentile_approx("doc_id", shares, max(1000, 4 * ranges))).first()[0] or []) if shares else []
    order = F.pmod(F.floor(F.col("h") / F.lit(float(1 << 34))), F.lit(1 << 30)) / F.lit(float(1 << 30))
    ranged = docs.withColumn("order", order)
    ranged = _once(ranged, range=_range(F.col("doc_id"), F.col("order"), ends, id_type))

    firsts = cut(ranged.groupBy("range").agg(F.max(F.struct("doc_id", "order", "h")).alias("top")), "ranges")  # MAX_RANGES + 1 rows at most
    down = Window.orderBy(F.desc("range"))
    firsts = firsts.select(F.lag("range").over(down).alias("above"), "top", F.min("range").over(Window.partitionBy()).alias("lowest"))
    firsts = firsts.select(F.coalesce("above", "lowest").alias("for_range"), F.col("top.doc_id").alias("top_id"), F.col("top.h").alias("top_h"))
    stand_in = docs.withColumn("order", order).join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("top_id")) & (F.col("h") == F.col("top_h")))
    stand_in = stand_in.select("doc_id", "text", "h", "order", F.col("for_range").alias("range")).dropDuplicates(["range"])  # rows that repeat as a whole stand in once
    both = [beside(rows).withColumn("stand_in", F.lit(i)) for i, rows in enumerate((ranged, stand_in))]
    rows = both[0].unionByName(both[1])
    down = Window.partitionBy("range").orderBy("stand_in", F.desc_nulls_last("doc_id"), F.desc("order"), F.desc("h"), "text")
    rows = rows.withColumns({"next_text": F.lead("text").over(down), "next_id": F.lead("doc_id").over(down), **{f"next_{c}": F.lead(c).over(down) for c in names}})
    return rows.where("stand_in = 0").drop("range", "stand_in", "order", "h")


def _edited(text: Column, next_text: Column) -> Column:
    n = F.char_length(text)
    m = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - m), F.substring(next_text, F.lit(1), m))


def edited_fingerprints(docs: DataFrame, bits: int = 128) -> DataFrame:
    """One row for each document: its fingerprint and that of its edited text. Each text is made canonical once before it is dealt, and its edited text once after."""
    texts_ = docs.select("doc_id", text_of().alias("text"))

    def own(rows: DataFrame) -> DataFrame:
        rows = _once(rows, _c=canonical(F.col("text")))
        return rows.withColumns({"key0": bucket_key(F.col("_c"), bits), "hash0": F.xxhash64(F.lit("third"), "_c")}).drop("_c")

    rows = with_next(docs, own, ("key0", "hash0"))
    rows = rows.withColumnsRenamed({"next_key0": "key2", "next_hash0": "hash2"})
    rows = _once(rows, edited=_edited(F.col("text"), F.col("next_text")))
    rows = _once(rows, c1=canonical(F.col("edited")))
    base = cut(
        rows.select(
            "doc_id", "next_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            "key0", "hash0", bucket_key(F.col("c1"), bits).alias("key1"), F.xxhash64(F.lit("third"), "c1").alias("hash1"), "key2", "hash2",
        ),
        "fingerprints",
    )
    keyed = base.select(F.col("doc_id").alias("id"), F.inline(F.array(F.struct(F.lit(0).alias("kind"), F.col("key0").alias("key")), F.struct(F.lit(1).alias("kind"), F.col("key1").alias("key")))))

    def texts(members: DataFrame) -> DataFrame:
        first = _canonical_of(docs, members.where("kind = 0"), bits)
        # edited texts in a shared bucket: seldom; made again from the two documents
        one = members.where("kind = 1").dropDuplicates(["id", "key"])
        count = one.count()
        if count == 0:
            return first
        hint = (lambda x: F.broadcast(x)) if count <= BROADCAST_ROWS else (lambda x: x)
        pair = base.join(hint(one), base["doc_id"].eqNullSafe(one["id"]) & (base["key1"] == one["key"])).select("id", "kind", "key", "next_id", "key0", "key2")
        plain = texts_.select(F.col("doc_id").alias("own_id"), F.col("text").alias("own_text"))
        made = plain.join(hint(pair), plain["own_id"].eqNullSafe(pair["id"])).drop("own_id")
        made = _once(made, c0=canonical(F.col("own_text"))).where(bucket_key(F.col("c0"), bits) == F.col("key0")).drop("c0")
        heads = texts_.select(F.col("doc_id").alias("head_id"), F.col("text").alias("head_text"))
        made = heads.join(made, heads["head_id"].eqNullSafe(made["next_id"]))
        made = _once(made, c2=canonical(F.col("head_text"))).where(bucket_key(F.col("c2"), bits) == F.col("key2")).drop("c2")
        made = _once(made.select("id", "kind", "key", _edited(F.col("own_text"), F.col("head_text")).alias("_e")), canonical=canonical(F.col("_e")))
        return first.unionByName(made.where(bucket_key(F.col("canonical"), bits) == F.col("key")).select("id", "kind", "key", "canonical"))

    odd = _suffixes(keyed, texts)
    for kind, id_, h in ((0, "doc_id", "hash0"), (1, "doc_id", "hash1"), (2, "next_id", "hash2")):
        name = ("fingerprint", "edited_fingerprint", "next_fingerprint")[kind]
        if odd is None:
            base = base.withColumn(name, F.col(f"key{kind}"))
            continue
        named = odd.where(F.col("kind") == kind % 2).select(F.col("id").alias("odd_id"), "suffix", F.col("canonical_hash").alias("odd_hash"))
        base = base.join(named, base[id_].eqNullSafe(named["odd_id"]) & (base[h] == named["odd_hash"]), "left").withColumn(name, F.concat(f"key{kind}", F.coalesce("suffix", F.lit("")))).drop("odd_id", "suffix", "odd_hash")
    like = lambda other: (F.col("fingerprint") == F.col(other)).cast("double")  # noqa: E731  an exact digest is alike or not
    return base.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("edited_fingerprint").alias("near_edited"), like("next_fingerprint").alias("near_next"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
