"""Vector bin packing of examples into sequences, under limits on tokens, segments and loss-bearing tokens at once.

Each partition of the input packs its own rows and holds a pool of waiting examples, so rows are never shuffled and memory is bounded. A
sequence takes, again and again, the example with the largest dot product of its demand and the sequence's remaining room
(both as shares of the limits) among those that fit. If examples may be cut, the one that serves the last room is cut to fill it exactly, and
what a partition has left at its end goes to sequences whose lengths are powers of two, which need no padding.

Defined cases: a null or empty text is its end id alone; texts longer than a sequence fill sequences of their own first; equal texts and
repeated rows are packed as separate examples; an empty table gives no rows; other columns are ignored. A sequence's number holds its
partition's, so a task that runs again gives the same numbers.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .shared import small_batches, table, text_of

LIMIT, POOL, END_ID = 1024, 256, 0
#: A pool isn't packed before it holds so many sequences' tokens, however short its examples are.
DEPTH = 4
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a text by the tokenizer in `path`, without added special tokens; strings of special tokens in a text are what the tokenizer takes them for. If the same vocabulary lies beside
    it as ranks, these are used for texts without such strings: the same ids, six times as fast."""
    import json
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    def slow(text: str) -> np.ndarray:
        own = functools.cache(lambda: Tokenizer.from_file(path))() if not hasattr(slow, "own") else slow.own
        slow.own = own
        return np.array(own.encode(text, add_special_tokens=False).ids, dtype="<u4")

    ranks = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return slow
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    with open(path, encoding="utf-8") as said:
        special = [t["content"] for t in json.load(said)["added_tokens"]]
    core = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})._core_bpe

    def fast(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return slow(text)
        try:
            return np.frombuffer(core.encode_to_tiktoken_buffer(text, set()), dtype="<u4")
        except BaseException as error:  # noqa: BLE001 - its pattern engine gives up on very long runs of one kind, as a Rust panic
            if isinstance(error, (KeyboardInterrupt, SystemExit, GeneratorExit)):
                raise
            return slow(text)

    return fast


class Packer:
    """Packs examples (key, tokens, loss tokens). add() and finish() yield (key, start, length, sequence, offset)."""

    def __init__(self, limit: int = LIMIT, segments: int | None = None, loss: int | None = None, cut: bool = True, pool: int = POOL):
        self.limits = np.array([limit, segments or limit, loss or limit], dtype=float)  # without a limit on segments there can be as many as tokens
        self.cut, self.pool, self.sequence = cut, pool, 0
        self.keys: list = []
        self.starts = np.zeros(0, dtype=np.int64)
        self.sizes = np.zeros((0, 2), dtype=np.int64)  # tokens, loss tokens of the waiting examples
        self.waiting: list[tuple] = []

    def add(self, key, tokens: int, loss: int | None = None) -> Iterator[tuple]:
        loss, limit, start = tokens if loss is None else loss, int(self.limits[0]), 0
        if self.cut:
            if loss != tokens:
                raise ValueError("examples with tokens that bear no loss aren't cut")
            while tokens - start >= limit <= self.limits[2] and self.limits[1] >= 1:
                yield key, start, limit, self.sequence, 0
                self.sequence, start = self.sequence + 1, start + limit
        elif tokens > limit or loss > self.limits[2]:
            raise ValueError(f"example {key!r} exceeds a sequence")
        if tokens > start or tokens == 0:
            self.waiting.append((key, start, tokens - start, tokens - start if self.cut else loss))
        if len(self.waiting) >= self.pool:
            self._take()
            while len(self.keys) > self.pool // 2 and self.sizes[:, 0].sum() >= DEPTH * limit:
                yield from self._fill(limit)

    def _take(self) -> None:
        if self.waiting:
            self.keys += [x[0] for x in self.waiting]
            self.starts = np.append(self.starts, [x[1] for x in self.waiting])
            self.sizes = np.vstack([self.sizes, [x[2:] for x in self.waiting]]).astype(np.int64)
            self.waiting = []

    def _fill(self, limit: int) -> Iterator[tuple]:
        """One sequence of at most `limit` tokens."""
        room, at = self.limits.copy(), 0
        room[0] = limit
        while len(self.keys) and room.min() > 0:
            fits = (self.sizes[:, 0] <= room[0]) & (self.sizes[:, 1] <= room[2])
            if self.cut and room[1] == 1:  # the last segment: an example that fills the sequence, if there is one
                fits &= self.sizes[:, 0] >= room[0]
            most = int(min(room[0], room[2]))
            if fits.any():
                share = room / self.limits
                value = self.sizes[:, 0] / self.limits[0] * share[0] + share[1] / self.limits[1] + self.sizes[:, 1] / self.limits[2] * share[2]
                i = int(np.argmax(np.where(fits, value, -1)))
                taken = int(self.sizes[i, 0])
            elif self.cut:
                i = int(np.argmax(self.sizes[:, 0]))
                taken = min(most, int(self.sizes[i, 0]))
            else:
                break
            yield self.keys[i], int(self.starts[i]), taken, self.sequence, at
            room -= (taken, 1, taken if self.cut else self.sizes[i, 1])
            at += taken
            if taken == self.sizes[i, 0]:
                last = len(self.keys) - 1  # the last example takes its place
                self.keys[i], self.starts[i], self.sizes[i] = self.keys[last], self.starts[last], self.sizes[last]
                self.keys.pop()
                self.starts, self.sizes = self.starts[:last], self.sizes[:last]
            else:
                self.starts[i] += taken
                self.sizes[i] -= taken
        self.sequence += 1

    def finish(self) -> Iterator[tuple]:
        self._take()
        limit = int(self.limits[0])
        while len(self.keys):
            left = int(self.sizes[:, 0].sum())
            yield from self._fill(limit if left >= limit or not self.cut else 1 << max(0, left.bit_length() - 1))


def pack_texts(docs: DataFrame, path: str) -> DataFrame:
    """One row for each piece of each document (doc_id, text); doc_id keeps its type."""
    names = ["doc_id", *(f.split()[0] for f in SCHEMA.split(", "))]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, base = encoder(path), Packer(), TaskContext.get().partitionId() << 32
        ids: dict[int, list] = {}  # of documents that wait: doc_id, ids, tokens not yet packed
        out: list[tuple] = []

        def rows(pieces) -> None:
            for key, start, length, sequence, offset in pieces:
                entry = ids[key]
                entry[2] -= length
                out.append((entry[0], start, length, zlib.crc32(entry[1][start : start + length].tobytes()), len(entry[1]), base + sequence, offset))
                if not entry[2]:
                    del ids[key]

        def made(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            first, *rest = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(first, kind), *(pa.array(x, pa.int64()) for x in rest)], names=names)

        count, kind = 0, pa.int64()
        for batch in batches:
            kind = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.append(encode(text), np.uint32(END_ID)).astype("<u4")
                ids[count] = [doc, own, len(own)]
                rows(packer.add(count, len(own)))
                count += 1
                if len(out) >= 4096:
                    yield made(out, kind)
                    out.clear()
        rows(packer.finish())
        if out:
            yield made(out, kind)

    small_batches(docs.sparkSession)
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(packed, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def pack_examples(examples: DataFrame, limit: int = LIMIT, segments: int | None = None, loss: int | None = None) -> DataFrame:
    """Whole examples (example_id, tokens, loss_tokens), for instruction data: (example_id, sequence_id, offset). One that exceeds a sequence is an error."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = Packer(limit, segments, loss, cut=False), TaskContext.get().partitionId() << 32

        def batch_of(pieces):
            rows = [(key, base + sequence, offset) for key, _, _, sequence, offset in pieces]
            return pa.RecordBatch.from_pydict(dict(zip(("example_id", "sequence_id", "offset"), map(list, zip(*rows, strict=True)), strict=True))) if rows else None

        for batch in batches:
            made = batch_of(p for key, n, k in zip(*(c.to_pylist() for c in batch.columns), strict=True) for p in packer.add(key, n or 0, k or 0))
            if made is not None:
                yield made
        if (made := batch_of(packer.finish())) is not None:
            yield made

    return examples.select("example_id", "tokens", "loss_tokens").mapInArrow(packed, "example_id long, sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
