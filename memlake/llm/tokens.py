"""Counts of tokens as a byte-level BPE vocabulary with word ends gives them, without making the tokens' ids.

Texts are split at ASCII white space, which this kind of pre-tokenizer drops, and what has been counted before isn't counted again. The pre-tokens of what is new are one ragged
array of symbols; in each round every pre-token's pair of lowest rank is merged, in all pre-tokens and at all its places at once, until none has a pair with a rank. The symbols left are the tokens.
Pieces of ASCII characters are pre-tokenized in that array too; others by the tokenizer's own normalizer and pre-tokenizer. Strings of special tokens inside a text are one token each.

Merging all places of a pair at once gives the library's result if a merge's symbol is made by that merge alone and pairs with it rank later. That is tested when the
file is read; one that fails it has its pairs merged one place at a time.

Defined cases: a null text counts as empty; an empty text, and one of white space, has no tokens; rows that repeat are counted each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import small_batches, table, text_of

LIMIT = 2048
#: Bytes of pieces that are merged at a time (a longer piece is merged alone), and of pieces whose counts a task remembers. No result depends on them.
SLICE, REMEMBERED = 1 << 20, 8 << 20
NONE = np.int32(np.iinfo(np.int32).max)
#: The pattern of the pre-tokenizer that is done here for ASCII.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SHORT, LONG = b"stmd", (b"re", b"ve", b"ll")


def byte_symbols() -> dict[int, str]:
    """The character that stands for each byte: itself if it is printable in Latin-1, else the next one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Counter:
    """Tokens of pieces of text by the tokenizer in a file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model, split = said["model"], (said["pre_tokenizer"].get("pretokenizers") or [{}])[0]
        if model.get("end_of_word_suffix") != "</w>" or split.get("pattern") != {"Regex": PATTERN} or model.get("dropout"):
            raise ValueError(f"{path} is not a byte-level BPE with word ends")
        self.own = Tokenizer.from_file(path)
        special = [t["content"].encode() for t in said["added_tokens"]]
        if any(t["normalized"] or t["single_word"] or t["content"].split() != [t["content"]] for t in said["added_tokens"]):
            raise ValueError(f"{path} has special tokens of an unknown kind")
        self.special = re.compile(b"(" + b"|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + b")")
        self.starts = [s[:2] for s in special]
        vocab, symbols = model["vocab"], byte_symbols()
        self.first, self.last = (np.array([vocab[symbols[b] + end] for b in range(256)], dtype=np.int64) for end in ("", "</w>"))
        self.byte = {ord(c): b for b, c in symbols.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        pairs = np.array([[vocab[a], vocab[b], vocab[a + b]] for a, b in merges], dtype=np.int64).reshape(-1, 3)
        self.size = max(vocab.values()) + 1
        codes = pairs[:, 0] * self.size + pairs[:, 1]
        order = np.argsort(codes, kind="stable")
        self.codes, self.ranks, self.made = codes[order], order.astype(np.int32), pairs[:, 2]
        born = np.full(self.size, -1, dtype=np.int64)
        born[pairs[:, 2]] = np.arange(len(pairs))
        basic = np.concatenate([self.first, self.last])
        self.together = len(np.unique(pairs[:, 2])) == len(pairs) and not np.isin(pairs[:, 2], basic).any() and bool((born[pairs[:, :2]] < np.arange(len(pairs))[:, None]).all())
        kinds = np.zeros(256, dtype=np.int8)  # of lower-case ASCII: 0 other, 1 letter, 2 digit
        kinds[97:123], kinds[48:58] = 1, 2
        self.kinds = kinds
        self.known: dict[bytes, int] = {}
        self.held = 0

    def count(self, texts: list[bytes]) -> list[int]:
        """Tokens of each text."""
        pieces = [t.split() for t in texts]  # bytes split at ASCII white space alone
        new = set().union(*pieces).difference(self.known)
        counted = dict(self._count_pieces(list(new))) if new else {}
        self.known.update(counted)
        known = self.known
        out = [sum(map(known.__getitem__, p)) for p in pieces]
        self.held += sum(map(len, counted))
        if self.held > REMEMBERED:
            self.known, self.held = {}, 0
        return out

    def _count_pieces(self, pieces: list[bytes]) -> Iterator[tuple[bytes, int]]:
        at = 0
        while at < len(pieces):
            end, size = at, 0
            while end < len(pieces) and (end == at or size + len(pieces[end]) <= SLICE):
                size += len(pieces[end])
                end += 1
            yield from zip(pieces[at:end], self._count_slice(pieces[at:end]).tolist(), strict=True)
            at = end

    def _count_slice(self, pieces: list[bytes]) -> np.ndarray:
        total = np.zeros(len(pieces), dtype=np.int64)
        plain, plain_of, rest, rest_of = [], [], [], []
        for i, piece in enumerate(pieces):
            parts = [piece]
            if any(s in piece for s in self.starts):
                parts = self.special.split(piece)
                total[i] += len(parts) // 2
                parts = [p for p in parts[::2] if p]
            for p in parts:
                if p.isascii():
                    plain.append(p)
                    plain_of.append(i)
                else:
                    for word in self._library_words(p):
                        rest.append(word)
                        rest_of.append(i)
        raw = np.frombuffer(b"".join(plain).lower(), dtype=np.uint8)
        sizes = np.array([len(p) for p in plain], dtype=np.int64)
        of = np.repeat(np.array(plain_of, dtype=np.int64), sizes)
        starts = self._ascii_words(raw, sizes)
        words_of = [of[starts], np.array(rest_of, dtype=np.int64)]
        sizes_of_rest = np.array([len(w) for w in rest], dtype=np.int64)
        symbols = np.concatenate([raw, np.frombuffer(b"".join(rest), dtype=np.uint8)])
        starts = np.concatenate([starts, len(raw) + np.cumsum(sizes_of_rest) - sizes_of_rest])
        np.add.at(total, np.concatenate(words_of), self.merged(symbols, starts))
        return total

    def _library_words(self, piece: bytes) -> list[bytes]:
        text = self.own.normalizer.normalize_str(piece.decode("utf-8", "replace"))
        return [bytes(map(self.byte.__getitem__, map(ord, word))) for word, _ in self.own.pre_tokenizer.pre_tokenize_str(text)]

    def _ascii_words(self, raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Where pre-tokens of lower-case ASCII pieces start: where the kind of character changes, at each digit, and around the endings 's 't 're 've 'm 'll 'd."""
        if not len(raw):
            return np.zeros(0, dtype=np.int64)
        kind = self.kinds[raw]
        start = np.empty(len(raw), dtype=bool)
        start[0] = True
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        edge = np.zeros(len(raw) + 3, dtype=bool)  # where another piece starts, or the array ends
        edge[np.cumsum(sizes) - sizes] = True
        edge[len(raw) :] = True
        start |= edge[: len(raw)]
        after = np.concatenate([raw, np.zeros(3, dtype=np.uint8)])
        mark = np.flatnonzero((raw == 39) & start)  # an apostrophe that no mark stands before
        one = ~edge[mark + 1] & np.isin(after[mark + 1], np.frombuffer(SHORT, dtype=np.uint8))
        two = np.zeros(len(mark), dtype=bool)
        for a, b in LONG:
            two |= (after[mark + 1] == a) & (after[mark + 2] == b)
        two &= ~edge[mark + 1] & ~edge[mark + 2]
        start[mark[one | two] + 1] = False
        for at in (mark[one] + 2, mark[two] + 3):
            start[at[at < len(raw)]] = True
        return np.flatnonzero(start)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left * self.size + right
        at = np.searchsorted(self.codes, code)
        at[at == len(self.codes)] = 0
        return np.where(self.codes[at] == code, self.ranks[at], NONE) if len(self.codes) else np.full(len(code), NONE)

    def merged(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """How many symbols are left of each sequence of bytes; a sequence goes to the next one's start."""
        n = len(starts)
        left = np.zeros(n, dtype=np.int64)
        if not n:
            return left
        symbol = self.first[raw]
        ends = np.append(starts[1:], len(raw)) - 1
        symbol[ends] = self.last[raw[ends]]
        of = np.repeat(np.arange(n), ends + 1 - starts)
        rank = np.full(len(symbol), NONE)
        inside = np.flatnonzero(of[1:] == of[:-1])
        rank[inside] = self._rank(symbol[inside], symbol[inside + 1])
        while len(symbol):
            begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            size = np.diff(np.append(begin, len(of)))
            lowest = np.minimum.reduceat(rank, begin)
            over = lowest == NONE
            left[of[begin[over]]] = size[over]
            if over.any():
                stay = np.repeat(~over, size)
                symbol, of, rank, size, lowest = symbol[stay], of[stay], rank[stay], size[~over], lowest[~over]
                if not len(symbol):
                    break
            low = np.repeat(lowest, size)
            hit = np.flatnonzero(rank == low)
            # a pair of equal symbols can follow itself: of such a run every second one is merged
            fresh = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (of[hit[1:]] != of[hit[:-1]])])
            run = np.flatnonzero(fresh)
            hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))) % 2 == 0]
            if not self.together:
                hit = hit[np.concatenate([[True], of[hit[1:]] != of[hit[:-1]]])]
            symbol[hit] = self.made[rank[hit]]
            stay = np.ones(len(symbol), dtype=bool)
            stay[hit + 1] = False
            at = hit - np.arange(len(hit))  # places after what stood before is gone
            symbol, of, rank = symbol[stay], of[stay], rank[stay]
            rank[at] = NONE
            for pair in (at, at[at > 0] - 1):
                pair = pair[pair + 1 < len(of)]
                pair = pair[of[pair] == of[pair + 1]]
                rank[pair] = self._rank(symbol[pair], symbol[pair + 1])
        return left


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One for each task's process: it keeps what it has counted."""
    return Counter(path)


def with_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of documents (doc_id, text); doc_id keeps its type."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for rows in batches:
            texts = rows.column(1).to_pylist()
            tokens = own.count(texts)
            columns = [rows.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", text_of().cast("binary").alias("text")).mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return with_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
