"""Chunks and facts as table functions, for SQL text and the DataFrame API alike.

    register(spark)
    SELECT doc_id, part, chunk FROM documents, LATERAL smart_chunks(text, 4000, 200)
    SELECT page_id, part, block FROM pages, LATERAL code_blocks(html, 'python')
    SELECT doc_id, place, fact FROM documents, LATERAL sentence_facts(text)
    SELECT * FROM conversation_chunks(TABLE(messages), 'conv_id', 'turn')

Arguments beside texts and rows are constants; what they may be is checked when the query is analysed. A null text counts as empty.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from memlake.functions import seams
from memlake.operators import chunk


def _text(x: AnalyzeArgument, name: str) -> None:
    if x.isTable or x.dataType.typeName() not in ("string", "void"):
        raise ValueError(f"{name} must be a text")


def _sizes(size: AnalyzeArgument | None, overlap: AnalyzeArgument | None) -> None:
    """Both are constants; chunks hold four bytes at least, so that any character fits."""
    given = []
    for x, name, default in ((size, "size", chunk.MAX_BYTES), (overlap, "overlap", chunk.OVERLAP)):
        if x is not None and (not x.isConstantExpression or not isinstance(x.value, int)):
            raise ValueError(f"{name} must be a constant whole number")
        given.append(default if x is None else x.value)
    if given[0] < 4 or not 0 <= given[1] < given[0]:
        raise ValueError("size must be 4 or more, and overlap from 0 to under size")


def _columns(*fields: tuple) -> StructType:
    return StructType([StructField(n, t) for n, t in fields])


class SmartChunks:
    """(part, chunk) of a text: chunks of at most `size` bytes, as operators.chunk.smart_chunks cuts them."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument = None, overlap: AnalyzeArgument = None) -> AnalyzeResult:
        _text(text, "text")
        _sizes(size, overlap)
        return AnalyzeResult(_columns(("part", IntegerType()), ("chunk", StringType())))

    def eval(self, text: str, size: int = chunk.MAX_BYTES, overlap: int = chunk.OVERLAP) -> Iterator[tuple]:
        yield from enumerate(chunk.smart_chunks(text or "", size, overlap))


class CodeBlocks:
    """(part, block, start_line, end_line) of a source: blocks between blank lines, or the items of a language if one is named."""

    @staticmethod
    def analyze(source: AnalyzeArgument, language: AnalyzeArgument = None) -> AnalyzeResult:
        _text(source, "source")
        if language is not None:
            _text(language, "language")
        return AnalyzeResult(_columns(("part", IntegerType()), ("block", StringType()), ("start_line", IntegerType()), ("end_line", IntegerType())))

    def eval(self, source: str, language: str | None = None) -> Iterator[tuple]:
        for n, found in enumerate(chunk.code_chunks(language, source or "")):
            yield n, *found


def facts_by(complete: Callable[[str], str]) -> type:
    """A table function (place, fact, overview, content, category, tags) over a function from a text to JSON like that of seams.FACTS, asked twice at most. An answer that fails gives no rows."""

    class Facts:
        @staticmethod
        def analyze(text: AnalyzeArgument) -> AnalyzeResult:
            _text(text, "text")
            return AnalyzeResult(_columns(("place", IntegerType()), ("fact", StringType()), ("overview", StringType()), ("content", StringType()), ("category", StringType()), ("tags", ArrayType(StringType()))))

        def eval(self, text: str) -> Iterator[tuple]:
            try:
                found = json.loads(seams.complete_json(complete)(text or ""))["memories"]
                rows = [(n, f["l0_abstract"], f.get("l1_overview"), f.get("l2_content"), f.get("category"), [*map(str, f.get("tags") or [])]) for n, f in enumerate(found)]
            except Exception:  # noqa: BLE001 - one failed answer must not end the job
                rows = []
            yield from rows

    return Facts


class ConversationChunks:
    """(key, part, chunk) of conversations: messages as `role: content` lines, in order, joined and cut into overlapping chunks like one text. The function asks for rows by key and in order, so a call can't get
    them wrong; one conversation is read by one task, which holds one chunk and one message of it at a time. Rows of equal order go by role and content. Null roles and contents count as empty; all rows with a null key are one conversation."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, order: AnalyzeArgument, size: AnalyzeArgument = None, overlap: AnalyzeArgument = None) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("rows must be a table")
        for x, name in ((key, "key"), (order, "order")):
            if not x.isConstantExpression or x.value not in rows.dataType.names:
                raise ValueError(f"{name} must name a column of the table")
        if not {"role", "content"} <= set(rows.dataType.names):
            raise ValueError("the table needs columns role and content")
        _sizes(size, overlap)
        schema = _columns((key.value, rows.dataType[key.value].dataType), ("part", IntegerType()), ("chunk", StringType()))
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn(order.value), OrderingColumn("role"), OrderingColumn("content")])

    def __init__(self):
        self.key, self.held, self.bytes, self.part, self.any = None, [], 0, 0, False

    def eval(self, rows: Row, key: str, order: str, size: int = chunk.MAX_BYTES, overlap: int = chunk.OVERLAP) -> Iterator[tuple]:
        self.key, self.any = rows[key], True
        line = f"{rows['role'] or ''}: {rows['content'] or ''}\n"
        self.held.append(line)
        self.bytes += len(line.encode("utf-8", "surrogatepass"))
        if self.bytes > size:  # a cut looks at the next `size` bytes alone, so all chunks but the last are settled
            *done, rest = chunk.smart_chunks("".join(self.held), size, overlap)
            self.held, self.bytes = [rest], len(rest.encode("utf-8", "surrogatepass"))
            for found in done:
                yield self.key, self.part, found
                self.part += 1

    def terminate(self) -> Iterator[tuple]:
        if self.any:
            yield self.key, self.part, "".join(self.held)


def register(spark: SparkSession) -> None:
    """The functions by name, with the stand-in for facts; `facts_by` makes others."""
    for name, made in (("smart_chunks", SmartChunks), ("code_blocks", CodeBlocks), ("sentence_facts", facts_by(seams.sentence_facts)), ("conversation_chunks", ConversationChunks)):
        spark.udtf.register(name, udtf(made))
