"""Texts and files into rows: sections, overlapping chunks, blank-line code blocks, syntax-tree chunks for Python, items between braces for Rust, JavaScript and TypeScript."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.functions.text import content_type, strip

MAX_BYTES, OVERLAP = 80_000, 2_000


def sections(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, part, section): a heading of level one or two starts a section, if the one before isn't blank. Lines are grouped inside each row."""
    lines = F.split(F.regexp_replace(F.regexp_replace(F.col(text), "\r\n", "\n"), "\n$", ""), "\n")
    start = lambda line: line.startswith("# ") | line.startswith("## ")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc, line):
        turn = start(line) & (strip(acc["now"]) != "")
        return F.struct(F.when(turn, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"), F.concat(F.when(turn, "").otherwise(acc["now"]), line, F.lit("\n")).alias("now"))

    whole = F.aggregate(lines, empty, step, lambda acc: F.when(strip(acc["now"]) != "", F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]))
    parts = F.when(F.size(whole) == 0, F.array(F.col(text))).otherwise(whole)
    return docs.select(id_, F.posexplode(parts).alias("part", "section"))


def smart_chunks(text: str, size: int = MAX_BYTES, overlap: int = OVERLAP) -> Iterator[str]:
    """Chunks of at most `size` bytes that end, if they can, before a heading, after a blank line, or after a line; neighbours overlap. No character is cut."""
    raw = text.encode("utf-8", "surrogatepass")

    def whole(at: int) -> int:
        while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
            at -= 1
        return at

    start = 0
    while len(raw) - start > size:
        stop = whole(start + size)
        stop = stop if stop > start else min(len(raw), start + 4)
        window = raw[start:stop]
        ends = ((window.rfind(b"\n## "), 1), (window.rfind(b"\n\n"), 2), (window.rfind(b"\n"), 1))
        end = next((start + at + skip for at, skip in ends if at >= 0), stop)
        yield raw[start:end].decode("utf-8", "surrogatepass")
        back = whole(end - overlap) if end > overlap else end
        start = back if back > start else end
    yield raw[start:].decode("utf-8", "surrogatepass")


def code_blocks(text: str) -> Iterator[tuple[str, int, int]]:
    """(block, first line, last line) between blank lines."""
    held: list[str] = []
    first = 1
    lines = text.splitlines()
    for number, line in enumerate([*lines, ""], 1):
        if line.strip():
            first = first if held else number
            held.append(line)
        elif held:
            yield "\n".join(held).strip(), first, number - 1
            held = []


def python_chunks(source: str) -> Iterator[tuple[str, int, int]]:
    """Functions and classes at the top; what doesn't parse falls back to blank-line blocks."""
    try:
        nodes = [n for n in ast.parse(source).body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]
    except (SyntaxError, ValueError):
        nodes = []
    if not nodes:
        yield from code_blocks(source)
        return
    lines = source.splitlines()
    for n in nodes:
        first = min([n.lineno, *(d.lineno for d in n.decorator_list)])
        yield "\n".join(lines[first - 1 : n.end_lineno]), first, n.end_lineno


#: What opens a function, class, implementation or interface in languages with braces.
BRACED = {
    "rust": re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:default\s+|const\s+|async\s+|unsafe\s+|extern\s+(?:\"[^\"]*\"\s+)?)*(?:fn\b|impl\b)", re.M),
    "javascript": re.compile(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:(?:async\s+)?function\b|class\b|(?:const|let|var)\s+\w+\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>)", re.M),
    "typescript": re.compile(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:(?:async\s+)?function\b|(?:abstract\s+)?class\b|interface\b|type\s+\w+[^=\n]*=|(?:const|let|var)\s+\w+\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)]*\)(?:\s*:[^=\n]+)?|\w+)\s*=>)", re.M),
}
_SKIPPED = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])'|`(?:\\.|[^`\\])*`""", re.S)


def _item_end(code: str, at: int) -> int | None:
    """Where the item that starts at `at` ends: with its last brace, or with a semicolon or line outside of braces; None if braces don't match."""
    depth, braced = 0, False
    for i in range(at, len(code)):
        c = code[i]
        if c in "{([":
            depth, braced = depth + 1, braced or c == "{"
        elif c in "})]":
            depth -= 1
            if depth < 0:
                return None
            if depth == 0 and c == "}" and braced:
                return i + 1
        elif c == ";" and depth == 0:
            return i + 1
    return None if depth else len(code.rstrip())


def braced_chunks(language: str, source: str) -> Iterator[tuple[str, int, int]]:
    """Functions, implementations, classes, interfaces and type aliases that stand in no other one; what doesn't parse, or has none, falls back to blank-line blocks."""
    plain = _SKIPPED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)
    out, at = [], 0
    while m := BRACED[language].search(plain, at):
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        end = _item_end(plain, start)
        if end is None:
            out = []
            break
        out.append((source[start:end], source.count("\n", 0, start) + 1, source.count("\n", 0, end) + 1))
        at = end
    yield from out or code_blocks(source)


def code_chunks(language: str | None, source: str) -> Iterator[tuple[str, int, int]]:
    """Chunks of a source by its language."""
    if language == "python":
        return python_chunks(source)
    return braced_chunks(language, source) if language in BRACED else code_blocks(source)


def import_chunks(docs: DataFrame, id_: str, content: str, strategy: str = "auto") -> DataFrame:
    """(id, hint, part, chunk): what facts are extracted from. Conversations and large documents are cut into overlapping chunks, structured documents
    into sections, short notes stay whole; a strategy of atomic, section or document decides for all."""
    forced = {"atomic": "conversation", "section": "structured_doc", "document": "short_note"}.get(strategy)
    rows = docs.select(id_, F.coalesce(F.col(content), F.lit("")).alias(content))
    rows = rows.withColumn("hint", F.lit(forced) if forced else content_type(F.col(content)))
    key = F.struct(F.col(id_).alias("id"), (F.octet_length(content) > MAX_BYTES).alias("large")).alias(id_)  # a document's size goes with its id, so rows that repeat an id stay apart
    atomic = chunked(rows.where(F.col("hint").isin("conversation", "large_doc")).select(key, content), id_, content)
    whole = rows.where("hint = 'short_note'").select(id_, F.lit(0).alias("part"), F.col(content).alias("chunk"))
    parts = sections(rows.where("hint = 'structured_doc'"), id_, content).withColumnRenamed("section", "chunk")
    named = lambda x, hint: x.select(id_, hint.alias("hint"), "part", "chunk")
    size = F.lit(forced) if forced else F.when(F.col(f"{id_}.large"), "large_doc").otherwise("conversation")
    atomic = atomic.select(F.col(f"{id_}.id").alias(id_), size.alias("hint"), "part", "chunk")
    return named(whole, F.lit("short_note")).unionByName(named(parts, F.lit("structured_doc"))).unionByName(atomic)


def chunked(docs: DataFrame, id_: str, text: str, size: int = MAX_BYTES, overlap: int = OVERLAP) -> DataFrame:
    """(id, part, chunk), sizes in bytes. Short texts never leave the JVM; a null text is one empty chunk."""
    kind = docs.schema[id_].dataType.simpleString()
    docs = docs.select(id_, F.coalesce(F.col(text), F.lit("")).alias(text))
    short = docs.where(F.octet_length(text) <= size).select(id_, F.lit(0).alias("part"), F.col(text).alias("chunk"))

    def cut(frames):
        for frame in frames:
            ids = frame[[id_]]
            pieces = [(at, n, c) for at, t in enumerate(frame[text]) for n, c in enumerate(smart_chunks(t, size, overlap))]
            out = ids.iloc[[at for at, _, _ in pieces]].reset_index(drop=True)
            yield out.assign(part=[n for _, n, _ in pieces], chunk=[c for _, _, c in pieces])

    return short.unionByName(docs.where(F.octet_length(text) > size).mapInPandas(cut, f"{id_} {kind}, part int, chunk string"))


def blocks(docs: DataFrame, id_: str, text: str, split=code_blocks) -> DataFrame:
    """(id, part, block, start_line, end_line)."""
    kind = docs.schema[id_].dataType.simpleString()

    def cut(frames):
        for frame in frames:
            rows = [(i, n, *b) for i, t in zip(frame[id_], frame[text], strict=True) for n, b in enumerate(split(t or ""))]
            yield frame.__class__(rows, columns=[id_, "part", "block", "start_line", "end_line"])

    return docs.select(id_, text).mapInPandas(cut, f"{id_} {kind}, part int, block string, start_line int, end_line int")
