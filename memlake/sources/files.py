"""Files and transcripts as data sources: `spark.read.format("memory_files")` gives chunk rows, `spark.read.format("transcripts")` messages; both can be read as streams.

    files.register(spark)
    spark.read.format("memory_files").load("s3://bucket/folder")
    spark.readStream.format("transcripts").option("session", "sid").load(folder).writeStream.option("checkpointLocation", ...)

Options: `path` (a folder, with all below it, or one file; a local path or an address that pyarrow.fs knows), `pathGlobFilter` (a pattern of file names), `maxPartitionBytes`, and for streams `lag`.
Names that start with a dot or underscore are hidden. The driver lists names, sizes and times; only tasks open files.

A stream's offset is a time of modification: a batch is what was modified after the last one's time, so a restart reads nothing again and nothing is kept but one number. Files count `lag` seconds
(2) after they were written, so that one which shares its moment with others is never left behind; files must come with new times (moved copies that keep an old time aren't seen).
"""

from __future__ import annotations

import fnmatch
import io
import json
import time
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from memlake.functions import seams
from memlake.operators.chunk import MAX_BYTES, OVERLAP, code_chunks, smart_chunks

#: Files over so many bytes give one row that says so.
LONGEST = 50 << 20
PARTITION_BYTES = 64 << 20
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20

#: Kinds of files and languages by the end of their names.
KINDS = {
    "pdf": ["pdf"],
    "image": ["png", "jpg", "jpeg", "gif", "webp", "bmp"],
    "video": ["mp4", "mov", "avi", "mkv", "webm"],
    "code": ["rs", "py", "js", "mjs", "ts", "mts", "go"],
}
LANGUAGES = {"rs": "rust", "py": "python", "js": "javascript", "mjs": "javascript", "ts": "typescript", "mts": "typescript"}
CHUNK_TYPES = {"pdf": ("pdf_page", "pdf_metadata"), "image": ("image_ocr", "image_metadata"), "video": ("video_transcript", "video_metadata")}


class Piece(InputPartition):
    """What one task reads: (path, first byte, end, size) of files or parts of them."""

    def __init__(self, parts: list[tuple[str, int, int, int]]):
        self.parts = parts


class Folder:
    """The files under a path, dealt to tasks."""

    splits = False  # whether a file can be read from its middle

    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        if not self.options.get("path"):
            raise ValueError("a path is needed")
        self.path, self.bytes = self.options["path"], int(self.options.get("maxpartitionbytes", PARTITION_BYTES))
        self.lag = float(self.options.get("lag", 2))

    def system(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path)

    def listed(self) -> list[pafs.FileInfo]:
        system, at = self.system()
        top = system.get_file_info(at)
        if top.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [top] if top.is_file else system.get_file_info(pafs.FileSelector(at, recursive=True))
        pattern = self.options.get("pathglobfilter", "*")
        hidden = lambda f: any(n.startswith((".", "_")) for n in f.path[len(top.path) :].strip("/").split("/"))
        return sorted((f for f in found if f.is_file and not (f is not top and hidden(f)) and fnmatch.fnmatchcase(f.base_name, pattern)), key=lambda f: f.path)

    def dealt(self, found: list[pafs.FileInfo]) -> list[Piece]:
        """Small files share a task, up to `maxPartitionBytes`; large ones are split where the format allows it."""
        out: list[Piece] = []
        held: list[tuple[str, int, int, int]] = []
        room = self.bytes
        for f in found:
            step = self.bytes if self.splits else max(f.size, 1)
            for start in range(0, max(f.size, 1), step):
                part = (f.path, start, min(start + step, f.size), f.size)
                if held and part[2] - start > room:
                    out.append(Piece(held))
                    held, room = [], self.bytes
                held.append(part)
                room -= part[2] - start
        return [*out, Piece(held)] if held else out

    def rows(self, system: pafs.FileSystem, path: str, start: int, stop: int, size: int) -> Iterator[tuple]:
        raise NotImplementedError

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        """Rows in Arrow batches that are bounded in rows and bytes."""
        system, _ = self.system()
        held: list[tuple] = []
        size = 0
        for part in piece.parts:
            for row in self.rows(system, *part):
                held.append(row)
                size += sum(len(x) for x in row if isinstance(x, str))
                if len(held) == BATCH_ROWS or size > BATCH_BYTES:
                    yield self.batch(held)
                    held, size = [], 0
        if held:
            yield self.batch(held)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), self.arrow, strict=True)], schema=self.arrow)


class Chunks(Folder):
    """Files into chunk rows, as an upload makes them: code by its language, texts whole up to MAX_BYTES and else in overlapping chunks, other kinds by the decoders of `seams.DECODERS`. A kind without a decoder,
    or bytes that it refuses, give one row of facts. A file that is too large or can't be read gives one row without content, whose `error` says why. An empty file gives no row."""

    schema = "path string, kind string, chunk_type string, part int, content string, start_line int, end_line int, size long, source string, tags array<string>, error string"
    arrow = pa.schema([("path", pa.string()), ("kind", pa.string()), ("chunk_type", pa.string()), ("part", pa.int32()), ("content", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("size", pa.int64()), ("source", pa.string()), ("tags", pa.list_(pa.string())), ("error", pa.string())])

    def rows(self, system, path, start, stop, size):
        name = path.rpartition("/")[2]
        ext = name.rpartition(".")[2].lower() if "." in name else ""
        kind = next((k for k, ends in KINDS.items() if ext in ends), "text")
        row = lambda type_, part, content, first=None, last=None, error=None: (path, kind, type_, part, content, first, last, size, f"file_upload:{name}", [f"file:{name}", f"chunk_type:{type_}"], error)
        longest = int(self.options.get("longest", LONGEST))
        if size > longest:
            yield row("error", 0, None, error=f"file too large: {size} bytes (max {longest})")
            return
        try:
            with system.open_input_file(path) as f:
                raw = f.read()
        except OSError as e:
            yield row("error", 0, None, error=str(e))
            return
        if kind in CHUNK_TYPES:
            good, bad = CHUNK_TYPES[kind]
            try:
                yield from [row(good, n, t) for n, t in enumerate(seams.DECODERS[kind](raw))]
            except (KeyError, ValueError):
                yield row(bad, 0, f"[{kind} file, {len(raw)} bytes]")
            return
        text = raw.decode("utf-8", "replace")
        if kind == "code":
            language = LANGUAGES.get(ext)
            yield from (row("code_function" if language else "code_block", n, *c) for n, c in enumerate(code_chunks(language, text)))
        elif text:
            yield from (row("text", n, c) for n, c in enumerate(smart_chunks(text, int(self.options.get("size", MAX_BYTES)), int(self.options.get("overlap", OVERLAP)))))


class Messages(Folder):
    """Transcripts, one JSON object a line, into messages. A file is split at lines, so one of any size is read by many tasks. `at` is where a line starts, so it orders a file's messages. A session is what the
    field named by the option `session` (session_id) says, else the file. Content that is a list gives its text parts, joined by line ends. `fields` holds a line's other texts and, as JSON, numbers and truth values. Lines that are no object, or whose role or content isn't text, give no row."""

    splits = True
    schema = "path string, session string, at long, role string, content string, fields map<string,string>"
    arrow = pa.schema([("path", pa.string()), ("session", pa.string()), ("at", pa.int64()), ("role", pa.string()), ("content", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))])

    def rows(self, system, path, start, stop, size):
        named = self.options.get("session", "session_id")
        with io.BufferedReader(system.open_input_file(path), 1 << 20) as f:
            f.seek(max(start - 1, 0))
            at = start - 1 + len(f.readline()) if start else 0  # a line belongs to the part in which it starts
            while at < stop and (line := f.readline()):
                message = self.message(line)
                if message:
                    role, content, fields = message
                    yield path, fields.get(named, path), at, role, content, list(fields.items())
                at += len(line)

    @staticmethod
    def message(line: bytes) -> tuple[str, str, dict[str, str]] | None:
        try:
            entry = json.loads(line.decode("utf-8", "replace"))
        except (ValueError, RecursionError):
            return None
        if not isinstance(entry, dict):
            return None
        role, content = entry.get("role"), entry.get("content")
        if isinstance(content, list):
            parts = [p.get("text", "") for p in content if isinstance(p, dict) and p.get("type") == "text"]
            content = "\n".join(p for p in parts if isinstance(p, str))
        if not isinstance(role, str) or not isinstance(content, str):
            return None
        whole = lambda t: t.encode("utf-8", "replace").decode()  # noqa: E731 - JSON may escape half a surrogate pair, which no UTF-8 text holds
        fields = {whole(k): whole(v) if isinstance(v, str) else json.dumps(v) for k, v in entry.items() if k not in ("role", "content") and isinstance(v, str | int | float)}
        return whole(role), whole(content), fields


class Batch(DataSourceReader):
    def __init__(self, folder: Folder):
        self.folder = folder

    def partitions(self):
        return self.folder.dealt(self.folder.listed()) or [Piece([])]

    def read(self, partition):
        return self.folder.read(partition)


class Stream(DataSourceStreamReader):
    def __init__(self, folder: Folder):
        self.folder = folder

    def initialOffset(self):  # noqa: N802
        return {"until": 0}

    def latestOffset(self):  # noqa: N802
        settled = time.time_ns() - int(self.folder.lag * 1e9)
        return {"until": max((f.mtime_ns for f in self.folder.listed() if f.mtime_ns <= settled), default=0)}

    def partitions(self, start, end):
        return self.folder.dealt([f for f in self.folder.listed() if start["until"] < f.mtime_ns <= end["until"]]) or [Piece([])]

    def read(self, partition):
        return self.folder.read(partition)


class MemoryFiles(DataSource):
    rows = Chunks

    @classmethod
    def name(cls) -> str:
        return "memory_files"

    def schema(self) -> str:
        return self.rows.schema

    def reader(self, schema: StructType) -> Batch:
        return Batch(self.rows(dict(self.options)))

    def streamReader(self, schema: StructType) -> Stream:  # noqa: N802
        return Stream(self.rows(dict(self.options)))


class Transcripts(MemoryFiles):
    rows = Messages

    @classmethod
    def name(cls) -> str:
        return "transcripts"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MemoryFiles)
    spark.dataSource.register(Transcripts)
