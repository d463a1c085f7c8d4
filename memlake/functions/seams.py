"""Seams for models: embedders, language models, rerankers and file decoders as pandas UDFs, with deterministic stand-ins."""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def embedder(embed: Callable[[list[str]], list[list[float]]], batch: int = 25):
    """A column function over any function from texts to vectors, called with `batch` texts at a time."""

    @F.pandas_udf("array<float>")
    def run(text: pd.Series) -> pd.Series:
        texts = text.fillna("").tolist()
        return pd.Series([v for i in range(0, len(texts), batch) for v in embed(texts[i : i + batch])])

    return run


def hashing_vectors(texts: list[str], dim: int = 64) -> list[list[float]]:
    """Signed word hashing, unit length: the same text has the same vector everywhere."""
    v = np.zeros((len(texts), dim))
    for row, t in zip(v, texts, strict=True):
        for w in re.findall(r"\w+", t.lower()):
            h = _hashed(w)
            row[h % dim] += 1 if h >> 63 else -1
    n = np.sqrt((v * v).sum(1, keepdims=True))  # of whole numbers, so the same in any order
    return np.divide(v, n, out=v, where=n > 0).astype(np.float32).tolist()


@functools.lru_cache(1 << 17)
def _hashed(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


def completer(complete: Callable[[str], str]):
    """A column function over any function from a prompt to an answer; an answer that fails is null."""

    @F.pandas_udf("string")
    def run(prompt: pd.Series) -> pd.Series:
        def one(p):
            try:
                return complete(p)
            except Exception:  # noqa: BLE001 - one failed answer must not end the job
                return None

        return prompt.map(one)

    return run


def sentence_facts(prompt: str, most: int = 50) -> str:
    """A stand-in for extraction: sentences as facts, in JSON."""
    facts = [{"l0_abstract": s.strip(), "category": "events", "tags": []} for s in re.split(r"(?<=[.!?。！？])\s+", prompt) if s.strip()]
    return json.dumps({"memories": facts[:most]}, ensure_ascii=False)


FENCE = re.compile(r"^```[a-zA-Z]*\s*|\s*```$")
HINT = "\n\nIMPORTANT: Return ONLY valid JSON, no explanation or markdown."


def complete_json(complete: Callable[[str], str]) -> Callable[[str], str]:
    """A function from a prompt to JSON: fences go, and an answer that isn't JSON is asked for once more, with a hint. A second one fails."""

    def run(prompt: str) -> str:
        for asked in (prompt, prompt + HINT):
            answer = FENCE.sub("", complete(asked).strip()).strip()
            try:
                json.loads(answer)
            except ValueError:
                continue
            return answer
        raise ValueError("the answer is no JSON")

    return run


def ruled_decisions(score: Column) -> Column:
    """A stand-in for asking what to do with a fact, by its best match: the same is skipped, nearly the same supports, else it is created."""
    return F.when(score >= 0.95, "SKIP").when(score >= 0.85, "SUPPORT").otherwise("CREATE")


FACTS = "struct<memories:array<struct<l0_abstract:string,l1_overview:string,l2_content:string,category:string,tags:array<string>>>>"


def overlap_scores(query: str):
    """A stand-in for a reranker: share of the query's words that a text holds."""
    asked = set(re.findall(r"\w+", query.lower()))

    @F.pandas_udf("double")
    def run(text: pd.Series) -> pd.Series:
        return text.fillna("").map(lambda t: len(asked & set(re.findall(r"\w+", t.lower()))) / max(1, len(asked)))

    return run


def pdf_pages(raw: bytes) -> list[str]:
    """Texts shown by the content streams of a PDF, one for each stream that shows any. Only plain and deflated streams with simple strings are read."""
    import zlib

    pages = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", raw, re.S):
        try:
            data = zlib.decompress(m[1])
        except zlib.error:
            data = m[1]
        shown = re.findall(rb"\(((?:[^()\\]|\\.)*)\)\s*(?:Tj|'|\")|\[((?:[^\]\\]|\\.)*)\]\s*TJ", data, re.S)
        texts = [one or b"".join(re.findall(rb"\(((?:[^()\\]|\\.)*)\)", many)) for one, many in shown]
        if texts:
            pages.append("\n".join(re.sub(rb"\\(.)", rb"\1", t).decode("latin-1") for t in texts))
    if not pages:
        raise ValueError("no text")
    return pages


def image_facts(raw: bytes) -> list[str]:
    """What a picture's header says: kind and size."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n":
        return [f"[PNG image, {int.from_bytes(raw[16:20], 'big')}x{int.from_bytes(raw[20:24], 'big')}, {len(raw)} bytes]"]
    if raw[:6] in (b"GIF87a", b"GIF89a"):
        return [f"[GIF image, {int.from_bytes(raw[6:8], 'little')}x{int.from_bytes(raw[8:10], 'little')}, {len(raw)} bytes]"]
    raise ValueError("unknown kind")


#: Decoders that need no program beside Python; OCR and speech are left to the caller.
DECODERS = {"pdf": pdf_pages, "image": image_facts}


def decoded(decoders: dict[str, Callable[[bytes], list[str]]]):
    """Chunks of a file's bytes by its kind; a kind without decoder, or bytes that one refuses, give a row that says so."""

    @F.pandas_udf("array<string>")
    def run(kind: pd.Series, content: pd.Series) -> pd.Series:
        def one(k, c):
            if k in ("text", "code"):
                return [bytes(c).decode("utf-8", "replace")]
            try:
                return decoders[k](bytes(c))
            except Exception:  # noqa: BLE001
                return [f"[{k} file, {len(c)} bytes]"]

        return pd.Series([one(k, c) for k, c in zip(kind, content, strict=True)])

    return run
