"""Token counts against the library that the vocabulary file is for."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from memlake.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(PATH)
    return lambda t: len(own.encode(t, add_special_tokens=False).ids)


ODD = [
    "", " \t\n", "Hello, World!", "it's 'sad'state 'tis they'Re WE'LL ''s x'' 'd", "'", "a'", "'s", "x's't", "12 345 6a7", "a<|endoftext|>b", "<|startoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext| >", "aaaaaaaaaaaaaaaaaaaaaaaa aaa aaaa",
    "über Größe naïve ﬁ ǅ İstanbul ΣΊΣΥΦΟΣ", "é ́x  y z　w", "\x1c\x1d a\x1fb \x00\x7f", "漢字かな交じり文 русский текст हिन्दी", "😀👍🏽 👨‍👩‍👧", "١٢٣ ½ ²", "a\u0085b​c﻿d", "K Å", "don’t ‘s", "---===*** !!!???", "http://x.y/z?a=1&b=2#c",
]


def test_counts_of_odd_texts(library):
    own = tokens.Counter(PATH)
    assert own.together
    assert own.count([t.encode() for t in ODD]) == [library(t) for t in ODD]
    assert own.count([t.encode() for t in ODD]) == [library(t) for t in ODD]  # from memory


def test_counts_of_random_texts(library):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz" * 3 + "ETAOIN'''\"0123456789.,;-_()<>|éüßñ \n\t  漢а"
    texts = ["".join(rng.choices(letters, k=rng.randrange(1, 400))) for _ in range(600)]
    assert tokens.Counter(PATH).count([t.encode() for t in texts]) == [library(t) for t in texts]


def test_one_place_at_a_time_gives_the_same(library):
    own = tokens.Counter(PATH)
    own.together = False
    assert own.count([t.encode() for t in ODD]) == [library(t) for t in ODD]


def test_long_pieces_and_a_small_memory(library, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    monkeypatch.setattr(tokens, "SLICE", 64)
    rng = random.Random(6)
    texts = ["x" * 30_000, "ab" * 9_000, "".join(rng.choices("abcdefgh", k=3_000)), "Word " * 20_000, *ODD]
    assert tokens.Counter(PATH).count([t.encode() for t in texts]) == [library(t) for t in texts]


def test_query_equals_the_library(spark, library):
    d = "/root/testdata/sf0.001"
    out = {r["doc_id"]: r for r in tokens.op11_token_counts(spark, d).collect()}
    rows = spark.read.parquet(f"{d}/documents.parquet").collect()
    assert len(out) == len(rows)
    for r in rows:
        t = r["text"] or ""
        n = library(t)
        assert tuple(out[r["doc_id"]]) == (r["doc_id"], len(t.encode()), n, n > 2048)


def test_counts_of_odd_tables(spark):
    rows = [(1, None, 5), (1, "a b", 6), (1, "a b", 6), (None, "", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    assert sorted(map(tuple, tokens.with_counts(df, PATH, 1).collect()), key=str) == sorted([(1, 0, 0, False), (1, 3, 2, True), (1, 3, 2, True), (None, 0, 0, False)], key=str)
    assert tokens.with_counts(df.limit(0), PATH).collect() == []


def test_files_of_another_kind_are_refused():
    with pytest.raises(ValueError):
        tokens.Counter(public_tokenizers.path("byte_bpe_50k.json"))
