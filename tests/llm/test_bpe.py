import random

import pytest
from pyspark.sql import functions as F

from plinth.llm import bpe

PATH = f"{bpe.DEFAULT_FOLDER}/byte_bpe_50k.json"
TEXTS = ["", None, " ", "\n\n \t", "Hello  world's 123 $4,000.50!", "<|endoftext|> x", "a" * 3000, "ab" * 1500, "=" * 2001, "到目前为止" * 700, "Ünïcödé é 🏗️🚧", "x​﻿y\xa0z", "The  pump   failed\r\nagain", " 주 정부 지원이"]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def ours(texts):
    offsets, ids = bpe.Encoder(bpe.load(PATH)).encode(texts)
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)]


def test_odd_texts(library):
    assert ours(TEXTS) == library(TEXTS)


def test_random_texts(library):
    r = random.Random(3)
    alphabet = "aaabbc  \n.,'-1ñ中🏗sSTt"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 400))) for _ in range(300)] + [r.choice("ab") * r.randint(250, 600) for _ in range(10)]
    assert ours(texts) == library(texts)


def test_corpus(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.key: list(r.ids) for r in bpe.encode(docs, F.col("doc_id"), F.col("text"), PATH).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert got == dict(zip([r.doc_id for r in rows], library([r.text for r in rows]), strict=True))
    counts = {r.key: r.n_tokens for r in bpe.encode(docs, F.col("doc_id"), F.col("text"), PATH, only_counts=True).collect()}
    assert counts == {k: len(v) for k, v in got.items()}


def test_frames(spark):
    df = spark.createDataFrame([(1, None, "k"), (1, "", "k"), (None, "Hi", None)], "id int, text string, ids string")
    got = bpe.encode(df, F.col("id"), F.col("text"), PATH)
    assert got.dtypes == [("key", "int"), ("ids", "array<int>")]
    assert sorted(((r.key or 0, r.ids) for r in got.collect())) == [(0, [17250]), (1, []), (1, [])]
    assert bpe.encode(df.limit(0), F.col("id"), F.col("text"), PATH).count() == 0


def test_memory_bound(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    e = bpe.Encoder(bpe.load(PATH))
    for _ in range(3):
        offsets, ids = e.encode(["one two three four five", "one"])
        assert len(offsets) == 3 and len(e.known) <= 8
