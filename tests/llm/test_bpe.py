import hashlib

import numpy as np
from tokenizers import Tokenizer

from tidemark.llm import bpe

TEXTS = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "The cat's sat. the CAT'S 12 345 İstanbul ΣΑΣ Straße é  x y　",
    "a<|startoftext|>b <|endoftext|> <|STARTOFTEXT|> <|endoftext|>x",
    "\x1c\x1d\x85 z​﻿ 中文字 👍🏽 ́a",
    "ab " * 30_000,
    "x" * 5_000,
    "same row",
    "same row",
]


def test_ids_and_text_equal_the_library(spark):
    tokenizer = Tokenizer.from_file(bpe.public_path())
    docs = spark.createDataFrame([(i, t, "other") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    text = bpe.read_tokenizer(bpe.public_path())
    made = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs, text), text).collect()}
    assert len(made) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(made[i]["ids"], "<u4").tolist() == ids, t
        assert made[i]["decoded"] == tokenizer.decode(ids, skip_special_tokens=False)


def test_clashing_hashes_are_encoded_in_place(spark, monkeypatch):
    text = bpe.read_tokenizer(bpe.public_path())
    table = bpe.word_table(spark.createDataFrame([("only these words",)], "text string"), text)
    ids, sizes = bpe._lookup(table, [b"these", b"unknown's", b"words"], lambda: Tokenizer.from_str(text))
    expected = [Tokenizer.from_str(text).encode(w, add_special_tokens=False).ids for w in ("these", "unknown's", "words")]
    assert ids.tolist() == sum(expected, []) and sizes.tolist() == [len(x) for x in expected]


def test_query_on_every_document(spark):
    sf = "/root/testdata/sf0.001"
    tokenizer = Tokenizer.from_file(bpe.public_path())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    made = bpe.query(spark, sf).collect()
    assert len(made) == len(texts)
    for r in made:
        ids = tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_empty_table(spark):
    text = bpe.read_tokenizer(bpe.public_path())
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(none, text), text).count() == 0
