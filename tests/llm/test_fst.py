import json
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import fst

SF = "/root/testdata/sf0.001"
TEXTS = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "The cat's sat. the CAT'S 12 345 İstanbul ΣΑΣ Straße é x y　",
    "a<|startoftext|>b <|endoftext|> <|STARTOFTEXT|> <|endoftext|><|endoftext|>x é<|endoftext|>́",
    "\x1c\x1d\x85 z​﻿ 中文字 👍🏽 ́a",
    "it're 've 'll 'lx 'rx 'v' ''s !'s 'd'e 's's 'R'E ' 'r 'l'l a'",
    "ab " * 30_000,
    "x" * 5_000,
    "same row",
    "same row",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(fst.public_path())


@pytest.fixture(scope="module")
def machine():
    return fst.Transducer(fst.read_tokenizer(fst.public_path()))


def number(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def random_texts(n, seed):
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz''''   0189!?.,ABCéüσΣ中ÅŁ́̇\n-_/=+<|>'srvelmtd"
    return ["".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(n)]


def test_counts_equal_the_library(library, machine):
    for text in [t or "" for t in TEXTS] + random_texts(2_000, 1):
        assert machine.count(machine.prepare(text)) == number(library, text), text[:80]


def test_every_token_and_its_neighbours(library, machine):
    """Vocabulary entries, cut short, lengthened and joined: where merges over borders matter."""
    rng = random.Random(2)
    words = [t.removesuffix("</w>") for t in json.loads(library.to_str())["model"]["vocab"] if t.removesuffix("</w>").isascii()]
    for _ in range(4_000):
        a, b = rng.choices(words, k=2)
        text = a[: rng.randint(1, len(a))] + b
        assert machine.count(machine.prepare(text)) == number(library, text), text


def test_maps_compose_in_any_grouping(library, machine):
    rng = random.Random(3)
    for text in [t or "" for t in TEXTS] + random_texts(300, 4):
        ready = machine.prepare(text)
        size = rng.choice([1, 2, 7, 100])
        maps = [machine.map(ready[i : i + size]) for i in range(0, min(len(ready), 4_000), size)] or [machine.map("")]
        maps = [fst.Map.unpack(m.pack()) for m in maps]
        want = machine.count(ready[: size * len(maps)])
        while len(maps) > 1:
            i = rng.randrange(len(maps) - 1)
            maps[i : i + 2] = [machine.compose(*maps[i : i + 2])]
        assert machine.total(maps[0]) == want, text[:80]


def test_a_full_transducer_starts_anew(library):
    small = fst.Transducer(fst.read_tokenizer(fst.public_path()), keep=50)
    for text in random_texts(200, 5):
        assert small.count(small.prepare(text)) == number(library, text)


@pytest.mark.parametrize("chunk", [64, fst.CHUNK])
def test_texts_in_one_or_many_chunks(spark, library, chunk):
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string, n_bytes int")
    made = fst.counts(docs.withColumn("_k", F.lit(0)), fst.read_tokenizer(fst.public_path()), chunk=chunk)
    assert made.columns == ["doc_id", "text", "_k", "n_bytes", "n_tokens"]
    found = {r["doc_id"]: r for r in made.collect()}
    assert len(found) == len(TEXTS) == made.count()
    for i, t in enumerate(TEXTS):
        assert found[i]["n_tokens"] == number(library, t) and found[i]["n_bytes"] == len((t or "").encode()) and found[i]["text"] == t


def test_query_on_every_document(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    made = fst.query(spark, SF).collect()
    assert len(made) == len(texts)
    for r in made:
        n = number(library, texts[r["doc_id"]])
        assert (r["n_tokens"], r["over_limit"]) == (n, n > 2048)
        assert r["n_bytes"] == len((texts[r["doc_id"]] or "").encode())


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="can be compiled"):
        fst.read_tokenizer(fst.public_path("byte_bpe_50k.json"))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fst.counts(docs, fst.read_tokenizer(fst.public_path())).count() == 0
