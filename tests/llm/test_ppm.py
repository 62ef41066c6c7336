import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidemark.llm import ppm, shards

SCHEMA = "doc_id long, text string, lang string"
TRAIN = [
    (1, "the cat sat on the mat and the hat", "en"),
    (2, "that is the thing that they think", "en"),
    (3, "der hund und die katze sind schön", "de"),
    (4, "das ist doch nicht für die und den", "de"),
    (5, None, "de"),
    (6, "no language here", None),
    (7, "", "en"),
]


def brute_bits(rows, lang, text, languages):
    """Code length by plain dictionaries; a context known in any language is used for all."""
    counts = {x: defaultdict(Counter) for x in languages}
    known = set()
    for _, t, x in rows:
        data = b"   " + t.encode()
        for i in range(3, len(data)):
            for d in range(4):
                counts[x][data[i - d : i]][data[i]] += 1
                known.add(data[i - d : i])
    padded = b"   " + text.encode()

    def share(context, symbol):
        shorter = share(context[1:], symbol) if context else 1 / 256
        seen = counts[lang][context]
        total, kinds = sum(seen.values()), len(seen)
        if not total:
            return shorter
        return seen[symbol] / (total + kinds) if seen[symbol] else kinds / (total + kinds) * shorter

    out = 0.0
    for i in range(3, len(padded)):
        context = next((padded[i - d : i] for d in (3, 2) if padded[i - d : i] in known), padded[i - 1 : i])
        out -= math.log2(share(context, padded[i]))
    return out


def test_code_lengths_are_those_of_plain_dictionaries(spark):
    rows = [(1, "the cat sat on the mat and the hat", "en"), (3, "der hund und die katze sind schön", "de")]
    model = ppm.train(spark.createDataFrame(rows, SCHEMA))
    assert model.languages == ["de", "en"]
    for text in ("the hat", "die katze", "sat und", "schön the", "then"):
        got = model.bits([text.encode()])[0]
        for k, x in enumerate(model.languages):
            want = brute_bits(rows, x, text, model.languages)
            assert abs(got[k] - want) < 1e-3, (text, x)


def test_defined_results_for_odd_rows(spark):
    model = ppm.train(spark.createDataFrame(TRAIN, SCHEMA))
    docs = spark.createDataFrame(
        [(1, None, "x", 0.5), (2, "", "x", 0.5), (3, "123 !?", "x", 0.5), (4, "the thing that", "x", 0.5), (4, "the thing that", "x", 0.5), (None, "und die katze " * 20_000, "x", 0.5)],
        "doc_id long, text string, lang_pred string, score double",
    )
    found = sorted(map(tuple, ppm.identify(docs, model).select("doc_id", "lang_pred", F.round("score", 3)).collect()), key=str)
    assert found == sorted([(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (4, "en", 1.0), (4, "en", 1.0), (None, "de", 1.0)], key=str)
    assert ppm.identify(docs.limit(0), model).count() == 0
    assert ppm.identify(docs, model).columns == ["doc_id", "text", "lang_pred", "score"]


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ppm.train(empty) is None
    assert ppm.train(spark.createDataFrame([(1, None, "en"), (2, "x", None)], SCHEMA)) is None
    one = spark.createDataFrame([(1, "some text", None)], SCHEMA)
    assert [tuple(r) for r in ppm.identify(one.select("doc_id", "text"), None).collect()] == [(1, "some text", "und", 0.0)]


def test_ties_go_to_the_first_language(spark):
    same = spark.createDataFrame([(1, "abc abc", "b"), (2, "abc abc", "a")], SCHEMA)
    row = ppm.identify(same, ppm.train(same)).first()
    assert (row["lang_pred"], row["score"]) == ("a", 0.5)


def test_a_small_table_keeps_the_frequent_contexts(spark):
    docs = spark.createDataFrame(TRAIN, SCHEMA)
    for cells in (0, 4_000):
        model = ppm.train(docs, cells=cells)
        assert model.costs.shape[0] <= max(cells // 2, model.width**2)
        assert ppm.identify(docs.where("doc_id = 1"), model).first()["lang_pred"] == "en"


def test_held_out_accuracy_on_whole_documents(spark):
    sf_dir = "/root/testdata/sf0.001"
    found = ppm.query(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = found.where("held_out and lang is not null and lang_pred <> 'und'")
    right, n = held.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 30 and right / n >= 0.9, (right, n)


def test_prediction_does_not_read_the_label(spark):
    model = ppm.train(spark.createDataFrame(TRAIN, SCHEMA))
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, "der hund und die", rng.choice(["en", "de", None])) for i in range(12)], SCHEMA)
    assert {r["lang_pred"] for r in ppm.identify(docs, model).collect()} == {"de"}
    assert docs.where(shards.crc_is(F.col("doc_id"), 3, 1)).count() < 12
