"""Every stage of the pipeline against brute force, on what the stage before it kept."""

import numpy as np
import pytest
import test_decontam
import test_secrets
import test_setsketch
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import bpe
from tidemark.session import stage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The rows of documents before and after each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    more = [(90_001, None, "en", "x", 0), (90_002, "", None, None, None), (90_003, "123 456", "en", None, 7), (None, "Of the and a thing in the", None, None, 5)]
    docs = docs.union(spark.createDataFrame(more, docs.schema))
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, spark.createDataFrame(out[-1], docs.schema) if len(out) <= 5 else None, SF)
        if stage is not corpus_pipeline.tokens:
            assert made.columns == docs.columns
        out.append(made.collect())
    return out


def ids(rows):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)


def test_language_drops_what_has_none(steps):
    assert {r["doc_id"] for r in steps[0]} - {r["doc_id"] for r in steps[1]} == {90_001, 90_002, 90_003}


def test_one_of_each_class_stays(steps):
    expected = test_setsketch.brute([(r["doc_id"], r["text"]) for r in steps[1] if r["doc_id"] is not None], 5, 80)
    assert ids(steps[2]) == ids([r for r in steps[1] if r["doc_id"] is None or r["doc_id"] in {x[0] for x in expected if x[3]}])
    assert len(steps[2]) < len(steps[1])


def test_contaminated_documents_go(spark, steps):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {x[0] for x in test_decontam.brute([(r["doc_id"], r["text"]) for r in steps[2] if r["doc_id"] is not None], items)}
    assert hit and ids(steps[3]) == ids([r for r in steps[2] if r["doc_id"] not in hit])


def test_secrets_are_replaced(steps):
    made = {r["doc_id"]: r for r in steps[4]}
    assert len(made) == len(steps[3])
    changed = 0
    for r, (_, spans) in zip(steps[3], test_secrets.brute([r["text"] for r in steps[3]]), strict=True):
        text, at = "", 0
        for start, _, _, end in spans:
            if start >= at:
                text += r["text"][at:start] + "[secret]"
            at = max(at, end)
        text += r["text"][at:]
        changed += bool(spans)
        assert made[r["doc_id"]]["text"] == text and made[r["doc_id"]]["n_chars"] == len(text)
    assert changed


def test_tokens_equal_the_library(steps):
    tokenizer = Tokenizer.from_file(bpe.public_path())
    made = {r["doc_id"]: r for r in steps[5]}
    assert len(made) == len(steps[4])
    for r in steps[4]:
        expected = tokenizer.encode(r["text"], add_special_tokens=False).ids
        assert np.frombuffer(made[r["doc_id"]]["ids"], "<u4").tolist() == expected
        assert made[r["doc_id"]]["n_tokens"] == len(expected)
        assert made[r["doc_id"]]["decoded"] == tokenizer.decode(expected, skip_special_tokens=False)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        assert made.count() == 0


def test_columns_of_documents_are_kept_whatever_their_names(spark):
    """Own columns that bear the names of a stage's working columns come through unchanged."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    more = {"score": "0.75", "hits": "array(1)", "found": "'f'", "base": "doc_id", "lang_pred": "'und'", "kept": "false", "digest": "'d'", "_own_text": "'t'"}
    docs = stage(docs.selectExpr("*", *[f"{v} AS {c}" for c, v in more.items()]))
    plain = {r["doc_id"]: r for r in docs.collect()}
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, SF))
        assert docs.count() > 0, name
        for r in docs.collect():
            assert [r[c] for c in more] == [plain[r["doc_id"]][c] for c in more], name
