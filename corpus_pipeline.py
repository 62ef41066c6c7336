"""The corpus pipeline: each stage is one operator of ``tidemark.llm`` applied to what is left.

Every stage works on all rows that its predecessor kept, and all but the last return the
columns of documents. NULL and empty texts leave with the first stage, which finds no
language in them; a row without an id stays unless its text is rejected. Each stage handles
empty input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, ppm, secrets, setsketch
from tidemark.session import stage


def _beside(docs: DataFrame, made: tuple[str, ...], function) -> DataFrame:
    """The columns of ``docs`` after ``function``, whose own columns ``made`` may bear names that ``docs`` has."""
    hidden = {c: f"_own_{c}" for c in docs.columns if c in made}
    out = function(docs.withColumnsRenamed(hidden))
    return out.select(*[F.col(hidden.get(c, c)).alias(c) for c in docs.columns])


def language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the labels of this table teach; ``und`` goes."""
    model = ppm.train(docs)
    return _beside(docs, ("lang_pred", "score"), lambda rows: ppm.identify(rows, model).where("lang_pred <> 'und'"))


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each class of near-duplicates (five words, similarity 0.8).

    A doc_id goes when none of its rows is the one to keep.
    """
    found = setsketch.classes(docs, 5, 80)
    gone = found.where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a window within a fifth of its words of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _beside(docs, ("hits",), lambda rows: decontam.contamination(rows, items).where(F.size("hits") == 0))


def secret_scan(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; ``n_chars`` follows."""

    def clean(rows):
        made = secrets.redact(secrets.scan(rows))
        return made.withColumn("n_chars", F.length("text").cast(rows.schema["n_chars"].dataType)) if "n_chars" in rows.columns else made

    return _beside(docs, ("base", "found"), clean)


def tokens(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (little-endian unsigned 32-bit) and the text they decode to."""
    tokenizer = bpe.read_tokenizer(bpe.public_path())
    # Written in between, so that a task has one worker at a time and not two.
    both = bpe.decode(stage(bpe.encode(docs, tokenizer).drop("text")), tokenizer)
    return both.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("tokens", tokens),
]
#: The trained language model and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """Every stage is written once, so that none is computed again by those after it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = step(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stage(docs)
    return docs
