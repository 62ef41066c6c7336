"""Removal of repeated word windows: seed and extend.

Documents meet on winnowed seeds of ``seed`` words (``anchors``). From there all segments of
a seed are extended at once, a word at a time, to the left and to the right: after each step
the segments that agree so far have one number. A window is a stretch to the left and one to
the right of its seed, so two windows are equal if both numbers are. Windows that overlap
join to maximal repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import anchors, shards

WINDOW, SEED = 13, 5


def _extend(content, first, room, group, steps, way):
    """Numbers of segments that agree for 0, 1, ... steps; -1 where a segment is too short."""
    numbers = [group]
    for step in range(steps):
        open_ = np.flatnonzero(room > step)
        word = content[first[open_] + way * step]
        _, word = np.unique(word, return_inverse=True)
        _, same = np.unique(numbers[-1][open_] * (len(content) + 1) + word, return_inverse=True)
        longer = np.full(len(group), -1)
        longer[open_] = same
        numbers.append(longer)
    return numbers


def _classes(window: int, seed: int):
    def find(content, sizes, before, group):
        starts, reach = np.cumsum(sizes) - sizes, window - seed
        left = _extend(content, starts + before - 1, before, group, reach, -1)
        right = _extend(content, starts + before + seed, sizes - before - seed, group, reach, 1)
        out, last = [], 0
        for back in range(reach + 1):
            whole = np.flatnonzero((left[back] >= 0) & (right[reach - back] >= 0))
            both = left[back][whole] * (len(sizes) + 1) + right[reach - back][whole]
            _, cls = np.unique(both, return_inverse=True)
            out.append((whole, before[whole] - back, cls + last))
            last += len(whole)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    return find


def _words(texts):
    words = [t.split() for t in texts]
    known = _words.known
    return shards.hash_words([w for x in words for w in x], known), np.array([len(x) for x in words], np.int64)


_words.known = {}


def method(window: int = WINDOW, seed: int = SEED) -> anchors.Method:
    return anchors.Method(window, seed, _words, _classes(window, seed), False)


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, kept: texts without windows that a smaller doc_id also has.

    All is judged on the input; kept words are joined by one space. A NULL text has no words.
    A row without an id keeps all and repeats nothing; repeats within one doc_id stay.
    """
    how = method(window, seed)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    repeats = anchors.find_repeats(rows, how)

    def apply(batches):
        for batch in batches:
            for part, texts, which, ids in anchors.pieces(batch):
                words = [t.split() for t in texts]
                removed, kept = np.zeros(len(words), np.int64), [b" ".join(w) for w in words]
                symbols, sizes = _words([texts[i] for i in which])
                gone = repeats.marks(symbols, sizes, ids)
                ends = np.cumsum(sizes)
                sums = np.r_[0, np.cumsum(gone)]
                for row, start, end in zip(which, ends - sizes, ends, strict=True):
                    if sums[end] > sums[start]:
                        removed[row] = sums[end] - sums[start]
                        kept[row] = b" ".join(w for w, x in zip(words[row], gone[start:end].tolist(), strict=True) if not x)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"]
                )

    return rows.mapInArrow(apply, "doc_id long, n_words long, n_removed long, kept string")


def query(spark, sf_dir):
    """op8: every document without the windows of 13 words that smaller ids also have."""
    made = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return made.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), p AS (
  SELECT r, doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM t
), g AS (
  SELECT r, doc_id, i, w[i:i + 12] AS win FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM t)
), first AS (SELECT win, min(doc_id) AS d FROM g GROUP BY win),
hit AS (SELECT DISTINCT r, i + unnest(range(13)) AS i FROM g JOIN first USING (win) WHERE doc_id > d),
k AS (
  SELECT p.r, count(*) AS n_words, count(hit.r) AS n_removed,
    coalesce(string_agg(word, ' ' ORDER BY p.i) FILTER (WHERE hit.r IS NULL), '') AS kept
  FROM p LEFT JOIN hit USING (r, i) GROUP BY p.r
)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN k USING (r)
"""
