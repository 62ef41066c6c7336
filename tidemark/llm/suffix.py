"""Exact removal of repeated byte strings, by intervals on a Burrows-Wheeler transform.

The segments that ``anchors`` brings together for a seed are laid under each other, so that
the seed stands in the same columns; equal strings start in the same column then. For each
column the suffixes from there on are sorted, from the last column to the first: a stable
sort by the byte before turns one order into the next (a positional transform). Common
prefixes are then derived without comparing text, by increasing length: the suffixes of a
column with a common prefix of ``n`` bytes are an interval, and going back over the byte
before each leads from the bounds of the intervals for ``n`` to those for ``n + 1``. Only
intervals that were split in the last round are extended, all of them at once (breadth
first), and the search stops at the minimum length: the intervals left are the classes of
equal strings of that length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import anchors, shards

SEED = 40


def prefix_classes(cells: np.ndarray, group: np.ndarray, length: int):
    """(order, bounds): by column, the rows in suffix order and where an interval of ``length`` begins.

    ``cells`` has a row for each segment and a symbol from 1 on in each column, or 0 where the
    segment has nothing; rows of a group (numbers up to 65,535, rising) are compared.
    """
    rows, columns = cells.shape
    group = group.astype(np.uint16)
    order = np.empty((columns, rows), np.int64)
    back, previous = np.full((columns, rows), -1, np.int64), np.full((columns, rows), -1, np.int64)
    bounds = np.zeros((columns, rows), bool)
    now = np.arange(rows)
    for c in range(columns - 1, -1, -1):
        by = np.argsort(cells[now, c], kind="stable")
        by = by[np.argsort(group[now[by]], kind="stable")]
        now = now[by]
        symbol, of = cells[now, c], group[now]
        new = np.ones(rows, bool)
        # Where a segment has nothing it differs from everything.
        new[1:] = (symbol[1:] != symbol[:-1]) | (of[1:] != of[:-1]) | (symbol[1:] == 0)
        order[c], bounds[c] = now, new
        if c + 1 < columns:
            # Back step from the next column: where each row went, and who of the same symbol is before it.
            at = (c + 1) * rows
            back[c + 1, by] = np.where(symbol > 0, c * rows + np.arange(rows), -1)
            previous[c + 1, by[1:]] = np.where(new[1:], -1, at + by[:-1])
    order, back, previous, bounds = (x.ravel() for x in (order, back, previous, bounds))
    fresh = np.flatnonzero(bounds)
    for _ in range(length - 1):
        starts = np.flatnonzero(bounds)
        at = np.searchsorted(starts, fresh)
        n = np.r_[starts[1:], len(bounds)][at] - fresh
        first = np.repeat(fresh, n)
        inside = first + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        to = back[inside[previous[inside] < first]]
        to = to[to >= 0]
        fresh = np.unique(to[~bounds[to]])
        if not len(fresh):
            break
        bounds[fresh] = True
    return order, bounds


def _classes(length: int, seed: int):
    reach = length - seed

    def find(content, sizes, before, group):
        # The seed starts in column ``reach``.
        cells = np.zeros((len(sizes), reach + length), np.uint16)
        row = np.repeat(np.arange(len(sizes)), sizes)
        column = np.arange(len(content)) + np.repeat(reach - before - np.cumsum(sizes) + sizes, sizes)
        cells[row, column] = content.astype(np.uint16) + 1
        out, last = [], 0
        group = group - (group[0] if len(group) else 0)
        for i, j in shards.runs(group // 65_536):
            order, bounds = prefix_classes(cells[i:j], group[i:j] % 65_536, length)
            segment = order + i
            offset = np.repeat(np.arange(reach + length), j - i) - reach + before[segment]
            full = (offset >= 0) & (sizes[segment] - offset >= length)
            out.append((segment[full], offset[full], last + np.cumsum(bounds)[full]))
            last += len(order)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    return find


def _bytes(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.array([len(x) for x in texts], np.int64)


def method(length: int, seed: int = SEED) -> anchors.Method:
    return anchors.Method(length, seed, _bytes, _classes(length, seed), True)


def remove_repeats(docs: DataFrame, length: int = 100, seed: int = SEED) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept: texts without strings that start earlier.

    A byte goes if a string of ``length`` bytes that covers it also starts in a document with
    a smaller doc_id, or earlier in the same one. Overlaps count; all is judged on the input.
    A NULL text is empty. A row without an id is returned whole and repeats nothing. Rows with
    the same doc_id and text are at the same place, so neither is earlier than the other.
    ``seed`` must be shorter than ``length``.
    """
    how = method(length, seed)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    repeats = anchors.find_repeats(rows, how)

    def apply(batches):
        for batch in batches:
            for part, texts, which, ids in anchors.pieces(batch):
                made = [[len(t), 0, 0, t] for t in texts]
                symbols, sizes = _bytes([texts[i] for i in which])
                gone = repeats.marks(symbols, sizes, ids)
                ends = np.cumsum(sizes)
                sums = np.r_[0, np.cumsum(gone)]
                for row, start, end in zip(which, ends - sizes, ends, strict=True):
                    if sums[end] > sums[start]:
                        mine = gone[start:end]
                        made[row][1:] = int(sums[end] - sums[start]), int(mine[0]) + int((mine[1:] & ~mine[:-1]).sum()), symbols[start:end][~mine].tobytes()
                columns = list(zip(*made, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
                )

    return rows.mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark, sf_dir):
    """op2: every document without the strings of 100 bytes that start earlier."""
    made = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return made.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
