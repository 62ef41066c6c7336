"""Near-duplicate vectors by spherical-cap filters.

A filter is a cap around a direction. Directions are a random product code: the dimensions
are cut into blocks with ``CODES`` random unit vectors each, and a direction takes one from
each block, so there are ``CODES ** blocks`` of them but a vector's best ones are found from
short sorted lists (list decoding): the combination of the r1-th, r2-th, ... best codes has
at least r1 * r2 * ... combinations at or above it. Each vector goes to the ``LIST`` caps
that it reaches deepest into; near vectors share most of theirs.

Vectors of one label and filter meet in a task, which compares them in double precision by
matrix products and sends on counts of links by vector and a few links that span its
components, never pairs. A pair counts in the first filter that it shares only. Buckets over
``BLOCK`` vectors are cut into blocks, and every two blocks meet in a task of their own.
Equal vectors are one node with a weight, so copies meet once.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shards
from tidemark.llm.components import components
from tidemark.session import stage

BLOCKS, CODES, LIST, BLOCK = 4, 16, 24, 2048
_NODES = pa.schema([("vec_id", pa.int64()), ("node", pa.binary()), ("space", pa.string()), ("vector", pa.binary())])


def _codes(dims: int) -> list[np.ndarray]:
    rng = np.random.default_rng(11)
    out = []
    for part in np.array_split(np.arange(dims), min(BLOCKS, dims)):
        x = rng.standard_normal((CODES, len(part)))
        out.append(x / np.linalg.norm(x, axis=1, keepdims=True))
    return out


def _ranks(blocks: int, size: int) -> np.ndarray:
    """Rank tuples (from 0) that can be among the best ``size`` combinations."""
    best = range(min(CODES, size))
    return np.array([r for r in itertools.product(best, repeat=blocks) if math.prod(x + 1 for x in r) <= size])


def filters(vectors: np.ndarray, size: int = LIST) -> np.ndarray:
    """Sorted numbers of the ``size`` filters that each vector reaches deepest into."""
    codes = _codes(vectors.shape[1])
    parts = np.array_split(np.arange(vectors.shape[1]), len(codes))
    ranks = _ranks(len(codes), size)
    total, number = 0.0, 0
    for k, (code, part) in enumerate(zip(codes, parts, strict=True)):
        score = vectors[:, part] @ code.T
        order = np.argsort(-score, axis=1, kind="stable")
        pick = order[:, ranks[:, k]]
        total = total + np.take_along_axis(score, pick, 1)
        number = number * CODES + pick
    best = np.argsort(-total, axis=1, kind="stable")[:, :size]
    return np.sort(np.take_along_axis(number, best, 1), axis=1)


def _readable(rows: DataFrame, wide: bool) -> DataFrame:
    """vec_id, node, space (label and number of dimensions) and packed vector; NULLs where it can't be linked."""
    kind = np.float64 if wide else np.float32

    def run(batches):
        for batch in batches:
            out = []
            for label, vector in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = np.array(vector, kind) if vector and label is not None and None not in vector else np.empty(0)
                if len(x) and np.isfinite(x).all() and x.any():
                    space = f"{len(x)}:{label}"
                    data = (x + kind(0)).tobytes()  # without negative zeros
                    out.append((xxhash.xxh3_128_digest(space.encode() + b" " + data), space, data))
                else:
                    out.append((None, None, None))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, _NODES.types[1:], strict=True))], schema=_NODES)

    return rows.mapInArrow(run, "vec_id long, node binary, space string, vector binary")


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the components of a symmetric boolean matrix."""
    open_, links = np.ones(len(near), bool), []
    for start in range(len(near)):
        if not open_[start]:
            continue
        open_[start] = False
        edge = [start]
        while edge:
            i = edge.pop()
            found = np.flatnonzero(near[i] & open_)
            open_[found] = False
            links += [(i, int(j)) for j in found]
            edge += found.tolist()
    return links


def classes(vectors: DataFrame, least: float = 0.98, size: int = LIST, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of (vec_id, embedding, label).

    Rows link if their labels are equal and their cosine is ``least`` or more. Vectors that
    are NULL, empty, zero, or hold NULL or non-finite components link with nothing, nor do
    those without a label or of different lengths. Rows that repeat a vec_id are rows of their
    own: each is linked with the others that are near. A row without an id is never kept.
    """
    kind = dict(vectors.dtypes)["embedding"]
    wide = kind != "array<float>"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>" if wide else "array<float>"))
    number = np.float64 if wide else np.float32
    drawn = stage(_readable(rows, wide))
    nodes = stage(
        drawn.where("node is not null").groupBy("node").agg(F.first("space").alias("space"), F.first("vector").alias("vector"), F.count("*").alias("weight"))
    )

    def unit(data) -> np.ndarray:
        x = np.stack([np.frombuffer(d, number) for d in data]).astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def decode(batches):
        for batch in batches:
            data = batch.column(2).to_pylist()
            length = np.array([len(d) for d in data])
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                found = filters(unit([data[i] for i in mine]), size)
                take = pa.array(np.repeat(mine, found.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(found.ravel())], names=["node", "space", "filter"])

    seats = nodes.select("node", "space", "vector").mapInArrow(decode, "node binary, space string, filter long")
    sizes = seats.groupBy("space", "filter").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / block).cast("int")).drop("n")
    part = F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int")
    seats = seats.join(sizes, ["space", "filter"]).withColumn("part", part).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    seats = seats.select("node", "filter", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))

    def bucket(x, own, number_, side, weight):
        """Links counted by row, and spanning links, of one bucket or two of its blocks."""
        near = x @ x.T >= least
        np.fill_diagonal(near, False)
        if side is not None:
            near &= side[:, None] != side
        near |= near.T
        if not near.any():
            return None
        before = np.unique(own[own < number_])
        has = np.zeros((len(x), len(before)), np.float32)
        if len(before):
            at = np.minimum(np.searchsorted(before, own), len(before) - 1)
            row, column = np.nonzero(before[at] == own)
            has[row, at[row, column]] = 1
        return (near & ~(has @ has.T > 0)) @ weight, _forest(near)

    def compare(table):
        names, data = (table.column(c).to_pylist() for c in ("node", "vector"))
        index: dict[bytes, int] = {}
        place = np.array([index.setdefault(n, len(index)) for n in names])
        _, first = np.unique(place, return_index=True)
        length = np.array([len(data[i]) for i in first])
        xs, owns = [None] * len(first), [None] * len(first)
        for n in np.unique(length):
            mine = np.flatnonzero(length == n)
            x = unit([data[first[i]] for i in mine])
            for i, v, o in zip(mine, x, filters(x, size), strict=True):
                xs[i], owns[i] = v, o
        weight, part, low, high, number_ = (table.column(c).to_numpy().astype(np.int64) for c in ("weight", "part", "low", "high", "filter"))
        space = table.column("space").combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.lexsort((part, high, low, number_, space))
        new = np.zeros(len(order), bool)
        new[:1] = True
        for key in (space, number_, low, high):
            new[1:] |= key[order][1:] != key[order][:-1]
        links, edges = np.zeros(len(index), np.int64), []
        for i, j in shards.runs(np.cumsum(new)):
            at = order[i:j]
            if len(at) == 1:
                continue
            here, one = place[at], at[0]
            side = part[at] == low[one] if low[one] != high[one] else None
            made = bucket(np.stack([xs[k] for k in here]), np.stack([owns[k] for k in here]), number_[one], side, weight[at])
            if made:
                np.add.at(links, here, made[0])
                edges += [(names[at[a]], names[at[b]], 0) for a, b in made[1]]
        rows = [(name, None, int(links[k])) for name, k in index.items() if links[k]] + list(dict.fromkeys(edges))
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.table({"a": pa.array(columns[0], pa.binary()), "b": pa.array(columns[1], pa.binary()), "n": pa.array(columns[2], pa.int64())})

    # Many small buckets make one task's table; the number of tables grows with the cluster's partitions.
    tables = 4 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = seats.join(nodes.select("node", "space", "vector", "weight"), "node")
    met = met.withColumn("table", F.pmod(F.xxhash64("space", "filter", "low", "high"), F.lit(tables)))
    found = stage(met.groupBy("table").applyInArrow(compare, "a binary, b binary, n long"))
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    roots = components(found.where("b is not null").select("a", "b"))
    state = nodes.select("node", "weight").join(links, "node", "left").join(roots, "node", "left")
    state = state.select(F.col("node").alias("of"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    labelled = drawn.join(state, F.col("node") == F.col("of"), "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "root")
    smallest = labelled.where("root is not null").groupBy(F.col("root").alias("of")).agg(F.min("vec_id").alias("smallest"))
    made = labelled.join(smallest, F.col("root") == F.col("of"), "left")
    return made.select("vec_id", "n_links", F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("smallest")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    )


def query(spark, sf_dir):
    """op9: classes of all vectors that a cosine of 0.98 links within a label."""
    return classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), c AS (
  SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT c.node, l.b FROM c JOIN l ON c.seen = l.a
), m AS (SELECT node, min(seen) AS component_id FROM c GROUP BY node),
n AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN m ON node = vec_id LEFT JOIN n ON a = vec_id
"""
