"""Near-duplicate documents by SetSketch registers.

A register keeps the smallest of exponentially distributed hashes of a set, truncated to an
exponentially spaced grid (base ``BASE``). Registers of a union are the larger of the parts'
registers, and equal registers become likelier with similarity, so bands of register values
find candidates. For a candidate pair the counts of larger, smaller and equal registers give
the likelihood of every similarity, with the set sizes known exactly.

1. Each text becomes a set of shingle hashes, a digest of the set and its registers. Equal
   sets are one node from here on, so exact copies never meet in pairs.
2. Nodes that share a band are linked to the smallest node of that band: a star, one link per
   node and band. Links whose likelihood rules out even half of the wanted similarity go.
3. Components of the stars are families. Every pair that shares a band is in one family.
4. Inside a family links are confirmed on the full sets. A link between two components has
   an end outside the larger one, so once a few nodes were compared with all others, only
   nodes outside the largest component still need to be. Families over ``BLOCK`` nodes are
   cut into blocks and every two blocks meet in a task of their own.

No pairs of a family are ever rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shards
from tidemark.llm.components import components
from tidemark.session import stage

BASE, RATE, LIMIT = 1.001, 20.0, 65_534
REGISTERS, ROWS = 96, 5  # 19 bands of 5: a pair of similarity 0.85 is missed with probability 1e-5, of 0.8 with 5e-4
BLOCK = 8192
_MULTIPLIERS = np.random.default_rng(20_240_229).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SKETCHES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("registers", pa.binary())])


def shingle_sets(texts: list[bytes], k: int, known: dict[bytes, int]) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes.

    A text of fewer than ``k`` words has one shingle, the whole sequence; without words none.
    """
    out = []
    for text in texts:
        words = text.lower().split()
        n = len(words)
        if not n:
            out.append(np.empty(0, np.uint64))
            continue
        w = shards.hash_words(words, known)
        width = min(k, n)
        acc = np.full(n - width + 1, width, np.uint64)
        for i in range(width):
            acc = acc * np.uint64(0x9E3779B97F4A7C15) ^ w[i : n - width + 1 + i]
            acc ^= acc >> np.uint64(29)
        out.append(np.unique(shards.mix(acc)))
    return out


def registers(sets: list[np.ndarray], m: int) -> np.ndarray:
    """One row of register values for each set; the sets must not be empty."""
    if not sets:
        return np.empty((0, m), np.uint16)
    flat = np.concatenate(sets)
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    least = np.empty((len(sets), m))
    for i in range(m):
        least[:, i] = np.minimum.reduceat(flat * _MULTIPLIERS[i], starts)
    exponential = -np.log1p(-np.minimum((least + 1) * 2.0**-64, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / math.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def similar_enough(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float, doubt: float = 12.5) -> np.ndarray:
    """Whether the joint likelihood leaves a similarity of ``least`` or more open.

    A pair goes only if every such similarity is ``exp(doubt)`` times less likely than the
    best one (five standard errors), or the sizes alone rule it out.
    """
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    top = np.minimum(na, nb) / np.maximum(na, nb)

    def log_likelihood(j):
        p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
        x, y = p(u - v * j), p(v - u * j)
        return sum(n * np.log(np.maximum(q, 1e-12)) for n, q in ((more, x), (less, y), (same, 1 - x - y)))

    grid = np.linspace(0, 1, 65)
    best = np.max([log_likelihood(np.minimum(g, top)) for g in grid], axis=0)
    wanted = np.max([log_likelihood(np.minimum(g, top)) for g in np.r_[least, grid[grid > least]]], axis=0)
    return (top >= least) & (wanted >= best - doubt)


def sketches(docs: DataFrame, k: int, m: int = REGISTERS, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_shingles, digest of the set and registers (both NULL for an empty set)."""

    def run(batches):
        known: dict[bytes, int] = {}
        for batch in batches:
            texts = shards.texts_of(batch.column(1))
            for i, j in shards.chunks([len(x) for x in texts]):
                sets = shingle_sets(texts[i:j], k, known)
                made = iter(registers([s for s in sets if len(s)], m))
                rows = [(xxhash.xxh3_128_digest(s.tobytes()), next(made).tobytes()) if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], pa.array([len(s) for s in sets], pa.int64()), *(pa.array(c, pa.binary()) for c in zip(*rows, strict=True))], schema=_SKETCHES
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(shards.trimmed(run), "doc_id long, n_shingles long, digest binary, registers binary")


def _bands(nodes: DataFrame, m: int, rows: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, m)
            for i in range(m // rows):
                key = np.full(len(values), i + 1, np.uint64)
                for column in values[:, i * rows : (i + 1) * rows].T:
                    key = shards.mix(key * np.uint64(0x9E3779B97F4A7C15) ^ column)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0)], names=["band", "node"])

    return nodes.select("digest", "registers").mapInArrow(shards.trimmed(run), "band long, node binary")


def _stars(nodes: DataFrame, m: int, rows: int, least: float) -> DataFrame:
    """Links (a, b) from each node to the smallest node of each of its bands, where plausible."""
    bands = _bands(nodes, m, rows)
    heads = bands.groupBy(F.col("band").alias("of")).agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    links = stage(bands.join(heads, F.col("band") == F.col("of")).where("node <> b").select(F.col("node").alias("a"), "b").distinct())
    side = lambda s: nodes.select(F.col("digest").alias(s), F.col("registers").alias(f"r{s}"), F.col("n_shingles").alias(f"n{s}"))
    pairs = links.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ra", "rb", "na", "nb")

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, m) for i in (2, 3))
            na, nb = (batch.column(i).to_numpy() for i in (4, 5))
            keep = pa.array(similar_enough(a, b, na, nb, least), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(keep)

    return pairs.mapInArrow(shards.trimmed(run), "a binary, b binary")


def confirmed_forest(sets: list[np.ndarray], percent: int, split: int | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that span the components of 100 * intersection >= percent * union.

    With ``split`` only links between sets before it and sets from it on are looked for.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    ids, place = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    label, links = np.arange(n), []
    done, count = np.zeros(n, bool), np.ones(n, int)
    flag = np.zeros(len(ids), bool)
    while True:
        giant = int(count.argmax())
        open_ = np.flatnonzero(~done & ((label != giant) | (count[giant] == 1)))
        if not len(open_) or count[giant] == n:
            return links
        i = int(open_[0])
        done[i] = True
        mine = place[starts[i] : starts[i] + sizes[i]]
        flag[mine] = True
        both = np.bincount(owner[flag[place]], minlength=n)
        flag[mine] = False
        near = 100 * both >= percent * (sizes + sizes[i] - both)
        if split is not None:
            near &= (np.arange(n) < split) != (i < split)
        others = np.flatnonzero(near & (label != label[i]))
        for j in others[np.unique(label[others], return_index=True)[1]].tolist():
            links.append((i, j))
            old, new = label[j], label[i]
            count[new] += count[old]
            count[old] = 0
            label[label == old] = new


def classes(docs: DataFrame, k: int, percent: int, m: int = REGISTERS, rows: int = ROWS, block: int = BLOCK, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: components of links of ``percent`` similarity.

    A NULL or empty text, or one without words, is linked with nothing. Rows that repeat a
    doc_id are all returned, and are kept or not alike. A row with a NULL id links others but
    is never kept; a group of such rows only has a NULL component.
    """
    spark = docs.sparkSession
    shards.small_batches(spark)
    drawn = stage(sketches(docs, k, m, id_col, text_col))
    nodes = stage(
        drawn.where("digest is not null").groupBy("digest").agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("rep"), F.first("registers").alias("registers"), F.first("n_shingles").alias("n_shingles"))
    )
    family = components(_stars(nodes, m, rows, percent / 200))
    parts = F.ceil(F.count("*") / block).cast("int").alias("parts")
    family = stage(family.join(family.groupBy("root").agg(parts), "root").join(nodes.select(F.col("digest").alias("node"), "rep"), "node"))

    # The full sets of family members only, from the texts, without shuffling any other text.
    folder, bits = shards.shared_folder(spark, "members"), shards.shard_bits(spark)

    def send(batches):
        for batch in batches:
            keys = np.unique(shards.mix(batch.column(0).to_numpy().astype(np.int64).view(np.uint64)))
            yield shards.cut(bits, keys, keys)

    def write(shard, packed):
        shards.save(f"{folder}/keys-{shard}.npy", np.unique(shards.unpack(packed, "u8")[0]))
        return pa.RecordBatch.from_arrays([pa.array([1])], names=["n"])

    shards.reduce_shards(family.select("rep").mapInArrow(shards.trimmed(send), shards.BLOCK), write, "n long").agg(F.sum("n")).collect()
    wanted = shards.Mapped(folder, bits)

    def members(batches):
        known: dict[bytes, int] = {}
        for batch in batches:
            ids = batch.column(0).fill_null(-(2**63)).to_numpy().astype(np.int64)
            keys = shards.mix(ids.view(np.uint64))
            order = np.argsort(keys)
            hit = np.sort(order[wanted.find(keys[order])[0]])
            part = batch.take(pa.array(hit))
            texts = shards.texts_of(part.column(1))
            for i, j in shards.chunks([len(x) for x in texts]):
                found = {xxhash.xxh3_128_digest(s.tobytes()): s.tobytes() for s in shingle_sets(texts[i:j], k, known) if len(s)}
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], names=["digest", "shingles"])

    sets = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(shards.trimmed(members), "digest binary, shingles binary")
    # Member x of a family of p parts goes to every two parts with its own: p tasks.
    part = F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int")
    seats = family.withColumn("part", part).select(
        "root", "node", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    ).select("root", "node", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))

    def confirm(table):
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        rows = {d: (p, s) for d, p, s in zip(*(table.column(c).to_pylist() for c in ("node", "part", "shingles")), strict=True)}
        names = sorted(rows, key=lambda d: (rows[d][0], d))
        found = [np.frombuffer(rows[d][1], np.uint64) for d in names]
        links = confirmed_forest(found, percent, sum(rows[d][0] == low for d in names) if low != high else None)
        return pa.table({"a": pa.array([names[i] for i, _ in links], pa.binary()), "b": pa.array([names[j] for _, j in links], pa.binary())})

    seated = seats.join(sets, F.col("node") == F.col("digest")).select("root", "low", "high", "part", "node", "shingles")
    linked = components(seated.groupBy("root", "low", "high").applyInArrow(confirm, "a binary, b binary"))
    labelled = drawn.join(linked, F.col("digest") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("root", "digest").alias("root"))
    least = labelled.where("root is not null").groupBy(F.col("root").alias("of")).agg(F.min("doc_id").alias("least"))
    return labelled.join(least, F.col("root") == F.col("of"), "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def query(spark, sf_dir):
    """op3: near-duplicate classes of all documents, on three-word shingles at 0.85."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 85)
