"""Merkle manifest of a dataset, and Octopus multiproofs for any part of its rows.

A row is a leaf. The leaves of a source form a tree of runs of three, its root is the source's
subroot, and the subroots form the tree above, whose root stands for the dataset. A node is
named by (tree, level, index); tree ``TOP`` is the one above, the others are numbered in the
order of their sources.

Leaf digests are made where the rows are read, so texts are never shuffled. Leaves are dealt
by ranges of (source, id, digest), so a source with a third of all rows is spread over tasks;
counts of each (source, range) give their positions. A block of ``3**DEPTH`` leaves rises
``DEPTH`` levels in one small group, and the nodes on its top are the leaves of the next round.

A multiproof treats a block's leaves at once: it lists the nodes that its leaves need and can't
derive (each once, the least there can be), fetches them by one join, derives the nodes between,
and writes out each leaf's own proof from what it has then.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import shards
from tidemark.session import stage

ARITY, DEPTH, TOP = 3, 6, -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "tree long, size long, level int, index long, digest string"
_NODES = pa.schema([("tree", pa.int64()), ("size", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("digest", pa.string())])


def _digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def widths(leaves: int) -> list[int]:
    """Nodes of each level, from the leaves to the root."""
    out = [leaves]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


def row_digest(columns) -> F.Column:
    """Digest of one row: ``-`` for NULL, else the value's UTF-8 length, a colon and the value."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _numbered(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """Adds ``index``, the place of a row within ``by``, and ``size``, the rows there are; staged.

    Rows are dealt by ranges, equal ones too; only counts by (group, range) are windowed.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*[F.col(c).asc_nulls_first() for c in by], *order]
    dealt = df.withColumn("_copy", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(parts, *keys, "_copy").sortWithinPartitions(*keys, "_copy").drop("_copy")
    rows = stage(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    runs = rows.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part")
    runs = runs.select(
        *by,
        F.col("_part").alias("_run"),
        "_first",
        F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*by)).alias("size"),
    )
    runs = runs.withColumnsRenamed({c: f"_{c}" for c in by})
    same = rows["_part"] == runs["_run"]
    for c in by:
        same &= rows[c].eqNullSafe(runs[f"_{c}"])
    return rows.join(runs, same).select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("index"), "size")


def _rise(table: pa.Table) -> pa.Table:
    """The nodes above one block of siblings, at most ``DEPTH`` levels of them."""
    tree, size, level = (table.column(c)[0].as_py() for c in ("tree", "size", "level"))
    nodes = dict(zip(table.column("index").to_pylist(), table.column("digest").to_pylist(), strict=True))
    out = []
    for up in range(level + 1, min(level + DEPTH, len(widths(size)) - 1) + 1):
        runs: dict[int, list[str]] = {}
        for i in sorted(nodes):
            runs.setdefault(i // ARITY, []).append(nodes[i])
        nodes = {i: _digest(run) for i, run in runs.items()}
        out += [(tree, size, up, i, d) for i, d in nodes.items()]
    columns = list(zip(*out, strict=True)) or [[]] * 5
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NODES, strict=True)], schema=_NODES)


def _grown(leaves: DataFrame, tallest: int) -> DataFrame:
    """All nodes above the leaves (rows of ``_NODE`` at level 0), round by round."""
    rounds, level = [], leaves
    for base in range(0, len(widths(tallest)) - 1, DEPTH):
        # A tree that already ended in its root has no level to rise to.
        block = (F.col("index") / ARITY**DEPTH).cast("long").alias("_block")
        made = stage(level.where(F.col("size") > ARITY**base).groupBy("tree", block).applyInArrow(_rise, _NODE))
        rounds.append(made)
        level = made.where(F.col("level") == base + DEPTH)
    out = leaves.limit(0)
    for made in rounds:
        out = out.unionByName(made)
    return out


@dataclass(frozen=True)
class Manifest:
    """Leaves with their coordinates (tree, size, index), all nodes, the number of sources and the root."""

    leaves: DataFrame
    nodes: DataFrame
    sources: int
    root: str | None


def manifest(docs: DataFrame, columns=FIELDS, extra: dict | None = None) -> Manifest:
    """The tree over ``docs``: leaves ascend by doc_id within a source, sources bytewise, NULL first.

    The leaf digest covers ``columns``; ``extra`` adds columns to the leaves, made from the row
    before it is left behind. Other columns are ignored, so they can't clash. A NULL id comes
    before all others, equal ids are ordered by digest, repeated rows are leaves of their own;
    NULL and empty texts differ; texts of any length are read whole. No rows: no root.
    """
    made = docs.select("doc_id", "source", row_digest([F.col(c) for c in columns]).alias("leaf"), *[c.alias(n) for n, c in (extra or {}).items()])
    placed = stage(_numbered(made, ["source"], [F.col("doc_id").asc_nulls_first(), "leaf"]))
    sources = placed.where("index = 0").select("source", F.col("size").alias("_size"))
    ranked = _numbered(sources, [], [F.col("source").asc_nulls_first()]).select(F.col("source").alias("_source"), F.col("index").alias("tree"))
    leaves = stage(placed.join(ranked, placed["source"].eqNullSafe(ranked["_source"])).drop("_source"))
    facts = leaves.agg(F.max("size"), F.max("tree")).first()
    if facts[0] is None:
        return Manifest(leaves, leaves.sparkSession.createDataFrame([], _NODE), 0, None)
    count = facts[1] + 1
    bottom = leaves.select("tree", "size", F.lit(0).alias("level"), "index", F.col("leaf").alias("digest"))
    inner = _grown(bottom, facts[0])
    # The root of a tree is the only node of its level, and a lone leaf is its own root.
    roots = bottom.where("size = 1").unionByName(inner.where(F.col("index") == 0))
    top = Window.partitionBy("tree")
    highest = roots.withColumn("_top", F.max("level").over(top)).where("level = _top")
    subroots = stage(highest.select(F.lit(TOP).cast("long").alias("tree"), F.lit(count).cast("long").alias("size"), F.lit(0).alias("level"), F.col("tree").alias("index"), "digest"))
    above = _grown(subroots, count)
    root = subroots.unionByName(above).orderBy(F.desc("level")).first()["digest"]
    return Manifest(leaves, bottom.unionByName(inner).unionByName(subroots).unionByName(above), count, root)


def _missing(size: int, known: set[int]) -> list[tuple[int, int]]:
    """The (level, index) that a set of leaves needs to reach the root and can't derive."""
    out = []
    for level, width in enumerate(widths(size)[:-1]):
        above = {i // ARITY for i in known}
        out += [(level, i) for p in sorted(above) for i in range(p * ARITY, min(width, p * ARITY + ARITY)) if i not in known]
        known = above
    return out


def missing(table: pa.Table, sources: int) -> pa.Table:
    """The coordinates that one block of leaves has to fetch, each once."""
    tree, block, size = (table.column(c)[0].as_py() for c in ("tree", "_block", "size"))
    own = _missing(size, set(table.column("index").to_pylist()))
    wanted = [(tree, *at) for at in own] + [(TOP, *at) for at in _missing(sources, {tree})]
    columns = [[tree] * len(wanted), [block] * len(wanted), *(zip(*wanted, strict=True) if wanted else [[]] * 3)]
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["tree", "_block", "_tree", "level", "index"])


class _Block:
    """What a block of leaves knows after its fetch: the nodes of every level on the way up."""

    def __init__(self, tree: int, size: int, sources: int, leaves: dict[int, str], fetched: dict):
        own, top = widths(size), widths(sources)
        self.turn = len(own) - 1  # the level of the subroot, which is a leaf of the tree above
        self.width = own[:-1] + top
        self.tree, self.levels = tree, []
        nodes = leaves
        for level, width in enumerate(self.width):
            if level == self.turn:
                self.subroot = nodes[0]
                nodes = {tree: self.subroot}
            name = (tree, level) if level < self.turn else (TOP, level - self.turn)
            nodes = nodes | fetched.get(name, {})
            self.levels.append(nodes)
            if level + 1 < len(self.width):
                above = {i // ARITY for i in nodes}
                nodes = {p: _digest([nodes[i] for i in self.run(level, p)]) for p in above if all(i in nodes for i in self.run(level, p))}
        self.root = self.levels[-1][0]
        self.tails: dict[tuple[int, int], str] = {}

    def run(self, level: int, parent: int) -> range:
        return range(parent * ARITY, min(self.width[level], parent * ARITY + ARITY))

    def index(self, level: int, leaf: int) -> int:
        return leaf // ARITY**level if level < self.turn else self.tree // ARITY ** (level - self.turn)

    def beside(self, level: int, index: int) -> tuple[str, str]:
        """Digests left and right of a node in its run."""
        nodes, run = self.levels[level], self.run(level, index // ARITY)
        return "".join(nodes[i] for i in run if i < index), "".join(nodes[i] for i in run if i > index)

    def proof(self, level: int, leaf: int) -> str:
        """The siblings from this level to the root; nodes that leaves share are written out once."""
        if level + 1 >= len(self.width):
            return ""
        at = level, self.index(level, leaf)
        if at not in self.tails:
            self.tails[at] = "".join(self.beside(*at)) + self.proof(level + 1, leaf)
        return self.tails[at]

    def fold(self, leaf: int, digest: str) -> str:
        """The root that this leaf digest leads to; from a node that is known, the way is known."""
        for level in range(len(self.width) - 1):
            at = self.index(level, leaf)
            if self.levels[level][at] == digest:
                return self.root
            left, right = self.beside(level, at)
            digest = _digest([left, digest, right])
        return digest


def prove(tree: Manifest, claims: DataFrame, claimed: str = "leaf", siblings: bool = False) -> DataFrame:
    """Proof and verification of some or all leaves: adds subroot, root, proof_sha256, folded_root, verified.

    ``claims`` are rows of ``tree.leaves``; the digest in ``claimed`` is folded with the proof's
    siblings, which stem from the manifest. ``siblings`` adds the proof itself, its hex digests
    joined. A leaf may be claimed once.
    """
    block = (F.col("index") / ARITY**DEPTH).cast("long").alias("_block")
    rows = claims.withColumn("_block", block)
    count = tree.sources

    def ask(table: pa.Table) -> pa.Table:
        return missing(table, count)

    asked = rows.select("tree", "size", "index", "_block").groupBy("tree", "_block").applyInArrow(ask, "tree long, _block long, _tree long, level long, index long")
    have = tree.nodes.select(F.col("tree").alias("_tree"), F.col("level").cast("long").alias("level"), "index", "digest")
    fetched = asked.join(have, ["_tree", "level", "index"]).select("tree", "_block", "_tree", "level", "index", "digest")
    added = [("subroot", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string())] + [("siblings", pa.string())] * siblings

    def expand(table: pa.Table, found: pa.Table) -> pa.Table:
        nodes: dict[tuple[int, int], dict[int, str]] = {}
        for r in found.to_pylist():
            nodes.setdefault((r["_tree"], r["level"]), {})[r["index"]] = r["digest"]
        at, digests = table.column("index").to_pylist(), table.column("leaf").to_pylist()
        own = _Block(table.column("tree")[0].as_py(), table.column("size")[0].as_py(), count, dict(zip(at, digests, strict=True)), nodes)
        folded = [own.fold(i, d) for i, d in zip(at, table.column(claimed).to_pylist(), strict=True)]
        proofs = [own.proof(0, i) for i in at]
        values = [[own.subroot] * len(at), [_digest([p]) for p in proofs], folded] + [proofs] * siblings
        out = table.drop_columns(["_block"])
        for (name, kind), value in zip(added, values, strict=True):
            out = out.append_column(name, pa.array(value, kind))
        return out

    form = T.StructType([*claims.schema.fields, *[T.StructField(n, T.StringType()) for n, _ in added]])
    made = rows.groupBy("tree", "_block").cogroup(fetched.groupBy("tree", "_block")).applyInArrow(expand, form)
    root = F.lit(tree.root).cast("string")
    return made.withColumn("root", root).withColumn("verified", F.col("folded_root") == root)


def query(spark, sf_dir):
    """op12: every document's leaf, its proof, and whether the row still verifies after tampering."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    hurt = [F.translate(c, "\n", "") if c == "text" else F.col(c) for c in FIELDS]
    held = F.when(shards.crc_is(F.col("doc_id"), 2, 0), row_digest(hurt)).otherwise(row_digest([F.col(c) for c in FIELDS]))
    tree = manifest(docs, extra={"held": held})
    proved = prove(tree, tree.leaves, "held")
    return proved.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _oracle(depth: int = 10, top: int = 6) -> str:
    """Trees of up to ``3**depth`` leaves, level by level, as joined tables."""
    part = lambda c: f"coalesce(CAST(strlen({c}) AS VARCHAR) || ':' || {c}, '-')"
    row = lambda text: "sha256(" + " || ".join(part(c) for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"
    crc = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(list_filter(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: c <> ''),
             lambda c: [ord(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) ELSE xor(acc >> 1, 3988292384 * (acc & 1)) END), 4294967295)"""
    flat = "replace(text, chr(10), '')"
    out = [
        f"rows_ AS (SELECT doc_id, source, {row('text')} AS leaf, CASE WHEN {crc} % 2 = 0 THEN {row(flat)} ELSE {row('text')} END AS held FROM documents)",
        """l0 AS (SELECT doc_id, source, leaf, held, leaf AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
             count(*) OVER (PARTITION BY source) AS n FROM rows_)""",
        "p0 AS (SELECT doc_id, source, leaf, i, held AS f, '' AS proof FROM l0)",
    ]

    def levels(name, walk, key, height):
        for k in range(height):
            same = f"a.{key} IS NOT DISTINCT FROM b.{key}"
            out.append(
                f"""{name}s{k} AS (SELECT a.{key}, a.i, a.n, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS lefts,
                    coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS rights
                    FROM {name}{k} a JOIN {name}{k} b ON {same} AND a.i // 3 = b.i // 3 GROUP BY a.{key}, a.i, a.n)"""
            )
            at = walk(k)
            out.append(
                f"""{at[1]} AS (SELECT p.* REPLACE (p.i // 3 AS i, CASE WHEN s.n > 1 THEN sha256(s.lefts || p.f || s.rights) ELSE p.f END AS f,
                    p.proof || s.lefts || s.rights AS proof) FROM {at[0]} p JOIN {name}s{k} s ON p.{key} IS NOT DISTINCT FROM s.{key} AND p.i = s.i)"""
            )
            out.append(
                f"""{name}{k + 1} AS (SELECT {key}, i // 3 AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h,
                    (any_value(n) + 2) // 3 AS n FROM {name}{k} GROUP BY {key}, i // 3)"""
            )

    levels("l", lambda k: (f"p{k}", f"p{k + 1}"), "source", depth)
    out.append(f"t0 AS (SELECT 0 AS one, source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM l{depth})")
    out.append(f"q0 AS (SELECT p.* REPLACE (t.i AS i), 0 AS one, t.h AS subroot FROM p{depth} p JOIN t0 t ON p.source IS NOT DISTINCT FROM t.source)")
    levels("t", lambda k: (f"q{k}", f"q{k + 1}"), "one", top)
    return "WITH " + ",\n".join(out) + f"""
SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = t.h AS verified FROM q{top} q, t{top} t"""


ORACLE = _oracle()
