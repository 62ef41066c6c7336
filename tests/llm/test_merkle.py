import hashlib
import random
import zlib

import pytest
from oracle_check import compare, duck
from pyspark.sql import functions as F

from tidemark.llm import merkle as M

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text=None):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"] if text is None else text]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def grow(nodes):
    """All levels of the tree over these digests."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H(*last[i : i + 3]) for i in range(0, len(last), 3)])
    return levels


def walk(levels, i):
    for nodes in levels[:-1]:
        a = i // 3 * 3
        yield nodes[a:i], nodes[i + 1 : a + 3]
        i //= 3


def brute(rows):
    """What the query has to return, from trees held whole."""
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: grow([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    top = grow([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (_, _, digest, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            hurt = zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None
            folded, proof = leaf(r, r["text"].replace("\n", "")) if hurt else digest, []
            for left, right in [*walk(trees[s], i), *walk(top, k)]:
                proof += left + right
                folded = H(*left, folded, *right)
            out.append((r["doc_id"], digest, trees[s][-1][0], top[-1][0], H(*proof), folded, folded == top[-1][0]))
    return out


def odd_rows(n=1700):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        source = rng.choice(["a", "a", "b", None, "ü", "", f"s{i % 40}"])
        rows.append({"doc_id": rng.choice([i, i, i, i // 2, None]), "text": rng.choice([None, "", "\n", f"x\ny {i}", "é\n" * 5]), "lang": rng.choice(["en", None]), "source": source, "n_chars": rng.choice([None, 3])})
    rows += [{"doc_id": 9_000, "text": "word\n" * 60_000, "lang": "en", "source": "long", "n_chars": 5}]
    return rows + rows[:50]


@pytest.mark.parametrize("parts", [1, 7])
def test_odd_rows_against_whole_trees(spark, tmp_path, parts):
    rows = odd_rows()
    spark.createDataFrame(rows, SCHEMA).repartition(parts).write.parquet(str(tmp_path / "documents.parquet"))
    made = [tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in M.query(spark, str(tmp_path)).collect()]
    assert sorted(made, key=repr) == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("size", [1, 2, 3, 4, 9, 10, 28, 81, 730])
def test_tree_sizes(spark, size):
    """Lone leaves, full runs and runs of one, above and below a block."""
    rows = [{"doc_id": i, "text": f"t{i}", "lang": None, "source": s, "n_chars": i} for s in "xy" for i in range(size if s == "x" else 1)]
    tree = M.manifest(spark.createDataFrame(rows, SCHEMA))
    assert tree.root == brute(rows)[0][3]


def test_a_multiproof_fetches_the_least(spark):
    """A few leaves of one tree: what is fetched is exactly what they can't derive, and it proves them."""
    rows = [{"doc_id": i, "text": f"t{i}", "lang": None, "source": "x" if i < 800 else f"s{i}", "n_chars": i} for i in range(810)]
    tree = M.manifest(spark.createDataFrame(rows, SCHEMA))
    some = tree.leaves.where("doc_id in (0, 1, 2, 4, 799, 805)")
    proved = {r["doc_id"]: r for r in M.prove(tree, some, siblings=True).collect()}
    full = {r[0]: r for r in brute(rows)}
    assert len(proved) == 6
    for i, r in proved.items():
        assert r["verified"] and r["folded_root"] == tree.root and H(r["siblings"]) == r["proof_sha256"] == full[i][4]
    # Leaves 0 to 2 make their own run; 4 lacks two, and then each level lacks two up to the block's edge.
    assert M._missing(9, {0, 1, 2, 4}) == [(0, 3), (0, 5), (1, 2)]
    assert M._missing(10, {9}) == [(2, 0)]
    assert M._missing(1, {0}) == []


def test_any_change_is_found(spark):
    rows = [{"doc_id": i, "text": f"line {i}\nnext", "lang": "en", "source": f"s{i % 4}", "n_chars": i} for i in range(60)]
    tree = M.manifest(spark.createDataFrame(rows, SCHEMA))
    claims = tree.leaves.withColumn("claim", F.when(F.col("doc_id") % 5 == 0, F.sha2("leaf", 256)).otherwise(F.col("leaf")))
    for r in M.prove(tree, claims, "claim").collect():
        assert r["verified"] == (r["doc_id"] % 5 != 0)


def test_no_rows_and_clashing_columns(spark):
    none = M.manifest(spark.createDataFrame([], SCHEMA))
    assert none.root is None and M.prove(none, none.leaves).count() == 0
    rows = [{"doc_id": i, "text": "t", "lang": None, "source": "x", "n_chars": i} for i in range(5)]
    plain = spark.createDataFrame(rows, SCHEMA)
    clash = plain.withColumns({c: F.lit("z") for c in ("index", "size", "tree", "leaf", "_part", "_block", "digest")})
    assert M.manifest(clash).root == M.manifest(plain).root


def test_query(spark):
    assert compare(M.query(spark, SF), duck(SF), M.ORACLE) is None
