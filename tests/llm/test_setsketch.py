import random

import numpy as np
import pytest

from tidemark.llm import setsketch


def brute(rows, k, percent):
    """Sets of word tuples, all pairs, smallest id of each component."""
    def words(t):
        return "".join(c if c not in "\t\n\x0b\x0c\r" else " " for c in (t or "")).split(" ")

    sets = []
    for _, text in rows:
        w = [x for x in words("".join(c.lower() if c.isascii() else c for c in text or "")) if x]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, len(s), least[find(i)] if s else doc, doc == (least[find(i)] if s else doc)) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True)))


def made_up(seed, n=160):
    """Families of near copies around the threshold, exact copies and short texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, base = [], []
    for i in range(n):
        if i % 20 == 0:
            base = rng.choices(vocabulary, k=rng.choice([3, 40, 120]))
        text = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        rows.append((i * 7 % n, " ".join(text)))
    return [*rows, (1000, None), (1001, ""), (1002, " \n\t"), (1003, "one"), (1004, "ONE"), (1005, "two words"), (1006, "İ ſ K"), (1007, "i̇ s k"), (1008, "Ä b c"), (1009, "ä B C")]


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 85, 8192), (5, 80, 8192), (3, 85, 4)])
def test_equals_all_pairs(spark, k, percent, block):
    rows = made_up(k + block)
    docs = spark.createDataFrame([(a, b, 5) for a, b in rows], "doc_id long, text string, n_shingles int")
    made = sorted(tuple(r) for r in setsketch.classes(docs, k, percent, block=block).collect())
    assert made == brute(rows, k, percent)


def test_every_document_of_the_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    made = sorted(tuple(r) for r in setsketch.query(spark, "/root/testdata/sf0.001").collect())
    assert made == brute(rows, 3, 85)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (None, "q r s"), (None, None)]
    made = setsketch.classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted(map(repr, map(tuple, made))) == sorted(
        map(repr, [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, 1, False), (None, 1, None, False), (None, 0, None, False)])
    )
    assert setsketch.classes(spark.createDataFrame([], "doc_id long, text string"), 3, 85).count() == 0


def test_registers_merge_and_estimate():
    random_ = np.random.default_rng(3)
    both = random_.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.unique(both[:2500]), np.unique(both[500:])
    r = setsketch.registers([a, b, np.union1d(a, b)], 96)
    assert (np.maximum(r[0], r[1]) == r[2]).all()
    n = np.array([len(a)]), np.array([len(b)])
    assert setsketch.similar_enough(r[:1], r[1:2], *n, 0.6)[0] and not setsketch.similar_enough(r[:1], r[1:2], *n, 0.95)[0]


def test_forest_with_many_components():
    random_ = np.random.default_rng(4)
    base = random_.integers(0, 2**60, 60, dtype=np.uint64)
    sets = [np.unique(np.where(random_.random(60) < p, base, random_.integers(0, 2**60, 60, dtype=np.uint64))) for p in random_.choice([0.8, 0.9, 0.97], 80)]
    links = setsketch.confirmed_forest(sets, 70)
    root = list(range(80))

    def find(x, of):
        while of[x] != x:
            x = of[x]
        return x

    for i, j in links:
        assert find(i, root) != find(j, root)
        root[find(i, root)] = find(j, root)
    true = list(range(80))
    for i in range(80):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 70 * (len(sets[i]) + len(sets[j]) - both):
                true[find(i, true)] = find(j, true)
    groups = lambda r: {frozenset(i for i in range(80) if find(i, r) == x) for x in {find(i, r) for i in range(80)}}
    assert groups(root) == groups(true)
