import numpy as np
import pytest
from oracle_check import compare, duck

from tidemark.llm import capfilters

SF = "/root/testdata/sf0.001"


def brute(rows, least):
    def good(x):
        return x and None not in x and np.isfinite(x).all() and np.any(x)

    n = len(rows)
    near = np.zeros((n, n), bool)
    for i, (_, a, p) in enumerate(rows):
        for j, (_, b, q) in enumerate(rows[:i]):
            if p is not None and p == q and good(a) and good(b) and len(a) == len(b):
                a64, b64 = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
                near[i, j] = near[j, i] = a64 @ b64 / np.linalg.norm(a64) / np.linalg.norm(b64) >= least
    label = list(range(n))
    for i, j in capfilters._forest(near):
        old, new = label[j], label[i]
        label = [new if x == old else x for x in label]
    least_id = {x: min(r[0] for r, y in zip(rows, label, strict=True) if y == x) for x in set(label)}
    return sorted((r[0], int(near[i].sum()), least_id[label[i]], r[0] == least_id[label[i]]) for i, r in enumerate(rows))


def made_up(seed, dims=24):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(260):
        if i % 20 == 0:
            base = rng.standard_normal(dims)
        x = base * rng.choice([1, 3]) + rng.standard_normal(dims) * rng.choice([0, 0.1, 0.14, 0.2, 1])
        rows.append((int(1000 - i), x.astype(np.float32).tolist(), int(rng.integers(3)) if i % 3 else i // 20 % 3))
    nan, inf = float("nan"), float("inf")
    return [*rows, (5000, rows[0][1], rows[0][2]), (5001, rows[0][1], rows[0][2]), (5002, None, 1), (5003, [], 1), (5004, [0.0] * dims, 1), (5005, [nan] * dims, 1), (5006, [inf] + [1.0] * (dims - 1), 1), (5007, [None] + [1.0] * (dims - 1), 1), (5008, rows[0][1], None), (5009, [1.0], 1), (5010, [2.0], 1), (5011, [1e-30] * dims, 2), (5012, [1e30] * dims, 2)]


@pytest.mark.parametrize(("seed", "block"), [(1, 2048), (2, 3)])
def test_equals_all_pairs(spark, seed, block):
    rows = made_up(seed)
    frame = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, label int, node int")
    made = sorted(tuple(r) for r in capfilters.classes(frame, block=block).collect())
    assert made == brute(rows, 0.98)


def test_repeated_ids_doubles_and_empty_table(spark):
    rows = [(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (2, [2.0, 1.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    made = sorted(map(repr, map(tuple, capfilters.classes(frame).collect())))
    assert made == sorted(map(repr, [(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (2, 0, 2, True)]))
    assert capfilters.classes(frame.limit(0)).count() == 0


def test_list_decoding_finds_the_deepest_filters():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((20, 12))
    codes, parts = capfilters._codes(12), np.array_split(np.arange(12), 4)
    scores = [x[:, p] @ c.T for p, c in zip(parts, codes, strict=True)]
    every = (scores[0][:, :, None, None, None] + scores[1][:, None, :, None, None] + scores[2][:, None, None, :, None] + scores[3][:, None, None, None, :]).reshape(20, -1)
    assert (capfilters.filters(x, 24) == np.sort(np.argsort(-every, axis=1)[:, :24], axis=1)).all()


def test_recall_at_the_threshold():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.standard_normal((4000, 64))
    away -= (away * x).sum(1, keepdims=True) * x
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * away
    shared = (capfilters.filters(x)[:, :, None] == capfilters.filters(y)[:, None, :]).any((1, 2))
    assert shared.mean() > 0.999


def test_query_matches_oracle(spark):
    assert compare(capfilters.query(spark, SF), duck(SF), capfilters.ORACLE) is None
