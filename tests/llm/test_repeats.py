import hashlib
import random

import numpy as np
import pytest
from oracle_check import compare, duck

from tidemark.llm import anchors, seeds, suffix

SF = "/root/testdata/sf0.001"


def brute_bytes(rows, length):
    """The definition: every window in order of (doc_id, start)."""
    first = {}
    order = sorted((i for i, (d, _) in enumerate(rows) if d is not None), key=lambda i: rows[i][0])
    texts = [(t or "").encode() for _, t in rows]
    for i in order:
        for s in range(len(texts[i]) - length + 1):
            key, at = texts[i][s : s + length], (rows[i][0], s)
            first[key] = min(first.get(key, at), at)
    out = []
    for i, (d, _) in enumerate(rows):
        gone = bytearray(len(texts[i]))
        for s in range(len(texts[i]) - length + 1) if d is not None else ():
            if first[texts[i][s : s + length]] < (d, s):
                gone[s : s + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(texts[i], gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((d, len(texts[i]), sum(gone), spans, kept))
    return out


def brute_words(rows, window):
    first, split = {}, [(t or "").encode().split() for _, t in rows]
    for i, (d, _) in enumerate(rows):
        for s in range(len(split[i]) - window + 1) if d is not None else ():
            key = tuple(split[i][s : s + window])
            first[key] = min(first.get(key, d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        gone = [False] * len(split[i])
        for s in range(len(split[i]) - window + 1) if d is not None else ():
            if first[tuple(split[i][s : s + window])] < d:
                gone[s : s + window] = [True] * window
        out.append((d, len(split[i]), sum(gone), b" ".join(w for w, g in zip(split[i], gone, strict=True) if not g).decode()))
    return out


def made_up(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["a", "ab", "é", "lorem", "ipsum", "dolor"] + [f"w{i}" for i in range(40)]
    passage = " ".join(rng.choices(vocabulary, k=80))
    rows = []
    for i in range(n):
        own = " ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 30, 100])))
        text = rng.choice([own, own + passage, passage[rng.randrange(100) :] + own, own + " x" * rng.randrange(200), passage])
        if rng.random() < 0.3 and rows:
            text = rows[rng.randrange(len(rows))][1] + own[:20]
        rows.append((n - i, text))
    rows += [(70, rows[3][1]), (70, rows[3][1]), (None, rows[3][1]), (None, None), (71, None), (72, ""), (73, "\x00" * 300 + "x" + "\x00" * 150), (74, "ab" * 5000)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, kept string")


@pytest.mark.parametrize(("seed", "hot"), [(1, 4096), (2, 4096), (3, 2)])
def test_bytes_equal_brute_force(spark, seed, hot, monkeypatch):
    monkeypatch.setattr(anchors, "HOT", hot)
    rows = made_up(seed)
    made = sorted(tuple(r) for r in suffix.remove_repeats(frame(spark, rows).where("doc_id is not null")).collect())
    assert made == sorted(r for r in brute_bytes(rows, 100) if r[0] is not None)


def test_bytes_of_rows_without_an_id(spark):
    made = suffix.remove_repeats(frame(spark, made_up(1))).where("doc_id is null").collect()
    assert sorted(bytes(r["kept"]) for r in made) == sorted((t or "").encode() for d, t in made_up(1) if d is None)


@pytest.mark.parametrize(("seed", "hot"), [(1, 4096), (2, 4096), (3, 2)])
def test_words_equal_brute_force(spark, seed, hot, monkeypatch):
    monkeypatch.setattr(anchors, "HOT", hot)
    rows = made_up(seed)
    key = lambda r: (r[0] is None, r[0] or 0, *map(repr, r[1:]))
    made = sorted((tuple(r) for r in seeds.remove_repeats(frame(spark, rows)).collect()), key=key)
    assert made == sorted(brute_words(rows, 13), key=key)


def test_small_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    made = sorted(tuple(r) for r in suffix.query(spark, SF).collect())
    assert made == sorted((*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in brute_bytes(rows, 100))
    assert compare(seeds.query(spark, SF), duck(SF), seeds.ORACLE) is None


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffix.remove_repeats(none).count() == 0 and seeds.remove_repeats(none).count() == 0


def test_intervals_equal_prefixes():
    rng = np.random.default_rng(5)
    cells = rng.integers(0, 3, (60, 25)).astype(np.uint16)
    group = np.sort(rng.integers(0, 4, 60))
    for length in (1, 2, 7, 20):
        order, bounds = suffix.prefix_classes(cells, group, length)
        classes = {}
        for at, (row, cls) in enumerate(zip(order.tolist(), np.cumsum(bounds).tolist(), strict=True)):
            column = at // 60
            part = cells[row, column : column + length].tolist()
            if len(part) == length and 0 not in part:
                classes.setdefault((column, int(group[row]), *part), set()).add(cls)
        assert all(len(x) == 1 for x in classes.values())
        assert len({next(iter(x)) for x in classes.values()}) == len(classes)
