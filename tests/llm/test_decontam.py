import random

import numpy as np
import pytest

from tidemark.llm import decontam

SF = "/root/testdata/sf0.001"


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def brute(docs, items):
    out = []
    for doc, text in docs:
        w = decontam.words(text)
        for item, passage in items:
            v = decontam.words(passage)
            n, limit = len(v), int(len(v) * 0.2 + 1e-9)
            if not n or item is None or not w:
                continue
            windows = [(s, w[s : s + n]) for s in range(max(1, len(w) - n + 1))]
            best = min(((distance(x, v), s, len(x)) for s, x in windows if len(set(x) & set(v)) >= len(set(v)) - limit - 1), default=None)
            if best and best[0] <= limit:
                out.append((doc, item, best[1], best[2], best[0]))
    return sorted(out)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        kind, at = rng.randrange(3), rng.randrange(len(words))
        if kind == 0:
            words[at] = f"new{rng.randrange(99)}"
        elif kind == 1:
            words.insert(at, f"new{rng.randrange(99)}")
        else:
            words.pop(at)
    return words


def test_equals_all_windows(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 4, 14, 15, 30, 59])))) for i in range(24)]
    items += [(100, None), (101, " .. "), (None, "w1 w2 w3"), (102, items[3][1].upper())]
    docs = []
    for i in range(150):
        own = rng.choices(vocabulary, k=rng.choice([0, 5, 80]))
        item = items[rng.randrange(24)][1].split()
        docs.append((i, " ".join(own + edited(rng, item, rng.randrange(len(item) // 4 + 1)) + own[:9])))
    docs += [(900, None), (901, ""), (902, "..."), (903, "(W1), " * 3000)]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, hits int")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    for chars in (decontam.BLOCK_CHARS, 1000):
        made = decontam.contamination(frame, bench, block_chars=chars).selectExpr("doc_id", "inline(hits)")
        assert sorted(tuple(r) for r in made.collect()) == brute(docs, items)


def test_small_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    made = sorted(tuple(r) for r in decontam.query(spark, SF).collect())
    assert made and made == brute(docs, items)


@pytest.mark.parametrize("n", [5, 14, 40])
def test_recall_at_the_limit(n):
    rng = random.Random(n)
    index = decontam.Items([(0, " ".join(f"w{i}" for i in range(n)))], decontam.SHARE, decontam.RECALL)
    limit, missed = int(decontam.edit_limit(n)), 0
    for _ in range(300):
        words = edited(rng, [f"w{i}" for i in range(n)], limit)
        text = " ".join([*words, *["pad"] * n])
        expected = any(distance(words[:n] + ["pad"] * max(0, n - len(words)), [f"w{i}" for i in range(n)]) <= limit for _ in (0,))
        missed += expected and not index.hits([text])[0]
    assert missed == 0


def test_edit_distances():
    rng = np.random.default_rng(1)
    left, right = rng.integers(0, 4, (50, 9)), rng.integers(0, 4, (50, 7))
    a, b = rng.integers(0, 10, 50), rng.integers(0, 8, 50)
    made = decontam.edit_distances(left, a, right, b)
    assert made.tolist() == [distance(x[:i].tolist(), y[:j].tolist()) for x, y, i, j in zip(left, right, a, b, strict=True)]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert decontam.contamination(docs.limit(0), items).count() == 0
    assert decontam.contamination(docs, items.limit(0)).first()["hits"] == []


def test_a_window_meets_few_items_however_many_there_are():
    """The table grows with the items, what a window finds in it hardly does."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    text = " ".join(rng.choices(vocabulary, k=4_000))
    met = []
    for items in (100, 3_000):
        index = decontam.Items([(i, " ".join(rng.choices(vocabulary, k=20))) for i in range(items)], decontam.SHARE, decontam.RECALL)
        own = index.lengths[0]
        symbols, sizes = index.symbols([text])
        # Windows before the bounds on their words, which random words of one vocabulary pass.
        start = np.arange(3_980)
        pairs = own.find(decontam.walk_keys(symbols, start, np.full(len(start), 20), own.sampled))
        met.append(len(pairs) / len(start))
        assert len(own.keys) == len(own.owner) == items * len(own.sampled)
        held = sum(a.nbytes for a in (own.keys, own.owner, own.words, own.most))
        assert held < items * (12 * len(own.sampled) + 100) + 4_000
    assert met[1] < 1 and met[1] < 4 * met[0] + 0.2, met


def test_long_repeated_and_odd_rows(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, "x " * 50_000 + passage + " y" * 50_000), (1, "x " * 50_000 + passage + " y" * 50_000), (None, passage), (2, "!!! ... ,")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(5, passage), (5, passage), (6, passage.upper())], "item_id long, text string")
    made = [tuple(r) for r in decontam.contamination(docs, items).selectExpr("doc_id", "inline(hits)").collect()]
    assert sorted(made, key=repr) == sorted([(1, i, 50_000, 20, 0) for i in (5, 6)] * 2 + [(None, i, 0, 20, 0) for i in (5, 6)], key=repr)
