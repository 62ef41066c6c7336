import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import lm, shards

SPACE = "\t\n\x0b\x0c\r"


def words(text):
    text = "".join(" " if c in SPACE else c.lower() if c.isascii() else c for c in text or "")
    return [w for w in text.split(" ") if w]


def discounts(values):
    n1, n2, n3, n4 = (sum(v == i for v in values) for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return [0, 0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    d = [0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return d if min(d[1:]) > 0 else [0, 0.5, 1.0, 1.5]


def brute(train, rows):
    """The model by dictionaries."""
    pairs = Counter()
    for t in train:
        w = [*words(t), "</s>"]
        pairs.update(zip(["<s>", *w[:-1]], w, strict=True))
    count, contexts, followers = Counter(), Counter(), defaultdict(list)
    for (u, w), n in pairs.items():
        count[w] += n
        contexts[w] += 1
        followers[u].append(n)
    total, distinct = sum(count.values()), len(count)
    d2, d1 = discounts(list(pairs.values())), discounts(list(contexts.values()))
    rest1 = sum(d1[min(n, 3)] for n in contexts.values()) / len(pairs)

    def p(u, w):
        p1 = max(contexts[w] - d1[min(contexts[w], 3)], 0) / len(pairs) + rest1 / (distinct + 1)
        if u not in followers:
            return p1
        all_ = sum(followers[u])
        n = pairs[u, w]
        return max(n - d2[min(n, 3)], 0) / all_ + sum(d2[min(x, 3)] for x in followers[u]) / all_ * p1

    out = []
    for i, text in rows:
        w = [*words(text), "</s>"]
        base = sum(math.log10((count[x] + 1) / (total + distinct + 1)) for x in w)
        out.append((i, len(w), sum(count[x] > 0 for x in w), base, sum(math.log10(p(u, x)) for u, x in zip(["<s>", *w[:-1]], w, strict=True))))
    return total, out


def agree(made, expected):
    assert [r[:3] for r in made] == [r[:3] for r in expected]
    for a, b in zip(made, expected, strict=True):
        assert a[3] == pytest.approx(b[3], abs=1e-6) and a[4] == pytest.approx(b[4], abs=1e-6)


@pytest.mark.parametrize("share", [1e-3, 0.05, 1.0])
def test_equals_dictionaries(spark, share):
    rng = random.Random(1)
    vocabulary = ["the"] * 30 + [f"w{int(rng.paretovariate(0.7))}" for _ in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(60))) for _ in range(80)] + ["rare Once", None, "", "the the the " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = lm.train(docs.where("doc_id % 3 > 0"), share=share)
    total, expected = brute([t for i, t in enumerate(texts) if i % 3], list(enumerate(texts)))
    made = sorted(tuple(r) for r in lm.score(docs, model).drop("text").collect())
    assert model.train_tokens == total
    agree(made, expected)


def test_probabilities_sum_to_one(spark):
    texts = ["a b c a b", "b a", "c c c a", "a b b", "d"]
    model = lm.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    vocabulary = ["a", "b", "c", "d", "e"]  # e is the one unknown word
    known = shards.hash_words([w.encode() for w in vocabulary], {})
    follow = np.r_[known, lm.END]
    for context in (known[0], known[1], known[4], lm.START):
        before = np.full(len(follow), context)
        hashes, place = np.unique(np.r_[before, follow], return_inverse=True)
        stats, contexts = model.words(hashes)
        u, w = place[: len(follow)], place[len(follow) :]
        p1 = (model._share(contexts, model.pairs, model.word_discounts) + model.word_rest / (model.distinct + 1))[w]
        total = stats[0][u]
        d = model.pair_discounts
        rest = np.where(total > 0, (d[1] * stats[1] + d[2] * stats[2] + d[3] * stats[3])[u] / np.maximum(total, 1), 1.0)
        keys, back = np.unique(lm._keys(before, follow, model.hot, model.bits), return_inverse=True)
        n = model.by_pair.find(keys, "pair_n")[1].astype(int)[back]
        assert (np.maximum(n - d[np.minimum(n, 3)], 0) / np.maximum(total, 1) + rest * p1).sum() == pytest.approx(1)


def test_query_on_every_document(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    total, expected = brute([t for i, t in rows if not held[i]], rows)
    made = sorted(lm.query(spark, sf).collect())
    assert [(r["held_out"], r["train_tokens"]) for r in made] == [(held[i], total) for i, _ in rows]
    agree([(r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in made], expected)
    out = [r for r in made if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    assert lm.score(none, lm.train(some)).count() == 0
    assert {r["score"] for r in lm.score(some, lm.train(none)).collect()} == {0.0}
