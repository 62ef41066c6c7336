import random

import pytest

from tidemark.llm.components import components


def brute(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return sorted((x, find(x)) for x in root)


def found(spark, links):
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    return sorted((r["node"], r["root"]) for r in rows)


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    assert found(spark, links) == brute(links)


def test_chain_star_cycle_and_odd_links(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)] + [(150, 100)]
    cycle = [(200, 201), (201, 202), (202, 200)]
    shared_child = [(309, 301), (309, 302)]
    odd = [(None, 1), (2, None), (400, 400), (309, 301)]
    links = chain + star + cycle + shared_child + odd
    assert found(spark, links) == brute(links)


def test_no_links(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, 1), (None, None)]) == []
