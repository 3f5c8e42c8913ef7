"""Components against a plain union-find."""

import random

import pytest

from vaultshift.llm.components import components


def brute(links):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {x: root(x) for x in up}


def result(spark, links):
    d = spark.createDataFrame([(*x, 1, "z") for x in links], "a long, b long, node int, component string")
    rows = components(d).collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.component for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_links(spark, seed):
    g = random.Random(seed)
    links = [(g.randrange(60), g.randrange(60)) for _ in range(45)]
    links += [(b, a) for a, b in links[:9]] + links[:5]
    assert result(spark, links) == brute(links)


def test_chain_star_and_odd_links(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(1000, 2000 + i) for i in range(30)]
    odd = [(None, 5), (6, None), (None, None), (77, 77), (-3, -9)]
    links = chain + star + odd
    got = result(spark, links)
    assert got == brute(links) and 77 not in got and got[-3] == -9


def test_no_links(spark):
    assert result(spark, []) == {}
