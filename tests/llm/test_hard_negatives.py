"""Hard negatives against brute force over all pairs."""

import math
import random

import numpy as np

from vaultshift.llm import hard_negatives as H

SCHEMA = "id long, label long, vector array<float>, block string, leaf string, v string"


def brute(rows, scale=256, every=100, positives=5, negatives=5, low=80, high=100):
    kept = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, label, [max(-H.BOUND, min(H.BOUND, math.floor(scale * float(np.float32(x))))) for x in v]))

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = []
    for a in sorted({i for i, _, _ in kept if i % every == 0}):
        _, label, v = min((r for r in kept if r[0] == a), key=lambda r: r[1:])
        best = sorted((-score(v, w), i) for i, k, w in kept if k == label and i != a)[:positives]
        others = sorted((-score(v, w), i) for i, k, w in kept if k != label)
        for s, p in best:
            inside = [x for x in others if low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(a, p, n, i, -s, -t) for n, (t, i) in enumerate(inside, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in H.mine(df, **more).collect())


def clustered(n, seed, dim=6):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(8)]
    return [(i, rnd.randrange(3), [x + rnd.gauss(0, 0.2) for x in rnd.choice(centres)]) for i in range(n)]


def test_matches_brute_force_with_many_leaves_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 16)
    monkeypatch.setattr(H, "FAN", 4)
    rows = clustered(600, 1) + [(i, i % 3, [0.5] * 6) for i in range(600, 900)]  # a third of all rows at one place
    got = mined(spark, rows, every=20)
    assert got == brute(rows, every=20) and len(got) > 200


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 4)
    monkeypatch.setattr(H, "LEAST", 2)
    inf, nan = float("inf"), float("nan")
    rows = [(0, 1, [1.0, 2.0]), (0, 1, [1.0, 1.0]), (0, 0, [3.0, 1.0]), (100, 1, []), (200, 0, [1.0]), (-100, 0, [1e30, -1e30]),
            (None, 1, [1.0]), (3, None, [1.0]), (4, 1, None), (5, 1, [None, 1.0]), (6, 1, [nan]), (7, 1, [inf, 0.0]), (8, 0, [-inf])]
    rows += [(9, 0, [1.0, 2.0])] * 3 + [(10 + i, i % 2, [1.0, float(i % 3)]) for i in range(12)] + [(300, 7, [1.0, 1.0])]
    assert mined(spark, rows) == brute(rows)


def test_no_rows_zero_vectors_and_other_parameters(spark):
    assert mined(spark, []) == [] == mined(spark, [(0, None, [1.0])])
    rows = [(i, i % 2, [0.0, 0.0]) for i in range(300)]
    assert mined(spark, rows) == brute(rows) != []
    rows = clustered(300, 2)
    more = dict(scale=64, every=7, positives=3, negatives=2, low=50, high=95)
    assert mined(spark, rows, **more) == brute(rows, **more) != []


def test_ranges_rule_out_leaves_but_never_a_row_of_the_window():
    x = np.array([[math.floor(256 * c) for c in v] for _, _, v in clustered(2000, 3)])
    m2 = float((x * x).sum(1).max())
    tree = H.fit_tree(x[:500], 6, m2, True, 20_000)
    leaf = H.place(tree, x)
    seen = 0
    for a in x[::100].astype(float):
        scores = x @ a
        top = np.sort(scores)[-20:]
        found = H.surviving(tree, a, top[:1], top[-1:])
        seen += len(found)
        assert set(leaf[(scores >= top[0]) & (scores <= top[-1])]) <= set(found)
    assert tree.leaves > 20 and seen < 0.5 * tree.leaves * 20
