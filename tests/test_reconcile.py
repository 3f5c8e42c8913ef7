"""Digest tree over key ranges against plain Python."""

import datetime as dt
import random
from collections import Counter

from vaultshift.operators import reconcile as R

SCHEMA = "k long, a string, b double"


def brute(a, b, fan, leaf):
    keys = [r[0] for r in a + b if r[0] is not None]
    low, high = (min(keys), max(keys)) if keys else (None, None)
    width = 1
    while keys and width < high - low + 1:
        width *= fan
    out = []

    def look(level, lo, hi, x, y, w):
        if not x and not y:
            return
        cx, cy = Counter(x), Counter(y)
        differs = cx != cy
        closed = differs and (lo is None or max(len(x), len(y)) <= leaf or w == 1)
        shown = (None if lo is None else lo, None if lo is None else min(hi, high))
        out.append((level, *shown, len(x), len(y), differs, sum((cx - cy).values()) if closed else None, sum((cy - cx).values()) if closed else None))
        if differs and not closed:
            part = w // fan
            for i in range(fan):
                s = lo + i * part
                look(level + 1, s, s + part - 1, [r for r in x if s <= r[0] < s + part], [r for r in y if s <= r[0] < s + part], part)

    look(0, None, None, [r for r in a if r[0] is None], [r for r in b if r[0] is None], width)
    if keys:
        look(0, low, high, [r for r in a if r[0] is not None], [r for r in b if r[0] is not None], width)
    return sorted(out, key=repr)


def found(spark, a, b, fan=4, leaf=8):
    return sorted((tuple(r) for r in R.row_diff_ranges(
        spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), ["k"], fan, leaf).collect()), key=repr)


def test_ranges_match_brute_force(spark):
    rnd = random.Random(3)
    a = [(rnd.randrange(-500, 900), rnd.choice("xyz"), None if i % 9 == 0 else i / 7) for i in range(700)]
    a += [(42, "hot", 1.0)] * 300 + [(None, "n", 1.0), (None, "n", 1.0)]
    b = [r for i, r in enumerate(a) if i % 151] + [(5, "new", 0.0), (42, "hot", 2.0)]
    b[10] = (b[10][0], "changed", b[10][2])
    assert found(spark, a, b) == brute(a, b, 4, 8)
    assert found(spark, a, b[:-1], 64, 256) == brute(a, b[:-1], 64, 256)


def test_equal_tables_move_digests_only(spark):
    a = [(i, "x", float(i)) for i in range(5000)]
    got = found(spark, a, a[::-1])
    assert got == [(0, 0, 4999, 5000, 5000, False, None, None)]


def test_one_changed_row_opens_one_chain(spark):
    a = [(i, "x", float(i)) for i in range(20_000)]
    b = [(i, "x", 0.5 if i == 12_345 else float(i)) for i in range(20_000)]
    got = found(spark, a, b, 8, 16)
    assert sum(r[5] for r in got) == max(r[0] for r in got) + 1 and len(got) <= 8 * 5
    assert [r[6:] for r in got if r[6] is not None] == [(1, 1)]


def test_empty_sides_and_null_keys(spark):
    a = [(1, "x", 1.0), (None, "y", 2.0)]
    assert found(spark, a, []) == brute(a, [], 4, 8)
    assert found(spark, [], a[1:]) == brute([], a[1:], 4, 8) and found(spark, [], []) == []


def test_other_keys(spark):
    far = [(-(1 << 63), "x", 1.0), ((1 << 63) - 1, "y", 1.0), (0, "z", 2.0)]
    got = R.row_diff_ranges(*[spark.createDataFrame(x, SCHEMA) for x in (far, far[:2])], ["k"], 4, 1).collect()
    assert sum(r.removed or 0 for r in got) == 1 and sum(r.added or 0 for r in got) == 0
    days = [(dt.date(2020, 1, 1) + dt.timedelta(i), f"n{i}") for i in range(100)]
    one, two = (spark.createDataFrame(x, "d date, s string") for x in (days, days[:50] + days[51:]))
    got = R.row_diff_ranges(one, two, ["d"], 4, 4).collect()
    first = (dt.date(2020, 1, 1) - dt.date(1970, 1, 1)).days
    assert [(r.lo, r.hi) for r in got if r.removed] and all(r.lo <= first + 50 <= r.hi for r in got if r.differs)
    got = R.row_diff_ranges(one, two, ["d", "s"], 4, 4).collect()
    assert sum(r.removed or 0 for r in got) == 1
