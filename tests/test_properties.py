"""Property checks against plain-Python references on small random inputs."""

import random

import pytest

from vaultshift.operators import preflight, views


def can_be_made(views_, deps, existing):
    """Views that some order can create."""
    made = set()
    while True:
        new = {v for v in views_ if v not in made and all(d in made or d in existing for d in deps.get(v, ()))}
        if not new:
            return made
        made |= new


def longest_path(v, deps, memo, views):
    if v in memo:
        return memo[v]
    ds = [d for d in deps.get(v, ()) if d in views]
    memo[v] = 0 if not ds else 1 + max(longest_path(d, deps, memo, views) for d in ds)
    return memo[v]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_recreate_order_matches_plain_python(spark, seed):
    rnd = random.Random(seed)
    n = 30
    ids = list(range(1, n + 1))
    deps = {}
    for v in ids:
        # acyclic: depend on smaller ids only; some on tables (1000+) or missing (-x)
        ds = set(rnd.sample(range(1, v), k=min(v - 1, rnd.randint(0, 3)))) if v > 1 else set()
        if rnd.random() < 0.1:
            ds.add(1000 + v)
        if rnd.random() < 0.05:
            ds.add(-v)
        deps[v] = ds
    existing = {1000 + v for v in ids}
    expect = can_be_made(ids, deps, existing)
    items = spark.createDataFrame([(v,) for v in ids], "view_id bigint")
    dep_df = spark.createDataFrame([(v, d) for v, ds in deps.items() for d in ds] or [(0, 0)],
                                   "view_id bigint, dep_id bigint")
    ex = spark.createDataFrame([(e,) for e in existing], "id bigint")
    got = {r["view_id"]: r for r in views.recreate_order(items, dep_df, ex).collect()}
    for v in ids:
        if v in expect:
            assert got[v]["status"] == "SUCCESS" and got[v]["reason"] is None, v
        else:
            assert got[v]["status"] == "FAILED" and got[v]["reason"] == views.MISSING and got[v]["level"] is None, v
    memo = {}
    for v in expect:
        assert got[v]["level"] == longest_path(v, deps, memo, set(ids))


def test_recreate_order_cycle_fails(spark):
    items = spark.createDataFrame([(i,) for i in range(1, 7)], "view_id bigint")
    deps = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (5, 4), (6, 99)], "view_id bigint, dep_id bigint")
    ex = spark.createDataFrame([], "id bigint")
    got = {r["view_id"]: (r["status"], r["reason"]) for r in views.recreate_order(items, deps, ex).collect()}
    cycle = ("FAILED", views.CYCLE)
    assert got == {1: cycle, 2: cycle, 3: cycle, 4: ("SUCCESS", None), 5: ("SUCCESS", None), 6: ("FAILED", views.MISSING)}


def test_recreate_order_of_a_long_chain(spark):
    n = 3000  # one round a level would take an hour
    items = spark.range(n).withColumnRenamed("id", "view_id")
    deps = spark.createDataFrame([(i, i - 1) for i in range(1, n)], "view_id bigint, dep_id bigint")
    got = {r["view_id"]: r["level"] for r in views.recreate_order(items, deps, spark.createDataFrame([], "id bigint")).collect()}
    assert got == {i: i for i in range(n)}


def test_recreate_order_of_cycles_and_what_hangs_on_them(spark):
    odd = [(i, (i - 1) % 7) for i in range(7)]  # a cycle whose length no doubling divides
    two = [(10, 11), (11, 10), (10, 12), (12, 10), (11, 12)]  # every view with several open edges
    more = [(20, 3), (21, 20), (30, 31), (30, 20), (40, 41), (40, 42), (41, 43), (42, 43), (50, 50)]
    ids = sorted({x for e in odd + two + more for x in e})
    got = {r.view_id: r for r in views.recreate_order(spark.createDataFrame([(i,) for i in ids], "view_id bigint"), spark.createDataFrame(
        odd + two + more, "view_id bigint, dep_id bigint"), spark.createDataFrame([], "id bigint")).collect()}
    assert {i for i, r in got.items() if r.status == "SUCCESS"} == {31, 40, 41, 42, 43}
    assert {got[i].reason for i in (0, 6, 10, 12, 20, 21, 30, 50)} == {views.CYCLE} and [got[i].level for i in (31, 43, 42, 41, 40)] == [0, 0, 1, 1, 2]


def brute_match(path, locs):
    p = (path or "").rstrip("/")
    best = None
    for name, url in locs:
        u = (url or "").rstrip("/")
        if u and (p == u or p.startswith(u + "/")):
            key = (-len(url or ""), name)
            if best is None or key < best[0]:
                best = (key, name)
    return best[1] if best else None


@pytest.mark.parametrize("seed", [7, 8])
def test_location_match_brute_force(spark, seed):
    rnd = random.Random(seed)
    segs = ["a", "b", "ab", "a1", "a10", "x"]

    def rand_path():
        return "s3://" + "/".join(rnd.choice(segs) for _ in range(rnd.randint(1, 4))) + rnd.choice(["", "/", "//"])

    locs = [(f"l{i}", rand_path()) for i in range(25)] + [("empty", "/"), ("nul", None)]
    paths = [(i, rand_path()) for i in range(200)]
    ldf = spark.createDataFrame(locs, "name string, url string")
    pdf = spark.createDataFrame(paths, "path_id bigint, path string")
    got = {r["path_id"]: r["name"] for r in preflight.location_match(pdf, ldf).collect()}
    for i, p in paths:
        assert got[i] == brute_match(p, locs), (p, got[i])
    # the same by joins without broadcast
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got2 = {r["path_id"]: r["name"] for r in preflight.location_match(pdf, ldf).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == got2


def test_location_without_a_name_matches_nothing(spark):
    ldf = spark.createDataFrame([("root", "s3://a"), (None, "s3://a/b"), ("x", None)], "name string, url string")
    pdf = spark.createDataFrame([(1, "s3://a/b/c"), (2, "s3://z"), (3, None)], "path_id bigint, path string")
    got = {r["path_id"]: r["name"] for r in preflight.location_match(pdf, ldf).collect()}
    assert got == {1: "root", 2: None, 3: None}
