"""Exact percentiles and nested groups against plain Python."""

import math
import random

from vaultshift.operators import access, quantiles

QS = [0.0, 0.01, 0.5, 0.9, 0.999, 1.0]


def test_percentiles_match_a_sort(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BUCKETS", 8)
    monkeypatch.setattr(quantiles, "FEW", 4)
    rnd = random.Random(4)
    inf = float("inf")
    rows = [("hot", rnd.choice([rnd.gauss(0, 1), rnd.expovariate(1) ** 9, -1e-300, 1e300, 3.5])) for _ in range(2000)] + [("tie", 2.5)] * 300
    rows += [("odd", x) for x in (inf, -inf, float("nan"), None, 0.0, -0.0, 1e308, -1e308, 5e-324)] + [("none", None), (None, 1.0), (None, 2.0), ("one", -7.0)]
    got = {(r.g, r.q): (r.n, r.value) for r in quantiles.exact_percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", QS).collect()}
    for g in {g for g, _ in rows}:
        own = sorted(v for k, v in rows if k == g and v is not None and not math.isnan(v))
        for q in QS:
            want = own[max(1, math.ceil(q * len(own))) - 1] if own else None
            assert got[g, q] == (len(own), want), (g, q)


def closure(members):
    out, up = set(), {}
    for p, g in members:
        up.setdefault(p, set()).add(g)
    for p in up:
        todo, seen = list(up[p]), set()
        while todo:
            g = todo.pop()
            if g not in seen:
                seen.add(g)
                todo += up.get(g, ())
        out |= {(p, g) for g in seen}
    return out


def test_nested_and_circular_groups(spark):
    rnd = random.Random(6)
    members = [(f"u{i}", f"g{rnd.randrange(40)}") for i in range(60)] + [(f"g{i}", f"g{rnd.randrange(40)}") for i in range(40) for _ in range(2)]
    members += [("a", "b"), ("b", "c"), ("c", "a"), ("x", "x"), (None, "g1"), ("u1", None)]
    df = spark.createDataFrame(members, "principal string, group_name string")
    want = closure([(p, g) for p, g in members if p and g])
    assert {tuple(r) for r in access.group_closure(df).collect()} == want
    assert access.group_closure(df.limit(0)).collect() == []


def test_privileges_come_down_from_parents_and_groups(spark):
    members = spark.createDataFrame([("ann", "dev"), ("dev", "all"), ("all", "dev")], "principal string, group_name string")
    grants = spark.createDataFrame([
        ("CATALOG", "c", "all", "USE CATALOG"), ("SCHEMA", "c.s", "dev", "select"), ("TABLE", "c.s.t", "ann", "MODIFY"), ("TABLE", "c.s.t", "ann", "OWN"),
        ("TABLE", "c.s.t2", "ann", "MODIFY"), ("SCHEMA", "c.s2", "all", "SELECT"), ("TABLE", "c.s.t", "bob", "SELECT")],
        "object_type string, object_key string, principal string, action_type string")
    asked = spark.createDataFrame([("ann", "c.s.t"), ("ann", "c.s"), ("bob", "c.s.t"), ("bob", "c"), ("eve", "c.s.t"), ("ann", None)], "principal string, object_key string")
    got = {(r.principal, r.object_key): (r.actions, r.sources) for r in access.inherited_privileges(asked, grants, members).collect()}
    assert got == {("ann", "c.s.t"): ("MODIFY, SELECT, USECATALOG", 3), ("ann", "c.s"): ("SELECT, USECATALOG", 2), ("bob", "c.s.t"): ("SELECT", 1),
                   ("bob", "c"): ("", 0), ("eve", "c.s.t"): ("", 0)}
