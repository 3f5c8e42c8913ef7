"""Learned operators: held-out accuracy, defined cases, and the scan against brute force."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vaultshift.llm import langid as G
from vaultshift.llm import toxicity as X
from vaultshift.llm.queries import QUERIES

MEDIUM = "/root/testdata/sf0.1"
SMALL = "/root/testdata/sf0.01"


def test_language_of_held_out_texts(spark):
    got = QUERIES["op6_language_id"](spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = got.where("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert r[0] > 0.98 and r[1] > 100 and 0 <= r[2] <= r[3] <= 1


def test_language_odd_rows(spark):
    rows = [(i, "the cat sat on the mat and it was good " * 3, "en") for i in range(40)]
    rows += [(100 + i, "der hund lief durch den wald und es war schön " * 3, "de") for i in range(40)]
    rows += [(500, None, "en"), (501, "", None), (502, "123 !? 456", "de"), (503, "x", None), (None, "der wald", None), (504, "the mat " * 20_000, None), (504, "the mat " * 20_000, None)]
    d = spark.createDataFrame([(*r, "q", 1) for r in rows], "doc_id long, text string, lang string, language string, score int")
    model = G.train(d)
    got = {}
    for r in G.predict(d, model).collect():
        assert 0 <= r.language.score <= 1 and got.setdefault(r.doc_id, r.language.lang) == r.language.lang
    assert {got[i] for i in (500, 501, 502)} == {"und"} and got[503] in ("en", "de")
    assert got[504] == "en" and got[None] == "de" and {got[i] for i in range(40)} == {"en"} and {got[100 + i] for i in range(40)} == {"de"}
    empty = d.limit(0)
    assert G.train(empty) is None and {r.language.lang for r in G.predict(d, None).collect()} == {"und"}
    assert G.predict(empty, model).count() == 0


def test_means_do_not_depend_on_blocks(monkeypatch):
    g = np.random.default_rng(0)
    rows = g.random((1 << G.BUCKET_BITS, G.WIDTH)).astype(np.float32)
    rows[0] = 0
    texts = ["", "a", "ab", "Grüße " * 300, None, "x" * 900, "ñ"]
    whole = G.means(pa.array(texts), rows)
    alone = np.concatenate([G.means(pa.array([t], pa.string()), rows) for t in texts])
    monkeypatch.setattr(G, "_BLOCK", 64)
    assert np.allclose(whole, alone) and np.allclose(whole, G.means(pa.array(texts), rows))
    assert whole[2].any() and not whole[0].any()


def test_toxic_held_out_texts(spark):
    got = QUERIES["op9_toxicity"](spark, MEDIUM).join(spark.read.parquet(f"{MEDIUM}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    y, s = got.toxic.to_numpy(), got.score.rank().to_numpy()
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    auc = (s[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)
    assert auc > 0.94 and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.5).astype(int)).all()
    assert got.predicted[y == 1].mean() > 0.85 and got.predicted[y == 0].mean() < 0.04


def test_toxic_odd_rows(spark):
    g = np.random.default_rng(1)
    word = lambda n: [f"w{x}" for x in g.integers(0, 300, n)]
    rows, labels = [], []
    for i in range(400):
        t = word(60)
        if i % 4 == 0:
            for k in g.integers(0, 60, 5):
                t[k] = ("vile", "filth")[k % 2]
        rows.append((i, " ".join(t)))
        labels.append((i, int(i % 4 == 0)))
    extra = [(900, None), (901, ""), (902, "..."), (None, "vile filth"), (903, " ".join(["vile", "filth"] * 40)), (904, " ".join(word(30_000))), (905, "vile w1 filth"), (905, "vile w1 filth")]
    labels += [(900, 1), (None, 1), (3, None), (0, 0), (10 ** 9, 1)]
    d = spark.createDataFrame([(*r, "t", 1) for r in rows + extra], "doc_id long, text string, toxicity string, k int")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model, share = X.train(d, lab)
    got = {}
    for r in X.score(d, model, share).collect():
        assert got.setdefault(r.doc_id, r.toxicity.score) == r.toxicity.score and 0 <= r.toxicity.score <= 1
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(400))
    assert got[900] == got[901] == got[902] == min(got.values()) and got[903] > 0.5 > got[904]
    none, share = X.train(d, lab.limit(0))
    assert none is None and {r.toxicity.score for r in X.score(d, none, share).collect()} == {0.0}
    assert X.score(d.limit(0), model, share).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-9, 9).filter(bool)), max_size=25))
def test_all_maximal_segments(values):
    """Against the recursive definition: the best segment, then the same left and right of it."""
    other = -0.5
    full = [other if v is None else v + 0.25 for v in values]

    def rec(a, b):
        best = max(((sum(full[i:j]), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        i, j = -best[2], -best[2] - best[1]
        return rec(a, i) + [(round(best[0], 6), i, j)] + rec(j, b)

    at = np.array([i for i, v in enumerate(values) if v is not None], np.int64)
    got = X.segments(at, np.array([full[i] for i in at]), len(full), other)
    assert [(round(s, 6), a, b) for s, a, b in got] == rec(0, len(full))


def test_the_scan_is_linear():
    import time

    def seconds(n):
        score, began = np.tile([1.0, -1.0, -1.0], n), time.perf_counter()
        assert len(X.segments(np.arange(3 * n), score, 3 * n, -0.5)) == n
        return time.perf_counter() - began

    seconds(1000)
    assert min(seconds(80_000) for _ in range(3)) < 30 * min(seconds(8_000) for _ in range(3))  # quadratic: a hundred times
