"""Sketches against plain sets of units."""

import hashlib
import re

import pytest

from tests.conftest import SF_SMALL
from vaultshift.llm import fingerprints as P
from vaultshift.llm.queries import QUERIES

ENDS = re.compile(r"(?<=[.!?])[ \t\n\x0b\f\r]+|\n+")


def units(text):
    return {x for x in ENDS.split(text) if x}


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    """Of rows whose ids differ; none comes last."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = {}
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        k = len(t) // 3
        e = t[:len(t) - k] + nxt[:k]
        out[d] = (len(t), hashlib.sha256(e.encode()).hexdigest(), alike(units(t), units(e)), alike(units(t), units(nxt)))
    return out


def result(df, key="doc_id"):
    return {r[key]: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in df.collect()}


def close(got, want):
    assert got.keys() == want.keys()
    for d, w in want.items():
        assert got[d][:2] == w[:2]
        assert got[d][2:] == pytest.approx(w[2:], abs=1e-12), d


def test_whole_table_matches_sets(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    df = QUERIES["op4_document_fingerprints"](spark, SF_SMALL).cache()
    close(result(df), brute(rows))
    texts = dict(rows)
    prints = {}
    for r in df.collect():
        assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert len(set(prints.values())) == len({frozenset(units(t or "")) for t in prints})


@pytest.mark.parametrize("cells", [6, 48])
def test_odd_rows_and_retries(spark, cells):
    rows = [(1, None), (2, ""), (3, "One. Two. Three! Four?\nFive"), (7, "One. Two. Three! Four?\nFive"), (11, "x"),
            (12, " ".join(f"Unit {i}." for i in range(700))), (13, "é ñ. 👩‍👩‍👧 ü!\n\n\nß"), (14, "same. " * 50), (None, "gone.")]
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, row int, pair int")
    got = P.compare(d, cells=cells)
    close(result(got, "id"), brute(rows))
    assert got.where("id in (3, 7)").select("fingerprint").distinct().count() == 1


def test_small_tables(spark):
    one = spark.createDataFrame([(5, "A b. C d. E f.")], "doc_id long, text string")
    close(result(P.compare(one), "id"), brute([(5, "A b. C d. E f.")]))
    assert P.compare(one.limit(0)).count() == 0
    twice = spark.createDataFrame([(5, "A b. C d."), (5, "A b. C d."), (4, "x")], "doc_id long, text string")
    assert sorted(r.id for r in P.compare(twice).collect()) == [4, 5, 5]


def test_rows_without_ids(spark):
    texts = ["A b. C d.", "E f. G h. I j.", "K."]
    rows = [(None, t) for t in texts]
    got = P.compare(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 3 and {r.id for r in got} == {None}
    # each is edited by another one, and the three form one ring
    edits = {hashlib.sha256((a[:len(a) - len(a) // 3] + b[:len(a) // 3]).encode()).hexdigest(): (a, b) for a in texts for b in texts if a != b or len(a) < 3}
    assert len([r for r in got if r.edited_sha256 in edits]) == 3
    # ids whose least one begins the lowest range leave that range to the rows without ids
    more = [(i, f"Text {i}. It ends.") for i in range(1, 400)] + [(None, "Nothing. At all. Here.")]
    close(result(P.compare(spark.createDataFrame(more, "doc_id long, text string")), "id"), brute(more))


def test_no_table_is_left_in_the_catalog(spark):
    before = {t.name for t in spark.catalog.listTables()}
    df = P.compare(spark.createDataFrame([(i, f"Text {i}. It ends.") for i in range(20)], "doc_id long, text string"))
    assert {t.name for t in spark.catalog.listTables()} == before
    assert df.count() == 20


def test_no_python_and_one_text_shuffle(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    plan = P.compare(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
