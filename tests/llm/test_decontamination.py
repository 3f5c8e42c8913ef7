"""Suffix-array decontamination against brute force on every window."""

import hashlib
import re

import numpy as np
import pytest

from tests.conftest import SF_SMALL
from vaultshift.llm import decontamination as D
from vaultshift.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size=13):
    tests = {}
    for item, text in items:
        w = words(text)
        if w and item is not None:
            for i in range(max(1, len(w) - size + 1)):
                tests.setdefault(tuple(w[i:i + size]), set()).add(str(item))
    lengths = {len(t) for t in tests}
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = [False] * len(w), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if names := tests.get(tuple(w[i:i + n])):
                    found |= names
                    hit[i:i + n] = [True] * n
        out.append((doc, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                    sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return sorted(out, key=repr)


def longest_of(docs, items, size=13):
    """{(document, text): (length, first place, least item)} of matches of a window or more."""
    tests = [(str(i), words(t)) for i, t in items if i is not None and words(t)]
    out = {}
    for doc, text in docs:
        w, best = words(text), (0, -1, None)
        for name, x in tests:
            for i in range(len(w)):
                for j in range(len(x)):
                    n = 0
                    while i + n < len(w) and j + n < len(x) and w[i + n] == x[j + n]:
                        n += 1
                    if n >= min(size, len(x)):
                        best = min(best, (n, i, name), key=lambda z: (-z[0], z[1], z[2] or ""))
        out[doc, text] = best
    return out


LONGEST = ("longest", "longest_at", "longest_item")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


FIELDS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_whole_tables_match_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    got = QUERIES["op3_benchmark_decontamination"](spark, SF_SMALL).select("doc_id", *FIELDS)
    want = brute(docs, items)
    assert rows(got) == want and any(r[-1] for r in want)


@pytest.mark.parametrize("block_bytes", [1 << 25, 40])
def test_odd_rows(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(D, "BLOCK_BYTES", block_bytes)
    long = " ".join(f"w{i}" for i in range(3000))
    docs = [(1, None), (2, ""), (3, "..."), (4, "Alpha beta"), (4, "Alpha beta"), (5, "x alpha-BETA y alpha beta"),
            (6, long), (None, "one two three " * 9), (7, "É é ß alpha"), (8, " ".join(f"w{i}" for i in range(40, 90)))]
    items = [(1, "alpha beta"), (1, "beta y"), (2, " ".join(f"w{i}" for i in range(50, 80))), (3, None), (4, "!"),
             (10, "one two three " * 9), (11, "one two three " * 9), (12, "é ß"), (None, "alpha")]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, contamination string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = D.find_contamination(d, b).select("doc_id", *[f"contamination.{f}" for f in FIELDS])
    assert rows(got) == brute(docs, items)
    longest = {r[0]: r[1:] for r in D.find_contamination(d, b).select(
        "doc_id", "contamination.longest", "contamination.longest_at", "contamination.longest_item").collect()}
    assert longest[6] == (30, 50, "2") and longest[8] == (30, 10, "2")
    assert D.find_contamination(d.limit(0), b).count() == 0
    assert D.decontaminated(d, b.limit(0)).count() == len(docs)


def test_random_against_brute(spark):
    g = np.random.default_rng(3)
    text = lambda n: " ".join(f"t{x}" for x in g.integers(0, 4, n))
    docs = [(i, text(int(g.integers(0, 120)))) for i in range(150)]
    items = [(i, text(int(g.integers(0, 24)))) for i in range(30)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for window in (3, 6):
        got = D.find_contamination(d, b, window=window).select("doc_id", *[f"contamination.{f}" for f in FIELDS])
        assert rows(got) == brute(docs, items, window)
        want = longest_of(docs, items, window)
        got = D.find_contamination(d, b, window=window).select("doc_id", "text", *[f"contamination.{f}" for f in LONGEST])
        assert {(r[0], r[1]): tuple(r[2:]) for r in got.collect()} == want and any(x[0] > window for x in want.values())


def test_equal_documents_have_equal_longest_matches_whatever_the_partitions(spark):
    item = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(["x"] * (i % 5) + item[:(30, 30, 20)[i % 3]] + ["y"])) for i in range(30)]
    docs += [(i + 100, t) for i, t in docs]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([("b", " ".join(item)), ("a", " ".join(item[:25]))], "item_id string, text string")
    want = longest_of(docs, [("b", " ".join(item)), ("a", " ".join(item[:25]))])
    for n in (1, 3, 11):
        got = D.find_contamination(d.repartition(n), b).select("doc_id", "text", *[f"contamination.{f}" for f in LONGEST])
        assert {(r[0], r[1]): tuple(r[2:]) for r in got.collect()} == want
    assert sorted({x[0] for x in want.values()}) == [20, 30] and {x[2] for x in want.values()} == {"a", "b"}
