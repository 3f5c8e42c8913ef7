"""The Jaccard join against brute force over all pairs."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SF_SMALL
from vaultshift.llm import ngram_join as N
from vaultshift.llm.components import components
from vaultshift.llm.queries import QUERIES


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    by: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    tried = set()
    for i, s in enumerate(sets):
        if rows[i][0] is None:
            continue
        for j in {j for x in s for j in by[x] if j < i and rows[j][0] is not None}:
            tried.add((i, j))
            o = len(s & sets[j])
            if 100 * o >= 85 * len(s | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least[root(i)] if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_whole_table_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    assert result(QUERIES["op10_ngram_jaccard_join"](spark, SF_SMALL)) == want
    assert len({c for _, _, c in want}) < len(want)


@pytest.mark.parametrize("common", [1 << 19, 1])
def test_families_of_near_copies(spark, monkeypatch, common):
    """Chains of edits, so that first and last aren't linked but their component is one; passages that all share."""
    monkeypatch.setattr(N, "MOST_COMMON", common)
    monkeypatch.setattr(N, "BLOCK", 7)
    r = random.Random(5)
    word = lambda: f"w{r.randrange(4000)}"
    passage = [word() for _ in range(60)]
    rows = []
    for f in range(12):
        text = [word() for _ in range(r.randrange(20, 120))]
        if f % 3 == 0:
            text = passage + text
        for _ in range(r.randrange(1, 25)):
            rows.append((len(rows), " ".join(text)))
            if r.random() < 0.7:
                text = list(text)
                text[r.randrange(len(text))] = word()
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "a b"), (504, "A  B"), (505, "a b c"), (None, "a b"), (503, "a b"),
             (506, " ".join(passage)), (507, "x " * 3000), (508, "X " * 2999), (None, None)]
    d = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, node long")
    assert result(N.ngram_components(d)) == brute(rows)


def test_empty_table(spark):
    assert N.ngram_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30)).map(sorted), max_size=14), st.integers(1, 12))
def test_divide_skip(lists, least):
    want = {}
    for x in lists:
        for i in x:
            want[i] = want.get(i, 0) + 1
    assert N.divide_skip(lists, least) == {i: c for i, c in want.items() if c >= least}


def test_components_of_chains_and_hubs(spark):
    g = random.Random(2)
    ids = list(range(400))
    g.shuffle(ids)
    links = [(ids[i], ids[i + 1]) for i in range(200)] + [(ids[250], ids[i]) for i in range(251, 380)] + [(ids[390], ids[391])]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    for part in (ids[:201], ids[250:380], ids[390:392]):
        assert {got[i] for i in part} == {min(part)}
    assert len(got) == 201 + 130 + 2


def test_lone_pairs_that_share_a_frequent_phrase(spark):
    """Shingles that begin one set of a pair only because the phrase's were moved last are still shared."""
    r = random.Random(8)
    word = lambda: f"w{r.randrange(10 ** 6)}"
    phrase = [word() for _ in range(6)]
    rows = []
    for _ in range(600):
        text = [word() for _ in range(r.randrange(4, 25))]
        at = r.randrange(len(text) + 1)
        text = text[:at] + phrase + text[at:]
        rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join([word(), *text] if r.random() < 0.5 else [*text, word()]))]
    want = brute(rows)
    assert result(N.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"))) == want
    assert len({c for _, _, c in want}) < 0.7 * len(want)


def test_links_within_a_family_of_near_copies_are_linear(spark, monkeypatch):
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    n = 2000
    rows = []
    for d in range(n):
        words = list(base)
        words[rnd.randrange(120)] = f"own{d}"  # every copy is a set of its own, linked with nearly all others
        rows.append((d, " ".join(words)))
    found, links = N._hot_links, []

    def counted(*args):
        out = found(*args)
        links.append(out.count())
        return out

    monkeypatch.setattr(N, "_hot_links", counted)
    got = result(N.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {c for _, _, c in got} == {0} and len(got) == n
    assert sum(links) < 2 * n
