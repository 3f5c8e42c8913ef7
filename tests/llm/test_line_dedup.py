"""Line dedup against brute force on the bytes of all chunks, and on planted passages."""

import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SF_SMALL
from vaultshift.llm import line_dedup as L
from vaultshift.llm.queries import QUERIES


def chunks(text):
    c = L.Chunks(pa.array([text]))
    return [c.bytes_of(k).decode() for k in range(len(c.starts))]


def units(cs):
    """{(first, last) chunk: text} of neighbouring chunks with words, and of chunks with enough of them."""
    said = [k for k, c in enumerate(cs) if _words(c)]
    return {(k, k): (cs[k],) for k in said if len(_words(cs[k])) >= L.LEAST_WORDS} | {(a, b): (cs[a], cs[b]) for a, b in zip(said, said[1:])}


def brute(rows):
    """Passages of repeated units go, but where a unit is first, by id."""
    cut = [chunks(t) if t is not None else [] for _, t in rows]
    own = [units(cs) for cs in cut]
    first, count = {}, {}
    for (d, _), us in zip(rows, own):
        for u in us.values():
            count[u] = count.get(u, 0) + 1
            if d is not None:
                first[u] = min(d, first.get(u, d))
    out = []
    for (d, t), cs, us in zip(rows, cut, own):
        seen, links, gone = set(), [], set()
        for (a, b), u in sorted(us.items()):
            if count[u] > 1 and u in first and (first[u] != d or u in seen):
                if links and a <= links[-1][1]:
                    links[-1][1] = max(b, links[-1][1])
                else:
                    links.append([a, b])
            seen.add(u)
        for a, b in links:
            if sum(len(_words(c)) for c in cs[a:b + 1]) >= L.LEAST_WORDS:
                gone |= set(range(a, b + 1))
        out.append((d, t if t is None else "\n".join(c for k, c in enumerate(cs) if k not in gone)))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_whole_table_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op1_line_dedup"](spark, SF_SMALL)
    assert result(got) == brute(rows) != sorted(rows, key=repr)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab\n é", max_size=60), st.text(max_size=30)), max_size=6))
def test_chunks_join_to_the_text(texts):
    c = L.Chunks(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        own = range(c.at[i], c.at[i + 1])
        assert b"\n".join(c.bytes_of(k) for k in own).decode() == (t or "")
        assert sum(c.lines[k] for k in own) == (t or "").count("\n") + 1
        assert sum(c.words[k] for k in own) == len([w for line in (t or "").split("\n") for w in _words(line)])
        if t is not None:
            assert [c.bytes_of(k).decode() for k in own] == chunks(t)  # its neighbours in a batch don't matter


def _words(line):
    import re
    return re.findall(r"[^\x20\x09-\x0D]+", line)


def test_planted_passages_and_odd_rows(spark):
    r = random.Random(4)
    line = lambda n: " ".join(f"w{r.randrange(9999)}" for _ in range(n))
    one, two = line(70), line(40) + "\n" + line(30)
    rows = []
    for i in range(40):
        own = [line(r.randrange(3, 60)) for _ in range(r.randrange(1, 6))]
        own.insert(r.randrange(len(own) + 1), (one, two, line(60))[i % 3])
        rows.append((i, "\n".join(own)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, one), (103, one), (None, one), (None, "x " * 30), (None, "x " * 30), (104, one + "\n" + one)]
    d = spark.createDataFrame([(*x, "z", 5) for x in rows], "doc_id long, text string, dedup string, hash int")
    got = L.remove_repeats(d)
    assert result(got) == brute(rows) and got.columns == ["doc_id", "text", "hash", "dedup"]
    kept = [t or "" for _, t in result(got)]
    assert sum(one in t for t in kept) == 1 and sum(two in t for t in kept) == 1
    clean = {i: t for i, t in rows if i is not None and i < 40 and i % 3 == 2}
    assert {i: t for i, t in result(got) if i in clean} == clean
    assert L.remove_repeats(d.limit(0)).count() == 0


def test_equal_hashes_of_different_bytes_remove_nothing(spark):
    rows = [(i, f"{'abcdefgh'[i % 8]} " * 30) for i in range(16)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(L.remove_repeats(d, bits=1)) == sorted(rows, key=repr)  # two hashes for eight texts
    assert result(L.remove_repeats(d)) == brute(rows)
    same = [(i, "a " * 30) for i in range(5)]
    assert result(L.remove_repeats(spark.createDataFrame(same, "doc_id long, text string"), bits=1)) == brute(same)


def _with_passages(r, edge, words, n=60):
    """[(id, text)] of pairs of documents that share a passage of short lines, and the passages."""
    line = lambda k: " ".join(f"w{r.randrange(99999)}" for _ in range(k))
    rows, passages = [], []
    for i in range(n):
        shared, least = [], r.randrange(*words)
        while sum(len(x.split()) for x in shared) < least:
            shared.append(line(r.randrange(6, 21)))
        passages.append(shared)
        for _ in range(2):
            around = [[line(r.randrange(*edge)) for _ in range(r.randrange(1, 8))] for _ in range(2)]
            rows.append((len(rows), "\n".join([*around[0], *shared, *around[1]])))
    return rows, passages


def _left(rows, got, passages):
    """Of each passage, the share of words that its second document still has; the first one has it whole."""
    kept, out = dict(got), []
    for i, shared in enumerate(passages):
        assert kept[2 * i] == rows[2 * i][1]
        lines = set(kept[2 * i + 1].split("\n"))
        assert set(rows[2 * i + 1][1].split("\n")) - set(shared) <= lines
        out.append(sum(len(x.split()) for x in shared if x in lines) / sum(len(x.split()) for x in shared))
    return out


def test_passages_of_short_lines(spark):
    """Judged without ``Chunks``: at least nine tenths of the words of shared passages go, among short lines and long ones."""
    r = random.Random(11)
    for edge, words in (((25, 60), (40, 121)), ((6, 21), (40, 121)), ((1, 6), (40, 121)), ((6, 21), (50, 60))):
        rows, passages = _with_passages(r, edge, words, 120)
        parts = _left(rows, result(L.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))), passages)
        assert sum(parts) / len(parts) <= 0.1 and sum(x == 1 for x in parts) / len(parts) <= 0.03


def test_lines_that_are_common_alone_stay(spark):
    """Lines that many documents have, in ever other neighbourhoods, are no passage."""
    r = random.Random(12)
    common = [" ".join(f"c{i}w{k}" for k in range(12)) for i in range(60)]
    rows = [(d, "\n".join(x for _ in range(6) for x in (r.choice(common), " ".join(f"o{r.randrange(10 ** 6)}" for _ in range(9))))) for d in range(200)]
    assert result(L.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == sorted(rows, key=repr)


def test_every_line_that_goes_is_in_a_shared_passage_and_stays_somewhere(spark):
    """On the whole table, against all pairs of neighbouring lines, without ``Chunks``."""
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()}
    got = dict(result(QUERIES["op1_line_dedup"](spark, SF_SMALL)))
    lines = {d: [x for x in (t or "").split("\n") if _words(x)] for d, t in rows.items()}
    shared, ideal, went = {}, 0, 0
    for own in lines.values():
        for u in [*zip(own, own[1:]), *((x,) for x in own if len(_words(x)) >= L.LEAST_WORDS)]:
            shared[u] = shared.get(u, 0) + 1
    left = {x for t in got.values() for x in (t or "").split("\n")}
    for d, own in lines.items():
        kept = [x for x in (got[d] or "").split("\n") if _words(x)]
        for x in {x for x in own if own.count(x) > kept.count(x)}:
            k = [i for i, y in enumerate(own) if x == y]
            assert any(shared.get(u, 0) > 1 for i in k for u in ((x,), tuple(own[i:i + 2]), tuple(own[max(0, i - 1):i + 1]))) and x in left
            went += len(_words(x))
    assert went > 0


def test_a_shift_moves_no_cut_behind_it():
    r = random.Random(3)
    lines = [" ".join(f"w{r.randrange(9999)}" for _ in range(r.randrange(1, 9))) for _ in range(400)]
    whole, shifted = chunks("\n".join(lines)), chunks("\n".join(["new", "lines", *lines]))
    assert whole[3:] == shifted[-len(whole) + 3:] and max(c.count("\n") for c in whole) >= 1
