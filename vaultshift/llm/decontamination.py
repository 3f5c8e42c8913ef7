"""Benchmark decontamination with suffix arrays of the training texts.

The documents are cut into shards of about ``SHARD_WORDS`` words, each within
a task.  A shard's suffix array holds its word suffixes in order; every suffix of
every test item is binary-searched in it, all of them in step, one word deeper at
a time.  The interval where a test window ends gives all places of that
window.  A place whose word before isn't the test's word before begins a longest match there;
these are followed word by word to their ends, so every document gets its own longest
verbatim match of a window or more, wherever it is and whatever shard it is in.
Documents of which test windows cover enough words are removed.

Two savings that change no result: words that no test item has are one symbol
that matches nothing, and suffixes too short, before such a word, to hold the
shortest test window are left out.  Words are compared by 64-bit hashes.

The test items are broadcast in blocks of at most ``BLOCK_BYTES`` of text; each
further block is one more pass over the documents, and what the passes found
is united per row.

Defined cases: null and empty texts have no words and are never contaminated; an
item without words or without an id is no test; items with equal ids or texts
each count by their id once; equal documents get equal results.  Of equally long matches the first
place counts, then the least item id; a document without a whole window has length 0 and no place.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultshift.llm import words as W
from vaultshift.llm.common import frugal, small_batches
from vaultshift.session import written

WINDOW = 13
#: A document is contaminated if test windows cover at least one of so many words.
SHARE = 20
SHARD_WORDS = 1 << 20
BLOCK_BYTES = 32 << 20
FOUND = ("struct<n_words:bigint,n_hit:bigint,n_items:bigint,items_sha256:string,contaminated:boolean,"
         "spans:array<struct<start:bigint,end:bigint>>,items:array<string>,longest:bigint,longest_at:bigint,longest_item:string>")


class Tests:
    """The suffixes of a block of test items: ``ids`` of words, one item after the other."""

    def __init__(self, ids: list[str], texts: pa.Array, window: int):
        hashed, at = W.words(texts, W.ALNUM)
        by_text: dict[bytes, int] = {}
        named: list[set[str]] = []
        pieces: list[np.ndarray] = []
        for name, piece in zip(ids, W.split(hashed, at)):
            if len(piece):
                k = by_text.setdefault(piece.tobytes(), len(named))
                if k == len(named):
                    named.append(set())
                    pieces.append(piece)
                named[k].add(name)
        self.names = [sorted(x) for x in named]
        joined = np.concatenate(pieces) if pieces else np.zeros(0, np.uint64)
        #: Places of the texts in the order of their least item ids.
        self.rank = np.empty(len(named), np.int64)
        self.rank[sorted(range(len(named)), key=lambda k: self.names[k][0])] = np.arange(len(named))
        self.vocabulary = np.unique(joined)
        self.ids = (np.searchsorted(self.vocabulary, joined) + 1).astype(np.int32)
        size = np.array([len(p) for p in pieces], np.int64)
        first = self.first = np.cumsum(size) - size
        count = np.where(size >= window, size - window + 1, 1)
        self.item = np.repeat(np.arange(len(size)), count)
        self.start = first[self.item] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        self.left = (first + size)[self.item] - self.start
        self.window = np.minimum(size[self.item], window)
        self.deepest = int(self.left.max(initial=0))
        self.shallowest = int(self.window.min(initial=window))


def suffix_array(seq: np.ndarray, n: int, least: int, depth: int) -> np.ndarray:
    """Starts of the suffixes of seq[:n] with ``least`` or more symbols before a 0, ordered to ``depth`` symbols.

    ``seq`` ends in ``depth`` + 3 zeros.  Three symbols a round; only suffixes that are still level go on.
    """
    zeros = np.flatnonzero(seq == 0)
    at = np.flatnonzero(seq[:n])
    at = at[zeros[np.searchsorted(zeros, at)] - at >= least]
    group = np.zeros(len(at), np.int64)
    todo, done = np.arange(len(at)), 0
    while len(todo) > 1 and done < depth:
        here = at[todo]
        key = np.zeros(len(here), np.int64)
        wide = int(seq.max()).bit_length()
        take = min(3, 63 // max(1, wide))
        for k in range(take):
            key = (key << wide) | seq[here + done + k]
        order = np.lexsort((key, group[todo])) if done else np.argsort(key, kind="stable")
        here, key, level = here[order], key[order], group[todo][order]
        at[todo] = here
        new = np.ones(len(here), bool)
        new[1:] = (key[1:] != key[:-1]) | (level[1:] != level[:-1])
        # a group is named by the place of its first suffix, so names keep the order of groups
        group[todo] = np.maximum.accumulate(np.where(new, todo, 0))
        alone = new.copy()
        alone[:-1] &= new[1:]
        todo, done = todo[~alone], done + take
    return at


def search(seq: np.ndarray, sa: np.ndarray, t: Tests) -> tuple[np.ndarray, np.ndarray]:
    """For every test suffix the interval of its window in ``sa``."""
    m = len(t.start)
    lo, hi = np.zeros(m, np.int64), np.full(m, len(sa), np.int64)
    w_lo, w_hi = np.zeros(m, np.int64), np.zeros(m, np.int64)
    active, d = np.arange(m), 0
    while len(active) and len(sa):
        want = t.ids[t.start[active] + d]
        bounds = []
        for side in (False, True):  # the first suffix whose symbol isn't below the wanted one, then the first above it
            a, b = lo[active], hi[active]
            while (open_ := a < b).any():
                mid = (a + b) >> 1
                got = seq[sa[np.minimum(mid, len(sa) - 1)] + d]
                below = (got <= want) if side else (got < want)
                a = np.where(open_ & below, mid + 1, a)
                b = np.where(open_ & ~below, mid, b)
            bounds.append(a)
        lo[active], hi[active] = bounds
        active = active[bounds[0] < bounds[1]]
        d += 1
        full = active[t.window[active] == d]
        w_lo[full], w_hi[full] = lo[full], hi[full]
        active = active[t.window[active] > d]
    return w_lo, w_hi


def extend(seq: np.ndarray, t: Tests, q: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Lengths of the matches of test suffixes ``q`` at ``pos``, which share their window."""
    length = t.window[q].copy()
    going = np.flatnonzero(t.left[q] > length)
    while len(going):
        d = length[going]
        going = going[seq[pos[going] + d] == t.ids[t.start[q[going]] + d]]
        length[going] += 1
        going = going[t.left[q[going]] > length[going]]
    return length


def scan_shard(hashed: np.ndarray, at: np.ndarray, t: Tests) -> list[tuple[list, set, tuple]]:
    """(covered spans, ids of items, (longest match, its first word, its item)) of each document of a shard."""
    n_docs = len(at) - 1
    none = (0, -1, None)
    if not len(t.start) or not len(hashed):
        return [([], set(), none)] * n_docs
    k = np.searchsorted(t.vocabulary, hashed)
    known = t.vocabulary[np.minimum(k, len(t.vocabulary) - 1)] == hashed
    doc = np.repeat(np.arange(n_docs), np.diff(at))
    n = len(hashed) + n_docs
    seq = np.zeros(n + t.deepest + 4, np.int32)  # a 0 after each document
    seq[np.arange(len(hashed)) + doc] = np.where(known, k + 1, 0)
    origin = at[:-1] + np.arange(n_docs)
    sa = suffix_array(seq, n, t.shallowest, t.deepest)
    w_lo, w_hi = search(seq, sa, t)
    out: list = [([], set(), none)] * n_docs
    size = w_hi - w_lo
    total = int(size.sum())
    if not total:
        return out
    best: dict[int, tuple] = {}
    cover = np.zeros(n + 1, np.int64)
    items: dict[int, set] = {}
    q = np.repeat(np.arange(len(size)), size)
    pos = sa[np.arange(total) - np.repeat(np.cumsum(size) - size, size) + w_lo[q]]
    np.add.at(cover, pos, 1)
    np.add.at(cover, pos + t.window[q], -1)
    owner = np.searchsorted(origin, pos, "right") - 1
    for pair in np.unique(owner * np.int64(len(t.names)) + t.item[q]):
        items.setdefault(int(pair // len(t.names)), set()).update(t.names[int(pair % len(t.names))])
    begins = (t.start[q] == t.first[t.item[q]]) | (seq[pos - 1] != t.ids[t.start[q] - 1])  # seq ends in zeros, so -1 is none
    q, pos, owner = q[begins], pos[begins], owner[begins]
    length = extend(seq, t, q, pos)
    # Of each document the longest match, then the first place, then the least item.
    order = np.lexsort((t.rank[t.item[q]], pos, -length, owner))
    for k in order[np.concatenate(([True], np.diff(owner[order]) > 0))]:
        d = int(owner[k])
        best[d] = (int(length[k]), int(pos[k] - origin[d]), t.names[t.item[q[k]]][0])
    hit = np.cumsum(cover) > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    spans: dict[int, list] = {}
    for a, b in zip(edge[::2], edge[1::2]):
        d = int(np.searchsorted(origin, a, "right")) - 1
        spans.setdefault(d, []).append((int(a - origin[d]), int(b - origin[d])))
    for d in set(best) | set(spans):
        out[d] = (spans.get(d, []), items.get(d, set()), best.get(d, none))
    return out


def united(a: list, b: list) -> list[tuple[int, int]]:
    """Spans that cover what either list covers."""
    out: list[list[int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _blocks(benchmark: DataFrame, item: str, text: str, window: int):
    named = benchmark.select(F.col(f"`{item}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text")).where("id is not null")
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    for b in range(n):
        part = named.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b).toArrow()
        yield Tests(part["id"].to_pylist(), part["text"], window)


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                       item_text: str = "text", window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """``docs`` with a struct ``contamination`` (``FOUND``), which replaces a column of that name."""
    spark = docs.sparkSession
    small_batches(spark)
    state = docs.drop("contamination").withColumn("contamination", F.lit(None).cast(FOUND))
    schema = state.schema
    for b, tests in enumerate(_blocks(benchmark, item, item_text, window)):
        shared = spark.sparkContext.broadcast(tests)

        def run(batches, shared=shared, column=text):
            t = shared.value
            held: list[pa.RecordBatch] = []
            n = 0

            def flush():
                parts = [W.words(x.column(x.schema.get_field_index(column)), W.ALNUM) for x in held]
                shift = np.cumsum([0] + [len(h) for h, _ in parts])
                at = np.concatenate([[0], *[a[1:] + s for (_, a), s in zip(parts, shift)]])
                found = scan_shard(np.concatenate([h for h, _ in parts]), at, t)
                sizes = np.diff(at)
                k = 0
                for x in held:
                    last = x.num_columns - 1
                    old = x.column(last).to_pylist()
                    new = []
                    for i in range(x.num_rows):
                        spans, items, long = found[k + i]
                        if o := old[i]:
                            spans = united(spans, [(s["start"], s["end"]) for s in o["spans"]])
                            items = items | set(o["items"])
                            long = min(long, (o["longest"], o["longest_at"], o["longest_item"]), key=lambda z: (-z[0], z[1], z[2] or ""))
                        names, n_hit, size = sorted(items), sum(e - s for s, e in spans), int(sizes[k + i])
                        new.append({"n_words": size, "n_hit": n_hit, "n_items": len(names),
                                    "items_sha256": hashlib.sha256(",".join(names).encode()).hexdigest(),
                                    "contaminated": n_hit > 0 and share * n_hit >= size,
                                    "spans": [{"start": s, "end": e} for s, e in spans], "items": names,
                                    "longest": long[0], "longest_at": long[1], "longest_item": long[2]})
                    k += x.num_rows
                    yield pa.RecordBatch.from_arrays([*x.columns[:last], pa.array(new, x.schema.field(last).type)], schema=x.schema)
                held.clear()

            for x in batches:
                held.append(x)
                column_at = x.schema.get_field_index(column)
                n += x.column(column_at).nbytes
                if n >= SHARD_WORDS * 6:
                    yield from flush()
                    n = 0
            if held:
                yield from flush()

        if b:
            state = written(state, "contamination")
        state = state.mapInArrow(frugal(run), schema)
    return state


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """``docs`` without the contaminated ones."""
    found = find_contamination(docs, benchmark, text, **how)
    return found.where(~F.col("contamination.contaminated")).drop("contamination")
