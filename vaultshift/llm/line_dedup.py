"""Removal of repeated multi-line chunks with content-defined boundaries.

*Chunks.*  A hash rolls over the hashes of two lines at a time.  A text is cut after every line but
where that hash ends in ``BITS`` zeros, and around lines without words or of ``LEAST_WORDS``, so where it is cut depends on two lines
only: text that is shifted, inserted or removed before moves no cut behind it.

*What is compared.*  Two neighbouring chunks, and a single chunk of ``LEAST_WORDS`` words, are a unit.
Units that occur more than once are candidates by their hashes.  Their bytes are then
compared, by a SHA-256 of them, and a hash that stands for different bytes removes nothing.

*What goes.*  A unit may go wherever it isn't the first occurrence in the document of the least id.
Neighbouring units that may go are one passage; it goes if it has ``LEAST_WORDS`` words, lines without words
inside it too.  Shorter ones stay: lines that many documents have are no repeated passage.  In the
least document that has a chunk in any repeated unit all its units are first, so every chunk that
goes from one document stays in another.

Only hashes are shuffled to find repeats; texts move once, to meet what is known
of their units.  Hashes are written once and read from there.

Defined cases: a null text stays null, an empty one empty; rows without an id give
up what a row with an id has, and keep what only such rows have; rows of equal id
count as one place, each keeping its first occurrence; a text that is removed whole is empty.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultshift.llm import words as W
from vaultshift.llm.common import frugal, small_batches
from vaultshift.session import written

#: Least words of a passage that goes; zeros in the rolling hash where a text is not cut.
LEAST_WORDS, BITS = 25, 5


class Chunks:
    """Chunks of a batch of texts: byte spans and numbers of words; ``at`` has the first chunk of each text.

    ``units`` has their first and last chunk, ``hashes`` their hashes, ``unit_at`` the first unit of each text.
    """

    def __init__(self, texts: pa.Array, bits: int = 64):
        offsets, body = W.buffers(texts)
        self.body = body
        n = len(offsets) - 1
        breaks = np.flatnonzero(body == 10)
        # A line starts at the start of each text and after each line break.
        starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
        text = self._owners(offsets, breaks, starts, n)
        ends = np.empty(len(starts), np.int64)
        if n:
            ends[:-1] = starts[1:] - 1
            last = np.ones(len(starts), bool)
            last[:-1] = text[1:] != text[:-1]
            ends[last] = offsets[1:]
        else:
            last = np.zeros(0, bool)
        line = W.hashes(body, starts, ends)
        w, _ = W.find(offsets, body, W.NONSPACE)
        words = np.searchsorted(w, ends) - np.searchsorted(w, starts)
        total = np.concatenate(([0], np.cumsum(words)))
        before = np.zeros_like(line)
        before[1:][~last[:-1]] = line[:-1][~last[:-1]]
        rolled = W.mix(line * np.uint64(0x9E3779B97F4A7C15) + before)
        apart = (words == 0) | (words >= LEAST_WORDS)
        cut = last | ((rolled & np.uint64((1 << BITS) - 1)) != 0) | apart
        cut[:-1] |= apart[1:]
        stop = np.flatnonzero(cut)
        first = np.concatenate(([0], stop[:-1] + 1)).astype(np.int64) if len(stop) else stop
        self.starts, self.ends = starts[first], ends[stop]
        self.words = total[stop + 1] - total[first]
        self.lines = stop - first + 1
        owner = text[first]
        self.at = np.searchsorted(owner, np.arange(n + 1)) if n else np.zeros(1, np.int64)
        own = W.hashes(body, self.starts, self.ends)
        said = np.flatnonzero(self.words > 0)
        pair = np.flatnonzero(owner[said[1:]] == owner[said[:-1]])
        alone = said[self.words[said] >= LEAST_WORDS]
        a, b = np.concatenate((alone, said[:-1][pair])), np.concatenate((alone, said[1:][pair]))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        self.units = np.column_stack((a, b))
        joint = np.where(a == b, own[a], W.mix(own[a] * np.uint64(0xD1B54A32D192ED03) + own[b]))
        self.hashes = (joint >> np.uint64(64 - bits)).view(np.int64)
        self.unit_at = np.searchsorted(owner[a], np.arange(n + 1)) if n else np.zeros(1, np.int64)

    @staticmethod
    def _owners(offsets, breaks, starts, n):
        """The text of each line: one line per text, and one more for each break in it."""
        per_text = 1 + np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1])
        return np.repeat(np.arange(n), per_text)

    def bytes_of(self, i: int) -> bytes:
        return self.body[self.starts[i]: self.ends[i]].tobytes()

    def unit_bytes(self, u: int) -> bytes:
        a, b = self.units[u]
        return self.bytes_of(a) if a == b else self.bytes_of(a) + b"\0" + self.bytes_of(b)

    def passages(self, i: int, may_go: set[int]) -> set[int]:
        """Chunks of text ``i`` that go: of passages of units in ``may_go`` with enough words."""
        gone: set[int] = set()
        run: list[int] | None = None  # first and last chunk of a passage
        for u in [*sorted(may_go), None]:
            a, b = (int(x) for x in self.units[u]) if u is not None else (None, None)
            if run is not None and (u is None or a > run[1]):
                if self.words[run[0]: run[1] + 1].sum() >= LEAST_WORDS:
                    gone.update(range(run[0], run[1] + 1))
                run = None
            if u is not None:
                run = [a, b] if run is None else [run[0], max(run[1], b)]
        return gone


def _hashes(docs: DataFrame, bits: int) -> DataFrame:
    """(hash, id): the units of each text."""
    def run(batches):
        for b in batches:
            c = Chunks(b.column(1), bits)
            text = np.repeat(np.arange(b.num_rows), np.diff(c.unit_at))
            yield pa.RecordBatch.from_arrays([pa.array(c.hashes), b.column(0).take(pa.array(text))], ["hash", "id"])

    return docs.mapInArrow(frugal(run), f"hash bigint, id {docs.schema[0].dataType.simpleString()}")


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", bits: int = 64) -> DataFrame:
    """``docs`` with the text that stays, and ``dedup`` struct<lines, chunks, removed_chunks, removed_words>.

    ``dedup`` replaces a column of that name; the other columns are passed on.  ``bits`` of the hashes are used.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("dedup")
    own = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    found = written(_hashes(own, bits), "units")
    repeated = written(found.groupBy("hash").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("first"))
                       .where("c > 1 and first is not null").select("hash", "first"), "repeated")
    # What each document has of them: bounded by its own chunks.  Documents without an id have theirs found by hash.
    per_doc = found.where("id is not null").join(repeated, "hash").groupBy("id").agg(F.collect_set(F.struct("hash", "first")).alias("found"))
    placed = docs.where(F.col(f"`{key}`").isNotNull()).withColumnRenamed(key, "__id").join(
        per_doc.select(F.col("id").alias("__id"), F.col("found").alias("__found")), "__id", "left").withColumnRenamed("__id", key)
    anon = docs.where(F.col(f"`{key}`").isNull())
    anon = anon.withColumn("__n", F.monotonically_increasing_id())
    anon = _of_anonymous(written(anon, "anonymous"), repeated, text, bits)
    placed = written(placed.select(*[F.col(f"`{c}`") for c in docs.columns], "__found").unionByName(anon), "placed")

    def candidates(batches):
        for b in batches:
            c = Chunks(b.column(0), bits)
            out: list[tuple[int, bytes]] = []
            for i, found in enumerate(b.column(1).to_pylist()):
                known = {f["hash"] for f in found}
                for u in range(c.unit_at[i], c.unit_at[i + 1]):
                    if (h := int(c.hashes[u])) in known:
                        out.append((h, hashlib.sha256(c.unit_bytes(u)).digest()))
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], ["hash", "bytes"])

    compared = placed.where("__found is not null").select(F.col(f"`{text}`").alias("text"), "__found").mapInArrow(
        candidates, "hash bigint, bytes binary").groupBy("hash", "bytes").agg(F.count(F.lit(1)).alias("c"))
    unlike = written(compared.groupBy("hash").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("hash"), "unlike")
    # Hashes that stand for different bytes, by document; as good as always none, and then the join below is one with nothing.
    bad = written(per_doc.select("id", F.explode("found.hash").alias("hash")).join(unlike, "hash")
                  .groupBy("id").agg(F.collect_set("hash").alias("__bad")), "bad")
    placed = placed.join(bad.withColumnRenamed("id", "__bad_id"), F.col(f"`{key}`") == F.col("__bad_id"), "left").drop("__bad_id")
    return _kept(placed, docs.schema, text, key, bits)


def _of_anonymous(rows: DataFrame, repeated: DataFrame, text: str, bits: int) -> DataFrame:
    """Rows without an id with what they have of the repeated chunks, keyed by a written row number."""
    numbered = rows.select("__n", F.col(f"`{text}`").alias("text"))
    hashed = _hashes(numbered, bits).join(repeated, "hash").groupBy(F.col("id").alias("__n")).agg(F.collect_set(F.struct("hash", "first")).alias("__found"))
    return rows.join(hashed, "__n", "left").drop("__n")


def _kept(placed: DataFrame, schema: T.StructType, text: str, key: str, bits: int) -> DataFrame:
    kind = "struct<lines:bigint,chunks:bigint,removed_chunks:bigint,removed_words:bigint>"
    out = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in schema.fields), T.StructField("dedup", T._parse_datatype_string(kind))])

    def run(batches):
        for b in batches:
            place = b.schema.get_field_index
            texts, ids = b.column(place(text)), b.column(place(key)).to_pylist()
            c = Chunks(texts, bits)
            new, notes = texts.to_pylist(), []
            found, bad = b.column(place("__found")).to_pylist(), b.column(place("__bad")).to_pylist()
            for i in range(b.num_rows):
                span = range(c.at[i], c.at[i + 1])
                first = {f["hash"]: f["first"] for f in found[i] or ()}
                for h in bad[i] or ():
                    first.pop(h, None)
                gone: set[int] = set()
                if first:
                    seen: set[int] = set()
                    may_go: set[int] = set()
                    for u in range(c.unit_at[i], c.unit_at[i + 1]):
                        h = int(c.hashes[u])
                        if h in first:
                            if first[h] != ids[i] or h in seen:
                                may_go.add(u)
                            seen.add(h)
                    gone = c.passages(i, may_go)
                    if gone:
                        new[i] = b"\n".join(c.bytes_of(k) for k in span if k not in gone).decode()
                notes.append({"lines": int(c.lines[span.start: span.stop].sum()), "chunks": len(span), "removed_chunks": len(gone),
                              "removed_words": int(sum(c.words[k] for k in gone))})
            columns = [pa.array(new, texts.type) if f.name == text else b.column(place(f.name)) for f in schema.fields]
            struct = pa.struct([(x, pa.int64()) for x in ("lines", "chunks", "removed_chunks", "removed_words")])
            yield pa.RecordBatch.from_arrays([*columns, pa.array(notes, struct)], [f.name for f in out.fields])

    return placed.mapInArrow(frugal(run), out)
