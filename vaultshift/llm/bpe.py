"""Byte-level BPE as a finite-state transducer, and streaming decoding.

Encoding.  A token sequence is the BPE encoding of a piece exactly when every
two neighbours encode to themselves when joined.  So the last token of every
prefix of a piece is settled by the prefix alone, and a left-to-right machine
needs to remember only those last tokens that a longer prefix can still build on.
Its nodes and steps are compiled from the ranks as texts need them (lazily
determinised) and kept, and so is which tokens may be neighbours; reading on,
it emits the tokens on which all live readings agree.

Decoding is a transducer over token ids whose state is the unfinished UTF-8
character (at most three bytes); it, too, is compiled as it is needed.

Tables and memoised pieces live in the Python worker while a task runs.  The ranks and what is compiled
from them (nodes, steps, ends, halves) are bounded by the vocabulary; besides there are at most ``STATES`` neighbours
and decoder steps each, and twice ``PIECES`` pieces of at most 64 characters.  A full table is started anew, which
changes no result; with the task's end all of them go.

Defined cases: a null text counts as empty and has no tokens; equal texts have
equal tokens; the other columns of a row, whatever their names, are passed on.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vaultshift.llm.common import frugal, small_batches

STATES, PIECES = 1 << 19, 1 << 18
#: Bytes of a piece that are read before tokens are emitted; the last tokens of so many prefixes are kept.
AHEAD = 512


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class _Node(dict):
    """Steps from one node: byte -> node, compiled when first asked for.

    ``ends`` has each token that ends here: (its length, the token, which tokens may be left of it).
    """

    __slots__ = ("encoder", "reading", "ends")

    def __init__(self, encoder: Encoder, reading: bytes, ends: list[tuple[int, int, dict[int, bool]]]):
        self.encoder, self.reading, self.ends = encoder, reading, ends

    def __missing__(self, byte: int) -> _Node:
        return self.encoder._step(self, byte)


class Encoder:
    """The transducer of one vocabulary (token bytes -> rank).

    Its state has two parts.  ``node`` names the longest run of bytes, up to
    here, that begins a token; nodes and steps between them are compiled on first
    use, with the tokens that end there.  ``last`` has the last token of each
    prefix since the last emitted one.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.size = {i: len(b) for b, i in ranks.items()}
        self.starts = {b[:n] for b in ranks for n in range(1, len(b) + 1)}
        self._lefts: dict[int, dict[int, bool]] = {}
        self._pairs = 0
        self._made: dict[int, tuple[int | None, int | None]] = {}
        self._own: dict[int, bool] = {}
        self._root = _Node(self, b"", [])
        self._nodes: dict[bytes, _Node] = {b"": self._root}

    def merged(self, data: bytes) -> list[bytes]:
        return self.merged_below(data, 1 << 62)

    def merged_below(self, data: bytes, limit: int) -> list[bytes]:
        """BPE by its definition, with the ranks below ``limit``: join the neighbours of lowest joint rank, the leftmost first."""
        parts = [data[i: i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best >= limit:
                break
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stands(self, token: int) -> bool:
        """Whether a token is what its own bytes encode to."""
        if token not in self._own:
            self._own[token] = len(self.merged(self.bytes_of[token])) == 1
        return self._own[token]

    def _fits(self, left: int, right: int) -> bool:
        """Whether BPE of both tokens' bytes gives just these two.

        Undoes, latest first, the merges at the border: as long as both parts
        there stand, they must not have a joint token that came before the next merge.
        """
        a, b, before = left, right, 1 << 62
        while True:
            joint = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if joint is not None and joint < before:
                return False
            inner, outer = self._parts(a)[1], self._parts(b)[0]
            if inner is None and outer is None:
                return True
            # the later of both tokens came last; of equal ones the left one was there first
            if outer is None or inner is not None and a > b:
                a, before = inner, a
            else:
                b, before = outer, b + 1

    def _parts(self, token: int) -> tuple[int | None, int | None]:
        """The two tokens whose merge made a token; of a byte, none."""
        if token not in self._made:
            data = self.bytes_of[token]
            halves = (None, None)
            for n in range(1, len(data)):
                a, b = self.ranks.get(data[:n]), self.ranks.get(data[n:])
                if a is not None and b is not None and max(a, b) < token and self.merged_below(data, token) == [data[:n], data[n:]]:
                    halves = (a, b)
                    break
            self._made[token] = halves
        return self._made[token]

    def _step(self, node: _Node, byte: int) -> _Node:
        reading = node.reading + bytes([byte])
        while reading not in self.starts:
            reading = reading[1:]
            if not reading:
                raise ValueError(f"no token for byte {byte}")
        to = self._nodes.get(reading)
        if to is None:
            ends = ((n, self.ranks.get(reading[len(reading) - n:])) for n in range(len(reading), 0, -1))
            to = self._nodes[reading] = _Node(self, reading, [
                (n, t, self._lefts.setdefault(t, {})) for n, t in ends if t is not None and self._stands(t)])
        node[byte] = to
        return to

    def _learn(self, lefts: dict[int, bool], left: int, token: int) -> bool:
        self._pairs += 1
        lefts[left] = self._fits(left, token)
        return lefts[left]

    def _path(self, last: list[int], k: int) -> list[int]:
        out = []
        while k > 0:
            out.append(last[k])
            k -= self.size[last[k]]
        out.reverse()
        return out

    def piece(self, data: bytes) -> list[int]:
        """Token ids of one piece."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if self._pairs > STATES:
            for lefts in self._lefts.values():
                lefts.clear()
            self._pairs = 0
        out: list[int] = []
        node, last = self._root, [-1]
        for start in range(0, len(data), AHEAD):
            if start:
                # Later tokens start at a prefix that the node still reaches; what all of them agree on is emitted.
                at = len(last) - 1
                live = set(range(max(0, at - len(node.reading)), at + 1))
                while len(live) > 1:
                    far = max(live)
                    live = live - {far} | {far - self.size[last[far]]}
                meet = live.pop()
                out += self._path(last, meet)
                last = last[meet:]
            for byte in data[start: start + AHEAD]:
                node = node[byte]
                for n, token, lefts in node.ends:
                    left = last[-n]
                    if left < 0:
                        break
                    fit = lefts.get(left)
                    if fit is None:
                        fit = self._learn(lefts, left, token)
                    if fit:
                        break
                last.append(token)
        return out + self._path(last, len(last) - 1)


class _Steps(dict):
    """Steps with one unfinished character: token -> (text, the steps after it), compiled when first asked for."""

    __slots__ = ("decoder", "waiting")

    def __init__(self, decoder: Decoder, waiting: bytes):
        self.decoder, self.waiting = decoder, waiting

    def __missing__(self, token: int) -> tuple[str, _Steps]:
        text, waiting = self.decoder._step(self.waiting, token)
        self.decoder._made += 1
        to = self[token] = text, self.decoder._steps(waiting)
        return to


class Decoder:
    """Token ids to text, one id at a time; what is left of a character waits for the next id."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self._states: dict[bytes, _Steps] = {}
        self._made = 0

    def _steps(self, waiting: bytes) -> _Steps:
        found = self._states.get(waiting)
        if found is None:
            found = self._states[waiting] = _Steps(self, waiting)
        return found

    #: Bytes that follow a first byte of a character; what may come right after it, by the UTF-8 definition.
    @staticmethod
    def follow(first: int) -> tuple[int, int, int]:
        """(number of following bytes, least and greatest second byte); a byte that starts nothing has -1."""
        if first < 0x80:
            return 0, 0x80, 0xBF
        if 0xC2 <= first <= 0xDF:
            return 1, 0x80, 0xBF
        if 0xE0 <= first <= 0xEF:
            return 2, 0xA0 if first == 0xE0 else 0x80, 0x9F if first == 0xED else 0xBF
        if 0xF0 <= first <= 0xF4:
            return 3, 0x90 if first == 0xF0 else 0x80, 0x8F if first == 0xF4 else 0xBF
        return -1, 0, 0

    def _step(self, waiting: bytes, token: int) -> tuple[str, bytes]:
        out, held = [], bytearray()
        need = low = high = 0
        for byte in waiting + self.bytes_of[token]:
            if held:
                if low <= byte <= high:
                    held.append(byte)
                    low, high = 0x80, 0xBF
                    if len(held) == need + 1:
                        out.append(held.decode())
                        held.clear()
                    continue
                out.append("�")  # a broken character; the byte starts anew
                held.clear()
            need, low, high = self.follow(byte)
            if need == 0:
                out.append(chr(byte))
            elif need < 0:
                out.append("�")
            else:
                held.append(byte)
        return "".join(out), bytes(held)

    def feed(self, waiting: bytes, ids: list[int]) -> tuple[str, bytes]:
        """Text of ``ids`` after the unfinished bytes ``waiting``, and what is unfinished then."""
        if self._made > STATES:
            for steps in self._states.values():
                steps.clear()
            self._states, self._made = {}, 0
        steps, out = self._steps(waiting), []
        for token in ids:
            text, steps = steps[token]
            out.append(text)
        return "".join(out), steps.waiting

    def decode(self, ids: list[int]) -> str:
        text, waiting = self.feed(b"", ids)
        return text + "�" * bool(waiting)


class Codec:
    def __init__(self, path: str, pattern: str):
        self.encoder = Encoder(load_ranks(path))
        self.decoder = Decoder(self.encoder.bytes_of)
        self.pieces = regex.compile(pattern)
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _ids(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            ids = tuple(self.encoder.piece(piece.encode()))
        if len(piece) <= 64:
            if len(self.known) >= PIECES:
                self.known, self.older = {}, self.known
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        pieces = self.pieces.findall(text)
        found = list(map(self.known.get, pieces))
        if None in found:
            known = self.known
            for i, ids in enumerate(found):
                if ids is None:
                    piece = pieces[i]
                    ids = known.get(piece)  # met earlier in this text
                    if ids is None:
                        ids = self._ids(piece)
                        known = self.known
                    found[i] = ids
        return list(chain.from_iterable(found))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def forget() -> None:
    codec.cache_clear()
    load_ranks.cache_clear()


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text`` in ``ids`` (array<int>), which replaces a column of that name."""
    small_batches(docs.sparkSession)
    docs = docs.drop(ids)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text))
            lists = [c.encode(t.as_py() or "") for t in texts]
            yield _with(b, ids, pa.array(lists, pa.list_(pa.int32())))

    return docs.mapInArrow(frugal(run, forget), schema)


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text of ``ids`` in ``text``; a null list is the empty text."""
    small_batches(docs.sparkSession)
    docs = docs.drop(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(text, T.StringType(), False)])

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            lists = b.column(b.schema.get_field_index(ids))
            yield _with(b, text, pa.array([c.decoder.decode(x.as_py() or []) for x in lists], pa.string()))

    return docs.mapInArrow(frugal(run, forget), schema)


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str | None = None) -> DataFrame:
    """The other columns of ``docs`` with n_tokens, ids_sha256 and decoded_sha256, in one pass over the texts.

    The ids are hashed as little-endian unsigned 32-bit integers, the decoded text as UTF-8; ``ids`` names a
    column for the ids themselves.
    """
    small_batches(docs.sparkSession)
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
             T.StructField("decoded_sha256", T.StringType())]
    if ids:
        added.append(T.StructField(ids, T.ArrayType(T.IntegerType())))
    rest = [f for f in docs.schema.fields if f.name not in {text, *(a.name for a in added)}]

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            sizes, found, decoded, lists = [], [], [], []
            for t in b.column(b.schema.get_field_index(text)):
                own = c.encode(t.as_py() or "")
                sizes.append(len(own))
                packed = struct.pack(f"<{len(own)}I", *own)
                found.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(c.decoder.decode(own).encode()).hexdigest())
                if ids:
                    lists.append(np.frombuffer(packed, "<i4"))
            columns = [*(b.column(b.schema.get_field_index(f.name)) for f in rest), pa.array(sizes, pa.int64()),
                       pa.array(found, pa.string()), pa.array(decoded, pa.string())]
            if ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in [*rest, *added]])

    return docs.mapInArrow(frugal(run, forget), T.StructType([*rest, *added]))


def _with(b: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*b.columns, column], [*b.schema.names, name])
