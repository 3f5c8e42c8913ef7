"""The transducer against tiktoken, and the decoder against Python's own."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SF_SMALL
from vaultshift.llm import bpe
from vaultshift.llm.queries import QUERIES, RANKS

PATH = public_tokenizers.path(RANKS)
CODEC = bpe.codec(PATH, public_tokenizers.PATTERN)
OTHER = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks={
    base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))})


def test_whole_table_matches_tiktoken(spark):
    texts = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op5_byte_level_bpe"](spark, SF_SMALL).collect()}
    assert len(got) == len(texts)
    for r in texts:
        ids = OTHER.encode_ordinary(r.text or "")
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.text(alphabet="abcdeéßñ 's\n\t"), st.text(alphabet="the ing on", min_size=20),
                 st.lists(st.sampled_from(["aaaa", "的", "👩‍👩‍👧", "  ", "1234", "<|endoftext|>", "ñ", "́"])).map("".join)))
def test_random_texts(text):
    ids = CODEC.encode(text)
    assert ids == OTHER.encode_ordinary(text)
    assert CODEC.decoder.decode(ids) == text


def test_long_runs_and_full_tables(monkeypatch):
    monkeypatch.setattr(bpe, "STATES", 50)
    monkeypatch.setattr(bpe, "PIECES", 3)
    monkeypatch.setattr(bpe, "AHEAD", 40)
    for text in ("a" * 5000, "ab" * 3000, " " * 999 + "x", "thequickbrownfox" * 200, "ü" * 700, "\x00\x01" * 50):
        assert CODEC.encode(text) == OTHER.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40))
def test_decoder_on_any_bytes(data):
    ids = [CODEC.encoder.ranks[data[i:i + 1]] for i in range(len(data))]
    assert ("�" in CODEC.decoder.decode(ids)) == ("�" in data.decode(errors="replace"))
    try:
        assert CODEC.decoder.decode(ids) == data.decode()
    except UnicodeDecodeError:
        pass


def test_columns_and_odd_rows(spark):
    rows = [(1, None, 7), (2, "", 8), (2, "", 8), (None, "Hello, wörld", 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    back = bpe.decode(bpe.encode(d, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert back.columns == ["doc_id", "text", "ids", "decoded"]
    got = sorted(((r.doc_id or 0, r.decoded, r.ids) for r in back.collect()), key=repr)
    assert got == sorted([(1, "", []), (2, "", []), (2, "", []), (0, "Hello, wörld", OTHER.encode_ordinary("Hello, wörld"))], key=repr)
    assert bpe.digests(d.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_neighbours_against_the_definition():
    g = np.random.default_rng(1)
    e = CODEC.encoder
    for a, b in g.integers(0, len(e.ranks), (1500, 2)):
        left, right = e.bytes_of[int(a)], e.bytes_of[int(b)]
        if e._stands(int(a)) and e._stands(int(b)):
            assert e._fits(int(a), int(b)) == (e.merged(left + right) == [left, right])


def test_steps_are_kept_by_state_and_started_anew(monkeypatch):
    """Neighbours and decoder steps lie with their state; full tables are emptied there, and nothing changes."""
    c = bpe.Codec(PATH, public_tokenizers.PATTERN)
    texts = ["thequickbrownfox的ñéß" * 30, "日本語 текст 👩‍👩‍👧 " * 9, "x" * 1500 + "zq" * 700]
    for states in (1 << 19, 4):
        monkeypatch.setattr(bpe, "STATES", states)
        for text in texts * 2:
            ids = c.encode(text)
            assert ids == OTHER.encode_ordinary(text) and c.decoder.decode(ids) == text
            assert c.encoder._pairs == sum(map(len, c.encoder._lefts.values()))
            assert c.decoder._made == sum(map(len, c.decoder._states.values()))
    c.known, c.older = {}, {}
    c.encode("zqzqzq"), c.decoder.decode([])
    assert c.encoder._pairs < 50 and c.decoder._made <= 4
