"""Each stage of the pipeline against brute force on what the stage before kept."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from tests.conftest import SF_SMALL
from tests.llm import test_decontamination, test_line_dedup, test_ngram_join

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_match_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    kept = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept[-1], SF_SMALL)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == COLUMNS, name
        out.write.parquet(str(tmp_path / str(k)))
        kept.append(spark.read.parquet(str(tmp_path / str(k))))
    rows = [[(r.doc_id, r.text) for r in df.collect()] for df in kept[:-1]]

    toxic = {r.doc_id for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect() if r.toxic}
    gone = {d for d, _ in rows[0]} - {d for d, _ in rows[1]}
    assert len(gone - toxic) <= 0.05 * len(rows[0]) and set(rows[1]) <= set(rows[0])
    want = {d: t for d, t in test_line_dedup.brute(rows[1])}
    before = dict(rows[1])
    assert dict(rows[2]) == {d: t for d, t in want.items() if t != "" or before[d] == ""}
    assert {r.n_chars for r in kept[2].collect()} == {len(r.text) for r in kept[2].collect()}
    assert {d for d, _ in rows[3]} == {c for _, _, c in test_ngram_join.brute(rows[2])}
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {r[0] for r in test_decontamination.brute(rows[3], items) if not r[-1]}
    assert {d for d, _ in rows[4]} == clean < {d for d, _ in rows[3]}

    path = public_tokenizers.path(corpus_pipeline.RANKS)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    tok = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    last = {r.doc_id: r for r in kept[-1].collect()}
    assert last.keys() == dict(rows[4]).keys()
    for d, t in rows[4]:
        ids = tok.encode_ordinary(t)
        assert last[d].ids == ids and last[d].n_tokens == len(ids)
        assert last[d].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert last[d].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_odd_rows_and_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c", "en", None, 5), (3, "A  b C", None, "s", 6), (4, "a b c", "en", "s", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 1, 2, 3]
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none/documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "none/labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "none/benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_the_near_duplicate_stage_names_its_rule(spark, monkeypatch):
    rules = []
    own = corpus_pipeline.ngram_join.ngram_components
    monkeypatch.setattr(corpus_pipeline.ngram_join, "ngram_components", lambda docs, **rule: rules.append(rule) or own(docs, **rule))
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e"), (None, "x")], "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()) == [0, 1]
    assert rules == [{"size": 4, "percent": 85}]
