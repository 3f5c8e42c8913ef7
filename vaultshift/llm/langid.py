"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's subwords are its runs of 3 and 4 bytes, A-Z as a-z, with a line end before
and after the text.  Each has a row in a hashed table of embeddings; a text is the
mean of its rows, and a linear softmax over that gives the languages.  Embeddings and
softmax are learned together by stochastic gradient descent in numpy, in one task,
on about ``PER_LANG`` labelled texts of each language (chosen by a hash of the id).

A part of these texts is kept out of the descent.  On it a temperature is fitted
for the probabilities, and the least probability at which the accepted predictions are
right in ``TARGET`` of the cases; below it a prediction counts as rejected.

Defined cases: a null text or one without a letter is ``und`` with score 0; rows
without a language or an id aren't learned from; without any to learn from every text
is ``und``; equal texts get equal predictions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultshift.llm import words as W
from vaultshift.llm.common import small_batches

PER_LANG = 600
SUBWORDS, BUCKET_BITS, WIDTH = (3, 4), 16, 8
EPOCHS, RATE, TARGET = 6, 0.5, 0.99
LETTER = regex.compile(r"\p{L}")
_BLOCK = 1 << 20


@dataclass
class Model:
    langs: list[str]
    rows: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def probabilities(self, means: np.ndarray) -> np.ndarray:
        z = (means @ self.weights + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def subwords(offsets: np.ndarray, body: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Per subword length, the bucket of each position (the last ones of a text 0, a bucket never used), and text starts."""
    n = len(offsets) - 1
    out = np.full(len(body) + 2 * n, 10, np.uint8)
    text = np.repeat(np.arange(n), np.diff(offsets))
    out[np.arange(len(body)) + 2 * text + 1] = W.LOWER[body]
    at = offsets + 2 * np.arange(n + 1)
    wide = np.concatenate((out, np.zeros(max(SUBWORDS), np.uint8))).astype(np.uint32)
    found = []
    for size in SUBWORDS:
        code = np.zeros(len(out), np.uint32)
        for k in range(size):
            code = (code << np.uint32(8)) | wide[k: k + len(out)]
        code = (code * np.uint32(2654435761) + np.uint32(size * 97)) * np.uint32(2246822519) >> np.uint32(32 - BUCKET_BITS)
        code = np.maximum(code, 1)
        for k in range(size - 1):
            code[np.maximum(at[1:] - 1 - k, at[:-1])] = 0
        found.append(code)
    return found, at


def means(texts: pa.Array, rows: np.ndarray) -> np.ndarray:
    """Mean embedding of each text; of one without subwords, zeros.  Long texts are summed block by block."""
    offsets, body = W.buffers(texts)
    n = len(offsets) - 1
    total, count = np.zeros((n, rows.shape[1])), np.zeros(n)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _BLOCK, "right")) - 1)
        codes, at = subwords(offsets[i: j + 1] - offsets[i], body[offsets[i]: offsets[j]])
        for code in codes:
            for a in range(0, len(code), _BLOCK):
                cut = at[:-1][(at[:-1] > a) & (at[:-1] < a + _BLOCK)]
                starts = np.concatenate(([a], cut)) - a
                owner = np.searchsorted(at, starts + a, "right") - 1
                part = code[a: a + _BLOCK]
                total[i + owner] += np.add.reduceat(rows[part], starts, axis=0)
                count[i + owner] += np.add.reduceat((part > 0).astype(np.int64), starts)
        i = j
    return total / np.maximum(count, 1)[:, None]


def descend(texts: pa.Array, langs: list[str], names: list[str], seed: int = 7) -> Model:
    """The model after ``EPOCHS`` rounds over the texts, in an order of their own each."""
    g = np.random.default_rng(seed)
    rows = ((g.random((1 << BUCKET_BITS, WIDTH)) - 0.5) / WIDTH).astype(np.float32)
    rows[0] = 0
    weights, bias = np.zeros((WIDTH, len(names))), np.zeros(len(names))
    data = []
    offsets, body = W.buffers(texts)
    for i in range(len(offsets) - 1):
        codes, _ = subwords(np.array([0, offsets[i + 1] - offsets[i]]), body[offsets[i]: offsets[i + 1]])
        code = np.concatenate(codes)
        own, count = np.unique(code[code > 0], return_counts=True)
        data.append((own, (count / max(1, count.sum())).astype(np.float32)))
    target = [names.index(x) for x in langs]
    steps, done = EPOCHS * len(data), 0
    scale = np.float32(40)  # a mean spreads its gradient thinly over its rows
    for _ in range(EPOCHS):
        for i in g.permutation(len(data)):
            rate = RATE * (1 - done / steps)
            done += 1
            own, share = data[i]
            x = share @ rows[own] if len(own) else np.zeros(WIDTH)
            z = x @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[target[i]] -= 1
            back = weights @ p
            weights -= rate * np.outer(x, p)
            bias -= 0.1 * rate * p
            if len(own):
                rows[own] -= (np.float32(rate) * scale * share)[:, None] * back.astype(np.float32)
    return Model(names, rows, weights, bias)


def calibrate(model: Model, texts: pa.Array, langs: list[str]) -> None:
    """Sets the temperature of least log loss and the least accepted probability."""
    if not langs:
        return
    m = means(texts, model.rows)
    y = np.array([model.langs.index(x) for x in langs])
    best = None
    for t in np.geomspace(0.05, 20, 60):
        model.temperature = float(t)
        loss = -np.log(np.maximum(model.probabilities(m)[np.arange(len(y)), y], 1e-12)).mean()
        best = min(best or (loss, t), (loss, t))
    model.temperature = float(best[1])
    p = model.probabilities(m)
    sure, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-sure)
    good = np.cumsum(right[order]) / np.arange(1, len(y) + 1) >= TARGET
    model.least = float(sure[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0


def train(docs: DataFrame, fold: Column | None = None, text: str = "text", key: str = "doc_id", lang: str = "lang",
          per_lang: int = PER_LANG) -> Model | None:
    """Learns from the rows of ``docs`` where ``fold`` holds; about ``per_lang`` of each language."""
    small_batches(docs.sparkSession)
    own = docs.where(fold) if fold is not None else docs
    own = own.select(F.col(f"`{key}`").alias("k"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"))
    own = own.where("k is not null and lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, per_lang / n))).otherwise(share)
    draw = F.pmod(F.xxhash64("k"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = own.where(draw < share).select(F.xxhash64("k").alias("h"), "lang", "text")
    names = sorted(counts)

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        table = table.sort_by([("h", "ascending"), ("lang", "ascending"), ("text", "ascending")])
        apart = np.array([h % 5 == 0 for h in table["h"].to_pylist()])
        fit, rest = table.filter(pa.array(~apart)), table.filter(pa.array(apart))
        if not fit.num_rows:
            fit = table
        m = descend(fit["text"].combine_chunks(), fit["lang"].to_pylist(), names)
        calibrate(m, rest["text"].combine_chunks(), rest["lang"].to_pylist())
        yield pa.RecordBatch.from_arrays(
            [pa.array([m.rows.tobytes()]), pa.array([m.weights.tobytes()]), pa.array([m.bias.tobytes()]),
             pa.array([m.temperature]), pa.array([m.least])], ["rows", "weights", "bias", "temperature", "least"])

    kind = "rows binary, weights binary, bias binary, temperature double, least double"
    r = sample.repartition(1).mapInArrow(run, kind).first()  # the bounded sample, in one task
    if r is None:
        return None
    return Model(names, np.frombuffer(r["rows"], np.float32).reshape(-1, WIDTH), np.frombuffer(r["weights"]).reshape(WIDTH, -1),
                 np.frombuffer(r["bias"]), r["temperature"], r["least"])


def predict(docs: DataFrame, model: Model | None, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with ``language`` struct<lang, score, rejected>, which replaces a column of that name."""
    small_batches(docs.sparkSession)
    docs = docs.drop("language")
    rest = [f for f in docs.schema.fields if keep_text or f.name != text]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = "struct<lang:string,score:double,rejected:boolean>"

    def run(batches):
        m = shared.value
        for b in batches:
            texts = b.column(b.schema.get_field_index(text))
            lettered = [t is not None and LETTER.search(t) is not None for t in texts.to_pylist()]
            rows = [{"lang": "und", "score": 0.0, "rejected": True}] * len(texts)
            if m is not None and len(texts):
                p = m.probabilities(means(texts, m.rows))
                best = p.argmax(axis=1)
                rows = [{"lang": m.langs[k], "score": float(p[i, k]), "rejected": bool(p[i, k] < m.least)} if lettered[i] else rows[i]
                        for i, k in enumerate(best)]
            column = pa.array(rows, pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(f.name)) for f in rest), column],
                                             [*(f.name for f in rest), "language"])

    return docs.mapInArrow(run, T.StructType([*rest, T.StructField("language", T._parse_datatype_string(kind))]))
