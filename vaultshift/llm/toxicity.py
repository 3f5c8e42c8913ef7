"""Toxic passages as maximum-scoring segments of token log-odds.

Training counts every word, and every word beginning, in toxic and in other
texts.  In toxic texts a word counts once for each word that it follows: what
is toxic comes in many places, while copies of one text repeat theirs.  A word's log-odds has a Dirichlet prior that leans to the odds of
its beginning, whose prior in turn leans to the odds of all words; significant
ones make the model, all other words share one slightly negative score.  As
these are log-likelihood ratios, the best segment of ``n`` clean words exceeds
``s`` with a probability of about ``1 - exp(-K n exp(-s))``.

Scoring runs over the words once and finds all maximal segments (each better
than anything within or around it).  The excess of each over ``log(K n)``, summed,
is the text's evidence; ``K`` is fitted on clean training texts, and two
logistic parameters turn the evidence's logarithm into a probability.  Both are fitted on texts
that the counts they are scored with haven't seen (two halves, crossed).

Training takes at most ``TRAIN_ROWS`` labelled rows, chosen by a hash of the id.

Defined cases: null and empty texts have no words and no evidence, so the lowest
score; rows with a null id or label aren't learned from; several labels of an id
count as the greatest; without toxic or without other rows to learn from, all
scores are the share of toxic rows, or 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultshift.llm import words as W
from vaultshift.llm.common import frugal, small_batches

TRAIN_ROWS = 20_000
#: Bytes of a word's beginning, weight of the priors in words.
BEGINNING, PRIOR = 5, 2.0
#: A word that toxic texts use less often has no score of its own.
LEAST_USES = 2
_SHARD_BYTES = 4 << 20
COUNTS = "half int, whole boolean, key bigint, beginning bigint, before bigint, toxic bigint, clean bigint"


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, hashes of their beginnings, first word of each text and the total)."""
    offsets, body = W.buffers(texts)
    low = W.LOWER[body]
    starts, ends = W.find(offsets, low, W.ALNUM)
    return (W.hashes(low, starts, ends), W.hashes(low, starts, np.minimum(ends, starts + BEGINNING)),
            np.searchsorted(starts, offsets))


def _count(batches):
    """Counts of a few megabytes of texts at a time: toxic uses by what they follow, other uses in sum."""
    held: list[list[np.ndarray]] = []
    size = 0

    def flush():
        word, begin, before, half, toxic = (np.concatenate(x) for x in zip(*held))
        for whole, key in ((True, word), (False, begin)):
            for y in (0, 1):
                here = np.flatnonzero(toxic == y)
                use = np.zeros((len(here), 3), np.uint64)
                use[:, 0], use[:, 1] = half[here], key[here]
                if y:
                    use[:, 2] = before[here]
                order = np.lexsort(use.T[::-1])
                use = use[order]
                new = np.ones(len(use), bool)
                new[1:] = (use[1:] != use[:-1]).any(axis=1)
                first = np.flatnonzero(new)
                if not len(first):
                    continue
                n = np.diff(np.append(first, len(use)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(use[first, 0].astype(np.int32)), pa.array(np.full(len(first), whole)),
                     pa.array(use[first, 1].view(np.int64)), pa.array(begin[here[order[first]]].view(np.int64)),
                     pa.array(use[first, 2].view(np.int64)), pa.array(np.full(len(first), y, np.int64)),
                     pa.array(n.astype(np.int64) * (1 - y))],
                    ["half", "whole", "key", "beginning", "before", "toxic", "clean"])
        held.clear()

    for b in batches:
        word, begin, at = tokens(b.column(0))
        n = np.diff(at)
        before = np.roll(word, 1)
        before[at[:-1][at[:-1] < len(word)]] = 0
        held.append([word, begin, before, np.repeat(b.column(1).to_numpy(zero_copy_only=False), n),
                     np.repeat(b.column(2).to_numpy(zero_copy_only=False), n)])
        size += b.column(0).nbytes
        if size >= _SHARD_BYTES:
            yield from flush()
            size = 0
    if held:
        yield from flush()


@dataclass
class Model:
    """Sorted hashes with their scores; ``other``: the score of all other words."""

    words: np.ndarray
    word_scores: np.ndarray
    beginnings: np.ndarray
    beginning_scores: np.ndarray
    other: float
    k: float = 1.0
    slope: float = 0.0
    offset: float = 0.0

    def score_of(self, word: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """A word's own score, else that of its beginning, else ``other``; 0 stands for ``other``."""
        out = np.zeros(len(word))
        for keys, scores, sought in ((self.beginnings, self.beginning_scores, begin), (self.words, self.word_scores, word)):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
                out = np.where(keys[at] == sought, scores[at], out)
        return out


def segments(at: np.ndarray, score: np.ndarray, n: int, other: float) -> list[tuple[float, int, int]]:
    """All maximal segments (score, start, end) of n words that score ``other`` but where ``at`` says ``score``.

    One run from left to right over the words of the model; a stretch of other words is one step.  Each open
    segment keeps the sums before and after it and the nearest segment before it whose sum before is less; a new
    one swallows those that it can't do without.  A search follows these links, and what it passes
    over no later one meets, so the run is linear.
    """
    kept: list[list] = []  # [sum before, sum after, start, end, nearest with a lesser sum before]
    total, last = 0.0, 0
    for p, s in zip(at.tolist(), score.tolist()):
        total += (p - last) * other
        last = p + 1
        before, total = total, total + s
        if s <= 0:
            continue
        start, j = p, len(kept) - 1
        while True:
            while j >= 0 and kept[j][0] >= before:
                j = kept[j][4]
            if j < 0 or kept[j][1] >= total:
                kept.append([before, total, start, last, j])
                break
            before, _, start, _, link = kept[j]
            del kept[j:]
            j = link
    return [(b - a, start, end) for a, b, start, end, _ in kept]


def evidence(texts: pa.Array, model: Model) -> list[tuple[float, float, int, list]]:
    """(summed excess, best segment, words, significant segments) of each text."""
    word, begin, at = tokens(texts)
    score = model.score_of(word, begin)
    hits = np.flatnonzero(score)
    where = np.searchsorted(hits, at)
    out = []
    for i in range(len(at) - 1):
        n = int(at[i + 1] - at[i])
        own = hits[where[i]: where[i + 1]]
        found = segments(own - at[i], score[own], n, model.other) if len(own) else []
        least = np.log(max(1.0, model.k * n))
        good = [x for x in found if x[0] > least]
        out.append((sum(x[0] - least for x in good), max((x[0] for x in found), default=0.0), n, good))
    return out


def _fit(counts, halves: tuple[int, ...]) -> Model | None:
    """The model from the counts of some halves; a pandas frame of bounded training rows."""
    def of(rows):
        return rows.assign(toxic=sum(rows[f"toxic_{h}"] for h in halves), clean=sum(rows[f"clean_{h}"] for h in halves)).set_index("key")

    empty = np.zeros(0, np.uint64)
    words, begins = of(counts[counts.whole]), of(counts[~counts.whole])
    total_t, total_c = float(words.toxic.sum()), float(words.clean.sum())
    if not total_t or not total_c:
        return None
    odds, total_words, total_begins = total_t / total_c, int(words["keys"].sum()), int(begins["keys"].sum())
    words, begins = words.drop(index=0, errors="ignore"), begins.drop(index=0, errors="ignore")

    def scored(t, n, share):
        a, b = t + PRIOR * share, n + PRIOR * (1 - share)
        return np.log(a / b / odds), np.sqrt(1 / a + 1 / b)

    base = total_t / (total_t + total_c)
    b_score, b_dev = scored(begins.toxic.to_numpy(float), begins.clean.to_numpy(float), base)
    share = (begins.toxic + PRIOR * base) / (begins.toxic + begins.clean + PRIOR)
    w_score, w_dev = scored(words.toxic.to_numpy(float), words.clean.to_numpy(float),
                            share.reindex(words.beginning).to_numpy(float))
    # Of so many scores without meaning, the greatest is about this many deviations above 0.
    keep_w, keep_b = (z >= np.sqrt(2 * np.log(max(2, n))) for z, n in ((w_score / w_dev, total_words), (b_score / b_dev, total_begins)))

    def table(index, scores, keep):
        keys = index.to_numpy(np.int64).view(np.uint64)[keep]
        order = np.argsort(keys)
        return keys[order], scores[keep][order]

    words_in = (words.toxic.to_numpy()[keep_w].sum(), words.clean.to_numpy()[keep_w].sum())
    rest = (total_t - words_in[0]) / total_t, (total_c - words_in[1]) / total_c
    other = min(-1e-3, float(np.log(max(rest[0], 1e-6) / max(rest[1], 1e-6))))
    w, b = table(words.index, w_score, keep_w), table(begins.index, b_score, keep_b)
    return Model(w[0] if len(w[0]) else empty, w[1], b[0] if len(b[0]) else empty, b[1], other)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by damped Newton steps; a small penalty keeps separable data finite."""
    a, b = 0.0, float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * x).sum() + 1e-2 * a, (p - y).sum() + 1e-2 * b])
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return a, b


def train(docs: DataFrame, labels: DataFrame, fold: Column | None = None, text: str = "text", key: str = "doc_id",
          label: str = "toxic", rows: int = TRAIN_ROWS) -> tuple[Model | None, float]:
    """(model, share of toxic training rows) from the labelled rows where ``fold`` (over ``labels``) holds."""
    spark = docs.sparkSession
    small_batches(spark)
    own = labels.where(fold) if fold is not None else labels
    own = (own.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).where("k is not null and y is not null")
           .groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(rows))
    texts = (docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("text"))
             .join(F.broadcast(own), "k")  # at most ``rows`` rows
             .select("text", F.pmod(F.xxhash64("k", F.lit(1)), F.lit(2)).cast("int").alias("half"), "y"))
    uses = (texts.mapInArrow(frugal(_count), COUNTS).groupBy("half", "whole", "key", "before")
            .agg(F.min("beginning").alias("beginning"), F.max("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    # One row per word with the counts of both halves.  Words that toxic texts hardly have can't be significant:
    # they are one remainder row (key 0) with their sums and their number, so the driver gets few rows.
    by_half = [F.sum(F.when(F.col("half") == h, F.col(c)).otherwise(0)).alias(f"{c}_{h}") for h in (0, 1) for c in ("toxic", "clean")]
    words = uses.groupBy("whole", "key").agg(F.min("beginning").alias("beginning"), *by_half)
    rare = F.col("toxic_0") + F.col("toxic_1") < LEAST_USES
    counts = words.groupBy("whole", F.when(rare, F.lit(0)).otherwise(F.col("key")).alias("key")).agg(
        F.min(F.when(rare, F.lit(0)).otherwise(F.col("beginning"))).alias("beginning"), F.count(F.lit(1)).alias("keys"),
        *[F.sum(f"{c}_{h}").alias(f"{c}_{h}") for h in (0, 1) for c in ("toxic", "clean")]).toPandas()
    share = own.agg(F.avg("y")).first()[0] or 0.0
    model = _fit(counts, (0, 1))
    crossed = [_fit(counts, (1,)), _fit(counts, (0,))]  # by the half that they are to score
    if model is None or None in crossed:
        return None, float(share)
    shared = spark.sparkContext.broadcast(crossed)

    def held_in(batches):
        for b in batches:
            halves, out = b.column(1).to_pylist(), []
            both = [evidence(b.column(0), m) for m in shared.value]
            out = [both[h][i] for i, h in enumerate(halves)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([float(x[1]) for x in out]), pa.array([x[2] for x in out], pa.int64()), b.column(2).cast(pa.int32()),
                 pa.array([[float(s[0]) for s in x[3]] for x in out], pa.list_(pa.float64()))], ["best", "n", "y", "segments"])

    seen = texts.mapInArrow(frugal(held_in), "best double, n bigint, y int, segments array<double>").toPandas()
    clean = seen[(seen.y == 0) & (seen.n > 0)]
    k = len(clean) / float((clean.n * np.exp(-clean.best)).sum()) if len(clean) else 1.0
    for m in (model, *crossed):
        m.k = k
    least = np.log(np.maximum(1.0, k * seen.n.to_numpy(float)))
    x = np.array([sum(max(0.0, s - l) for s in ss) for ss, l in zip(seen.segments, least)])
    model.slope, model.offset = _logistic(np.log1p(x), seen.y.to_numpy(float))
    return model, float(share)


def score(docs: DataFrame, model: Model | None, share: float, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with ``toxicity`` struct<score, passages>, which replaces a column of that name.

    ``passages`` lists (start, end, score) of the significant segments in words.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("toxicity")
    kind = "struct<score:double,passages:array<struct<start:int,end:int,score:double>>>"
    rest = [f for f in docs.schema.fields if keep_text or f.name != text]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            texts = b.column(b.schema.get_field_index(text))
            if m is None:
                rows = [{"score": share, "passages": []}] * len(texts)
            else:
                rows = [{"score": float(1 / (1 + np.exp(-np.clip(m.slope * np.log1p(x) + m.offset, -30, 30)))),
                         "passages": [{"start": a, "end": e, "score": float(s)} for s, a, e in good]}
                        for x, _, _, good in evidence(texts, m)]
            kept = [b.column(b.schema.get_field_index(f.name)) for f in rest]
            column = pa.array(rows, pa.struct([("score", pa.float64()), ("passages", pa.list_(pa.struct(
                [("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))]))
            yield pa.RecordBatch.from_arrays([*kept, column], [*(f.name for f in rest), "toxicity"])

    return docs.mapInArrow(frugal(run), T.StructType([*rest, T.StructField("toxicity", T._parse_datatype_string(kind))]))


def in_fold(key: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id's text leaves ``fold``; a null id is in no fold."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))
