"""Hard-negative mining over a multiway hyperplane tree with range tables (GNAT).

Rows are (id, label, vector).  A component x counts as ``floor(scale * x)``; the
score of two rows is the inner product of these whole numbers.  Of an anchor
(a row whose id is divisible by ``every``) the positives are the best other rows
of its label, and for each positive the negatives are the best rows of other
labels whose score is between ``low`` and ``high`` per cent of the positive's.
Higher scores come first, ties by smaller id.

Inner products become distances by lifting: a row x gets one more coordinate,
``sqrt(m2 - |x|^2)`` with m2 the largest square norm of all rows, an anchor gets 0.
Then ``d(a, x)^2 = |a|^2 + m2 - 2 score``, so a window of scores is an annulus
around the anchor and a best-first search is a nearest-first one.

1. *Fit.*  Split points are chosen on a sample of at most ``SAMPLE`` rows: per tree
   node up to ``FAN`` points far from each other; every row goes to its nearest one.
2. *Place.*  One pass puts every row of the table into its leaf and takes, per tree node,
   the least and greatest distance of split point i to the rows below its sibling j.
   These tables cover all rows, so what they rule out is empty for certain.
3. *Block.*  A leaf is dealt out evenly to blocks of about ``BLOCK`` rows; a leaf that holds a
   third of all rows is many blocks.
4. *Search.*  An anchor visits the blocks of the leaves whose ranges meet its annulus
   at every split point (triangle inequality, both sides).  Rows and visits of a block
   come sorted to one task, rows first: the task holds one block and lets any
   number of visitors stream by.  The blocks are searched exhaustively, so results are
   exact.  A first visit to the anchor's own block bounds its positives' radius.

Cases: rows with a null id, label or vector, or a null, NaN or infinite component take
no part; components beyond ``BOUND`` either way count as ``BOUND``; a shorter vector counts
as filled up with zeros, an empty one as all zeros.  Rows of equal id are rows of their own
as candidates (never positives of that id); as an anchor the one with the least
(label, vector) speaks for the id.  No rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vaultshift.session import written

#: Rows that split points are chosen from (the driver holds them: SAMPLE * dimensions * 8 bytes).
SAMPLE = 4096
#: Split points of a tree node, rows of a block, rows of the sample below which a leaf is not split.
FAN, BLOCK, LEAST = 16, 1024, 16
#: Quantised components stay within this, so that a hundred times a score stays within 64 bits up to 65,536 dimensions.
BOUND = 1 << 20
_FAR = 1 << 62
#: Visitors whose scores against a block are computed at once.
_AT_ONCE = 256


@dataclass
class Node:
    points: np.ndarray            # (k, dim + 1), lifted
    child: list[int]              # a node's number, or -1 - leaf
    lo: np.ndarray                # (k, k): least distance of point i to the rows below child j
    hi: np.ndarray


@dataclass
class Tree:
    dim: int
    m2: float
    exact: bool                   # products fit 53 bits, so float64 matrix products are exact
    nodes: list[Node]
    leaves: int
    first: np.ndarray | None = None   # first block of each leaf, and the total

    @property
    def slack(self) -> float:
        """More than rounding can move a distance."""
        return 1e-6 * np.sqrt(self.m2) + 1e-9


def lifted(x: np.ndarray, m2: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.column_stack((x, np.sqrt(np.maximum(0.0, m2 - (x * x).sum(1)))))


def _between(x: np.ndarray, points: np.ndarray, m2: float) -> np.ndarray:
    """Distances of lifted rows to lifted points; all have the norm sqrt(m2)."""
    return np.sqrt(np.maximum(0.0, 2 * m2 - 2 * (x @ points.T)))


def _far_apart(x: np.ndarray, m2: float, least: float) -> np.ndarray:
    """Up to FAN rows of x, each the farthest from those before it."""
    tried = x[: 3 * FAN]
    if _between(tried, tried[:1], m2).max() <= least:
        tried = x
    chosen, near = [0], _between(tried, tried[:1], m2)[:, 0]
    while len(chosen) < FAN and near.max() > least:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _between(tried, tried[chosen[-1:]], m2)[:, 0])
    return tried[chosen]


def fit_tree(sample: np.ndarray, dim: int, m2: float, exact: bool, rows: int) -> Tree:
    """Splits the sample until a part stands for about BLOCK rows of the table, or is down to LEAST rows or one place."""
    tree = Tree(dim, m2, exact, [], 1)
    small = max(LEAST, BLOCK * len(sample) / max(1, rows))
    # A part to split, and the place in its parent that is to name it.
    work, leaves = [(lifted(sample, m2), None)], 0
    while work:
        x, at = work.pop()
        points = _far_apart(x, m2, tree.slack) if len(x) > small else x[:1]
        if len(points) < 2:
            name, leaves = -1 - leaves, leaves + 1
        else:
            name, k = len(tree.nodes), len(points)
            tree.nodes.append(Node(points, [0] * k, np.full((k, k), np.inf), np.full((k, k), -np.inf)))
            side = _between(x, points, m2).argmin(1)
            work += [(x[side == j], (name, j)) for j in range(k)]
        if at is not None:
            tree.nodes[at[0]].child[at[1]] = name
    tree.leaves = leaves
    return tree


def place(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each row; the range tables of ``tree`` take the rows in."""
    at = np.full(len(x), 0 if tree.nodes else -1)
    up = lifted(x, tree.m2)
    # A child's number is greater than its parent's, so one pass goes all the way down.
    for k, node in enumerate(tree.nodes):
        here = np.flatnonzero(at == k)
        if not len(here):
            continue
        d = _between(up[here], node.points, tree.m2)
        side = d.argmin(1)
        for j in np.unique(side):
            own = d[side == j]
            node.lo[:, j] = np.minimum(node.lo[:, j], own.min(0))
            node.hi[:, j] = np.maximum(node.hi[:, j], own.max(0))
        at[here] = np.array(node.child)[side]
    return -1 - at


def surviving(tree: Tree, a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[int]:
    """Leaves that may hold rows whose score with ``a`` is in one of the windows [lo, hi]."""
    if not tree.nodes:
        return [0]
    square = float((a * a).sum()) + tree.m2
    inner, outer = (np.sqrt(np.maximum(0.0, square - 2.0 * w)) for w in (hi, lo))
    inner, outer = inner[:, None] - tree.slack, outer[:, None] + tree.slack
    found, work = [], [0]
    while work:
        node = tree.nodes[work.pop()]
        d = np.sqrt(np.maximum(0.0, square - 2 * (node.points[:, :-1] @ a)))
        # A row of the annulus is between these distances from each split point.
        near, far = np.maximum(d - outer, inner - d)[:, :, None], (d + outer)[:, :, None]
        meets = ((near <= node.hi) & (far >= node.lo)).all(1).any(0)
        for j in np.flatnonzero(meets):
            if node.child[j] >= 0:
                work.append(node.child[j])
            else:
                found.append(-1 - node.child[j])
    return found


def _matrix(v: pa.Array, dim: int) -> np.ndarray:
    """Rows of an Arrow list column, filled up with zeros to ``dim`` columns."""
    at = np.asarray(v.offsets, np.int64)
    size = np.diff(at)
    out = np.zeros((len(v), dim), np.int64)
    out[np.arange(dim) < size[:, None]] = np.asarray(v.values)[at[0]: at[-1]] if len(v) else 0
    return out


def _place_rows(tree) -> Iterator:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, vector = tree.value, None
        # Running numbers in each leaf; tasks begin at different ones, or all would fill the first blocks.
        seen = np.full(t.leaves, TaskContext.get().partitionId() * 7919, np.int64)
        for node in t.nodes:
            node.lo[:], node.hi[:] = np.inf, -np.inf
        for b in batches:
            n, vector = b.num_rows, b["v"].type
            leaf = place(t, _matrix(b["v"], t.dim))
            order = np.argsort(leaf, kind="stable")
            many = np.bincount(leaf, minlength=t.leaves)
            turn = np.empty(n, np.int64)
            turn[order] = np.arange(n) - np.repeat(np.cumsum(many) - many, many) + np.repeat(seen, many)
            seen += many
            none = pa.nulls(n, pa.float64())
            yield pa.RecordBatch.from_arrays(
                [b["id"], b["label"], b["v"], pa.array(leaf, pa.int32()), pa.array(turn, pa.int64()),
                 pa.nulls(n, pa.int64()), none, none], names=[*_PLACED])
        # This task's ranges, as rows of their own.
        base = 0
        for node in t.nodes:
            k = node.lo.size
            pair = np.flatnonzero(np.isfinite(node.lo.ravel()))
            if len(pair):
                none = pa.nulls(len(pair), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [none, none, pa.nulls(len(pair), vector), pa.nulls(len(pair), pa.int32()), none,
                     pa.array(base + pair, pa.int64()), pa.array(node.lo.ravel()[pair]), pa.array(node.hi.ravel()[pair])], names=[*_PLACED])
            base += k
    return run


_PLACED = {"id": "long", "label": "long", "v": "array<int>", "leaf": "int", "turn": "long", "pair": "long", "lo": "double", "hi": "double"}
_VISIT = {"block": "long", "kind": "int", "id": "long", "label": "long", "v": "array<int>", "no": "array<int>", "lo": "array<long>", "hi": "array<long>"}
_FOUND = "anchor long, no int, score long, other long"


def _schema(of: dict[str, str]) -> str:
    return ", ".join(f"{k} {t}" for k, t in of.items())


def _route(tree) -> Iterator:
    """One row per anchor and block that it has to visit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tree.value
        for whole in batches:
            for s in range(0, whole.num_rows, _AT_ONCE):
                b = whole.slice(s, _AT_ONCE)
                x = _matrix(b["v"], t.dim).astype(np.float64)
                rows, blocks = [], []
                for i, (lo, hi) in enumerate(zip(b["lo"].to_pylist(), b["hi"].to_pylist())):
                    for leaf in surviving(t, x[i], np.array(lo, np.float64), np.array(hi, np.float64)):
                        own = range(t.first[leaf], t.first[leaf + 1])
                        rows += [i] * len(own)
                        blocks += own
                for k in range(0, len(rows), 4096):
                    part = b.take(pa.array(rows[k: k + 4096], pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(blocks[k: k + 4096], pa.int64()), pa.array(np.ones(part.num_rows), pa.int32()),
                         *[part[c] for c in ("id", "label", "v", "no", "lo", "hi")]], names=[*_VISIT])
    return run


def _answers(held, b: pa.RecordBatch, dim: int, exact: bool, same: bool, most: int) -> pa.RecordBatch:
    ids, labels, m = held
    x = _matrix(b["v"], dim)
    scores = (x.astype(np.float64) @ m.astype(np.float64).T).astype(np.int64) if exact else x @ m.T
    who, label = np.asarray(b["id"]), np.asarray(b["label"])
    out: list[tuple] = []
    for i, (no, lo, hi) in enumerate(zip(b["no"].to_pylist(), b["lo"].to_pylist(), b["hi"].to_pylist())):
        fit = (labels == label[i]) & (ids != who[i]) if same else labels != label[i]
        for n, low, high in zip(no, lo, hi):
            c = np.flatnonzero(fit & (scores[i] >= low) & (scores[i] <= high))
            s = scores[i][c]
            if len(c) > most:
                keep = s >= np.partition(s, len(s) - most)[len(s) - most]
                c, s = c[keep], s[keep]
            best = np.argsort(-s, kind="stable")[:most]  # the rows are in the order of their ids
            out += [(int(who[i]), n, int(s[j]), int(ids[c[j]])) for j in best]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
        zip(*out) if out else [[]] * 4, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["anchor", "no", "score", "other"])


def _search(rows: DataFrame, visits: DataFrame, tree: Tree, same: bool, most: int) -> DataFrame:
    """(anchor, no, score, other): per visit and window the best ``most`` rows of the block."""
    dim, exact = tree.dim, tree.exact

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, held = None, [], None
        for b in batches:
            block, kind = np.asarray(b["block"]), np.asarray(b["kind"])
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for s, e in zip([0, *cuts], [*cuts, b.num_rows]):
                if s == e:
                    continue
                if block[s] != now:
                    now, parts, held = block[s], [], None
                if kind[s] == 0:
                    p = b.slice(s, e - s)
                    parts.append((np.asarray(p["id"]), np.asarray(p["label"]), _matrix(p["v"], dim)))
                    continue
                if held is None and not parts:
                    continue  # by chance no row of the leaf was dealt here
                if held is None:
                    ids, labels, m = (np.concatenate(x) for x in zip(*parts))
                    order = np.argsort(ids, kind="stable")
                    held, parts = (ids[order], labels[order], m[order]), []
                for k in range(s, e, _AT_ONCE):
                    yield _answers(held, b.slice(k, min(_AT_ONCE, e - k)), dim, exact, same, most)

    none = [F.lit(None).cast(_VISIT[c]).alias(c) for c in ("no", "lo", "hi")]
    both = rows.select("block", F.lit(0).alias("kind"), "id", "label", "v", *none).unionByName(visits.select(*_VISIT))
    return both.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(run, _FOUND)


def _best(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("other"))
    return found.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= most)


def quantised(rows: DataFrame, scale: int) -> DataFrame:
    """(id, label, v) of the rows that take part."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = F.transform("vector", lambda x: F.least(F.greatest(
        F.floor(F.lit(float(scale)) * F.greatest(F.least(x.cast("double"), F.lit(1e15)), F.lit(-1e15))), F.lit(-BOUND)), F.lit(BOUND)).cast("int"))
    return rows.where("id is not null and label is not null and vector is not null").where(~bad).select(
        F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), v.alias("v"))


def mine(rows: DataFrame, scale: int = 256, every: int = 100, positives: int = 5, negatives: int = 5,
         low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``rows`` (id, label, vector)."""
    spark, sc = rows.sparkSession, rows.sparkSession.sparkContext
    clean = quantised(rows.select("id", "label", "vector"), scale)
    square = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
    top = F.aggregate("v", F.lit(0), lambda s, x: F.greatest(s, F.abs(x)))
    n, dim, m2, most = clean.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(square), F.max(top)).first()
    if not n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    dim = max(1, dim)
    sample = clean.orderBy(F.xxhash64("id"), "id", "label", "v").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    tree = fit_tree(_matrix(sample, dim), dim, float(m2), dim * most * most < 1 << 53, n)

    to_place = sc.broadcast(tree)
    placed = written(clean.mapInArrow(_place_rows(to_place), _schema(_PLACED)), "placed")
    lo, hi = (np.full(sum(x.lo.size for x in tree.nodes), y) for y in (np.inf, -np.inf))
    for r in placed.where("pair is not null").groupBy("pair").agg(F.min("lo"), F.max("hi")).collect():  # the tree's size, not the table's
        lo[r[0]], hi[r[0]] = r[1], r[2]
    base = 0
    for node in tree.nodes:
        size, shape = node.lo.size, node.lo.shape
        node.lo, node.hi = lo[base: base + size].reshape(shape), hi[base: base + size].reshape(shape)
        base += size
    here = placed.where("pair is null")
    count = np.zeros(tree.leaves, np.int64)
    for leaf, c in here.groupBy("leaf").count().collect():
        count[leaf] = c
    blocks = -(-count // BLOCK)
    tree.first = np.concatenate(([0], np.cumsum(blocks)))
    dealt = spark.createDataFrame([(i, int(f), int(b)) for i, (f, b) in enumerate(zip(tree.first, blocks)) if b], "leaf int, first long, blocks long")
    placed = here.join(F.broadcast(dealt), "leaf").select((F.col("first") + F.col("turn") % F.col("blocks")).alias("block"), "id", "label", "v")

    anchors = written(placed.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("label", "v", "block")).alias("a"))
                      .select("id", "a.label", "a.v", "a.block"), "anchors")
    to_route = sc.broadcast(tree)
    all_of = [F.array(F.lit(x).cast(t)) for x, t in ((0, "int"), (-_FAR, "long"), (_FAR, "long"))]
    home = anchors.select("block", F.lit(1).alias("kind"), "id", "label", "v", *[c.alias(k) for c, k in zip(all_of, ("no", "lo", "hi"))])
    bound = _search(placed, home, tree, True, positives).groupBy(F.col("anchor").alias("id")).agg(
        F.when(F.count(F.lit(1)) >= positives, F.min("score")).otherwise(-_FAR).alias("least"))
    routed = anchors.join(bound, "id", "left").select(
        "id", "label", "v", all_of[0].alias("no"), F.array(F.coalesce("least", F.lit(-_FAR))).alias("lo"), all_of[2].alias("hi")
    ).mapInArrow(_route(to_route), _schema(_VISIT))
    best = _best(_search(placed, routed, tree, True, positives), ["anchor"], positives)
    pairs = written(best.select("anchor", F.col("rank").alias("no"), F.col("other").alias("positive"), F.col("score").alias("positive_score")), "positives")

    part = "((positive_score * {0} - pmod(positive_score * {0}, 100)) div 100)"  # rounded down, in whole numbers
    windows = pairs.selectExpr("anchor", "no", f"-{part.format(-low)} AS lo", f"{part.format(high)} AS hi").where("lo <= hi").groupBy(F.col("anchor").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("no", "lo", "hi"))).alias("w"))  # at most one for each positive
    routed = anchors.join(windows, "id").select("id", "label", "v", *[F.col(f"w.{c}").alias(c) for c in ("no", "lo", "hi")]).mapInArrow(
        _route(to_route), _schema(_VISIT))
    best = _best(_search(placed, routed, tree, False, negatives), ["anchor", "no"], negatives)
    out = written(best.withColumnRenamed("score", "negative_score").join(pairs, ["anchor", "no"]).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("other").alias("negative_id"),
        "positive_score", "negative_score"), "hard-negatives")
    to_place.destroy()
    to_route.destroy()
    return out
