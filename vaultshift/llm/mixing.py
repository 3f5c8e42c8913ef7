"""Mixing sources to target weights by cube-method balanced sampling.

Every source gets a target of words (``targets``).  With r = target / words of the source
(0 to ``most``), each of its documents is taken floor(r) times, and a balanced sample of
them once more, each with the probability r - floor(r).  The sample is balanced on two
totals of its source, words and documents: it has as many of each as expected, but
for what the landing leaves.

*Flight.*  Each unit holds a probability.  Three units at a time have a direction in which
both totals stand still, (c-b, a-c, b-a) for sizes a, b, c; the cube method moves along
it, one way or the other by a fair draw, until a unit reaches 0 or 1, is decided, and makes
room for the next.  What can't move any more, two units or fewer, is left over.

*Rounds.*  A source's documents are dealt by a hash to chunks of about ``CHUNK``; each chunk
flies on its own, so a source with a third of all rows is many tasks.  A chunk that many repeated
rows make longer flies in parts of 4 ``CHUNK``, each with what the part before left over.
What the chunks leave over goes into the next round, up to one chunk a source.

*Landing.*  Of the at most 2^2 ways to decide a source's last units, the one that comes nearest
to the words expected of them is taken (then to their number, then the least).  They
are small documents, as the large ones are decided first.

Draws are hashes of the seed, the round and the unit, so reruns agree whatever the partitions.

Cases: a null or empty text has size 0; null is a source of its own, after all
others; a source without words has target 0 and nothing of it is taken; rows of equal id are units
of their own; no rows give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultshift.session import written

#: Documents of a chunk, about.  It changes the work's grain; totals hold at any value.
CHUNK = 4096
WEIGHTS = (5, 2, 1)
_EDGE = 1e-9
_UNIT = "id long, size long, source string, copies int, rest double, left boolean"


def sizes(docs: DataFrame) -> DataFrame:
    """(id, source, size): words ``[^\\x20\\x09-\\x0D]+`` of whole texts."""
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select("id", "source", F.coalesce(words, F.lit(0)).cast("long").alias("size"))


def targets(units: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, docs, target) of ``units`` (source, size).

    Sources in the order of their code points, null last, weigh ``weights``, repeating, and
    share ``share`` times all sizes; a target stops at ``most`` times its source's size and what
    is over goes to the others by weight, until none is above.  Sources stay
    a table however many there are: each goes by its place in a distributed sort.
    """
    spark = units.sparkSession
    per = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    # Number in a sort = numbers before its partition + number within it.
    ranked = written(per.sort(F.asc_nulls_last("source")).withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33)
    before, total = {}, 0
    for p, n in sorted(tuple(r) for r in ranked.groupBy(part).count().collect()):  # one row a partition
        before[p], total = total, total + n
    if not total:
        return ranked.select("source", "source_size", "docs", F.lit(0.0).alias("target"))
    first = spark.createDataFrame(list(before.items()), "part long, first long")
    n = (F.col("first") + F.col("at").bitwiseAND((1 << 33) - 1)) % len(weights)
    weighed = written(ranked.join(F.broadcast(first), part == F.col("part")).select(
        "source", "source_size", "docs", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n + 1).cast("int")).alias("weight")), "weights")
    cap = F.col("source_size") * most
    # The level at which the open sources share what the stopped ones leave; a round stops at least one source more.
    level, stopped = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("weight") * level >= cap
        left, weight, now = weighed.agg(
            F.sum(F.col("source_size") * share) - F.coalesce(F.sum(F.when(full, cap)), F.lit(0)),
            F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if weight is None or now == stopped:
            break
        level, stopped = left / weight, now
    return weighed.select("source", "source_size", "docs", F.least(cap.cast("double"), F.col("weight") * level).alias("target"))


def draw(*of) -> float:
    """A number in [0, 1) that depends on ``of`` alone."""
    return int.from_bytes(hashlib.blake2b(repr(of).encode(), digest_size=7).digest(), "big") / (1 << 56)


def direction(size: list[int]) -> tuple[float, ...] | None:
    """A way in which neither the number nor the words of the units change; None where there is none."""
    if len(size) == 3:
        a, b, c = size
        if a == b == c:
            return 1.0, -1.0, 0.0
        return float(c - b), float(a - c), float(b - a)
    return (1.0, -1.0) if len(size) == 2 and size[0] == size[1] else None


def move(rest: list[float], way: tuple[float, ...], chance: float) -> list[float]:
    """Along ``way`` or against it until a unit is at 0 or 1; each as likely as keeps every probability."""
    up = min(((1 - p) / w if w > 0 else p / -w) for p, w in zip(rest, way) if w)
    down = min((p / w if w > 0 else (1 - p) / -w) for p, w in zip(rest, way) if w)
    step = up if chance * (up + down) < down else -down
    return [0.0 if p < _EDGE else 1.0 if p > 1 - _EDGE else p for p in (p + step * w for p, w in zip(rest, way))]


def fly(units: list[tuple], seed: tuple) -> tuple[list[tuple], list[tuple]]:
    """(decided, left over) of units (id, size, copies, rest).

    The two largest units in flight trade with each other and a small one takes up their difference.  With
    neighbours in size the large ones are decided early; a lone large unit among small ones would hardly move.
    """
    units = sorted(units, key=lambda u: (-u[1], u[0] is None, u[0] or 0, u[3]))
    i, j, step, out, held = 0, len(units) - 1, 0, [], [None] * 3
    while True:
        for k in range(3):
            if held[k] is None and i <= j:
                held[k] = units[j if k == 2 else i]
                i, j = (i, j - 1) if k == 2 else (i + 1, j)
        at = [k for k in range(3) if held[k] is not None]
        way = direction([held[k][1] for k in at])
        if way is None:
            return out, [held[k] for k in at]
        step += 1
        for k, p in zip(at, move([held[k][3] for k in at], way, draw(*seed, step))):
            unit, size, copies, _ = held[k]
            if p in (0.0, 1.0):
                out.append((unit, size, copies + int(p), 0.0))
            held[k] = None if p in (0.0, 1.0) else (unit, size, copies, p)


def land(units: list[tuple]) -> list[tuple]:
    """Decides the last units: nearest to their expected words, then to their expected number."""
    words, number = sum(u[1] * u[3] for u in units), sum(u[3] for u in units)
    ways = [[k >> i & 1 for i in range(len(units))] for k in range(1 << len(units))]
    best = min(ways, key=lambda w: (abs(sum(u[1] * x for u, x in zip(units, w)) - words), abs(sum(w) - number), w))
    return [(i, s, c + x, 0.0) for (i, s, c, _), x in zip(units, best)]


def _fly(seed: int, turn: int):
    """Rows (source, chunk, chunks, id, size, copies, rest), sorted -> decided units and those left over."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, part = None, [], 0

        def frame(rows: list[tuple]) -> pd.DataFrame:
            cols = list(zip(*rows)) if rows else [[]] * 6
            return pd.DataFrame({"id": pd.array(list(cols[0]), "Int64"), "size": np.array(cols[1], np.int64), "source": pd.Series(list(cols[4]), dtype=object),
                                 "copies": np.array(cols[2], np.int32), "rest": np.array(cols[3], np.float64), "left": np.array(cols[5], bool)})

        def flown(last: bool) -> list[tuple]:
            nonlocal held, part
            done, held = fly(held, (seed, turn, now[0], now[1], part))
            part += 1
            if last and now[2] == 1:  # the source's only chunk: nothing left to fly with
                done, held = done + land(held), []
            return [(*u, now[0], False) for u in done] + ([(*u, now[0], True) for u in held] if last else [])

        for b in batches:
            out = []
            ids = [None if pd.isna(i) else int(i) for i in b["id"]]
            sources = [None if pd.isna(s) else s for s in b["source"]]
            for i, key, size, copies, rest in zip(ids, zip(sources, b["chunk"].tolist(), b["chunks"].tolist()), b["size"].tolist(), b["copies"].tolist(), b["rest"].tolist()):
                if key != now or len(held) >= 4 * CHUNK:
                    if now is not None:
                        out += flown(key != now)
                    if key != now:
                        now, held, part = key, [], 0
                held.append((i, size, copies, rest))
            yield frame(out)
        yield frame(flown(True) if now is not None else [])
    return run


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, seed: int = 20) -> DataFrame:
    """(id, source, size, source_size, target, taken) of ``docs`` (id, text, source); taken = size * copies in the mix."""
    units = written(sizes(docs.select("id", "text", "source")), "sizes")
    goal = written(targets(units, weights, share, most), "targets")
    same = units["source"].eqNullSafe(goal["source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # Rates that are whole but for rounding are whole.
    rate = F.when(F.abs(rate - F.round(rate)) < _EDGE, F.round(rate)).otherwise(rate)
    copies = F.floor(rate).cast("int")
    whole = units.join(goal, same).select("id", "size", units["source"], copies.alias("copies"), (rate - copies).alias("rest"),
                                          F.ceil(F.col("docs") / CHUNK).cast("long").alias("chunks"))
    schema = [c.split()[0] for c in _UNIT.split(", ")]
    done = [whole.where("rest = 0").withColumn("left", F.lit(False)).select(*schema)]
    left, turn = whole.where("rest > 0"), 0
    while True:
        salted = left.withColumn("chunk", F.pmod(F.xxhash64(F.lit(seed + turn), "id", "size"), "chunks"))
        flown = written(salted.repartition("source", "chunk").sortWithinPartitions("source", "chunk", "id", "size", "rest")
                        .select("source", "chunk", "chunks", "id", "size", "copies", "rest").mapInPandas(_fly(seed, turn), _UNIT), "flown")
        done.append(flown.where("not left").select(*schema))
        over = flown.where("left")
        if over.isEmpty():
            break
        per = over.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("long").alias("chunks")).withColumnRenamed("source", "of")
        left, turn = over.join(per, over["source"].eqNullSafe(per["of"])).drop("of", "left"), turn + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.join(goal.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select(
        "id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
