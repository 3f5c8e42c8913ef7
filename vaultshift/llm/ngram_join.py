"""Jaccard self-join on word n-grams by T-occurrence search.

Documents with at least ``100 * |A & B| >= PERCENT * |A | B|`` of their word
shingles in common are linked; the result names each document's component.

1. Equal shingle sets become one node.
2. Any order of shingles in which two linked sets are sorted alike puts ``k`` common
   shingles among the first ``n - ceil(PERCENT n / 100) + k`` of each.  The order is by
   hash, but shingles that many sets begin with (a bounded list) come last.  Beginnings
   that no other set has are dropped, at first by a Bloom filter of bounded size: it holds
   what two sets begin with by hash, and all that any set begins with only by the final order.
3. The rest is an inverted index.  Per shingle and size band every node is searched
   from a leader; found links are contracted to components.
4. Nodes of other components that share enough beginnings are still to be searched.
   Where few nodes have a shingle these are pairs.  Nodes with enough shingles that
   many have form families, cut into blocks of nodes of like size, and blocks are searched from blocks:
   each from itself, then from the next, then from all, with contraction between.  Blocks that have become one component
   are not searched, and a search joins components as it goes, so a family of copies gives links in
   proportion to its nodes.

A search is a T-occurrence query (DivideSkip): the inverted lists, over a block of
candidate sets, of the query's shingles; the short lists are merged on a heap that skips,
the long ones are probed by binary search, and documents that reach the required
overlap are links.  No step lists the pairs within a group of copies, and no
group goes to one task whole: leaders are aggregates, and candidates come in blocks.

Defined cases: null and empty texts have no shingles and are linked with
nothing; rows without an id get their number of shingles and no component; rows
of equal ids are one document per text, and share the id in the result.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultshift.llm import words as W
from vaultshift.llm.common import frugal, partitions, small_batches
from vaultshift.llm.components import components
from vaultshift.session import written

SIZE, PERCENT = 4, 85
#: Shingles that come last in the order, at most; bits of the Bloom filter; candidates that a task holds at once.
MOST_COMMON, BLOOM_BITS, BLOCK = 1 << 19, 26, 256
#: Nodes of a key beyond which it is met in blocks of that many; ratio of sizes within a band of blocks.
HOT, BAND = 128, 0.95
#: Weight of a binary probe against a step of the merge (the published choice).
MU = 0.0085


def shingle_sets(texts: pa.Array, size: int = SIZE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; of fewer words than ``size`` the whole sequence."""
    hashed, at = W.words(texts, W.NONSPACE)
    out = []
    rolled = np.zeros(max(0, len(hashed) - size + 1), np.uint64)
    for k in range(size):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashed[k: k + len(rolled)]
    rolled = W.mix(rolled)
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= size:
            out.append(np.unique(rolled[a: b - size + 1]))
        elif b > a:
            whole = hashlib.blake2b(hashed[a:b].tobytes(), digest_size=8, salt=b"short").digest()
            out.append(np.frombuffer(whole, np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def needed(n: int, percent: int) -> int:
    """Least overlap that a set of n can be linked with."""
    return -(-percent * n // 100)


def together(n):
    """Number of shingles that a set of n shares with a linked one at their beginnings; of a pair, the smaller size counts."""
    return 1 + n // 16


def node_of(own: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def in_order(own: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the set in the global order, the place of each of its shingles by hash)."""
    if not len(common):
        return own, np.arange(len(own))
    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
    last = common[at] == own
    order = np.concatenate((np.flatnonzero(~last), np.flatnonzero(last)))
    return own[order], order


def bloom_places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bit positions of each key."""
    shift = np.uint64(64 - BLOOM_BITS)
    return keys * np.uint64(0xC2B2AE3D27D4EB4F) >> shift, keys * np.uint64(0x165667B19E3779F9) >> shift


def divide_skip(lists: list[list[int]], least: int) -> dict[int, int]:
    """{id: number of ``lists`` that hold it} for all ids in at least ``least`` (>= 1) of the sorted lists."""
    lists = sorted((x for x in lists if x), key=len)
    if len(lists) < least:
        return {}
    longest = len(lists[-1])
    n_long = min(int(least / (MU * np.log2(longest + 1) + 1)), least - 1)
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long:]
    enough = least - n_long
    heads = [(x[0], i, 0) for i, x in enumerate(short)]
    heapq.heapify(heads)
    out: dict[int, int] = {}
    while len(heads) >= enough:
        now, hit = heads[0][0], []
        while heads and heads[0][0] == now:
            hit.append(heapq.heappop(heads))
        if len(hit) >= enough:
            total, left = len(hit), n_long
            for x in long:
                at = bisect_left(x, now)
                total += at < len(x) and x[at] == now
                left -= 1
                if total + left < least:
                    break
            else:
                out[now] = total
            for _, i, at in hit:
                if at + 1 < len(short[i]):
                    heapq.heappush(heads, (short[i][at + 1], i, at + 1))
            continue
        # Nothing before the head that leaves ``enough`` lists at or before it can be in so many: skip there.
        while heads and len(hit) < enough - 1:
            hit.append(heapq.heappop(heads))
        if not heads:
            break
        to = heads[0][0]
        for _, i, at in hit:
            at = bisect_left(short[i], to, at)
            if at < len(short[i]):
                heapq.heappush(heads, (short[i][at], i, at))
    return out


class Lists:
    """Inverted lists of a block of sets: for each shingle, the numbers of the sets that have it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        keys = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def search(self, query: np.ndarray, percent: int, among: np.ndarray | None = None) -> list[int]:
        """Numbers of the sets (``among`` some of them) that are linked with ``query``."""
        n = len(query)
        least = -(-percent * (n + self.sizes) // (100 + percent))
        able = (least <= n) & (least <= self.sizes)
        if among is not None:
            able &= among
        if not able.any():
            return []
        start, stop = np.searchsorted(self.keys, query), np.searchsorted(self.keys, query, "right")
        some = np.flatnonzero(start < stop)
        owners, whole = self.owners, bool(able.all())
        lists = []
        for i in some:
            x = owners[start[i]: stop[i]]
            lists.append((x if whole else x[able[x]]).tolist())
        found = divide_skip(lists, max(1, int(least[able].min())))
        return [k for k, o in found.items() if 100 * o >= percent * (n + int(self.sizes[k]) - o)]


def search(query: np.ndarray, sets: list[np.ndarray], percent: int) -> list[int]:
    """Numbers of the ``sets`` that are linked with ``query``."""
    return Lists(sets).search(query, percent)


def _nodes(docs: DataFrame, size: int) -> DataFrame:
    """(id, n, node) of every row; node is null where there is nothing to link."""
    def run(batches):
        for b in batches:
            sets = shingle_sets(b.column(1), size)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())], ["id", "n", "node"])

    return docs.mapInArrow(frugal(run), f"id {docs.schema[0].dataType.simpleString()}, n bigint, node bigint")


def _beginnings(docs: DataFrame, size: int, percent: int, common=None, bloom=None, entered: bool = False) -> DataFrame:
    """(key, node, n) of the shingles that each set begins with; equal sets once a task.

    ``entered``: only those that it doesn't begin with by hash.
    """
    def run(batches):
        last = common.value if common else np.zeros(0, np.uint64)
        filled = bloom.value if bloom else None
        seen: set[int] = set()
        for b in batches:
            keys, nodes, ns = [], [], []
            for own, known in zip(shingle_sets(b.column(1), size), b.column(0).is_valid().to_pylist()):
                if not len(own) or not known:
                    continue
                node = node_of(own)
                if node in seen:
                    continue
                if len(seen) < 1 << 18:  # a memory of a task; what it forgets is only told twice
                    seen.add(node)
                n_first = min(len(own), len(own) - needed(len(own), percent) + together(len(own)))
                first, order = in_order(own, last)
                first = first[:n_first]
                if entered:
                    first = first[order[:n_first] >= n_first]
                if filled is not None:
                    x, y = bloom_places(first)
                    shared = (filled[x >> np.uint64(6)] >> (x & np.uint64(63)) & filled[y >> np.uint64(6)] >> (y & np.uint64(63)) & np.uint64(1)) > 0
                    first = first[shared]
                keys.append(first)
                nodes.append(np.full(len(first), node, np.int64))
                ns.append(np.full(len(first), len(own), np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (keys, nodes, ns)], ["key", "node", "n"])

    return docs.mapInArrow(frugal(run), "key bigint, node bigint, n bigint")


def _index(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The inverted index (key, node, n) of beginnings that two nodes or more share, of nodes with enough of them."""
    spark = docs.sparkSession
    counts = written(_beginnings(docs, size, percent).groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "counts")
    total = counts.agg(F.sum("c")).first()[0] or 0
    # At most MOST_COMMON keys can be counted so often.
    often = max(64, -(-total // MOST_COMMON))
    common = np.sort(counts.where(F.col("c") >= often).select("key").toArrow()["key"].to_numpy().view(np.uint64))

    def bits(batches):
        for b in batches:
            at = np.concatenate(bloom_places(b.column(0).to_numpy().view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64))], ["p"])

    # Counts are by hash order.  What begins a set only since the common ones come last may be counted once, or never.
    moved = spark.sparkContext.broadcast(common)
    known = counts.select("key")
    if len(common):
        known = known.unionByName(_beginnings(docs, size, percent, moved, entered=True).select("key"))
    places = known.mapInArrow(bits, "p bigint")
    filled = places.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    bloom = np.zeros(1 << (BLOOM_BITS - 6), np.uint64)
    bloom[filled["word"].to_numpy()] = filled["bits"].to_numpy().view(np.uint64)
    told = _beginnings(docs, size, percent, moved, spark.sparkContext.broadcast(bloom))
    told = written(told.groupBy("key", "node").agg(F.min("n").alias("n")), "beginnings")
    shared = told.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    indexed = told.join(shared, "key")
    able = told.join(shared, "key").groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("m")).where(F.col("c") >= F.floor(F.col("m") / 16) + 1)
    return written(indexed.join(able.select("node"), "node"), "index")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among candidate pairs (q, node): every q is a query against blocks of its candidates."""
    spark = pairs.sparkSession
    pairs = written(pairs.where("q <> node").distinct(), "pairs")
    size = pairs.groupBy("q").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = pairs.join(size, "q").withColumn("block", F.pmod(F.xxhash64("node", "q"), F.col("blocks")).cast("int"))
    member = placed.join(sets, "node").select("q", "block", F.lit(1).alias("kind"), "node", "own")
    query = size.select("q", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(
        sets.withColumnRenamed("node", "q"), "q").select("q", "block", F.lit(0).alias("kind"), F.col("q").alias("node"), "own")
    rows = query.unionByName(member).repartition(partitions(spark), "q", "block").sortWithinPartitions("q", "block", "kind")

    def run(batches):
        here, query_set, nodes, own = None, None, [], []

        def links() -> Iterator[tuple[int, int]]:
            if query_set is not None and nodes:
                for k in search(query_set, own, percent):
                    yield here[0], nodes[k]

        for b in batches:
            q, block, kind, node = (b.column(i).to_numpy() for i in range(4))
            sets_, out = b.column(4), []
            at = sets_.offsets.to_numpy()
            flat = sets_.values.to_numpy().view(np.uint64)
            for i in range(len(q)):
                if here != (q[i], block[i]):
                    out += links()
                    here, query_set, nodes, own = (q[i], block[i]), None, [], []
                values = flat[at[i]: at[i + 1]]
                if kind[i] == 0:
                    query_set = values.copy()
                else:
                    nodes.append(int(node[i]))
                    own.append(values.copy())
                if len(own) >= 4 * BLOCK:  # uneven blocks are searched piece by piece
                    out += links()
                    nodes, own = [], []
            if out:
                yield _pairs(out)
        out = list(links())
        if out:
            yield _pairs(out)

    return written(rows.mapInArrow(frugal(run), "a bigint, b bigint"), "found")


def _led(index: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs (q, node): per node one leader of another component, among the leaders of its keys and size band.

    Keys whose nodes are all in one component have no leader.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(-np.log(percent / 100))))
    rows = index.withColumn("band", band).join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lead = (rows.groupBy("key", "band").agg(F.min("node").alias("q"), F.min("component").alias("lo"), F.max("component").alias("hi"))
            .where("lo <> hi").select("key", "band", "q"))
    of = known.select(F.col("node").alias("q"), F.col("component").alias("q_component"))
    # Sizes of a band differ by less than the links' percentage, so the leader's share is bounded by the node's.
    enough = F.floor(F.col("n") * percent / 1600) + 1
    pairs = (rows.join(lead, ["key", "band"]).where("q <> node").groupBy("node", "component", "n", "q").agg(F.count(F.lit(1)).alias("shared"))
             .where(F.col("shared") >= enough).join(of, "q", "left").where(F.coalesce("q_component", "q") != F.col("component")))
    best = pairs.groupBy("node").agg(F.max("shared").alias("shared"))
    return pairs.join(best, ["node", "shared"]).groupBy("node").agg(F.min("q").alias("q")).select("q", "node")


def _often(index: DataFrame) -> DataFrame:
    """Keys that more than ``HOT`` nodes have: they are met in blocks, not in pairs."""
    return index.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT).select("key", F.lit(True).alias("hot"))


def _cold_pairs(index: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs (q, node) of different components that share a key of few nodes, and enough keys if all hot ones are shared."""
    marked = index.join(_often(index), "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    hot = marked.where("hot").groupBy("node").agg(F.count(F.lit(1)).alias("hots"))
    rows = (marked.where("not hot").join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
            .join(hot, "node", "left").withColumn("hots", F.coalesce("hots", F.lit(0))).select("key", "node", "n", "component", "hots"))
    mixed = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    rows = rows.join(mixed, "key")
    other = rows.select("key", F.col("node").alias("q"), F.col("n").alias("q_n"), F.col("component").alias("q_component"), F.col("hots").alias("q_hots"))
    return rows.join(other, "key").where(
        (F.col("component") != F.col("q_component")) & (F.col("n") * 100 >= F.col("q_n") * percent)
        & ((F.col("n") < F.col("q_n")) | ((F.col("n") == F.col("q_n")) & (F.col("node") < F.col("q"))))).groupBy("q", "node", "n").agg(
            (F.count(F.lit(1)) + F.least(F.min("hots"), F.min("q_hots"))).alias("shared")).where(
                F.col("shared") >= F.floor(F.col("n") / 16) + 1).select("q", "node")


def _families(index: DataFrame, known: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Families of nodes that share hot keys, in blocks of like size, and which blocks are searched from which.

    Returns members (node, family, band, block) and meetings (family, band, block, band_b, block_b, turn).  Turn 0
    is a block and itself, turn 1 a block and the next one of its size or the first one of another, turn 2 all others.
    """
    rows = index.join(_often(index), "key")
    enough = rows.groupBy("node", "n").agg(F.count(F.lit(1)).alias("hots")).where(F.col("hots") >= F.floor(F.col("n") / 16) + 1)
    rows = written(rows.join(enough.select("node"), "node").select("key", "node"), "hot")
    lead = rows.groupBy("key").agg(F.min("node").alias("lead"))
    family = components(rows.join(lead, "key").select(F.col("node").alias("a"), F.col("lead").alias("b")))
    band = F.floor(F.log(F.col("n").cast("double")) / float(-np.log(BAND)))
    member = (enough.join(family.withColumnRenamed("component", "family"), "node").join(known, "node", "left")
              .select("node", "family", band.alias("band"), F.coalesce("component", "node").alias("component")))
    open_ = member.groupBy("family").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("family")
    member = member.join(open_, "family")
    size = member.groupBy("family", "band").agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("blocks"))
    member = written(member.join(size, ["family", "band"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
                     .select("node", "family", "band", "block"), "members")
    # Blocks of bands that links can join; the bands of a link are at most REACH apart.
    reach = int(np.floor(np.log(percent / 100) / np.log(BAND))) + 1
    blocks = size.select("family", "band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    upper = blocks.select("family", F.col("band").alias("band_b"), F.col("block").alias("block_b"))
    against = blocks.withColumn("band_b", F.explode(F.sequence(F.col("band"), F.col("band") + reach))).join(upper, ["family", "band_b"]).where(
        (F.col("band_b") > F.col("band")) | (F.col("block_b") >= F.col("block")))
    like, gap = F.col("band_b") == F.col("band"), F.col("block_b") - F.col("block")
    turn = F.when(like & (gap == 0), 0).when((like & (gap == 1)) | (~like & (F.col("block") == 0) & (F.col("block_b") == 0)), 1).otherwise(2)
    return member, written(against.withColumn("turn", turn), "against")


def _hot_links(member: DataFrame, against: DataFrame, known: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that the meetings ``against`` find between nodes of different components.

    Blocks that are of one component with each other are not searched.  A meeting
    contracts as it goes, so it returns fewer links than its two blocks have components.
    """
    here = member.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of = here.groupBy("family", "band", "block").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    of_b = of.select("family", F.col("band").alias("band_b"), F.col("block").alias("block_b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    against = against.join(of, ["family", "band", "block"]).join(of_b, ["family", "band_b", "block_b"]).where(
        F.least("lo", "lo_b") != F.greatest("hi", "hi_b")).withColumn("task", F.xxhash64("family", "band", "block", "band_b", "block_b"))
    full = here.join(sets, "node")
    left = against.select("family", "band", "block", "task", F.lit(0).alias("kind"))
    right = against.select("family", F.col("band_b").alias("band"), F.col("block_b").alias("block"), "task", F.lit(1).alias("kind"))
    rows = (left.unionByName(right).join(full, ["family", "band", "block"]).select("task", "kind", "node", "component", "own")
            .repartition(partitions(member.sparkSession), "task").sortWithinPartitions("task", "kind"))

    def run(batches):
        here, sides = None, None

        def links() -> list[tuple[int, int]]:
            if here is None or not sides[1][0]:
                return []
            lists, nodes = Lists(sides[1][2]), np.array(sides[1][0])
            mine, theirs = np.array(sides[0][1]), np.array(sides[1][1])
            out = []
            for i, (q, own) in enumerate(zip(sides[0][0], sides[0][2])):
                for k in lists.search(own, percent, (theirs != mine[i]) & (nodes != q)):
                    if theirs[k] != mine[i]:
                        out.append((q, int(nodes[k])))
                        gone = theirs[k]
                        mine[mine == gone], theirs[theirs == gone] = mine[i], mine[i]
            return out

        for b in batches:
            task, kind, node, component = (b.column(i).to_numpy() for i in range(4))
            at, flat = b.column(4).offsets.to_numpy(), b.column(4).values.to_numpy().view(np.uint64)
            out: list[tuple[int, int]] = []
            for i in range(len(task)):
                if here != task[i]:
                    out += links()
                    here, sides = task[i], ([[], [], []], [[], [], []])
                side = sides[kind[i]]
                side[0].append(int(node[i]))
                side[1].append(int(component[i]))
                side[2].append(flat[at[i]: at[i + 1]].copy())
            if out:
                yield _pairs(out)
        if out := links():
            yield _pairs(out)

    return written(rows.mapInArrow(frugal(run), "a bigint, b bigint"), "found")


def _joined(known: DataFrame, links: DataFrame) -> DataFrame:
    """``known`` (node, component) after ``links``, which are contracted as links of components."""
    of = known.select(F.col("node").alias("a"), F.col("component").alias("x"))
    of_b = known.select(F.col("node").alias("b"), F.col("component").alias("y"))
    ends = links.join(of, "a", "left").join(of_b, "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    root = components(ends).select(F.col("node").alias("component"), F.col("component").alias("root"))
    new = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(known, "node", "left_anti")
    whole = known.unionByName(new.select("node", F.col("node").alias("component")))
    return written(whole.join(root, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "known")


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([int(x) for x, _ in out], pa.int64()), pa.array([int(y) for _, y in out], pa.int64())], ["a", "b"])


def ngram_components(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) of every row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    nodes = written(_nodes(own, size), "nodes")
    index = _index(own, size, percent)
    # The sets of indexed nodes, from one row of each.
    wanted = nodes.join(index.select("node").distinct(), "node").groupBy("node").agg(F.min("id").alias("id"))

    def run(batches):
        for b in batches:
            sets = shingle_sets(b.column(1), size)
            same = [i for i, (s, n) in enumerate(zip(sets, b.column(0).to_pylist())) if node_of(s) == n]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(same, pa.int64())), pa.array([sets[i].view(np.int64) for i in same], pa.list_(pa.int64()))], ["node", "own"])

    sets = own.join(wanted, "id").select("node", "text").mapInArrow(frugal(run), "node bigint, own array<bigint>").dropDuplicates(["node"])
    sets = written(sets, "sets")
    known = spark.createDataFrame([], "node bigint, component bigint")
    known = _joined(known, _verified(_led(index, known, percent), sets, percent))
    member, against = _families(index, known, percent)
    for turn in range(3):
        now = against.where(F.col("turn") == turn)
        if not now.isEmpty():
            known = _joined(known, _hot_links(member, now, known, sets, percent))
    known = _joined(known, _verified(_cold_pairs(index, known, percent), sets, percent))
    named = nodes.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = written(named.where("node is not null and id is not null").groupBy("component").agg(F.min("id").alias("component_id")), "named")
    alone = F.col("node").isNull()
    out = named.join(least, "component", "left")
    return out.select("id", F.col("n").alias("n_shingles"),
                      F.when(F.col("id").isNull(), F.lit(None)).when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
