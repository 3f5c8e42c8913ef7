"""Invertible Bloom lookup sketches of texts, compared by subtraction and peeling.

A text's paragraph units (lines, and sentences within them) have 64-bit digests.  Its
sketch has ``CELLS`` cells; every distinct digest is added to one cell in each
third of them: a count, the xor of digests, the xor of their check hashes.
Subtracting two sketches cell by cell leaves the digests that only one text has.
Peeling takes out the digest of every cell that holds just one (its count is 1 or
-1 and its check hash fits) and goes on with what then remains.  If cells are left
over, both sketches are built anew with ``GROWTH`` times the cells, until none are.

The likeness of two fingerprints is the Jaccard similarity of their units, from the
number of units that differ and the sizes of both.  DataFrame functions only.

Texts move once: to their neighbours by id, in ranges of ids.  Sketches, their
differences and the rounds of peeling are aggregates that stay in these ranges.

Defined cases: a null text is an empty one; empty texts have empty sketches, which are
alike by 1; rows without an id come last in the order; rows of equal id, or of none,
are ordered by the hash of their texts and stay in one range; a single row is its own next one.  Ids are numbers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultshift.llm.common import partitions
from vaultshift.session import shared_uri, written

CELLS, GROWTH = 48, 5
#: Rounds of peeling at the first size, where most differences are small or hopeless, and at larger ones.
ROUNDS = 5, 8
#: Ranges of ids in a partition: enough that partitions are even.
RANGES = 8
#: The end of a sentence or line.
UNIT_ENDS = r"(?<=[.!?])\s+|\n+"
_ROW = ["range", "row"]


def units(text: Column) -> Column:
    """Distinct 64-bit digests of a text's paragraph units."""
    return F.array_distinct(F.transform(F.filter(F.split(text, UNIT_ENDS), lambda x: x != ""), lambda x: F.xxhash64(x)))


def check(digest: Column) -> Column:
    return F.hash(digest)


def places(digest: Column, cells: Column) -> Column:
    """The cell of a digest in each third of the cells."""
    third = (cells / 3).cast("bigint")
    return F.array(*[F.pmod(F.xxhash64(digest, F.lit(i)), third) + third * i for i in range(3)])


def neighbours(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(range, row, id, text, next): each text with the next one by descending id; after the last comes the first.

    Ids are cut at quantiles into a few ranges per partition.  The first text of a range also goes,
    as a guest, to the end of the range before; so one shuffle of the texts brings neighbours together.
    """
    d = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    n = RANGES * partitions(docs.sparkSession)
    cuts = d.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 10_000).alias("p")).first()["p"] if n > 1 else None
    cuts = sorted(set(cuts or []))
    where = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("id"))) if cuts else F.lit(0)
    d = d.withColumn("range", where.cast("int"))
    # One id per range: bounded by the number of partitions, as are the guests.
    tops = {r["range"]: r["top"] for r in d.groupBy("range").agg(F.max("id").alias("top")).collect()}
    order = sorted(tops, reverse=True)
    guest_of = [(b, a) for a, b in zip(order, order[1:] + order[:1])]
    own = d.withColumn("guest", F.lit(False))
    for to in (b for a, b in guest_of if tops[a] is None):
        # A range of rows without ids: its first row is that of the least hash.
        ranked = d.where(F.col("id").isNull()).withColumn("hash", F.xxhash64("text"))
        first = ranked.agg(F.min("hash").alias("least"))
        own = own.unionByName(ranked.join(F.broadcast(first), F.col("hash") == F.col("least")).select(
            "id", "text", F.lit(to).alias("range"), F.lit(True).alias("guest")))
    guests = [(tops[a], b) for a, b in guest_of if tops[a] is not None]
    if guests:
        to = docs.sparkSession.createDataFrame(guests, f"id {d.schema['id'].dataType.simpleString()}, to int")
        own = own.unionByName(d.join(F.broadcast(to), "id").select("id", "text", F.col("to").alias("range"), F.lit(True).alias("guest")))
    line = Window.partitionBy("range").orderBy("guest", F.desc_nulls_last("id"), F.xxhash64("text"))
    own = own.repartition(partitions(docs.sparkSession), "range")
    placed = own.withColumn("units", units(F.col("text"))).select(
        "range", "id", "text", "guest", "units", F.row_number().over(line).alias("row"),
        F.lead("text").over(line).alias("next"), F.lead("units").over(line).alias("next_units"))
    return placed.where(~F.col("guest")).drop("guest")


def edited(text: Column, following: Column) -> Column:
    """The last third of the code points replaced by as many (or all) of the next text."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - third), F.substr(following, F.lit(1), third))


def _added(rows: DataFrame, sides: list[tuple[Column, Column]], cells: Column, keep: list[str]) -> DataFrame:
    """Sketch rows (range, row, *keep, cell) with count_i, keys_i, checks_i of each side; a side is (array, wanted)."""
    none = F.array().cast("array<bigint>")

    def told(i: int, digests: Column, wanted: Column) -> Column:
        return F.transform(F.when(wanted, F.coalesce(digests, none)).otherwise(none), lambda x: F.struct(F.lit(i).alias("side"), x.alias("digest")))

    parts = F.concat(*[told(i, *side) for i, side in enumerate(sides)])
    opened = rows.select(*_ROW, *keep, cells.alias("cells"), F.inline(parts)).select(
        *_ROW, *keep, "side", "digest", F.explode(places(F.col("digest"), F.col("cells"))).alias("cell"))
    sums = []
    for i in range(len(sides)):
        here = F.col("side") == i
        sums += [F.sum(F.when(here, 1).otherwise(0)).cast("bigint").alias(f"count_{i}"), F.bit_xor(F.when(here, F.col("digest")).otherwise(F.lit(0).cast("bigint"))).alias(f"keys_{i}"),
                 F.bit_xor(F.when(here, check(F.col("digest"))).otherwise(F.lit(0))).alias(f"checks_{i}")]
    return opened.groupBy(*_ROW, *keep, "cell").agg(*sums)


def peeled(cells: DataFrame, rounds: int) -> DataFrame:
    """(range, row, pair, found, left): digests recovered from each difference, and cells that remain.

    Cell -1 of a pair counts its recovered digests.
    """
    own = [*_ROW, "pair", "cells"]
    empty = (F.col("n") == 0) & (F.col("keys") == 0) & (F.col("checks") == 0)
    state = cells.where(~empty)
    zero, none = F.lit(0).cast("bigint"), F.lit(0)
    for _ in range(rounds):
        pure = (F.abs("n") == 1) & (F.col("cell") >= 0) & (F.col("checks") == check(F.col("keys")))
        cell = F.struct(F.lit(False).alias("is_key"), F.col("cell").cast("bigint").alias("k"), F.col("n").alias("n"), F.col("keys").alias("keys"), F.col("checks").alias("checks"))
        key = F.struct(F.lit(True).alias("is_key"), F.col("keys").alias("k"), F.col("n").alias("n"), zero.alias("keys"), none.alias("checks"))
        # A digest may be alone in several cells; it is taken out once.
        told = state.select(*own, F.inline(F.when(pure, F.array(cell, key)).otherwise(F.array(cell))))
        once = told.groupBy(*own, "is_key", "k").agg(F.max("n").alias("n"), F.max("keys").alias("keys"), F.max("checks").alias("checks"))
        out = F.transform(places(F.col("k"), F.col("cells")), lambda c: F.struct(
            c.alias("cell"), (-F.col("n")).alias("n"), F.col("k").alias("keys"), check(F.col("k")).alias("checks")))
        counted = F.array(F.struct(F.lit(-1).cast("bigint").alias("cell"), F.lit(1).cast("bigint").alias("n"), zero.alias("keys"), none.alias("checks")))
        itself = F.array(F.struct(F.col("k").alias("cell"), F.col("n").alias("n"), F.col("keys").alias("keys"), F.col("checks").alias("checks")))
        moved = once.select(*own, F.inline(F.when(F.col("is_key"), F.concat(out, counted)).otherwise(itself)))
        state = moved.groupBy(*own, "cell").agg(F.sum("n").alias("n"), F.bit_xor("keys").alias("keys"), F.bit_xor("checks").alias("checks")).where(~empty)
    return state.groupBy(*_ROW, "pair").agg(F.sum(F.when(F.col("cell") == -1, F.col("n")).otherwise(0)).alias("found"),
                                            F.sum(F.when(F.col("cell") >= 0, 1).otherwise(0)).alias("left"))


def _kept_in_ranges(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder in files that keep the ranges apart, so that reading it needs no shuffle.

    Buckets can only be read through the catalog; the entry is dropped once the frame has been resolved, the files stay.
    """
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex[:12]}"
    df.write.bucketBy(partitions(spark), "range").option("path", shared_uri(spark, label)).saveAsTable(name)
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def _cell_text(side: int) -> Column:
    """A cell as text: its number, count, digests and checks in hexadecimal; null for an empty cell."""
    parts = [F.lower(F.hex(F.col(c))) for c in ("cell", f"count_{side}", f"keys_{side}", f"checks_{side}")]
    return F.when(F.col(f"count_{side}") > 0, F.concat_ws(":", *parts))


def _sketch_text(cells: int, found: str) -> Column:
    """A sketch as text: the number of its cells, then those that aren't empty, in order."""
    rest = F.transform(F.array_sort(F.coalesce(F.col(found), F.array().cast("array<struct<cell:bigint,text:string>>"))), lambda x: x["text"])
    return F.concat_ws(",", F.lit(f"{cells:x}"), rest)


def compare(docs: DataFrame, text: str = "text", key: str = "doc_id", cells: int = CELLS) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # joins by (range, row) stay in the ranges
    pairs = neighbours(docs, text, key).withColumn("edited", edited(F.col("text"), F.col("next")))
    base = _kept_in_ranges(pairs.select(
        "range", "row", "id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.col("units").alias("own"), units(F.col("edited")).alias("changed"), F.col("next_units").alias("following")), "units")
    yes = F.lit(True)
    size, done = cells, None
    todo = base.select("range", "row", "own", "changed", "following", yes.alias("want_0"), yes.alias("want_1"))
    while True:
        wide = F.lit(size).cast("bigint")
        sketches = _added(todo, [(F.col("own"), yes), (F.col("changed"), F.col("want_0")), (F.col("following"), F.col("want_1"))], wide, ["want_0", "want_1"])
        # one pass over the sketches makes both differences
        both = F.array(*[F.struct(F.lit(p).alias("pair"), (F.col("count_0") - F.col(f"count_{p + 1}")).alias("n"),
                                  F.col("keys_0").bitwiseXOR(F.col(f"keys_{p + 1}")).alias("keys"),
                                  F.col("checks_0").bitwiseXOR(F.col(f"checks_{p + 1}")).alias("checks")) for p in (0, 1)])
        wanted = F.filter(both, lambda x: F.when(x["pair"] == 0, F.col("want_0")).otherwise(F.col("want_1")))
        differing = sketches.select(*_ROW, wide.alias("cells"), "cell", F.inline(wanted))
        result = written(peeled(differing, ROUNDS[size > cells]), "peeled")
        good = result.where("left = 0").select(*_ROW, "pair", "found")
        done = good if done is None else done.unionByName(good)
        failed = written(result.where("left > 0").groupBy(*_ROW).agg(F.max(F.col("pair") == 0).alias("want_0"), F.max(F.col("pair") == 1).alias("want_1")), "failed")
        if failed.isEmpty():
            break
        size *= GROWTH
        todo = base.join(failed, _ROW).select("range", "row", "own", "changed", "following", "want_0", "want_1")
    differ = _kept_in_ranges(done.groupBy(*_ROW).agg(F.max(F.when(F.col("pair") == 0, F.col("found"))).alias("d0"),
                                                     F.max(F.when(F.col("pair") == 1, F.col("found"))).alias("d1")), "differ")
    first = _added(base, [(F.col("own"), yes), (F.col("changed"), yes)], F.lit(cells).cast("bigint"), [])
    # An aggregate takes no null, so empty cells are left out.
    prints = first.select(*_ROW, "cell", *[_cell_text(i).alias(f"text_{i}") for i in (0, 1)]).groupBy(*_ROW).agg(*[
        F.collect_list(F.when(F.col(f"text_{i}").isNotNull(), F.struct("cell", F.col(f"text_{i}").alias("text")))).alias(f"found_{i}") for i in (0, 1)])

    def likeness(a: str, b: str, d: str) -> Column:
        total, apart = F.size(a) + F.size(b), F.coalesce(F.col(d), F.lit(0))
        return F.when(total + apart == 0, F.lit(1.0)).otherwise((total - apart) / (total + apart))

    return base.join(differ, _ROW, "left").join(prints, _ROW, "left").select(
        "id", "n_chars", "edited_sha256", _sketch_text(cells, "found_0").alias("fingerprint"), _sketch_text(cells, "found_1").alias("edited_fingerprint"),
        likeness("own", "changed", "d0").alias("near_edited"), likeness("own", "following", "d1").alias("near_next"))
