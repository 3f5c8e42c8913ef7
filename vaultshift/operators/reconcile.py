"""Reconciling two large tables by a tree of digests over key ranges.

Level 0 is the whole range of keys.  Per level every open range gets a digest of each side (count,
xor and exact sum of row hashes: one scan with partial aggregation, so a row per range is
shuffled), ranges whose digests agree are closed, and the others are opened into ``fan`` equal
parts.  Ranges of ``leaf`` rows at most, or of one key, are not opened further; only their rows are
compared one by one.  Equal tables move two digests; one changed row costs a chain of ranges.

Keys are one whole-number, date or timestamp column, whose least and greatest open key of a level go to the scan as a
filter, or any columns, which then count by a 62-bit hash.  Which ranges are open is a relation and is
met by an equi-join, whatever their number.  A key that a third of all rows have is one range of one
key: its rows are compared by an aggregate, not listed.

Cases: a null key is a range of its own (``lo`` and ``hi`` null); rows are a multiset; an empty side has ranges of
0 rows; both empty give one equal range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultshift.operators.clone import DIGEST_FIELDS, digest_columns, row_hash, row_hash2
from vaultshift.session import written

FAN, LEAF = 64, 256


def _number(df: DataFrame, keys: list[str], hashed: bool) -> Column:
    """The key as a whole number that keeps its order; of several or other columns, a hash."""
    kind = df.schema[keys[0]].dataType
    if not hashed and len(keys) == 1 and isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.col(f"`{keys[0]}`").cast("long")
    if not hashed and len(keys) == 1 and isinstance(kind, T.DateType):
        return F.unix_date(F.col(f"`{keys[0]}`")).cast("long")
    if not hashed and len(keys) == 1 and isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(f"`{keys[0]}`"))
    cols = [F.col(f"`{k}`") for k in keys]
    any_null = reduce(lambda a, b: a | b, [c.isNull() for c in cols])
    return F.when(~any_null, F.shiftrightunsigned(F.xxhash64(*cols), 2))


def _rows(orig: DataFrame, new: DataFrame, keys: list[str], hashed: bool) -> DataFrame:
    """(key, h1, h2, side) of all rows; side 0 is the original."""
    columns = orig.columns
    sides = [df.select(_number(df, keys, hashed).alias("key"), row_hash(df, columns).alias("h1"), row_hash2(df, columns).alias("h2"), F.lit(s).alias("side"))
             for s, df in enumerate((orig, new.select(*[f"`{c}`" for c in columns])))]
    return sides[0].unionByName(sides[1])


def _digests(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per ``by``: rows of each side, and whether the digests differ."""
    per = rows.groupBy(*by, "side").agg(*digest_columns(F.col("h1")))
    one = F.struct(*DIGEST_FIELDS)
    both = per.groupBy(*by).agg(F.max(F.when(F.col("side") == 0, one)).alias("o"), F.max(F.when(F.col("side") == 1, one)).alias("n"))
    return both.select(*by, F.coalesce("o.rows", F.lit(0)).cast("long").alias("rows_original"), F.coalesce("n.rows", F.lit(0)).cast("long").alias("rows_new"),
                       (~F.col("o").eqNullSafe(F.col("n"))).alias("differs"))


def _start(low: int, width: int) -> Column:
    return F.expr(f"{low}L + ((key - {low}L) div {width}L) * {width}L")


def row_diff_ranges(orig: DataFrame, new: DataFrame, keys: list[str], fan: int = FAN, leaf: int = LEAF) -> DataFrame:
    """(level, lo, hi, rows_original, rows_new, differs, removed, added) of all ranges that the search looked at.

    ``hi`` is included.  ``removed`` and ``added`` count the rows that only one side has, in differing ranges that
    were not opened further; elsewhere they are null.  Ranges without a row on either side are left out.
    """
    rows = _rows(orig, new, keys, False)
    low, high = rows.agg(F.min("key"), F.max("key")).first()
    if low is not None and high - low >= 1 << 62:  # too far apart for differences of 64 bits
        rows = _rows(orig, new, keys, True)
        low, high = rows.agg(F.min("key"), F.max("key")).first()
    columns = ["level", "lo", "hi", "rows_original", "rows_new", "differs"]
    whole = [F.when(F.col("key").isNotNull(), F.lit(x).cast("long")).alias(c) for x, c in ((low, "lo"), (high, "hi"))]
    levels = [written(_digests(rows.select("*", *whole), ["lo", "hi"]).withColumn("level", F.lit(0)).select(*columns), "ranges")]
    big = F.greatest("rows_original", "rows_new") > leaf
    # Widths are powers of the fan, so every range is a part of one range of the level before.
    width, counts = 1, []
    while low is not None and width < high - low + 1:
        width *= fan
    while True:
        last = levels[-1].where("differs")
        closed = last.where(F.col("lo").isNull() | ~big if width > 1 else F.lit(True))
        own = F.lit(None).cast("long") if low is None else F.when(F.col("key").isNotNull(), _start(low, width))
        ends = closed.agg(F.min("lo"), F.max("lo"), F.count(F.lit(1)), F.count_if(F.col("lo").isNull())).first()
        if ends[2]:
            near = F.col("key").between(ends[0], ends[1] + width - 1) if ends[0] is not None else F.lit(False)
            inside = rows.where(near | F.col("key").isNull() if ends[3] else near).withColumn("lo", own)
            inside = inside.join(closed.select(F.col("lo").alias("of")), F.col("lo").eqNullSafe(F.col("of")), "left_semi")
            one = inside.groupBy("lo", "key", "h1", "h2").agg(F.sum(F.when(F.col("side") == 0, 1).otherwise(-1)).alias("d")).where("d <> 0")
            counts.append(one.groupBy("lo").agg(F.sum(F.when(F.col("d") > 0, F.col("d")).otherwise(0)).cast("long").alias("removed"),
                                                F.sum(F.when(F.col("d") < 0, -F.col("d")).otherwise(0)).cast("long").alias("added"))
                          .withColumn("level", F.lit(len(levels) - 1)))
        open_ = last.where(F.col("lo").isNotNull() & big)
        least, greatest = open_.agg(F.min("lo"), F.max("lo")).first() if width > 1 else (None, None)
        if least is None:
            break
        # The least and greatest open key are a filter of the scan; which ranges between are open, an equi-join.
        inside = rows.where(F.col("key").between(least, greatest + width - 1)).withColumn("up", own)
        inside = inside.join(open_.select(F.col("lo").alias("up")), "up", "left_semi")
        width //= fan
        cut = inside.withColumn("lo", _start(low, width)).withColumn("hi", F.least(F.col("lo") + (width - 1), F.lit(high)))
        levels.append(written(_digests(cut, ["lo", "hi"]).withColumn("level", F.lit(len(levels))).select(*columns), "ranges"))
    out = reduce(DataFrame.unionByName, levels)
    if not counts:
        return out.withColumns({c: F.lit(None).cast("long") for c in ("removed", "added")})
    found = reduce(DataFrame.unionByName, counts).withColumnsRenamed({"lo": "of", "level": "at"})
    return out.join(found, F.col("lo").eqNullSafe(F.col("of")) & (F.col("level") == F.col("at")), "left").select(*columns, "removed", "added")
