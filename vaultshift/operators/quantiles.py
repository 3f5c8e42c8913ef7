"""Exact percentiles per group, without a sort of any group.

The q-percentile of n values is the one of rank ceil(q n), at least 1, from below (as SQL's discrete percentile).
Per round each wanted rank keeps a range of values that holds it: the rows in it are counted in
``BUCKETS`` parts of the range, with the least and greatest value of each part (partial aggregation, so a
group that holds most rows is a few rows per task), and the part with the rank becomes the next range.
A range of one value is the answer.  Odd rounds part the range evenly, even rounds by the logarithm, so
values of very different size don't take many rounds.  Every round leaves out at least
one end of a range, and a range of ``FEW`` rows or fewer is counted value by value.

Cases: null and NaN values count nowhere; a group without values has null; infinite values are values; ties are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vaultshift.session import written

BUCKETS, FEW, HUGE = 1024, 4096, 1e300


def exact_percentiles(df: DataFrame, groups: list[str], value: str, qs: list[float]) -> DataFrame:
    """``groups``, q, n, value of each q of ``qs`` per group."""
    v = F.col(f"`{value}`").cast("double")
    rows = df.select(*groups, v.alias("v")).where("v is not null and not isnan(v)")
    per = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    rank = F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n"))).cast("long")
    state = written(per.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs]))).withColumn("rank", rank)
                    .withColumn("inside", F.col("n")), "ranks")
    same = [rows[g].eqNullSafe(F.col(f"of_{i}")) for i, g in enumerate(groups)]
    keys = [*groups, "q"]
    found, turn = [], 0
    # Values stand within +-HUGE for the parting only, so that differences are finite.
    hold = lambda c: F.greatest(F.lit(-HUGE), F.least(F.lit(HUGE), c))
    flat = lambda c: F.signum(c) * F.log1p(F.abs(c))
    while True:
        found.append(state.where("lo = hi").select(*groups, "n", "q", F.col("lo").alias("value")))
        open_ = state.where("lo < hi")
        if open_.isEmpty():
            break
        ranges = open_.withColumnsRenamed({g: f"of_{i}" for i, g in enumerate(groups)})
        meets = reduce(lambda a, b: a & b, same, F.lit(True))
        inside = rows.join(ranges, meets & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        as_is = hold if turn % 2 == 0 else lambda c: flat(hold(c))
        span = as_is(F.col("hi")) - as_is(F.col("lo"))
        part = F.when(span > 0, F.least(F.floor((as_is(F.col("v")) - as_is(F.col("lo"))) / span * BUCKETS), F.lit(BUCKETS - 1))).otherwise(
            F.when(F.col("v") > F.col("lo"), BUCKETS).otherwise(0))
        # Few rows: each value is a part.  The least value is always a part of its own side: it can only be left out or be the answer.
        part = F.when(F.col("v") == F.col("lo"), F.lit(-1)).otherwise(part)
        cell = F.when(F.col("inside") <= FEW, F.col("v"))
        counted = inside.groupBy(*groups, "q", "n", "rank", part.cast("int").alias("part"), cell.alias("cell")).agg(
            F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        # Parts of one rank: BUCKETS or FEW rows, in order.
        w = Window.partitionBy(*keys).orderBy("lo")
        upto = counted.withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        state = written(upto.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("c") < F.col("rank"))).select(
            *groups, "n", "lo", "hi", "q", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"), F.col("c").alias("inside")), "ranks")
        turn += 1
    out = reduce(DataFrame.unionByName, found)
    empty = df.select(*groups).distinct().withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    on = reduce(lambda a, b: a & b, [empty[g].eqNullSafe(out[g]) for g in groups], empty["q"] == out["q"])
    return empty.join(out, on, "left").select(*[empty[g] for g in groups], empty["q"], F.coalesce(out["n"], F.lit(0)).alias("n"), out["value"])
