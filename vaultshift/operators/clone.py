"""Full copy of tables with order-free digests of both sides.

A clone is one scan of the source and one write, with no shuffle.  The
source digest is taken during that same scan (``DataFrame.observe``), so the
source is read once; the copy is read back once for its digest.  Digest =
(count, bit_xor of row hashes, exact sum of row hashes): it does not depend
on row order or partitioning, and xor and sum together do not cancel on
duplicate rows.

Several tables are copied at once from a small driver thread pool; each is
an independent Spark job, so a failing table is logged and the others go on.
"""

from __future__ import annotations

import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _normal(c: Column, dt: T.DataType) -> Column:
    """Value with one encoding per logical value (-0.0 -> 0.0, one NaN,
    maps as key-sorted entry arrays)."""
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        zero = F.lit(0.0).cast(dt)
        return F.when(F.isnan(c), F.lit(float("nan")).cast(dt)).when(c == zero, zero).otherwise(c)
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda x: _normal(x, dt.elementType))
    if isinstance(dt, T.MapType):
        entries = F.array_sort(F.map_entries(c))
        sub = T.StructType([T.StructField("key", dt.keyType), T.StructField("value", dt.valueType)])
        return F.transform(entries, lambda e: _normal(e, sub))
    if isinstance(dt, T.StructType):
        if not dt.fields:
            return c
        return F.struct(*[_normal(c[f.name], f.dataType).alias(f.name) for f in dt.fields])
    return c


def _parts(df: DataFrame, columns: list[str] | None = None) -> list[Column]:
    fields = df.schema.fields if columns is None else [df.schema[c] for c in columns]
    return [F.xxhash64(F.lit(i), _normal(F.col(f"`{f.name}`"), f.dataType)) for i, f in enumerate(fields)]


def row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """64-bit hash of a whole row (or of ``columns``); a null in column i
    hashes differently from a null in column j."""
    parts = _parts(df, columns)
    return F.xxhash64(*parts) if parts else F.lit(0).cast("bigint")


def row_hash2(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A second 32-bit hash (Murmur3) of the normalised values themselves, so that it shares no
    intermediate value with ``row_hash``; a column's number stands before its value, as nulls are skipped."""
    fields = df.schema.fields if columns is None else [df.schema[c] for c in columns]
    parts = [x for i, f in enumerate(fields) for x in (F.lit(i), _normal(F.col(f"`{f.name}`"), f.dataType))]
    return F.hash(*parts) if parts else F.lit(0)


DIGEST_FIELDS = ("rows", "xor", "s0", "s1", "s2", "s3")


def digest_columns(h: Column) -> list[Column]:
    """count, bit_xor and the exact sum of the hashes, kept as four sums of
    16-bit quarters in plain longs (exact up to 2^47 rows; no decimal
    arithmetic per row, no overflow in ANSI mode)."""
    quarters = [F.shiftrightunsigned(h, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    zero = F.lit(0).cast("bigint")
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor(h), zero).alias("xor")] + [
        F.coalesce(F.sum(q), zero).alias(f"s{i}") for i, q in enumerate(quarters)]


def digest(df: DataFrame) -> DataFrame:
    """One-row digest of a DataFrame (one scan, partial aggregation)."""
    return df.select(row_hash(df).alias("_h")).agg(*digest_columns(F.col("_h")))


def digest_value(df: DataFrame) -> tuple:
    r = digest(df).first()
    return tuple(r[k] for k in DIGEST_FIELDS)


@dataclass
class CloneResult:
    table_name: str
    target: str
    rows_source: int | None = None
    rows_target: int | None = None
    digest_source: tuple | None = None
    digest_target: tuple | None = None
    clone_seconds: float = 0.0
    seconds: float = 0.0
    status: str = "FAILED"
    message: str = ""
    extra: dict = field(default_factory=dict)


def clone_one(spark: SparkSession, name: str, source: DataFrame, target: str,
              partition_by: list[str] | None = None, max_records_per_file: int = 5_000_000) -> CloneResult:
    """Copy ``source`` (one snapshot: its file list is fixed when it was read)
    to ``target``; compare digests of both sides.

    The copy is written to an attempt folder of its own beside ``target`` and
    moved there once both digests agree.  A failed attempt leaves nothing at
    ``target``, so it can be repeated; a target that exists is never touched.
    """
    res = CloneResult(table_name=name, target=target)
    t0 = time.time()
    try:
        attempt = f"{target.rstrip('/')}.attempt-{uuid.uuid4().hex[:12]}"
        fs, path = _hadoop_fs(spark, target)
        if fs.exists(path(target)):
            raise FileExistsError(f"{target} exists")
        obs = Observation(f"src_{name}_{int(t0 * 1000)}")
        own = f"_hash_{uuid.uuid4().hex}"  # no column of the table
        observed = source.select("*", row_hash(source).alias(own)).observe(obs, *digest_columns(F.col(own)))
        writer = observed.drop(own).write.mode("errorifexists").option("maxRecordsPerFile", max_records_per_file)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(attempt)
        res.clone_seconds = time.time() - t0
        m = obs.get
        res.digest_source = tuple(m[k] for k in DIGEST_FIELDS)
        res.rows_source = m["rows"]
        copy = spark.read.schema(source.schema).parquet(attempt).select(*[f"`{c}`" for c in source.columns])
        res.digest_target = digest_value(copy)
        res.rows_target = res.digest_target[0]
        res.status = "SUCCESS" if res.digest_source == res.digest_target else "FAILED"
        if res.status == "SUCCESS" and not fs.rename(path(attempt), path(target)):
            raise OSError(f"{attempt} could not be moved to {target}")
        if res.status != "SUCCESS":
            fs.delete(path(attempt), True)
        res.message = (f"clone={res.clone_seconds:.1f}s rows={res.rows_target} "
                       f"digest={'equal' if res.status == 'SUCCESS' else 'different'}")
    except Exception as e:  # noqa: BLE001 - one failing table must not stop the others
        res.status = "FAILED"
        res.message = str(e)
    res.seconds = time.time() - t0
    return res


def _hadoop_fs(spark: SparkSession, target: str):
    """The Hadoop file system of ``target`` and a maker of its paths."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return jvm.org.apache.hadoop.fs.Path(target).getFileSystem(conf), jvm.org.apache.hadoop.fs.Path


def clone_tables(spark: SparkSession, sources: dict[str, DataFrame], target_root: str, parallel: int = 8,
                 partition_by: dict[str, list[str]] | None = None) -> list[CloneResult]:
    """Copy many tables, ``parallel`` Spark jobs in flight at once."""
    partition_by = partition_by or {}
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        futures = [
            pool.submit(clone_one, spark, name, df, f"{target_root}/{name}", partition_by.get(name))
            for name, df in sources.items()
        ]
        return [f.result() for f in futures]


CLONE_REPORT_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("rows", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("duration_seconds", T.DoubleType()),
])


def clone_report(spark: SparkSession, results: list[CloneResult]) -> DataFrame:
    """One row per copied table (small: one row per object, not per data row)."""
    rows = [(r.table_name, r.rows_target, r.status, r.message, float(r.seconds)) for r in results]
    return spark.createDataFrame(rows, CLONE_REPORT_SCHEMA)
