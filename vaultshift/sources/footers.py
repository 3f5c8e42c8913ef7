"""Schemas of Parquet files, read from their footers in tasks.

``footers`` opens each file of a listing once, reads its footer alone and gives a row per column, nested
ones included: path, type, nullability and statistics.  What a table's columns are, and
files whose columns differ from the rest, follow by aggregates over these rows; the driver holds neither
files nor columns.  The type is the one that Spark wrote down in the file, else the one of the
Parquet types.

Cases: an unreadable file is a row with an error and no column; a file without row groups has its columns, with 0 rows;
statistics that a file lacks are null, those of nested columns add up over their leaves only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultshift.operators import files as fl
from vaultshift.session import written

FOOTERS = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("rows", T.LongType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("position", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("data_type", T.StringType()),
    T.StructField("nullable", T.BooleanType()),
    T.StructField("comment", T.StringType()),
    T.StructField("nulls", T.LongType()),
    T.StructField("least", T.StringType()),
    T.StructField("greatest", T.StringType()),
    T.StructField("error", T.StringType()),
])
SPARK_SCHEMA = b"org.apache.spark.sql.parquet.row.metadata"


def walk(fields: list[T.StructField], above: str = "", depth: int = 0) -> Iterator[tuple[str, int, int, T.StructField]]:
    """(dotted name, place among its siblings, depth, field) of all fields, parents first; elements, keys and values have these names."""
    for i, f in enumerate(fields, 1):
        name = f"{above}.{f.name}" if above else f.name
        yield name, i, depth, f
        kind = f.dataType
        if isinstance(kind, T.StructType):
            yield from walk(kind.fields, name, depth + 1)
        elif isinstance(kind, T.ArrayType):
            yield from walk([T.StructField("element", kind.elementType, kind.containsNull)], name, depth + 1)
        elif isinstance(kind, T.MapType):
            yield from walk([T.StructField("key", kind.keyType, False), T.StructField("value", kind.valueType, kind.valueContainsNull)], name, depth + 1)


def spark_schema(meta) -> T.StructType:
    """The schema of a file's footer."""
    from pyspark.sql.pandas.types import from_arrow_schema

    own = (meta.metadata or {}).get(SPARK_SCHEMA)
    return T.StructType.fromJson(json.loads(own)) if own else from_arrow_schema(meta.schema.to_arrow_schema())


def _leaf(path: str) -> str:
    """A leaf's dotted name as ``walk`` says it, without the groups that Parquet puts around elements and entries."""
    return path.replace(".list.element", ".element").replace(".key_value.", ".").replace(".bag.array_element", ".element")


def _statistics(meta) -> dict[str, tuple[int | None, object, object]]:
    out: dict[str, tuple] = {}
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        for c in range(group.num_columns):
            col = group.column(c)
            s, name = col.statistics, _leaf(col.path_in_schema)
            here = (s.null_count if s is not None and s.has_null_count else None,
                    *((s.min, s.max) if s is not None and s.has_min_max else (None, None)))
            if name not in out:
                out[name] = here
            else:
                n, lo, hi = out[name]
                out[name] = (None if n is None or here[0] is None else n + here[0],
                             None if lo is None or here[1] is None else min(lo, here[1]), None if hi is None or here[2] is None else max(hi, here[2]))
    return out


def footers(files: DataFrame, root: str) -> DataFrame:
    """``FOOTERS`` rows of the files of ``files`` (table_name, path relative to root)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        fs, base = fl.filesystem(root)
        for b in batches:
            out = []
            for table, rel in zip(b["table_name"], b["path"]):
                try:
                    with fs.open_input_file(fl._join(base, rel)) as src:
                        meta = pq.ParquetFile(src).metadata
                        schema, stats = spark_schema(meta), _statistics(meta)
                    for name, place, depth, f in walk(schema.fields):
                        nulls, lo, hi = stats.get(name, (None, None, None))
                        out.append((table, rel, meta.num_rows, name, place, depth, f.dataType.simpleString(), f.nullable, f.metadata.get("comment"),
                                    nulls, None if lo is None else str(lo), None if hi is None else str(hi), None))
                except Exception as e:  # noqa: BLE001 - reported per file
                    out.append((table, rel, *[None] * 10, str(e)[:500]))
            frame = pd.DataFrame(out, columns=FOOTERS.fieldNames())
            whole = {"rows": "Int64", "position": "Int32", "depth": "Int32", "nulls": "Int64", "nullable": "boolean"}
            yield frame.astype({c: k for c, k in whole.items()})

    return written(files.select("table_name", "path").repartition(F.xxhash64("path")).mapInPandas(run, FOOTERS), "footers")


def table_files(spark: SparkSession, root: str) -> DataFrame:
    """(table_name, path) of the Parquet files below ``root``, listed in tasks; the first folder is the table's name."""
    listed = fl.manifest(spark, root).where(F.col("path").endswith(".parquet") & ~F.col("path").rlike(r"(^|/)[_.]"))
    return listed.select(F.regexp_replace(F.substring_index("path", "/", 1), r"\.parquet$", "").alias("table_name"), "path")


def columns_of(found: DataFrame) -> DataFrame:
    """A table's columns (``validate.COLUMNS_SCHEMA``), nested ones too: what most of its files say, of equally many the least.

    A column that a file lacks, or that may be null in one, may be null.
    """
    per_file = found.where("column_name is not null")
    n_files = per_file.groupBy("table_name").agg(F.countDistinct("path").alias("files"))
    said = per_file.groupBy("table_name", "column_name", "position", "data_type", "comment").agg(
        F.count(F.lit(1)).alias("n"), F.max("nullable").alias("nullable"))
    best = said.groupBy("table_name", "column_name").agg(
        F.max_by(F.struct("position", "data_type", "comment"), F.struct("n", -F.col("position"), "data_type")).alias("c"),
        F.sum("n").alias("n"), F.max("nullable").alias("nullable"))
    return best.join(n_files, "table_name").select(
        "table_name", "column_name", "c.position", "c.data_type", (F.col("nullable") | (F.col("n") < F.col("files"))).alias("nullable"), "c.comment")


def drift(found: DataFrame) -> DataFrame:
    """(table_name, column_name, issue, files) where files of one table don't agree: type_differs, missing_in_files, nullability_differs, unreadable."""
    n_files = found.where("column_name is not null").groupBy("table_name").agg(F.countDistinct("path").alias("all"))
    usual = columns_of(found).select("table_name", "column_name", F.col("data_type").alias("usual"))
    seen = found.where("column_name is not null").join(usual, ["table_name", "column_name"]).groupBy("table_name", "column_name").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("data_type") != F.col("usual")).alias("other"), F.count_if("nullable").alias("nullable")).join(n_files, "table_name")
    mixed = F.when(F.col("nullable") < F.col("n"), F.col("nullable")).otherwise(F.lit(0).cast("long"))
    issues = F.array(*[F.struct(F.lit(issue).alias("issue"), n.alias("files")) for issue, n in (
        ("type_differs", F.col("other")), ("missing_in_files", F.col("all") - F.col("n")), ("nullability_differs", mixed))])
    rows = seen.select("table_name", "column_name", F.explode(issues).alias("i")).select("table_name", "column_name", "i.issue", "i.files").where("files > 0")
    bad = found.where("error is not null").groupBy("table_name").agg(F.count(F.lit(1)).alias("files")).select(
        "table_name", F.lit(None).cast("string").alias("column_name"), F.lit("unreadable").alias("issue"), "files")
    return rows.unionByName(bad)
