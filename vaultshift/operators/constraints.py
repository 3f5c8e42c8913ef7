"""Primary and foreign keys rebuilt from the constraint relations.

Key columns are aggregated per constraint first (bounded: a key has few
columns), then joined; the FK target is looked up with a left join instead
of one query per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS3 = ["constraint_name", "table_schema", "table_name"]


def key_columns(kcu: DataFrame) -> DataFrame:
    """(constraint_name, table_schema, table_name, col_list) with columns in key order."""
    return kcu.groupBy(*KEYS3).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("ordinal_position", "column_name"))),
            lambda x: x["column_name"],
        ).alias("col_list")
    )


def pk_constraints(tc: DataFrame, kcu: DataFrame) -> DataFrame:
    """(table_schema, table_name, constraint_name, col_list, cols)."""
    pk = tc.where(F.col("constraint_type") == "PRIMARY KEY").select(*KEYS3)
    return pk.join(key_columns(kcu), KEYS3).select(
        "table_schema", "table_name", "constraint_name", "col_list",
        F.array_join("col_list", ", ").alias("cols"),
    )


def fk_constraints(tc: DataFrame, kcu: DataFrame, rc: DataFrame, catalog: str, target_catalog: str) -> DataFrame:
    """FKs with their referenced table and columns.

    The referential relation is joined on schema *and* name (names repeat
    across schemas).  The target is looked up in the key columns of the
    source catalog; a target in another catalog, or one that is not found,
    keeps ``ref_table = ''``.  References into the source catalog are rebased
    to ``target_catalog``.
    """
    kc = key_columns(kcu)
    fk = tc.where(F.col("constraint_type") == "FOREIGN KEY").select(*KEYS3).join(kc, KEYS3)
    r = rc.select(
        "constraint_name",
        F.col("constraint_schema").alias("table_schema"),
        F.col("unique_constraint_catalog").alias("ref_catalog_src"),
        F.col("unique_constraint_schema").alias("ref_schema"),
        F.col("unique_constraint_name").alias("ref_constraint"),
    )
    target = kc.groupBy(F.col("table_schema").alias("t_schema"), F.col("constraint_name").alias("t_name")).agg(
        F.min_by(F.struct(F.col("table_name").alias("ref_table"), F.col("col_list").alias("ref_list")),
                 F.col("table_name")).alias("t")
    ).withColumn("t_catalog", F.lit(catalog))
    joined = fk.join(r, ["constraint_name", "table_schema"]).join(
        target,
        (F.col("ref_catalog_src") == F.col("t_catalog"))
        & (F.col("ref_schema") == F.col("t_schema"))
        & (F.col("ref_constraint") == F.col("t_name")),
        "left",
    )
    return joined.select(
        "table_schema", "table_name", "constraint_name", "col_list",
        F.array_join("col_list", ", ").alias("cols"),
        F.when(F.col("ref_catalog_src") == F.lit(catalog), F.lit(target_catalog))
        .otherwise(F.col("ref_catalog_src")).alias("ref_catalog"),
        "ref_schema",
        F.coalesce(F.col("t.ref_table"), F.lit("")).alias("ref_table"),
        F.coalesce(F.col("t.ref_list"), F.array().cast("array<string>")).alias("ref_list"),
        F.coalesce(F.array_join(F.col("t.ref_list"), ", "), F.lit("")).alias("ref_cols"),
    )
