"""Per-object metadata: DESCRIBE key/value pivot and the restore list of a table.

The restore list replaces seven lookups per table by left joins of
pre-aggregated relations, all keyed by (table_schema, table_name), so each
side is shuffled once on the same key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultshift.functions import names as N
from vaultshift.operators import access, constraints, inventory, tags

TKEY = ["table_schema", "table_name"]


def describe_pivot(describe_kv: DataFrame) -> DataFrame:
    """(object_name, owner, comment, properties); keys trimmed and compared lower-case,
    values trimmed, missing or null -> ''."""
    key = F.lower(F.trim(F.coalesce(F.col("info_name"), F.lit(""))))
    val = F.coalesce(F.trim(F.col("info_value")), F.lit(""))

    def pick(k):
        return F.coalesce(F.max(F.when(key == k, val)), F.lit("")).alias(k)

    return describe_kv.groupBy("object_name").agg(pick("owner"), pick("comment"), pick("properties"))


def describe_value(describe_kv: DataFrame, key_text: str, alias: str) -> DataFrame:
    """First value whose trimmed key equals ``key_text`` (e.g. 'View Text'), per object."""
    return describe_kv.where(F.trim(F.col("info_name")) == key_text).groupBy("object_name").agg(
        F.min("info_value").alias(alias))


def table_metadata(tables: DataFrame, tag_rows: DataFrame, tc: DataFrame, kcu: DataFrame, rc: DataFrame,
                   grants: DataFrame, catalog: str, target_catalog: str) -> DataFrame:
    """One row per managed in-scope table with everything restored after the copy."""
    base = inventory.classify_tables(tables).where(F.col("class") == "managed").select(
        *TKEY, F.coalesce(F.col("comment"), F.lit("")).alias("comment"),
        F.coalesce(F.col("table_owner"), F.lit("")).alias("table_owner"),
        N.fqn(F.lit(catalog), F.col("table_schema"), F.col("table_name")).alias("object_key"),
    )
    ttags = tags.table_tag_pairs(tag_rows).select(*TKEY, F.col("tags").alias("table_tags"))
    ctags = tag_rows.where(F.upper(F.col("object_type")) == "COLUMN").groupBy(*TKEY).agg(
        F.count(F.lit(1)).alias("n_column_tags"))
    pk = constraints.pk_constraints(tc, kcu).groupBy(*TKEY).agg(
        F.min_by(F.struct(F.col("constraint_name").alias("pk_name"), F.col("cols").alias("pk_cols")),
                 F.col("constraint_name")).alias("pk"))
    # FKs that will be rebuilt: they have key columns and a referential row (semi joins; the
    # referenced-key lookup of fk_constraints is not needed for a count)
    fk = (
        tc.where(F.col("constraint_type") == "FOREIGN KEY").select(*constraints.KEYS3)
        .join(kcu.select(*constraints.KEYS3), constraints.KEYS3, "left_semi")
        .join(rc.select("constraint_name", F.col("constraint_schema").alias("table_schema")),
              ["constraint_name", "table_schema"], "left_semi")
        .groupBy(*TKEY).agg(F.count(F.lit(1)).alias("n_fks"))
    )
    g = access.drop_ownership(grants.where(F.upper(F.col("object_type")) == "TABLE")).select(
        "object_key", "principal", "action_type").distinct().groupBy("object_key").agg(
        F.count(F.lit(1)).alias("n_grants"))
    out = (
        base.join(ttags, TKEY, "left").join(ctags, TKEY, "left").join(pk, TKEY, "left").join(fk, TKEY, "left")
        .join(g, "object_key", "left")
    )
    return out.select(
        *TKEY, "comment",
        F.coalesce(F.col("table_tags"), F.lit("")).alias("table_tags"),
        F.coalesce(F.col("n_column_tags"), F.lit(0)).cast("bigint").alias("n_column_tags"),
        F.coalesce(F.col("pk.pk_name"), F.lit("")).alias("pk_name"),
        F.coalesce(F.col("pk.pk_cols"), F.lit("")).alias("pk_cols"),
        F.coalesce(F.col("n_fks"), F.lit(0)).cast("bigint").alias("n_fks"),
        F.coalesce(F.col("n_grants"), F.lit(0)).cast("bigint").alias("n_grants"),
        "table_owner",
    )
