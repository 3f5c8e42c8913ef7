"""Inventory of a catalog: listings, object classes, scope, counts and risks.

Every function takes metadata relations (DataFrames) and returns a lazy
DataFrame; nothing is collected.  Counts over several relations are one
global aggregate over a tagged union (no joins, no cross products).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultshift.functions import names as N

# Table types and internal-table name patterns of the reference.
MANAGED_TYPES = ("MANAGED", "TABLE", "BASE TABLE")
KNOWN_TYPES = ("MANAGED", "TABLE", "BASE TABLE", "EXTERNAL", "VIEW", "MATERIALIZED_VIEW", "METRIC_VIEW", "STREAMING_TABLE")
INTERNAL_PATTERNS = ("^__materialization_", "^event_log_[0-9a-f]")
SYSTEM_SCHEMA = "information_schema"


def is_internal(name: Column) -> Column:
    """MV / pipeline backing table (case-sensitive, lower-case hex only)."""
    cond = F.lit(False)
    for p in INTERNAL_PATTERNS:
        cond = cond | F.coalesce(name.rlike(p), F.lit(False))
    return cond


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


# One SQL expression (parsed once) for the class of a table row.
CLASS_SQL = f"""CASE
  WHEN table_type IN {_in(MANAGED_TYPES)} AND (coalesce(table_name RLIKE '{INTERNAL_PATTERNS[0]}', false)
       OR coalesce(table_name RLIKE '{INTERNAL_PATTERNS[1]}', false)) THEN 'internal'
  WHEN table_type IN {_in(MANAGED_TYPES)} THEN 'managed'
  WHEN table_type = 'VIEW' THEN 'view'
  WHEN table_type = 'MATERIALIZED_VIEW' THEN 'mv'
  WHEN table_type = 'METRIC_VIEW' THEN 'metric_view'
  WHEN table_type = 'EXTERNAL' THEN 'external'
  WHEN table_type = 'STREAMING_TABLE' THEN 'streaming'
  ELSE 'unknown' END"""

# Scope words and inventory log wording.
_DERIVED_SQL = {
    "scope": """CASE WHEN class = 'internal' THEN 'SKIPPED'
  WHEN class IN ('managed', 'view', 'mv', 'metric_view') THEN 'IN_SCOPE' ELSE 'OUT_OF_SCOPE' END""",
    "log_type": """CASE class WHEN 'view' THEN 'VIEW' WHEN 'mv' THEN 'MATERIALIZED_VIEW'
  WHEN 'metric_view' THEN 'METRIC_VIEW' ELSE 'TABLE' END""",
    "log_message": """CASE
  WHEN class = 'managed' THEN concat('type=', table_type, ' owner=', coalesce(table_owner, ''))
  WHEN class IN ('view', 'mv', 'metric_view') THEN concat('owner=', coalesce(table_owner, ''))
  WHEN class IN ('external', 'streaming') THEN concat('type=', table_type, ' owner=', coalesce(table_owner, ''))
  WHEN class = 'internal' THEN 'Internal materialized-view/pipeline backing table'
  ELSE concat('type=', coalesce(table_type, ''), ' (unknown)') END""",
}


def list_schemas(schemata: DataFrame) -> DataFrame:
    return schemata.where(F.col("schema_name") != SYSTEM_SCHEMA).select("schema_name").orderBy("schema_name")


def list_tables(tables: DataFrame) -> DataFrame:
    return (
        tables.where(F.col("table_schema") != SYSTEM_SCHEMA)
        .select("table_schema", "table_name", "table_type", "table_owner", "comment")
        .orderBy("table_schema", "table_name")
    )


def list_volumes(volumes: DataFrame) -> DataFrame:
    return (
        volumes.where(F.col("volume_schema") != SYSTEM_SCHEMA)
        .select(
            "volume_schema", "volume_name", "volume_type",
            F.when(F.col("volume_type") == "MANAGED", "IN_SCOPE").otherwise("OUT_OF_SCOPE").alias("scope"),
        )
        .orderBy("volume_schema", "volume_name")
    )


def list_functions(routines: DataFrame) -> DataFrame:
    return (
        routines.where(F.col("routine_schema") != SYSTEM_SCHEMA)
        .select("routine_schema", "routine_name", "routine_body", "full_data_type", "comment")
        .orderBy("routine_schema", "routine_name")
    )


def classify_tables(tables: DataFrame) -> DataFrame:
    """Adds ``class``, ``scope`` and the inventory log fields to each table row."""
    t = tables.where(F.col("table_schema") != SYSTEM_SCHEMA).selectExpr("*", f"{CLASS_SQL} AS class")
    return t.selectExpr("*", *[f"{expr} AS {name}" for name, expr in _DERIVED_SQL.items()])


def scope_counts(tables: DataFrame) -> DataFrame:
    """Objects per table type and scope (map-side partial aggregation)."""
    return classify_tables(tables).groupBy("table_type", "scope").agg(F.count(F.lit(1)).alias("n"))


def _tagged(schemata: DataFrame, tables: DataFrame, volumes: DataFrame, routines: DataFrame) -> DataFrame:
    """One narrow relation of object kinds, the input of all global counts."""
    s = schemata.where(F.col("schema_name") != SYSTEM_SCHEMA).select(F.lit("schema").alias("kind"))
    t = classify_tables(tables).select(F.col("class").alias("kind"))
    v = volumes.where(F.col("volume_schema") != SYSTEM_SCHEMA).select(
        F.when(F.col("volume_type") == "MANAGED", "volume").otherwise("external_volume").alias("kind")
    )
    r = routines.where(F.col("routine_schema") != SYSTEM_SCHEMA).select(F.lit("function").alias("kind"))
    return s.unionByName(t).unionByName(v).unionByName(r)


def _n(kind: str) -> Column:
    return F.count_if(F.col("kind") == kind).cast("bigint")


def inventory_summary(schemata: DataFrame, tables: DataFrame, volumes: DataFrame, routines: DataFrame) -> DataFrame:
    """One row of object counts (dry-run summary)."""
    return _tagged(schemata, tables, volumes, routines).agg(
        _n("schema").alias("schemas"),
        _n("managed").alias("tables"),
        _n("view").alias("views"),
        _n("mv").alias("mvs"),
        _n("metric_view").alias("metric_views"),
        _n("function").alias("functions"),
        _n("volume").alias("volumes"),
        _n("external").alias("external_tables"),
        _n("streaming").alias("streaming_tables"),
        _n("external_volume").alias("external_volumes"),
    )


def inventory_log(schemata: DataFrame, tables: DataFrame, volumes: DataFrame, routines: DataFrame,
                  catalog: str) -> DataFrame:
    """Inventory rows as written to the audit log: (object_type, object_name, status, message)."""
    cat = F.lit(catalog)
    summary = inventory_summary(schemata, tables, volumes, routines).select(
        F.lit("CATALOG").alias("object_type"),
        cat.alias("object_name"),
        F.lit("SUCCESS").alias("status"),
        N.kv_message(schemas=F.col("schemas"), tables=F.col("tables"), views=F.col("views"), mvs=F.col("mvs"),
                     functions=F.col("functions"), volumes=F.col("volumes")).alias("message"),
    )
    sch = schemata.where(F.col("schema_name") != SYSTEM_SCHEMA).select(
        F.lit("SCHEMA").alias("object_type"), N.fqn(cat, F.col("schema_name")).alias("object_name"),
        F.lit("IN_SCOPE").alias("status"), F.lit(None).cast("string").alias("message"),
    )
    tab = classify_tables(tables).select(
        F.col("log_type").alias("object_type"), N.fqn(cat, F.col("table_schema"), F.col("table_name")).alias("object_name"),
        F.col("scope").alias("status"), F.col("log_message").alias("message"),
    )
    fun = routines.where(F.col("routine_schema") != SYSTEM_SCHEMA).select(
        F.lit("FUNCTION").alias("object_type"), N.fqn(cat, F.col("routine_schema"), F.col("routine_name")).alias("object_name"),
        F.lit("IN_SCOPE").alias("status"), F.concat(F.lit("body="), F.coalesce(F.col("routine_body"), F.lit(""))).alias("message"),
    )
    vol = volumes.where(F.col("volume_schema") != SYSTEM_SCHEMA).select(
        F.lit("VOLUME").alias("object_type"), N.fqn(cat, F.col("volume_schema"), F.col("volume_name")).alias("object_name"),
        F.when(F.col("volume_type") == "MANAGED", "IN_SCOPE").otherwise("OUT_OF_SCOPE").alias("status"),
        F.concat(F.lit("type="), F.coalesce(F.col("volume_type"), F.lit(""))).alias("message"),
    )
    return summary.unionByName(sch).unionByName(tab).unionByName(fun).unionByName(vol)


# Warning texts of the risk report (reference wording).
RISK_TEXT = {
    "EXTERNAL_TABLES": "EXTERNAL TABLES ({n}): Not migrated. These tables reference external storage and are out of scope.",
    "STREAMING_TABLES": "STREAMING TABLES ({n}): Not migrated. Streaming tables cannot be cloned and require full re-ingestion from source.",
    "EXTERNAL_VOLUMES": "EXTERNAL VOLUMES ({n}): Not migrated. External volumes reference external storage and are out of scope.",
    "SHARES": "SHARING: {n} share(s) reference objects in this catalog. After migration, share references will point to objects in '{bkp}'. You must manually update shares to reference the migrated catalog.",
    "PIPELINES": "PIPELINES: Pipelines that write to this catalog are not detected or moved. If any pipelines target this catalog, they will need a full refresh after migration.",
    "AUX_COLLISION": "BLOCKING: Catalog '{aux}' already exists. Drop it or choose a different source catalog before proceeding.",
    "BKP_COLLISION": "BLOCKING: Catalog '{bkp}' already exists. Drop it or choose a different source catalog before proceeding.",
    "MATERIALIZED_VIEWS": "MATERIALIZED VIEWS ({n}): Will be recreated after the rename swap. This triggers a full recomputation which may take significant time and compute.",
}
RISK_ORDER = ("EXTERNAL_TABLES", "STREAMING_TABLES", "EXTERNAL_VOLUMES", "SHARES", "PIPELINES",
              "AUX_COLLISION", "BKP_COLLISION", "MATERIALIZED_VIEWS")


def risk_report(tables: DataFrame, volumes: DataFrame, catalogs: DataFrame, share_objects: DataFrame,
                catalog: str) -> DataFrame:
    """(code, n, detail), one row per risk with n > 0; PIPELINES always (n = 1)."""
    from vaultshift.operators.access import affected_shares

    aux, bkp = f"{catalog}_aux", f"{catalog}_bkp"
    kinds = (
        classify_tables(tables).select(F.col("class").alias("kind"))
        .unionByName(volumes.where(F.col("volume_schema") != SYSTEM_SCHEMA).select(
            F.when(F.col("volume_type") == "MANAGED", "volume").otherwise("external_volume").alias("kind")))
        .unionByName(affected_shares(share_objects, catalog).select(F.lit("share").alias("kind")))
        .unionByName(catalogs.select(
            F.when(F.col("catalog") == aux, "aux").when(F.col("catalog") == bkp, "bkp").alias("kind")))
    )
    counts = kinds.agg(
        _n("external").alias("EXTERNAL_TABLES"), _n("streaming").alias("STREAMING_TABLES"),
        _n("external_volume").alias("EXTERNAL_VOLUMES"), _n("share").alias("SHARES"),
        F.lit(1).cast("bigint").alias("PIPELINES"),
        F.least(_n("aux"), F.lit(1)).cast("bigint").alias("AUX_COLLISION"),
        F.least(_n("bkp"), F.lit(1)).cast("bigint").alias("BKP_COLLISION"),
        _n("mv").alias("MATERIALIZED_VIEWS"),
    )
    rows = [
        F.struct(F.lit(code).alias("code"), F.col(code).alias("n"),
                 _risk_text(code, F.col(code), aux, bkp).alias("detail"))
        for code in RISK_ORDER
    ]
    return (
        counts.select(F.explode(F.array(*rows)).alias("r"))
        .select("r.code", "r.n", "r.detail")
        .where(F.col("n") > 0)
    )


def _risk_text(code: str, n: Column, aux: str, bkp: str) -> Column:
    text = RISK_TEXT[code].replace("{aux}", aux).replace("{bkp}", bkp)
    if "{n}" not in text:
        return F.lit(text)
    head, tail = text.split("{n}", 1)
    return F.concat(F.lit(head), n.cast("string"), F.lit(tail))
