"""

Each query reads the driver's parquet tables (or the metadata relations
Spark derives from them, see ``vaultshift.sources.fixtures``) and runs one
operator of the library over all rows.  The oracle text is DuckDB SQL over
the same tables; the fixture relations go in front as CTEs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vaultshift.sources.fixtures import Fixtures, cte_prefix

SMOKE_DIR = "/root/testdata/sf0.001"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def deco(fn):
        _QUERIES[name] = fn
        if sql is not None:
            used = set(re.findall(r"\bm_\w+\b", sql))
            prefix, body = cte_prefix(sorted(used)), sql.strip()
            rec = re.match(r"WITH\s+RECURSIVE\s", body, re.IGNORECASE)
            if prefix and rec:
                _ORACLE[name] = "WITH RECURSIVE " + prefix[5:].rstrip() + ",\n" + body[rec.end():]
            elif prefix and body[:5].upper() == "WITH ":
                _ORACLE[name] = prefix.rstrip() + ",\n" + body[5:]
            else:
                _ORACLE[name] = prefix + body
        return fn
    return deco


_FIXTURES: dict[tuple[str, str], Fixtures] = {}


def _fx(spark: SparkSession, sf_dir: str) -> Fixtures:
    """Lazy relations of one folder, built once per session (plans only, no data)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FIXTURES:
        _FIXTURES[key] = Fixtures(spark, sf_dir)
    return _FIXTURES[key]


# Parameters of the registered runs (the source catalog of the fixtures is 'prod').
CATALOG = "prod"
BATCH = "b1"
BATCHES = ["b1", "b2"]

# Classification in SQL for the oracle (same rules as operators.inventory).
_MANAGED = "('MANAGED', 'TABLE', 'BASE TABLE')"
_INTERNAL = "(regexp_matches(table_name, '^__materialization_') OR regexp_matches(table_name, '^event_log_[0-9a-f]'))"
_CLASS = f"""CASE WHEN table_type IN {_MANAGED} AND {_INTERNAL} THEN 'internal'
  WHEN table_type IN {_MANAGED} THEN 'managed' WHEN table_type = 'VIEW' THEN 'view'
  WHEN table_type = 'MATERIALIZED_VIEW' THEN 'mv' WHEN table_type = 'METRIC_VIEW' THEN 'metric_view'
  WHEN table_type = 'EXTERNAL' THEN 'external' WHEN table_type = 'STREAMING_TABLE' THEN 'streaming'
  ELSE 'unknown' END"""

# ---------------------------------------------------------------- inventory

from vaultshift.operators import inventory as inv  # noqa: E402


@_register("inv_schemas", """
SELECT schema_name FROM m_schemata WHERE schema_name <> 'information_schema' ORDER BY schema_name""")
def q_inv_schemas(spark, sf_dir):
    return inv.list_schemas(_fx(spark, sf_dir)["m_schemata"])


@_register("inv_tables", """
SELECT table_schema, table_name, table_type, table_owner, comment FROM m_tables
WHERE table_schema <> 'information_schema' ORDER BY table_schema, table_name""")
def q_inv_tables(spark, sf_dir):
    return inv.list_tables(_fx(spark, sf_dir)["m_tables"])


@_register("inv_volumes", """
SELECT volume_schema, volume_name, volume_type,
  CASE WHEN volume_type = 'MANAGED' THEN 'IN_SCOPE' ELSE 'OUT_OF_SCOPE' END AS scope
FROM m_volumes WHERE volume_schema <> 'information_schema' ORDER BY volume_schema, volume_name""")
def q_inv_volumes(spark, sf_dir):
    return inv.list_volumes(_fx(spark, sf_dir)["m_volumes"])


@_register("inv_functions", """
SELECT routine_schema, routine_name, routine_body, full_data_type, comment FROM m_routines
WHERE routine_schema <> 'information_schema' ORDER BY routine_schema, routine_name""")
def q_inv_functions(spark, sf_dir):
    return inv.list_functions(_fx(spark, sf_dir)["m_routines"])


@_register("inv_scope", f"""
SELECT table_type, CASE WHEN cls = 'internal' THEN 'SKIPPED'
  WHEN cls IN ('managed', 'view', 'mv', 'metric_view') THEN 'IN_SCOPE' ELSE 'OUT_OF_SCOPE' END AS scope, count(*) AS n
FROM (SELECT table_type, {_CLASS} AS cls FROM m_tables WHERE table_schema <> 'information_schema') t
GROUP BY 1, 2""")
def q_inv_scope(spark, sf_dir):
    return inv.scope_counts(_fx(spark, sf_dir)["m_tables"])


_KINDS_SQL = f"""
kinds AS (
  SELECT 'schema' AS kind FROM m_schemata WHERE schema_name <> 'information_schema'
  UNION ALL SELECT {_CLASS} FROM m_tables WHERE table_schema <> 'information_schema'
  UNION ALL SELECT CASE WHEN volume_type = 'MANAGED' THEN 'volume' ELSE 'external_volume' END FROM m_volumes
    WHERE volume_schema <> 'information_schema'
  UNION ALL SELECT 'function' FROM m_routines WHERE routine_schema <> 'information_schema'),
counts AS (
  SELECT count_if(kind = 'schema') AS schemas, count_if(kind = 'managed') AS tables, count_if(kind = 'view') AS views,
    count_if(kind = 'mv') AS mvs, count_if(kind = 'metric_view') AS metric_views, count_if(kind = 'function') AS functions,
    count_if(kind = 'volume') AS volumes, count_if(kind = 'external') AS external_tables,
    count_if(kind = 'streaming') AS streaming_tables, count_if(kind = 'external_volume') AS external_volumes
  FROM kinds)"""


@_register("inventory_summary", f"""
SELECT * FROM (WITH {_KINDS_SQL} SELECT * FROM counts) s""")
def q_inventory_summary(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return inv.inventory_summary(f["m_schemata"], f["m_tables"], f["m_volumes"], f["m_routines"])


@_register("inventory_log", f"""
SELECT * FROM (WITH {_KINDS_SQL}
SELECT 'CATALOG' AS object_type, 'prod' AS object_name, 'SUCCESS' AS status,
  'schemas=' || schemas || ' tables=' || tables || ' views=' || views || ' mvs=' || mvs || ' functions=' || functions
  || ' volumes=' || volumes AS message FROM counts) s
UNION ALL SELECT 'SCHEMA', 'prod.' || schema_name, 'IN_SCOPE', NULL FROM m_schemata WHERE schema_name <> 'information_schema'
UNION ALL SELECT CASE cls WHEN 'view' THEN 'VIEW' WHEN 'mv' THEN 'MATERIALIZED_VIEW' WHEN 'metric_view' THEN 'METRIC_VIEW' ELSE 'TABLE' END,
  'prod.' || table_schema || '.' || table_name,
  CASE WHEN cls = 'internal' THEN 'SKIPPED' WHEN cls IN ('managed', 'view', 'mv', 'metric_view') THEN 'IN_SCOPE' ELSE 'OUT_OF_SCOPE' END,
  CASE WHEN cls = 'managed' THEN 'type=' || table_type || ' owner=' || coalesce(table_owner, '')
       WHEN cls IN ('view', 'mv', 'metric_view') THEN 'owner=' || coalesce(table_owner, '')
       WHEN cls IN ('external', 'streaming') THEN 'type=' || table_type || ' owner=' || coalesce(table_owner, '')
       WHEN cls = 'internal' THEN 'Internal materialized-view/pipeline backing table'
       ELSE 'type=' || coalesce(table_type, '') || ' (unknown)' END
FROM (SELECT *, {_CLASS} AS cls FROM m_tables WHERE table_schema <> 'information_schema') t
UNION ALL SELECT 'FUNCTION', 'prod.' || routine_schema || '.' || routine_name, 'IN_SCOPE', 'body=' || coalesce(routine_body, '')
FROM m_routines WHERE routine_schema <> 'information_schema'
UNION ALL SELECT 'VOLUME', 'prod.' || volume_schema || '.' || volume_name,
  CASE WHEN volume_type = 'MANAGED' THEN 'IN_SCOPE' ELSE 'OUT_OF_SCOPE' END, 'type=' || coalesce(volume_type, '')
FROM m_volumes WHERE volume_schema <> 'information_schema'""")
def q_inventory_log(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return inv.inventory_log(f["m_schemata"], f["m_tables"], f["m_volumes"], f["m_routines"], CATALOG)


@_register("risk_report", f"""
SELECT code, n, detail FROM (
  SELECT 'EXTERNAL_TABLES' AS code, count_if(cls = 'external') AS n,
    'EXTERNAL TABLES (' || count_if(cls = 'external') || '): Not migrated. These tables reference external storage and are out of scope.' AS detail
  FROM (SELECT {_CLASS} AS cls FROM m_tables WHERE table_schema <> 'information_schema') t
  UNION ALL SELECT 'STREAMING_TABLES', count_if(cls = 'streaming'),
    'STREAMING TABLES (' || count_if(cls = 'streaming') || '): Not migrated. Streaming tables cannot be cloned and require full re-ingestion from source.'
  FROM (SELECT {_CLASS} AS cls FROM m_tables WHERE table_schema <> 'information_schema') t
  UNION ALL SELECT 'EXTERNAL_VOLUMES', count_if(volume_type <> 'MANAGED'),
    'EXTERNAL VOLUMES (' || count_if(volume_type <> 'MANAGED') || '): Not migrated. External volumes reference external storage and are out of scope.'
  FROM m_volumes WHERE volume_schema <> 'information_schema'
  UNION ALL SELECT 'SHARES', count(DISTINCT share_name),
    'SHARING: ' || count(DISTINCT share_name) || ' share(s) reference objects in this catalog. After migration, share references will point to objects in ''prod_bkp''. You must manually update shares to reference the migrated catalog.'
  FROM m_share_objects WHERE starts_with(lower(coalesce(object_name, '')), 'prod.')
  UNION ALL SELECT 'PIPELINES', CAST(1 AS BIGINT), 'PIPELINES: Pipelines that write to this catalog are not detected or moved. If any pipelines target this catalog, they will need a full refresh after migration.'
  UNION ALL SELECT 'AUX_COLLISION', least(count_if(catalog = 'prod_aux'), 1), 'BLOCKING: Catalog ''prod_aux'' already exists. Drop it or choose a different source catalog before proceeding.' FROM m_catalogs
  UNION ALL SELECT 'BKP_COLLISION', least(count_if(catalog = 'prod_bkp'), 1), 'BLOCKING: Catalog ''prod_bkp'' already exists. Drop it or choose a different source catalog before proceeding.' FROM m_catalogs
  UNION ALL SELECT 'MATERIALIZED_VIEWS', count_if(cls = 'mv'),
    'MATERIALIZED VIEWS (' || count_if(cls = 'mv') || '): Will be recreated after the rename swap. This triggers a full recomputation which may take significant time and compute.'
  FROM (SELECT {_CLASS} AS cls FROM m_tables WHERE table_schema <> 'information_schema') t
) r WHERE n > 0""")
def q_risk_report(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return inv.risk_report(f["m_tables"], f["m_volumes"], f["m_catalogs"], f["m_share_objects"], CATALOG)


# ---------------------------------------------------------------- audit log

from vaultshift.operators import auditlog as alog  # noqa: E402

_LOGS: dict[tuple[str, str], str] = {}


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit log as the readers see it: a parquet table partitioned by
    catalog, filled once per session from the ``m_log`` rows."""
    from vaultshift.session import fresh_dir

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LOGS:
        path = fresh_dir(spark, "auditlog")
        alog.AuditLog(spark, path).append(_fx(spark, sf_dir)["m_log"])
        _LOGS[key] = path
    return alog.AuditLog(spark, _LOGS[key]).read()


@_register("log_full", f"SELECT * FROM m_log WHERE batch_id = '{BATCH}' ORDER BY logged_at")
def q_log_full(spark, sf_dir):
    return alog.full(_log(spark, sf_dir), BATCH)


@_register("log_summary", f"""
SELECT phase, object_type, status, count(*) AS cnt FROM m_log WHERE batch_id = '{BATCH}'
GROUP BY phase, object_type, status ORDER BY phase, object_type, status""")
def q_log_summary(spark, sf_dir):
    return alog.summary(_log(spark, sf_dir), BATCH)


@_register("log_phase_status", f"""
SELECT phase, status, count(*) AS cnt FROM m_log WHERE batch_id = '{BATCH}' GROUP BY phase, status ORDER BY phase, status""")
def q_log_phase_status(spark, sf_dir):
    return alog.phase_status(_log(spark, sf_dir), BATCH)


@_register("log_failures", f"""
SELECT phase, object_type, object_name, message FROM m_log WHERE batch_id = '{BATCH}' AND status IN ('FAILED', 'ERROR')
ORDER BY phase, object_name""")
def q_log_failures(spark, sf_dir):
    return alog.failures(_log(spark, sf_dir), BATCH)


@_register("log_failures_all", f"""
SELECT batch_id, phase, object_name, message FROM m_log WHERE catalog_name = '{CATALOG}' AND status IN ('FAILED', 'ERROR')
ORDER BY batch_id DESC, logged_at""")
def q_log_failures_all(spark, sf_dir):
    return alog.failures_all(_log(spark, sf_dir), CATALOG)


@_register("log_inventory", f"""
SELECT object_type, object_name, status, message FROM m_log WHERE batch_id = '{BATCH}' AND phase = 'inventory'
ORDER BY object_type, object_name""")
def q_log_inventory(spark, sf_dir):
    return alog.inventory(_log(spark, sf_dir), BATCH)


@_register("log_out_of_scope", f"""
SELECT object_type, object_name, message FROM m_log WHERE batch_id = '{BATCH}' AND phase = 'inventory' AND status = 'OUT_OF_SCOPE'
ORDER BY object_type, object_name""")
def q_log_out_of_scope(spark, sf_dir):
    return alog.out_of_scope(_log(spark, sf_dir), BATCH)


@_register("log_warnings", f"""
SELECT object_name, message FROM m_log WHERE batch_id = '{BATCH}' AND status = 'WARNING' ORDER BY logged_at""")
def q_log_warnings(spark, sf_dir):
    return alog.warnings(_log(spark, sf_dir), BATCH)


@_register("log_compare", f"""
SELECT batch_id, phase, status, count(*) AS cnt FROM m_log WHERE batch_id IN ('{BATCHES[0]}', '{BATCHES[1]}')
GROUP BY batch_id, phase, status ORDER BY batch_id, phase, status""")
def q_log_compare(spark, sf_dir):
    return alog.compare(_log(spark, sf_dir), BATCHES)


@_register("log_rowcount_results", f"""
SELECT object_name, status, message, CAST(regexp_extract(message, 'new=([0-9]+)', 1) AS BIGINT) AS new,
  CAST(regexp_extract(message, 'original=([0-9]+)', 1) AS BIGINT) AS original
FROM m_log WHERE batch_id = '{BATCH}' AND phase = 'validation' AND object_type = 'ROW_COUNT' ORDER BY object_name""")
def q_log_rowcount_results(spark, sf_dir):
    return alog.rowcount_results(_log(spark, sf_dir), BATCH)


@_register("log_durations", f"""
SELECT phase, count(*) AS n, round(sum(duration_seconds), 6) AS total_seconds, max(duration_seconds) AS max_seconds
FROM m_log WHERE batch_id = '{BATCH}' GROUP BY phase ORDER BY phase""")
def q_log_durations(spark, sf_dir):
    return alog.durations(_log(spark, sf_dir), BATCH)


@_register("log_duration_texts", """
SELECT batch_id, catalog_name, phase, printf('%.1f', round(CAST(CAST(min(duration_seconds) AS VARCHAR) AS DECIMAL(28, 12)), 1)) AS shortest,
  printf('%.1f', round(CAST(CAST(max(duration_seconds) AS VARCHAR) AS DECIMAL(28, 12)), 1)) AS longest
FROM m_log GROUP BY batch_id, catalog_name, phase""")
def q_log_duration_texts(spark, sf_dir):
    return alog.duration_texts(_fx(spark, sf_dir)["m_log"])


@_register("log_percentiles", """
SELECT phase, q, count(duration_seconds) AS n, list_sort(list(duration_seconds))[CAST(greatest(1, ceil(q * count(duration_seconds))) AS BIGINT)] AS value
FROM (SELECT CASE WHEN phase = 'tables' THEN 'tables' ELSE 'others' END AS phase, duration_seconds FROM m_log) l,
  (SELECT CAST(unnest([0.5, 0.9, 0.99, 1.0]) AS DOUBLE) AS q) t
GROUP BY phase, q""")
def q_log_percentiles(spark, sf_dir):
    """One phase holds most rows."""
    from pyspark.sql import functions as F

    from vaultshift.operators import quantiles

    log = _fx(spark, sf_dir)["m_log"].select(F.when(F.col("phase") == "tables", "tables").otherwise("others").alias("phase"), "duration_seconds")
    return quantiles.exact_percentiles(log, ["phase"], "duration_seconds", [0.5, 0.9, 0.99, 1.0])


@_register("log_append", "SELECT * FROM m_log")
def q_log_append(spark, sf_dir):
    from vaultshift.session import fresh_dir

    log = alog.AuditLog(spark, fresh_dir(spark, "auditlog"))
    log.append(_fx(spark, sf_dir)["m_log"])
    return log.read()


# ---------------------------------------------------------------- SQL text helpers (oracle side)

def _esc(x: str) -> str:
    return f"replace(replace({x}, '\\', '\\\\'), '''', '\\''')"


def _lit(x: str) -> str:
    return f"('''' || {_esc(x)} || '''')"


def _qp(x: str) -> str:
    return f"('`' || replace({x}, '`', '``') || '`')"


def _q(*parts: str) -> str:
    return " || '.' || ".join(_qp(p) for p in parts)


AUX = CATALOG + "_aux"
_NL = "chr(10)"
_CLASSIFIED = f"(SELECT *, {_CLASS} AS cls FROM m_tables WHERE table_schema <> 'information_schema')"
_DESCRIBE = """(SELECT object_name,
  coalesce(max(CASE WHEN lower(trim(coalesce(info_name, ''))) = 'owner' THEN coalesce(trim(info_value), '') END), '') AS owner,
  coalesce(max(CASE WHEN lower(trim(coalesce(info_name, ''))) = 'comment' THEN coalesce(trim(info_value), '') END), '') AS comment,
  coalesce(max(CASE WHEN lower(trim(coalesce(info_name, ''))) = 'properties' THEN coalesce(trim(info_value), '') END), '') AS properties
FROM m_describe_kv GROUP BY object_name)"""
_KC = """(SELECT constraint_name, table_schema, table_name, string_agg(column_name, ', ' ORDER BY ordinal_position) AS cols,
  string_agg('`' || replace(column_name, '`', '``') || '`', ', ' ORDER BY ordinal_position) AS qcols
FROM m_key_column_usage GROUP BY constraint_name, table_schema, table_name)"""
_FK = f"""(SELECT t.table_schema, t.table_name, t.constraint_name, kc.cols, kc.qcols,
  CASE WHEN rc.unique_constraint_catalog = '{CATALOG}' THEN '{AUX}' ELSE rc.unique_constraint_catalog END AS ref_catalog,
  rc.unique_constraint_schema AS ref_schema, coalesce(ref.ref_table, '') AS ref_table, coalesce(ref.ref_cols, '') AS ref_cols,
  coalesce(ref.ref_qcols, '') AS ref_qcols
FROM m_table_constraints t JOIN {_KC} kc USING (constraint_name, table_schema, table_name)
JOIN m_referential_constraints rc ON rc.constraint_name = t.constraint_name AND rc.constraint_schema = t.table_schema
LEFT JOIN (SELECT table_schema, constraint_name, min(table_name) AS ref_table, arg_min(cols, table_name) AS ref_cols,
             arg_min(qcols, table_name) AS ref_qcols FROM {_KC} k GROUP BY table_schema, constraint_name) ref
  ON rc.unique_constraint_catalog = '{CATALOG}' AND ref.constraint_name = rc.unique_constraint_name
 AND ref.table_schema = rc.unique_constraint_schema
WHERE t.constraint_type = 'FOREIGN KEY')"""
_SEC = f"""(SELECT 'CATALOG' AS object_type, '{CATALOG}' AS object_key
  UNION ALL SELECT 'SCHEMA', '{CATALOG}.' || schema_name FROM m_schemata WHERE schema_name <> 'information_schema'
  UNION ALL SELECT CASE WHEN table_type IN ('VIEW', 'METRIC_VIEW') THEN 'VIEW' ELSE 'TABLE' END,
    '{CATALOG}.' || table_schema || '.' || table_name FROM m_tables WHERE table_schema <> 'information_schema')"""


def _direct(grants: str) -> str:
    return f"""(SELECT DISTINCT s.object_type, s.object_key, g.principal, g.action_type FROM {_SEC} s
  JOIN {grants} g ON g.object_key = s.object_key WHERE g.object_type IS NULL OR upper(g.object_type) = upper(s.object_type))"""


def _norm(x: str) -> str:
    return f"upper(replace(replace({x}, '_', ''), ' ', ''))"


_POST = "cls IN ('view', 'mv', 'metric_view')"
_TGT_CAT = f"CASE WHEN {_POST} THEN '{CATALOG}' ELSE '{AUX}' END"
_TGT_TABLE = f"{_qp(_TGT_CAT)} || '.' || {_qp('table_schema')} || '.' || {_qp('table_name')}"
_OBJTYPE = "CASE cls WHEN 'view' THEN 'VIEW' WHEN 'mv' THEN 'MATERIALIZED_VIEW' WHEN 'metric_view' THEN 'METRIC_VIEW' ELSE 'TABLE' END"

# ---------------------------------------------------------------- metadata, keys, tags, functions

from vaultshift.functions import names as NM  # noqa: E402
from vaultshift.operators import access as acc  # noqa: E402
from vaultshift.operators import constraints as con  # noqa: E402
from vaultshift.operators import metadata as meta  # noqa: E402
from vaultshift.operators import routines as rtn  # noqa: E402
from vaultshift.operators import tags as tg  # noqa: E402
from vaultshift.plans import statements as st  # noqa: E402


@_register("describe_pivot", f"SELECT * FROM {_DESCRIBE} d")
def q_describe_pivot(spark, sf_dir):
    return meta.describe_pivot(_fx(spark, sf_dir)["m_describe_kv"])


@_register("quoted_names", f"""
SELECT concat_ws('.', '{CATALOG}', table_schema, table_name) AS fqn, {_q(f"'{CATALOG}'", 'table_schema', 'table_name')} AS quoted,
  {_esc('comment')} AS escaped_comment FROM m_tables""")
def q_quoted_names(spark, sf_dir):
    from pyspark.sql import functions as F

    t = _fx(spark, sf_dir)["m_tables"]
    return t.select(
        NM.fqn(F.lit(CATALOG), F.col("table_schema"), F.col("table_name")).alias("fqn"),
        NM.quoted(F.lit(CATALOG), F.col("table_schema"), F.col("table_name")).alias("quoted"),
        NM.escape_literal(F.col("comment")).alias("escaped_comment"),
    )


@_register("pk_constraints", f"""
SELECT t.table_schema, t.table_name, t.constraint_name, kc.cols FROM m_table_constraints t
JOIN {_KC} kc USING (constraint_name, table_schema, table_name) WHERE t.constraint_type = 'PRIMARY KEY'""")
def q_pk_constraints(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return con.pk_constraints(f["m_table_constraints"], f["m_key_column_usage"]).select(
        "table_schema", "table_name", "constraint_name", "cols")


@_register("fk_constraints", f"""
SELECT table_schema, table_name, constraint_name, cols, ref_catalog, ref_schema, ref_table, ref_cols FROM {_FK} fk""")
def q_fk_constraints(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return con.fk_constraints(f["m_table_constraints"], f["m_key_column_usage"], f["m_referential_constraints"],
                              CATALOG, AUX).select(
        "table_schema", "table_name", "constraint_name", "cols", "ref_catalog", "ref_schema", "ref_table", "ref_cols")


@_register("constraint_plan", f"""
SELECT 1 AS step, t.table_schema, t.table_name,
  'ALTER TABLE ' || {_q(f"'{AUX}'", 't.table_schema', 't.table_name')} || ' ADD CONSTRAINT ' || {_qp('t.constraint_name')}
  || ' PRIMARY KEY (' || kc.qcols || ')' AS statement
FROM m_table_constraints t JOIN {_KC} kc USING (constraint_name, table_schema, table_name) WHERE t.constraint_type = 'PRIMARY KEY'
UNION ALL
SELECT 2, table_schema, table_name,
  'ALTER TABLE ' || {_q(f"'{AUX}'", 'table_schema', 'table_name')} || ' ADD CONSTRAINT ' || {_qp('constraint_name')}
  || ' FOREIGN KEY (' || qcols || ') REFERENCES ' || {_q('ref_catalog', 'ref_schema', 'ref_table')} || ' (' || ref_qcols || ')'
FROM {_FK} fk""")
def q_constraint_plan(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return st.constraint_plan(f["m_table_constraints"], f["m_key_column_usage"], f["m_referential_constraints"],
                              CATALOG, AUX)


_TAGVAL = "coalesce(tag_value, '')"
_PAIR = f"('''' || tag_name || ''' = ' || {_lit(_TAGVAL)})"


@_register("tag_pairs", f"""
SELECT table_schema, table_name, string_agg({_PAIR}, ', ' ORDER BY tag_name, {_PAIR}) AS tags
FROM m_tags WHERE upper(object_type) = 'TABLE' GROUP BY table_schema, table_name""")
def q_tag_pairs(spark, sf_dir):
    return tg.table_tag_pairs(_fx(spark, sf_dir)["m_tags"]).select("table_schema", "table_name", "tags")


@_register("column_tag_pairs", f"""
SELECT table_schema, table_name, column_name, string_agg({_PAIR}, ', ' ORDER BY tag_name, {_PAIR}) AS tags
FROM m_tags WHERE upper(object_type) = 'COLUMN' GROUP BY table_schema, table_name, column_name""")
def q_column_tag_pairs(spark, sf_dir):
    return tg.column_tag_pairs(_fx(spark, sf_dir)["m_tags"]).select("table_schema", "table_name", "column_name", "tags")


@_register("tag_plan", f"""
WITH tt AS (SELECT table_schema, table_name, CASE WHEN cls IN ('view', 'metric_view') THEN 'VIEW' ELSE 'TABLE' END AS kw,
    {_TGT_TABLE} AS target_q FROM {_CLASSIFIED} c WHERE cls IN ('managed', 'view', 'mv', 'metric_view')),
g AS (SELECT x.table_schema, x.table_name, CASE WHEN upper(x.object_type) = 'COLUMN' THEN x.column_name END AS column_name,
    x.tag_name, x.tag_value, tt.kw, tt.target_q FROM m_tags x JOIN tt USING (table_schema, table_name)
  WHERE upper(x.object_type) IN ('TABLE', 'COLUMN')),
a AS (SELECT *, 'ALTER ' || kw || ' ' || target_q || CASE WHEN column_name IS NOT NULL THEN ' ALTER COLUMN ' || {_qp('column_name')}
    ELSE '' END || ' SET TAGS (' AS alter_txt, {_PAIR} AS pair FROM g)
SELECT table_schema, table_name, column_name, alter_txt || pair || ')' AS statement, 'single' AS mode FROM a
UNION ALL SELECT table_schema, table_name, column_name, alter_txt || string_agg(pair, ', ' ORDER BY tag_name, pair) || ')', 'batch'
FROM a GROUP BY table_schema, table_name, column_name, alter_txt""")
def q_tag_plan(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return st.tag_plan(f["m_tables"], f["m_tags"], CATALOG, AUX)


@_register("table_metadata", f"""
WITH base AS (SELECT table_schema, table_name, coalesce(comment, '') AS comment, coalesce(table_owner, '') AS table_owner,
    '{CATALOG}.' || table_schema || '.' || table_name AS object_key FROM {_CLASSIFIED} c WHERE cls = 'managed'),
tt AS (SELECT table_schema, table_name, string_agg({_PAIR}, ', ' ORDER BY tag_name, {_PAIR}) AS tags
  FROM m_tags WHERE upper(object_type) = 'TABLE' GROUP BY table_schema, table_name),
ct AS (SELECT table_schema, table_name, count(*) AS n FROM m_tags WHERE upper(object_type) = 'COLUMN' GROUP BY table_schema, table_name),
pk AS (SELECT t.table_schema, t.table_name, min(t.constraint_name) AS pk_name, arg_min(kc.cols, t.constraint_name) AS pk_cols
  FROM m_table_constraints t JOIN {_KC} kc USING (constraint_name, table_schema, table_name)
  WHERE t.constraint_type = 'PRIMARY KEY' GROUP BY t.table_schema, t.table_name),
fk AS (SELECT table_schema, table_name, count(*) AS n_fks FROM {_FK} f GROUP BY table_schema, table_name),
g AS (SELECT object_key, count(*) AS n_grants FROM (SELECT DISTINCT object_key, principal, action_type FROM m_grants
  WHERE upper(object_type) = 'TABLE' AND upper(action_type) NOT IN ('OWN', 'OWNERSHIP')) d GROUP BY object_key)
SELECT base.table_schema, base.table_name, base.comment, coalesce(tt.tags, '') AS table_tags, coalesce(ct.n, 0) AS n_column_tags,
  coalesce(pk.pk_name, '') AS pk_name, coalesce(pk.pk_cols, '') AS pk_cols, coalesce(fk.n_fks, 0) AS n_fks,
  coalesce(g.n_grants, 0) AS n_grants, base.table_owner
FROM base LEFT JOIN tt USING (table_schema, table_name) LEFT JOIN ct USING (table_schema, table_name)
LEFT JOIN pk USING (table_schema, table_name) LEFT JOIN fk USING (table_schema, table_name) LEFT JOIN g USING (object_key)""")
def q_table_metadata(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return meta.table_metadata(f["m_tables"], f["m_tags"], f["m_table_constraints"], f["m_key_column_usage"],
                               f["m_referential_constraints"], f["m_grants"], CATALOG, AUX)


@_register("function_ddl", f"""
WITH pl AS (SELECT specific_schema AS routine_schema, specific_name AS routine_name,
    string_agg({_qp('parameter_name')} || ' ' || full_data_type, ', ' ORDER BY ordinal_position) AS param_list
  FROM m_parameters WHERE parameter_mode = 'IN' GROUP BY specific_schema, specific_name),
r AS (SELECT m.*, pl.param_list, upper(coalesce(routine_body, '')) AS b, upper(coalesce(external_language, '')) AS l,
    coalesce(routine_definition IS NOT NULL AND routine_definition <> '', false) AS has_def
  FROM m_routines m LEFT JOIN pl USING (routine_schema, routine_name) WHERE routine_schema <> 'information_schema')
SELECT routine_schema, routine_name, CASE WHEN has_def THEN 'PLANNED' ELSE 'SKIPPED' END AS status,
  CASE WHEN NOT has_def THEN '{rtn.NO_DEFINITION}'
       WHEN b <> 'SQL' AND NOT (b = 'EXTERNAL' AND l = 'PYTHON') THEN 'Unsupported function type (' || b || '/' || l || '). Attempting SQL RETURN.'
  END AS warning,
  CASE WHEN has_def THEN 'CREATE FUNCTION ' || {_q(f"'{AUX}'", 'routine_schema', 'routine_name')} || '(' || coalesce(param_list, '') || ')'
    || {_NL} || 'RETURNS ' || full_data_type
    || CASE WHEN coalesce(comment, '') <> '' THEN {_NL} || 'COMMENT ' || {_lit('comment')} ELSE '' END
    || CASE WHEN upper(coalesce(is_deterministic, '')) = 'YES' THEN {_NL} || 'DETERMINISTIC' ELSE '' END
    || CASE WHEN b = 'SQL' THEN {_NL} || 'RETURN ' || routine_definition
            WHEN b = 'EXTERNAL' AND l = 'PYTHON' THEN {_NL} || 'LANGUAGE PYTHON' || {_NL} || 'AS $$' || {_NL} || routine_definition || {_NL} || '$$'
            ELSE {_NL} || 'RETURN ' || routine_definition END
  END AS ddl
FROM r""")
def q_function_ddl(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return rtn.function_ddl(f["m_routines"], f["m_parameters"], AUX)


# ---------------------------------------------------------------- plans

# ((k,v),(k2,v2)) -> ('k' = 'v', 'k2' = 'v2'), as plans.statements.properties_clause
_PROPS_RE = r"'\(([^(),]+),([^()]*)\)'"
_PROPS_TO = r"'''\1'' = ''\2'''"
_PROPS_CLAUSE = f"replace(regexp_replace(props, {_PROPS_RE}, {_PROPS_TO}, 'g'), ''',''', ''', ''')"

@_register("schema_plan", f"""
WITH s AS (SELECT m.schema_name, coalesce(d.comment, '') AS cmt, coalesce(d.properties, '') AS props
  FROM m_schemata m LEFT JOIN {_DESCRIBE} d ON d.object_name = m.schema_name WHERE m.schema_name <> 'information_schema'),
x AS (SELECT schema_name, CASE WHEN lower(schema_name) = 'default' AND cmt <> '' THEN 'COMMENT ON SCHEMA ' || {_q(f"'{AUX}'", 'schema_name')} || ' IS ' || {_lit('cmt')}
    WHEN lower(schema_name) <> 'default' THEN 'CREATE SCHEMA ' || {_q(f"'{AUX}'", 'schema_name')}
      || CASE WHEN cmt <> '' THEN ' COMMENT ' || {_lit('cmt')} ELSE '' END END AS statement FROM s
  UNION ALL SELECT schema_name, CASE WHEN props NOT IN ('', '(())') THEN 'ALTER SCHEMA ' || {_q(f"'{AUX}'", 'schema_name')}
    || ' SET DBPROPERTIES ' || {_PROPS_CLAUSE} END FROM s)
SELECT 'SCHEMA' AS object_type, '{CATALOG}.' || schema_name AS object_name, statement FROM x WHERE statement IS NOT NULL""")
def q_schema_plan(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return st.schema_plan(f["m_schemata"], f["m_describe_kv"], CATALOG, AUX).select(
        "object_type", "object_name", "statement")


@_register("comment_plan", f"""
SELECT {_OBJTYPE} AS object_type, '{CATALOG}.' || table_schema || '.' || table_name AS object_name,
  'COMMENT ON TABLE ' || {_TGT_TABLE} || ' IS ' || {_lit('comment')} AS statement
FROM {_CLASSIFIED} c WHERE cls IN ('managed', 'view', 'mv') AND coalesce(comment, '') <> ''""")
def q_comment_plan(spark, sf_dir):
    return st.comment_plan(_fx(spark, sf_dir)["m_tables"], CATALOG, AUX)


@_register("owner_plan", f"""
SELECT 'SCHEMA' AS object_type, '{CATALOG}.' || m.schema_name AS object_name,
  'ALTER SCHEMA ' || {_q(f"'{AUX}'", 'm.schema_name')} || ' SET OWNER TO ' || {_qp('d.owner')} AS statement
FROM m_schemata m LEFT JOIN {_DESCRIBE} d ON d.object_name = m.schema_name
WHERE m.schema_name <> 'information_schema' AND coalesce(d.owner, '') <> ''
UNION ALL SELECT {_OBJTYPE}, '{CATALOG}.' || table_schema || '.' || table_name,
  'ALTER ' || CASE WHEN cls IN ('view', 'metric_view') THEN 'VIEW' ELSE 'TABLE' END || ' ' || {_TGT_TABLE} || ' SET OWNER TO ' || {_qp('table_owner')}
FROM {_CLASSIFIED} c WHERE cls IN ('managed', 'view', 'mv', 'metric_view') AND coalesce(table_owner, '') <> ''
UNION ALL SELECT 'FUNCTION', '{CATALOG}.' || routine_schema || '.' || routine_name,
  'ALTER FUNCTION ' || {_q(f"'{AUX}'", 'routine_schema', 'routine_name')} || ' SET OWNER TO ' || {_qp('routine_owner')}
FROM m_routines WHERE routine_schema <> 'information_schema' AND coalesce(routine_owner, '') <> ''""")
def q_owner_plan(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return st.owner_plan(f["m_schemata"], f["m_describe_kv"], f["m_tables"], f["m_routines"], CATALOG, AUX)


@_register("grant_plan", f"""
SELECT object_type, object_key AS object_name,
  'GRANT ' || action_type || ' ON ' || upper(object_type) || ' ' ||
  CASE WHEN upper(object_type) = 'CATALOG' THEN {_qp("CASE WHEN upper(object_type) = 'VIEW' THEN '" + CATALOG + "' ELSE '" + AUX + "' END")}
       WHEN upper(object_type) = 'SCHEMA' THEN {_qp("CASE WHEN upper(object_type) = 'VIEW' THEN '" + CATALOG + "' ELSE '" + AUX + "' END")}
         || '.' || {_qp("split_part(object_key, '.', 2)")}
       ELSE {_qp("CASE WHEN upper(object_type) = 'VIEW' THEN '" + CATALOG + "' ELSE '" + AUX + "' END")}
         || '.' || {_qp("split_part(object_key, '.', 2)")} || '.' || {_qp("substr(object_key, length(split_part(object_key, '.', 1)) + length(split_part(object_key, '.', 2)) + 3)")} END
  || ' TO ' || {_qp('principal')} AS statement
FROM {_direct('m_grants')} d WHERE upper(action_type) NOT IN ('OWN', 'OWNERSHIP')""")
def q_grant_plan(spark, sf_dir):
    f = _fx(spark, sf_dir)
    direct = acc.direct_grants(f["m_grants"], acc.securables(f["m_schemata"], f["m_tables"], CATALOG))
    return st.grant_plan(direct, CATALOG, AUX)


# ---------------------------------------------------------------- grants and access

@_register("direct_grants", f"SELECT * FROM {_direct('m_grants')} d")
def q_direct_grants(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return acc.direct_grants(f["m_grants"], acc.securables(f["m_schemata"], f["m_tables"], CATALOG))


@_register("grant_diff", f"""
SELECT DISTINCT upper(object_type) AS object_type, object_key, principal, action_type FROM {_direct('m_grants')} o
WHERE upper(object_type) IN ('CATALOG', 'SCHEMA') AND upper(action_type) NOT IN ('OWN', 'OWNERSHIP')
EXCEPT
SELECT DISTINCT upper(object_type), object_key, principal, action_type FROM {_direct('m_grants_new')} n
WHERE upper(object_type) IN ('CATALOG', 'SCHEMA') AND upper(action_type) NOT IN ('OWN', 'OWNERSHIP')""")
def q_grant_diff(spark, sf_dir):
    f = _fx(spark, sf_dir)
    sec = acc.securables(f["m_schemata"], f["m_tables"], CATALOG)
    return acc.grant_diff(acc.direct_grants(f["m_grants"], sec), acc.direct_grants(f["m_grants_new"], sec),
                          CATALOG, CATALOG)




@_register("grant_apply_stats", """
SELECT object_name, count_if(status = 'SUCCESS') AS succeeded, count_if(status IN ('FAILED', 'ERROR')) AS failed,
  count_if(status = 'SKIPPED') AS skipped
FROM m_grant_log WHERE phase = 'grants' GROUP BY object_name""")
def q_grant_apply_stats(spark, sf_dir):
    return acc.grant_apply_stats(_fx(spark, sf_dir)["m_grant_log"])


@_register("effective_privileges", f"""
SELECT object_key, principal, string_agg(a, ', ' ORDER BY a) AS actions,
  bool_or(a IN ('CREATECATALOG', 'ALLPRIVILEGES')) AS can_create
FROM (SELECT DISTINCT object_key, principal, {_norm('action_type')} AS a FROM m_grants) g GROUP BY object_key, principal""")
def q_effective_privileges(spark, sf_dir):
    return acc.effective_privileges(_fx(spark, sf_dir)["m_grants"])


ADMIN_OWNER = "g_7"


@_register("admin_check", f"""
WITH p AS (SELECT DISTINCT principal FROM m_grants),
m AS (SELECT principal, count(*) AS n_groups, count_if(group_name = '{ADMIN_OWNER}') AS n_owner FROM m_memberships GROUP BY principal)
SELECT p.principal, CASE WHEN p.principal = '{ADMIN_OWNER}' THEN true WHEN m.n_groups IS NULL THEN NULL ELSE m.n_owner > 0 END AS is_admin
FROM p LEFT JOIN m USING (principal)""")
def q_admin_check(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return acc.admin_check(f["m_grants"], f["m_memberships"], ADMIN_OWNER)


@_register("inherited_privileges", f"""
WITH RECURSIVE
e AS (SELECT DISTINCT principal, group_name FROM m_nested_members),
closed(principal, holder) AS (SELECT principal, group_name FROM e UNION SELECT c.principal, e.group_name FROM closed c JOIN e ON e.principal = c.holder),
a AS (SELECT DISTINCT principal, object_key FROM m_asked),
up AS (SELECT principal, object_key, array_to_string(string_split(object_key, '.')[1:n], '.') AS obj FROM a, range(1, 4) t(n)),
who AS (SELECT principal, holder FROM closed UNION SELECT principal, principal FROM a),
held AS (SELECT DISTINCT principal AS holder, object_key AS obj, upper(object_type) AS kind, {_norm('action_type')} AS action FROM m_group_grants
  WHERE upper(action_type) NOT IN ('OWN', 'OWNERSHIP')),
got AS (SELECT up.principal, object_key, string_agg(DISTINCT action, ', ' ORDER BY action) AS actions, count(*) AS sources
  FROM up JOIN who ON who.principal = up.principal JOIN held ON held.holder = who.holder AND held.obj = up.obj GROUP BY up.principal, object_key)
SELECT a.principal, a.object_key, coalesce(actions, '') AS actions, coalesce(sources, 0) AS sources
FROM a LEFT JOIN got ON got.principal = a.principal AND got.object_key = a.object_key""")
def q_inherited_privileges(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return acc.inherited_privileges(f["m_asked"], f["m_group_grants"], f["m_nested_members"])


@_register("name_collisions", """
SELECT c.catalog,
  CASE WHEN EXISTS (SELECT 1 FROM m_catalogs x WHERE x.catalog = c.catalog || '_aux') THEN 'FAIL' ELSE 'OK' END AS aux,
  CASE WHEN EXISTS (SELECT 1 FROM m_catalogs x WHERE x.catalog = c.catalog || '_bkp') THEN 'FAIL' ELSE 'OK' END AS bkp
FROM m_catalogs c""")
def q_name_collisions(spark, sf_dir):
    return acc.name_collisions(_fx(spark, sf_dir)["m_catalogs"])


@_register("affected_shares", f"""
SELECT DISTINCT share_name FROM m_share_objects WHERE starts_with(lower(coalesce(object_name, '')), '{CATALOG.lower()}.')""")
def q_affected_shares(spark, sf_dir):
    return acc.affected_shares(_fx(spark, sf_dir)["m_share_objects"], CATALOG)


# ---------------------------------------------------------------- clone, digest, validation

from vaultshift.operators import clone as cl  # noqa: E402
from vaultshift.operators import validate as val  # noqa: E402
from vaultshift.sources.fixtures import BASE_TABLES  # noqa: E402

MISSING_ON_NEW = "labels"   # the new side lacks this table (row-count ERROR case)
EDITED = {"orders": "m_orders_new", "lineitem": "m_lineitem_new"}


_CLONES: dict[tuple, list] = {}


def _clone_all(spark, sf_dir, label: str, edited: bool):
    """Copy every base table to a fresh folder of the shared root (once per
    session; later queries of the same session read the same copies).

    ``edited``: the new side of the validation fixtures (orders and lineitem
    edited, one table left out).
    """
    key = (spark.sparkContext.applicationId, sf_dir, edited)
    if key not in _CLONES:
        _CLONES[key] = _clone_all_now(spark, sf_dir, label, edited)
    return _CLONES[key]


def _clone_all_now(spark, sf_dir, label: str, edited: bool):
    from vaultshift.session import fresh_dir

    f = _fx(spark, sf_dir)
    sources = {t: f[t] for t in BASE_TABLES}
    if edited:
        sources.pop(MISSING_ON_NEW)
        for t, rel in EDITED.items():
            sources[t] = f[rel]
    return cl.clone_tables(spark, sources, fresh_dir(spark, label))


def _new_side(spark, sf_dir):
    results = _clone_all(spark, sf_dir, "migrated", edited=True)
    return {r.table_name: spark.read.parquet(r.target) for r in results if r.status == "SUCCESS"}


def _counts_sql(col: str, tables: dict[str, str]) -> str:
    return "\n  UNION ALL ".join(f"SELECT '{t}' AS object_name, count(*) AS {col} FROM {rel}" for t, rel in tables.items())


_ORIG_TABLES = {t: t for t in BASE_TABLES}
_NEW_TABLES = {t: EDITED.get(t, t) for t in BASE_TABLES if t != MISSING_ON_NEW}
_ROWCOUNT_SQL = f"""(SELECT object_name, n.new, o.original,
  CASE WHEN n.new IS NULL OR o.original IS NULL THEN 'ERROR' WHEN n.new = o.original THEN 'PASS' ELSE 'FAIL' END AS status,
  'new=' || coalesce(CAST(n.new AS VARCHAR), 'missing') || ' original=' || coalesce(CAST(o.original AS VARCHAR), 'missing') AS message
FROM ({_counts_sql('original', _ORIG_TABLES)}) o FULL JOIN ({_counts_sql('new', _NEW_TABLES)}) n USING (object_name))"""


@_register("clone_table", "\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS rows, 'SUCCESS' AS status FROM {t}" for t in BASE_TABLES))
def q_clone_table(spark, sf_dir):
    return cl.clone_report(spark, _clone_all(spark, sf_dir, "clone", edited=False)).select(
        "table_name", "rows", "status")


def _multiset_equal_sql(a: str, b: str) -> str:
    return (f"((SELECT count(*) FROM (SELECT * FROM {a} EXCEPT ALL SELECT * FROM {b}) x) = 0 AND "
            f"(SELECT count(*) FROM (SELECT * FROM {b} EXCEPT ALL SELECT * FROM {a}) y) = 0)")


@_register("digest_check", "\nUNION ALL ".join(
    [f"SELECT '{t}' AS table_name, true AS equal" for t in BASE_TABLES]
    + [f"SELECT '{t}_edited', {_multiset_equal_sql(t, rel)}" for t, rel in EDITED.items()]
    + ["SELECT 'lineitem_reordered', true"]))
def q_digest_check(spark, sf_dir):
    from pyspark.sql import functions as F

    f = _fx(spark, sf_dir)
    rows = [(r.table_name, r.status == "SUCCESS" and r.digest_source == r.digest_target)
            for r in _clone_all(spark, sf_dir, "digest", edited=False)]
    shuffled = f["lineitem"].repartition("l_suppkey").sortWithinPartitions(F.desc("l_partkey"))
    sides = {"orders": f["orders"], "orders_new": f["m_orders_new"], "lineitem": f["lineitem"],
             "lineitem_new": f["m_lineitem_new"], "lineitem_shuffled": shuffled}
    # all comparison digests in one job: a union of row hashes tagged by side
    tagged = None
    for side, df in sides.items():
        part = df.select(F.lit(side).alias("side"), cl.row_hash(df).alias("_h"))
        tagged = part if tagged is None else tagged.unionByName(part)
    dg = {r["side"]: tuple(r[k] for k in cl.DIGEST_FIELDS)
          for r in tagged.groupBy("side").agg(*cl.digest_columns(F.col("_h"))).collect()}
    rows += [("orders_edited", dg["orders"] == dg["orders_new"]),
             ("lineitem_edited", dg["lineitem"] == dg["lineitem_new"]),
             ("lineitem_reordered", dg["lineitem"] == dg["lineitem_shuffled"])]
    return spark.createDataFrame(rows, "table_name string, equal boolean")


@_register("rowcount_check", f"SELECT object_name, new, original, status FROM {_ROWCOUNT_SQL} r")
def q_rowcount_check(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return val.rowcount_check(_new_side(spark, sf_dir), {t: f[t] for t in BASE_TABLES}).select(
        "object_name", "new", "original", "status")


def _kinds_sql(tables_rel: str, side: str) -> str:
    return f"""SELECT '{side}' AS side, 'schema' AS kind FROM m_schemata WHERE schema_name <> 'information_schema'
  UNION ALL SELECT '{side}', {_CLASS} FROM {tables_rel} WHERE table_schema <> 'information_schema'
  UNION ALL SELECT '{side}', CASE WHEN volume_type = 'MANAGED' THEN 'volume' ELSE 'external_volume' END FROM m_volumes
    WHERE volume_schema <> 'information_schema'
  UNION ALL SELECT '{side}', 'function' FROM m_routines WHERE routine_schema <> 'information_schema'"""


_COUNT_CHECK_SQL = "(SELECT object_name, new, original, CASE WHEN new = original THEN 'PASS' ELSE 'FAIL' END AS status FROM (" + \
    "\n  UNION ALL ".join(
        f"SELECT '{name}' AS object_name, count_if(side = 'new' AND kind = '{kind}') AS new, "
        f"count_if(side = 'original' AND kind = '{kind}') AS original FROM k"
        for name, kind in val.COUNT_CHECKS) + ") c)"


@_register("count_check", f"""
WITH k AS ({_kinds_sql('m_tables', 'original')} UNION ALL {_kinds_sql('m_tables_new', 'new')})
SELECT * FROM {_COUNT_CHECK_SQL} cc""")
def q_count_check(spark, sf_dir):
    f = _fx(spark, sf_dir)
    orig = {"schemata": f["m_schemata"], "tables": f["m_tables"], "volumes": f["m_volumes"], "routines": f["m_routines"]}
    new = dict(orig, tables=f["m_tables_new"])
    return val.count_check(orig, new).select("object_name", "new", "original", "status")


_GRANT_CHECK_SQL = f"""(SELECT s.object_key AS object_name, CASE WHEN coalesce(m.missing, 0) > 0 THEN 'FAIL' ELSE 'PASS' END AS status
FROM (SELECT * FROM {_SEC} s0 WHERE object_type IN ('CATALOG', 'SCHEMA')) s LEFT JOIN (
  SELECT object_key, count(*) AS missing FROM (
    SELECT DISTINCT upper(object_type) AS object_type, object_key, principal, action_type FROM {_direct('m_grants')} o
    WHERE upper(object_type) IN ('CATALOG', 'SCHEMA') AND upper(action_type) NOT IN ('OWN', 'OWNERSHIP')
    EXCEPT
    SELECT DISTINCT upper(object_type), object_key, principal, action_type FROM {_direct('m_grants_new')} n
    WHERE upper(object_type) IN ('CATALOG', 'SCHEMA') AND upper(action_type) NOT IN ('OWN', 'OWNERSHIP')) d
  GROUP BY object_key) m ON m.object_key = s.object_key)"""


@_register("grant_check", f"SELECT * FROM {_GRANT_CHECK_SQL} g")
def q_grant_check(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return val.grant_checks(f["m_grants"], f["m_grants_new"], f["m_schemata"], CATALOG).select("object_name", "status")


@_register("validation_verdict", f"""
WITH k AS ({_kinds_sql('m_tables', 'original')} UNION ALL {_kinds_sql('m_tables_new', 'new')}),
checks AS (SELECT status FROM {_COUNT_CHECK_SQL} a UNION ALL SELECT status FROM {_ROWCOUNT_SQL} b
  UNION ALL SELECT status FROM {_GRANT_CHECK_SQL} c),
fails AS (SELECT count(*) AS failures FROM m_log WHERE batch_id = '{BATCH}' AND status IN ('FAILED', 'ERROR'))
SELECT count(*) AS checks, count_if(status <> 'PASS') AS failed, (SELECT failures FROM fails) AS failures,
  CASE WHEN count_if(status <> 'PASS') = 0 AND (SELECT failures FROM fails) = 0 THEN '{val.VERDICT_OK}'
       WHEN count_if(status <> 'PASS') = 0 THEN '{val.VERDICT_WARN}' ELSE '{val.VERDICT_FAIL}' END AS verdict
FROM checks""")
def q_validation_verdict(spark, sf_dir):
    f = _fx(spark, sf_dir)
    orig = {"schemata": f["m_schemata"], "tables": f["m_tables"], "volumes": f["m_volumes"], "routines": f["m_routines"]}
    checks = (
        val.count_check(orig, dict(orig, tables=f["m_tables_new"])).select("status")
        .unionByName(val.rowcount_check(_new_side(spark, sf_dir), {t: f[t] for t in BASE_TABLES}).select("status"))
        .unionByName(val.grant_checks(f["m_grants"], f["m_grants_new"], f["m_schemata"], CATALOG).select("status"))
    )
    return val.verdict(checks, alog.failure_count(f["m_log"], BATCH).withColumnRenamed("failures", "failures"))


_ORDER_COLS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@_register("row_diff", f"""
SELECT change, count(*) AS n FROM (
  SELECT CASE WHEN n.o_orderkey IS NULL THEN 'removed' WHEN o.o_orderkey IS NULL THEN 'added'
    WHEN {' AND '.join(f'o.{c} IS NOT DISTINCT FROM n.{c}' for c in _ORDER_COLS)} THEN 'unchanged' ELSE 'changed' END AS change
  FROM orders o FULL JOIN m_orders_new n ON o.o_orderkey = n.o_orderkey) d
GROUP BY change""")
def q_row_diff(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return val.row_diff(f["orders"], f["m_orders_new"], ["o_orderkey"])


@_register("row_diff_multiset", """
SELECT 'removed' AS change, count(*) AS n FROM (SELECT * FROM lineitem EXCEPT ALL SELECT * FROM m_lineitem_new) a HAVING count(*) > 0
UNION ALL SELECT 'added', count(*) FROM (SELECT * FROM m_lineitem_new EXCEPT ALL SELECT * FROM lineitem) b HAVING count(*) > 0""")
def q_row_diff_multiset(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return val.row_diff_multiset(f["lineitem"], f["m_lineitem_new"])


from vaultshift.operators import reconcile as rec  # noqa: E402


@_register("row_diff_ranges", f"""
WITH u AS (SELECT coalesce(o.o_orderkey, n.o_orderkey) AS k, o.o_orderkey IS NOT NULL AS in_o, n.o_orderkey IS NOT NULL AS in_n,
    o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR NOT ({' AND '.join(f'o.{c} IS NOT DISTINCT FROM n.{c}' for c in _ORDER_COLS)}) AS d
  FROM orders o FULL JOIN m_orders_new n ON o.o_orderkey = n.o_orderkey),
b AS (SELECT min(k) AS low, max(k) AS high FROM u),
top AS (SELECT min(i) AS top FROM range(0, 11) t(i), b WHERE CAST(pow({rec.FAN}, i) AS BIGINT) >= high - low + 1),
lv AS (SELECT CAST(i AS INTEGER) AS level, CAST(pow({rec.FAN}, top - i) AS BIGINT) AS w FROM range(0, 11) t(i), top WHERE i <= top),
r AS (SELECT level, w, low + ((k - low) // w) * w AS lo, least(low + ((k - low) // w) * w + w - 1, any_value(high)) AS hi, count_if(in_o) AS rows_original,
    count_if(in_n) AS rows_new, bool_or(d) AS differs, count_if(d AND in_o) AS n_removed, count_if(d AND in_n) AS n_added
  FROM u, b, lv GROUP BY level, w, low, (k - low) // w)
SELECT r.level, r.lo, r.hi, r.rows_original, r.rows_new, r.differs,
  CASE WHEN r.differs AND (greatest(r.rows_original, r.rows_new) <= {rec.LEAF} OR r.w = 1) THEN r.n_removed END AS removed,
  CASE WHEN r.differs AND (greatest(r.rows_original, r.rows_new) <= {rec.LEAF} OR r.w = 1) THEN r.n_added END AS added
FROM r, b LEFT JOIN r p ON p.level = r.level - 1 AND p.lo = low + ((r.lo - low) // p.w) * p.w
WHERE r.level = 0 OR (p.differs AND greatest(p.rows_original, p.rows_new) > {rec.LEAF})""")
def q_row_diff_ranges(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return rec.row_diff_ranges(f["orders"], f["m_orders_new"], ["o_orderkey"])


_TABLE_LIST = ", ".join(f"'{t}'" for t in BASE_TABLES)


@_register("schema_diff", f"""
WITH oc AS (SELECT DISTINCT table_name, column_name, ordinal_position AS pos, data_type FROM information_schema.columns
  WHERE table_name IN ({_TABLE_LIST})),
nc AS (SELECT table_name, CASE WHEN table_name = 'customer' AND column_name = 'c_acctbal' THEN 'c_balance' ELSE column_name END AS column_name,
    row_number() OVER (PARTITION BY table_name ORDER BY pos) AS pos,
    CASE WHEN table_name = 'orders' AND column_name = 'o_totalprice' THEN 'DECIMAL(12,2)' ELSE data_type END AS data_type
  FROM oc WHERE NOT (table_name = 'lineitem' AND column_name = 'l_tax')),
j AS (SELECT coalesce(oc.table_name, nc.table_name) AS table_name, coalesce(oc.column_name, nc.column_name) AS column_name,
    oc.pos AS o_pos, nc.pos AS n_pos, oc.data_type AS o_type, nc.data_type AS n_type
  FROM oc FULL JOIN nc ON oc.table_name = nc.table_name AND oc.column_name = nc.column_name)
SELECT table_name, column_name, 'missing_in_new' AS issue FROM j WHERE n_pos IS NULL
UNION ALL SELECT table_name, column_name, 'added_in_new' FROM j WHERE o_pos IS NULL
UNION ALL SELECT table_name, column_name, 'type_changed' FROM j WHERE o_pos IS NOT NULL AND n_pos IS NOT NULL AND lower(o_type) <> lower(n_type)
UNION ALL SELECT table_name, column_name, 'position_changed' FROM j WHERE o_pos IS NOT NULL AND n_pos IS NOT NULL AND o_pos <> n_pos""")
def q_schema_diff(spark, sf_dir):
    """Both sides by the footers of their files: the copies of all tables, and the same with three tables changed."""
    from pyspark.sql import functions as F

    from vaultshift.session import fresh_dir
    from vaultshift.sources import footers as ft

    f = _fx(spark, sf_dir)
    orig = _clone_all(spark, sf_dir, "clone", edited=False)
    root = orig[0].target.rsplit("/", 1)[0]
    changed = fresh_dir(spark, "schemas-new")
    f["orders"].withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(12,2)")).write.parquet(f"{changed}/orders")
    f["lineitem"].drop("l_tax").write.parquet(f"{changed}/lineitem")
    f["customer"].withColumnRenamed("c_acctbal", "c_balance").write.parquet(f"{changed}/customer")
    old = ft.footers(ft.table_files(spark, root), root)
    same = old.where(~F.col("table_name").isin("orders", "lineitem", "customer"))
    new = same.unionByName(ft.footers(ft.table_files(spark, changed), changed))
    return val.schema_diff(ft.columns_of(old.where("depth = 0")), ft.columns_of(new.where("depth = 0")))


# ---------------------------------------------------------------- volumes (files)

from vaultshift.operators import files as fl  # noqa: E402

_DOC_PATH_SQL = "lang || '/' || source || '/doc_' || CAST(doc_id AS VARCHAR) || '.txt'"


_VOLUMES: dict[tuple, object] = {}


def _once(kind: str, spark, sf_dir, make):
    key = (kind, spark.sparkContext.applicationId, sf_dir)
    if key not in _VOLUMES:
        _VOLUMES[key] = make()
    return _VOLUMES[key]


def _volume(spark, sf_dir):
    return _once("volume", spark, sf_dir, lambda: _volume_now(spark, sf_dir))


def _copy(spark, sf_dir):
    return _once("copy", spark, sf_dir, lambda: _copy_now(spark, sf_dir))


def _volume_now(spark, sf_dir):
    """Lay out ``documents`` as a volume: one UTF-8 file per row at <lang>/<source>/doc_<id>.txt."""
    from pyspark.sql import functions as F

    from vaultshift.session import fresh_dir

    root = fresh_dir(spark, "volume-src")
    docs = _fx(spark, sf_dir)["documents"].select(
        F.concat_ws("/", "lang", "source", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")))
        .alias("path"), "text")
    fl.write_text_files(spark, docs, root).agg(F.count(F.lit(1))).collect()
    return root


def _copy_now(spark, sf_dir):
    """Copy the volume; the per-file results are written once and read back."""
    from vaultshift.session import fresh_dir

    src = _volume(spark, sf_dir)
    dst = fresh_dir(spark, "volume-dst")
    out = fresh_dir(spark, "copy-log")
    files = fl.snapshot_manifest(spark, src, fresh_dir(spark, "manifest"))
    fl.copy_files(spark, files, src, dst).write.parquet(out)
    return src, dst, spark.read.parquet(out), files


@_register("file_manifest", f"SELECT {_DOC_PATH_SQL} AS path, octet_length(encode(text)) AS bytes FROM documents")
def q_file_manifest(spark, sf_dir):
    return fl.manifest(spark, _volume(spark, sf_dir)).select("path", "bytes")


@_register("file_copy", f"""
SELECT {_DOC_PATH_SQL} AS path, octet_length(encode(text)) AS bytes, sha256(text) AS sha2, 'COPIED' AS status FROM documents""")
def q_file_copy(spark, sf_dir):
    return _copy(spark, sf_dir)[2].select("path", "bytes", "sha2", "status")


@_register("file_check", f"SELECT {_DOC_PATH_SQL} AS path, 'OK' AS issue FROM documents")
def q_file_check(spark, sf_dir):
    from vaultshift.session import fresh_dir

    src, dst, copied, files = _copy(spark, sf_dir)
    target = fl.hash_files(spark, fl.snapshot_manifest(spark, dst, fresh_dir(spark, "manifest-dst")), dst)
    return fl.file_check(fl.with_hashes(files, copied), target)


@_register("file_check_edited", f"""
SELECT path, CASE WHEN doc_id % 13 = 0 THEN 'MISSING' WHEN doc_id % 17 = 5 THEN 'SIZE'
  WHEN doc_id % 19 = 3 AND reverse(text) <> text THEN 'CONTENT' ELSE 'OK' END AS issue
FROM (SELECT doc_id, coalesce(text, '') AS text, {_DOC_PATH_SQL} AS path FROM documents) d
UNION ALL SELECT 'extra/doc_' || CAST(doc_id AS VARCHAR) || '.txt', 'EXTRA' FROM documents WHERE doc_id % 23 = 0""")
def q_file_check_edited(spark, sf_dir):
    """The volume against one with files left out, lengthened, altered and added."""
    from pyspark.sql import functions as F

    from vaultshift.session import fresh_dir

    docs = _fx(spark, sf_dir)["documents"].withColumn("text", F.coalesce("text", F.lit("")))
    path = F.concat_ws("/", "lang", "source", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")))
    changed = F.when(F.col("doc_id") % 17 == 5, F.concat("text", F.lit("x"))).when(
        F.col("doc_id") % 19 == 3, F.reverse("text")).otherwise(F.col("text"))
    rows = docs.where("doc_id % 13 <> 0").select(path.alias("path"), changed.alias("text")).unionByName(
        docs.where("doc_id % 23 = 0").select(F.concat(F.lit("extra/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text"))
    dst = fresh_dir(spark, "volume-edited")
    fl.write_text_files(spark, rows, dst).agg(F.count(F.lit(1))).collect()
    src = _volume(spark, sf_dir)
    source = fl.hash_files(spark, fl.snapshot_manifest(spark, src, fresh_dir(spark, "manifest")), src)
    target = fl.hash_files(spark, fl.snapshot_manifest(spark, dst, fresh_dir(spark, "manifest-dst")), dst)
    return fl.file_check(source, target)


from vaultshift.operators import ranges as rg  # noqa: E402

_RANGE, _LEAF = 4096, 1024  # texts are small files; so a long one is many ranges here


@_register("file_copy_ranges", f"""
SELECT path, bytes, greatest(1, CAST(ceil(bytes / {_RANGE}) AS BIGINT)) AS ranges, 'COPIED' AS status,
  sha256(coalesce(array_to_string(list_transform(range(0, CAST(ceil(bytes / {_LEAF}) AS BIGINT)),
    lambda i: sha256(from_hex(substr(h, CAST(i * {2 * _LEAF} + 1 AS BIGINT), {2 * _LEAF})))), ''), '')) AS tree_sha2, true AS equal
FROM (SELECT {_DOC_PATH_SQL} AS path, octet_length(encode(coalesce(text, ''))) AS bytes, hex(encode(coalesce(text, ''))) AS h FROM documents) d""")
def q_file_copy_ranges(spark, sf_dir):
    """The volume copied by byte ranges, then both sides' digests read again."""
    from pyspark.sql import functions as F

    from vaultshift.session import fresh_dir

    src, dst = _volume(spark, sf_dir), fresh_dir(spark, "volume-ranges")
    copied = rg.copy_ranges(spark, fl.snapshot_manifest(spark, src, fresh_dir(spark, "manifest")), src, dst, _RANGE, _LEAF)
    back = rg.digest_ranges(copied.select(F.col("target").alias("path"), "bytes"), dst, 2 * _RANGE, _LEAF).select(
        F.col("path").alias("target"), F.col("tree_sha2").alias("back"))
    return copied.join(back, "target", "left").select(
        "path", "bytes", "ranges", "status", "tree_sha2", F.col("tree_sha2").eqNullSafe(F.col("back")).alias("equal"))


from vaultshift.operators import snapshot as sn  # noqa: E402

_SNAP_LANG = "CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 11 = 0 THEN NULL ELSE lang END"


@_register("clone_snapshot", f"""
SELECT lang, source, count(*) AS rows, CAST(sum(doc_id) AS BIGINT) AS ids, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS bytes,
  true AS files_equal, 'gold' AS quality
FROM (SELECT doc_id, text, source, {_SNAP_LANG} AS lang FROM documents) d GROUP BY lang, source""")
def q_clone_snapshot(spark, sf_dir):
    """``documents`` as a snapshot table by language (empty and null ones too) and source, cloned file by file and read back."""
    from pyspark.sql import functions as F

    from vaultshift.session import fresh_dir

    src, dst = fresh_dir(spark, "snapshot"), fresh_dir(spark, "snapshot-clone")
    docs = _fx(spark, sf_dir)["documents"].withColumn("lang", F.expr(_SNAP_LANG))
    sn.write_table(docs, src, ("lang", "source"), {"quality": "gold"})
    equal = sn.clone_snapshot(spark, src, dst).where("status <> 'COPIED'").isEmpty()
    return sn.read_table(spark, dst).groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("doc_id").alias("ids"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).cast("bigint").alias("bytes")
    ).withColumn("files_equal", F.lit(equal)).withColumn("quality", F.lit(sn.properties_of(spark, dst)["quality"]))


# ---------------------------------------------------------------- views, publish

from vaultshift.operators import publish as pub  # noqa: E402
from vaultshift.operators import views as vw  # noqa: E402


@_register("view_capture", f"""
SELECT c.table_schema, c.table_name, c.table_type, v.ddl, CASE WHEN cls = 'view' THEN v.view_body END AS view_body,
  (v.ddl IS NOT NULL OR (CASE WHEN cls = 'view' THEN v.view_body END) IS NOT NULL) AS captured
FROM {_CLASSIFIED} c LEFT JOIN m_views v ON v.table_schema = c.table_schema AND v.table_name = c.table_name
WHERE cls IN ('view', 'mv')""")
def q_view_capture(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return vw.view_capture(f["m_tables"], f["m_views"])


@_register("metric_view_capture", f"""
SELECT table_schema, table_name, yaml_body, yaml_body IS NOT NULL AS captured FROM (
  SELECT c.table_schema, c.table_name, coalesce(v.yaml_body, (SELECT min(d.info_value) FROM m_describe_kv d
      WHERE trim(d.info_name) = 'View Text' AND d.object_name = c.table_schema || '.' || c.table_name)) AS yaml_body
  FROM {_CLASSIFIED} c LEFT JOIN m_views v ON v.table_schema = c.table_schema AND v.table_name = c.table_name
  WHERE cls = 'metric_view') x""")
def q_metric_view_capture(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return vw.metric_view_capture(f["m_tables"], f["m_views"], f["m_describe_kv"])


_VTGT = _q(f"'{CATALOG}'", 'c.table_schema', 'c.table_name')


@_register("recreate_plan", f"""
SELECT object_type, object_name, CASE WHEN reason IS NULL THEN 'PLANNED' ELSE 'SKIPPED' END AS status, reason, statement, fallback
FROM (SELECT CASE cls WHEN 'view' THEN 'VIEW' WHEN 'mv' THEN 'MATERIALIZED_VIEW' ELSE 'METRIC_VIEW' END AS object_type,
  '{CATALOG}.' || c.table_schema || '.' || c.table_name AS object_name,
  CASE WHEN cls = 'mv' AND v.ddl IS NULL THEN '{vw.NO_DDL}'
       WHEN cls = 'view' AND v.ddl IS NULL AND v.view_body IS NULL THEN '{vw.NO_DDL}'
       WHEN cls = 'metric_view' AND v.yaml_body IS NULL THEN '{vw.NO_YAML}' END AS reason,
  CASE WHEN cls = 'metric_view' THEN CASE WHEN v.yaml_body IS NOT NULL THEN 'CREATE VIEW ' || {_VTGT} || {_NL} || 'WITH METRICS'
      || {_NL} || 'LANGUAGE YAML' || CASE WHEN coalesce(c.comment, '') <> '' THEN {_NL} || 'COMMENT ' || {_lit('c.comment')} ELSE '' END
      || {_NL} || 'AS $$' || {_NL} || v.yaml_body || {_NL} || '$$' END
    ELSE v.ddl END AS statement,
  CASE WHEN cls = 'view' AND v.view_body IS NOT NULL THEN 'CREATE VIEW ' || {_VTGT}
      || CASE WHEN coalesce(c.comment, '') <> '' THEN ' COMMENT ' || {_lit('c.comment')} ELSE '' END || ' AS ' || v.view_body END AS fallback
FROM {_CLASSIFIED} c LEFT JOIN m_views v ON v.table_schema = c.table_schema AND v.table_name = c.table_name
WHERE cls IN ('view', 'mv', 'metric_view')) p""")
def q_recreate_plan(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return vw.recreate_plan(f["m_tables"], f["m_views"], CATALOG, warehouse=True)


@_register("recreate_order", f"""
WITH RECURSIVE
v AS (SELECT tid AS view_id FROM {_CLASSIFIED} c WHERE cls IN ('view', 'metric_view')),
d AS (SELECT view_id, dep_id FROM m_view_deps UNION SELECT view_id, dep_id FROM m_view_missing),
ex AS (SELECT tid AS id FROM {_CLASSIFIED} c WHERE cls IN ('managed', 'mv')),
edges AS (SELECT view_id, dep_id FROM d WHERE view_id IN (SELECT view_id FROM v) AND dep_id IN (SELECT view_id FROM v)),
bad AS (SELECT DISTINCT view_id FROM d WHERE dep_id NOT IN (SELECT view_id FROM v) AND dep_id NOT IN (SELECT id FROM ex)),
down(view_id) AS (SELECT view_id FROM bad UNION SELECT e.view_id FROM edges e JOIN down ON e.dep_id = down.view_id),
paths(view_id, depth) AS (SELECT view_id, 0 FROM v
  UNION SELECT e.view_id, p.depth + 1 FROM paths p JOIN edges e ON e.dep_id = p.view_id),
agg AS (SELECT view_id, max(depth) AS level FROM paths GROUP BY view_id)
SELECT v.view_id, CAST(CASE WHEN f.view_id IS NULL THEN agg.level END AS INTEGER) AS level,
  CASE WHEN f.view_id IS NULL THEN 'SUCCESS' ELSE 'FAILED' END AS status,
  CASE WHEN f.view_id IS NOT NULL THEN 'missing dependency' END AS reason
FROM v JOIN agg USING (view_id) LEFT JOIN (SELECT DISTINCT view_id FROM down) f USING (view_id)""")
def q_recreate_order(spark, sf_dir):
    from pyspark.sql import functions as F

    f = _fx(spark, sf_dir)
    existing = inv.classify_tables(f["m_tables"]).where(F.col("class").isin("managed", "mv")).select(F.col("tid").alias("id"))
    return vw.recreate_order(vw.creation_list(f["m_tables"]), f["m_view_deps"].unionByName(f["m_view_missing"]), existing)


@_register("create_views", """
WITH RECURSIVE
missing(id) AS (SELECT view_id FROM m_run_deps WHERE dep_id = -1 UNION SELECT d.view_id FROM m_run_deps d JOIN missing m ON d.dep_id = m.id),
failed AS (SELECT tid AS id FROM m_run_views WHERE contains(ddl, 'gone') AND contains(view_body, 'gone')),
lost(id) AS (SELECT id FROM failed UNION SELECT d.view_id FROM m_run_deps d JOIN lost l ON d.dep_id = l.id),
paths(id, depth) AS (SELECT tid, 0 FROM m_run_views UNION SELECT d.view_id, depth + 1 FROM paths p JOIN m_run_deps d ON d.dep_id = p.id),
v AS (SELECT tid, table_name AS object_name, ddl, (SELECT CAST(max(depth) AS INTEGER) FROM paths p WHERE p.id = tid AND tid NOT IN (SELECT id FROM missing)) AS level,
    CASE WHEN tid IN (SELECT id FROM failed) THEN 'FAILED' WHEN tid IN (SELECT id FROM missing) OR tid IN (SELECT id FROM lost) THEN 'SKIPPED' ELSE 'SUCCESS' END AS status
  FROM m_run_views),
o AS (SELECT o_custkey % 5 AS k, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS price FROM orders),
content AS (SELECT 'a_' || k AS object_name, price FROM o
  UNION ALL SELECT x || k, price FROM o, (VALUES ('b_'), ('c_'), ('d_')) t(x) WHERE o_orderkey % 2 = 0
  UNION ALL SELECT x || (k + 4) % 5, price FROM o, (VALUES ('c_'), ('d_')) t(x))
SELECT v.object_name, level, status, CASE WHEN status = 'SUCCESS' THEN CASE WHEN ddl IS NOT NULL AND NOT contains(ddl, 'gone') THEN 'STATEMENT' ELSE 'FALLBACK' END END AS used,
  count(price) AS "rows", CAST(coalesce(sum(price), 0) AS BIGINT) AS total
FROM v LEFT JOIN content c ON c.object_name = v.object_name AND status = 'SUCCESS' GROUP BY ALL""")
def q_create_views(spark, sf_dir):
    """The views are made in a schema of their own, read back by name, and dropped once the reading frame has been resolved."""
    import uuid
    from functools import reduce

    from pyspark.sql import functions as F

    from vaultshift.plans import execute
    from vaultshift.session import written

    f, schema = _fx(spark, sf_dir), f"views_{uuid.uuid4().hex[:12]}"
    named = f["m_run_views"].withColumn("table_schema", F.lit(schema)).withColumn("table_type", F.lit("VIEW")).withColumn(
        "table_owner", F.lit("owner_0")).withColumn("comment", F.lit(None).cast("string")).withColumn("yaml_body", F.lit(None).cast("string"))
    views = named.select(*named.columns[:2], "table_schema", "yaml_body", *[F.replace(c, F.lit("NEW."), F.lit(f"{schema}.")).alias(c) for c in ("ddl", "view_body")])
    names = named.select(F.col("tid").alias("view_id"), F.concat_ws(".", F.lit("spark_catalog"), "table_schema", "table_name").alias("object_name"))
    order = written(vw.recreate_order(vw.creation_list(named), f["m_run_deps"], spark.createDataFrame([], "id long")).join(names, "view_id").select(
        "object_name", "level", F.col("status").alias("order_status")), "view-order")
    reads = f["m_run_deps"].join(names, "view_id").join(names.toDF("dep_id", "reads"), "dep_id").select("object_name", "reads")
    spark.sql(f"CREATE DATABASE {schema}")
    try:
        spark.sql(f"CREATE VIEW {schema}.orders AS SELECT * FROM parquet.`{sf_dir}/orders.parquet`")
        made = execute.create_views(spark, vw.recreate_plan(named, views, "spark_catalog"), order, reads).select("object_name", "status", "used")
        parts = [spark.table(r["object_name"]).select(F.lit(r["object_name"]).alias("object_name"), F.floor("o_totalprice").cast("bigint").alias("price"))
                 for r in made.where("status = 'SUCCESS'").collect()]  # one row per view
        empty = spark.createDataFrame([], "object_name string, price bigint")
        content = reduce(lambda a, b: a.unionByName(b), parts, empty)
    finally:
        spark.sql(f"DROP DATABASE {schema} CASCADE")
    sums = content.groupBy("object_name").agg(F.count("price").alias("rows"), F.sum("price").alias("total"))
    return made.join(order.select("object_name", "level"), "object_name").join(sums, "object_name", "left").select(
        F.substring_index("object_name", ".", -1).alias("object_name"), "level", "status", "used",
        F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"), F.coalesce("total", F.lit(0)).cast("bigint").alias("total"))


from vaultshift.plans import ordering as po  # noqa: E402


@_register("migration_plan", f"""
WITH RECURSIVE
rel AS (SELECT tid, table_schema, table_name, CASE cls WHEN 'managed' THEN 'TABLE' WHEN 'view' THEN 'VIEW' WHEN 'mv' THEN 'MATERIALIZED_VIEW' ELSE 'METRIC_VIEW' END AS kind
  FROM {_CLASSIFIED} c WHERE cls IN ('managed', 'view', 'mv', 'metric_view')),
s AS (SELECT schema_name FROM m_schemata WHERE schema_name <> 'information_schema' UNION SELECT table_schema FROM m_tables),
n AS (SELECT 'S' || schema_name AS id, 'SCHEMA' AS kind, schema_name AS name FROM s
  UNION ALL SELECT 'T' || tid, kind, table_schema || '.' || table_name FROM rel
  UNION ALL SELECT 'F' || rid, 'FUNCTION', routine_schema || '.' || routine_name FROM m_routines
  UNION ALL SELECT 'V' || volume_schema || '.' || volume_name, 'VOLUME', volume_schema || '.' || volume_name FROM m_volumes WHERE volume_type = 'MANAGED'
  UNION ALL SELECT CASE constraint_type WHEN 'PRIMARY KEY' THEN 'P' ELSE 'K' END || table_schema || '.' || constraint_name, min(constraint_type),
    min(table_schema || '.' || table_name || '.' || constraint_name) FROM m_table_constraints GROUP BY constraint_type, table_schema, constraint_name),
e AS (SELECT 'T' || tid AS id, 'S' || table_schema AS dep FROM rel
  UNION SELECT 'F' || rid, 'S' || routine_schema FROM m_routines
  UNION SELECT 'V' || volume_schema || '.' || volume_name, 'S' || volume_schema FROM m_volumes WHERE volume_type = 'MANAGED'
  UNION SELECT CASE constraint_type WHEN 'PRIMARY KEY' THEN 'P' ELSE 'K' END || t.table_schema || '.' || constraint_name, coalesce('T' || rel.tid, 'none')
    FROM m_table_constraints t LEFT JOIN rel ON rel.table_schema = t.table_schema AND rel.table_name = t.table_name
  UNION SELECT 'K' || constraint_schema || '.' || constraint_name, 'P' || unique_constraint_schema || '.' || unique_constraint_name
    FROM m_referential_constraints WHERE unique_constraint_catalog = '{CATALOG}'
  UNION SELECT 'T' || view_id, 'T' || dep_id FROM (SELECT * FROM m_view_deps UNION ALL SELECT * FROM m_view_missing) d WHERE view_id IN (SELECT tid FROM rel)),
bad(id) AS (SELECT id FROM e WHERE dep NOT IN (SELECT id FROM n) UNION SELECT e.id FROM e JOIN bad ON e.dep = bad.id),
paths(id, depth) AS (SELECT id, 0 FROM n UNION SELECT e.id, depth + 1 FROM paths p JOIN e ON e.dep = p.id)
SELECT CAST(CASE WHEN b.id IS NULL THEN level END AS INTEGER) AS step, kind AS object_type, name AS object_name,
  CASE WHEN b.id IS NULL THEN 'SUCCESS' ELSE 'FAILED' END AS status, CASE WHEN b.id IS NOT NULL THEN 'missing dependency' END AS reason
FROM n JOIN (SELECT id, max(depth) AS level FROM paths GROUP BY id) l USING (id) LEFT JOIN (SELECT DISTINCT id FROM bad) b USING (id)""")
def q_migration_plan(spark, sf_dir):
    f = _fx(spark, sf_dir)
    # The schemas of the fixtures' objects are numbered; those of the schema list are named.
    named = f["m_schemata"].select("schema_name").unionByName(f["m_tables"].select(f["m_tables"]["table_schema"].alias("schema_name"))).distinct()
    return po.migration_order(*po.objects(named, f["m_tables"], f["m_routines"], f["m_table_constraints"], f["m_referential_constraints"],
                                          f["m_view_deps"].unionByName(f["m_view_missing"]), CATALOG, f["m_volumes"]))


@_register("publish_resolve", """
SELECT name, max(version) AS version, arg_max(target, version) AS target FROM m_pointers GROUP BY name""")
def q_publish_resolve(spark, sf_dir):
    return pub.resolve(_fx(spark, sf_dir)["m_pointers"])


@_register("publish_swap", """
WITH cur AS (SELECT name, max(version) AS v, arg_max(target, version) AS t FROM m_pointers GROUP BY name)
SELECT name, v + 1 AS version, 'new_' || name AS target FROM cur UNION ALL SELECT name || '_bkp', v + 1, t FROM cur""")
def q_publish_swap(spark, sf_dir):
    """All names swapped by two writers at the same time, each half of them in one commit."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.sql import functions as F

    from vaultshift.session import fresh_dir

    path = fresh_dir(spark, "pointers")
    base = _fx(spark, sf_dir)["m_pointers"]
    pub.create_pointers(spark, path, base)
    names = base.select("name").distinct().withColumn("target", F.concat(F.lit("new_"), "name"))
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda k: pub.publish_swaps(spark, path, names.where(F.pmod(F.xxhash64("name"), F.lit(2)) == k)), (0, 1)))
    return pub.resolve(pub.read_pointers(spark, path))


_LOG_TABLE_COLUMNS = "batch_id, catalog_name, phase, object_type, object_name, status, message, duration_seconds"


@_register("log_table", f"SELECT {_LOG_TABLE_COLUMNS} FROM m_log")
def q_log_table(spark, sf_dir):
    """The log appended batch by batch, small appends merged, and read back by its name in the catalog."""
    import uuid

    from pyspark.sql import functions as F

    from vaultshift.session import fresh_dir

    log, rows = alog.LogTable(spark, fresh_dir(spark, "log-table"), folders=4), _fx(spark, sf_dir)["m_log"]
    for batch in ("b0", "b1", "b2", "b3"):
        for catalog in ("prod", "dev"):
            log.append(rows.where((F.col("batch_id") == batch) & (F.col("catalog_name") == catalog)))
    name = f"migration_log_{uuid.uuid4().hex[:12]}"
    log.register(name)
    out = spark.table(name).select(*_LOG_TABLE_COLUMNS.split(", "))
    spark.sql(f"DROP VIEW {name}")  # the frame has been resolved
    return out


# ---------------------------------------------------------------- preflight

from vaultshift.operators import preflight as pf  # noqa: E402

_LOC_SQL = """(SELECT path_id, first(name ORDER BY url_len DESC NULLS LAST, name) AS name FROM (
  SELECT p.path_id, l.name, l.url_len FROM (SELECT path_id, regexp_replace(coalesce(path, ''), '/+$', '') AS p FROM {paths}) p
  LEFT JOIN (SELECT name, length(url) AS url_len, regexp_replace(url, '/+$', '') AS u FROM m_locations
    WHERE name IS NOT NULL AND url IS NOT NULL) l
    ON l.u <> '' AND (p.p = l.u OR starts_with(p.p, l.u || '/'))) j GROUP BY path_id)"""


@_register("location_match", "SELECT * FROM " + _LOC_SQL.format(paths="m_paths") + " lm")
def q_location_match(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return pf.location_match(f["m_paths"], f["m_locations"])


PF = dict(catalog="cat8", runner="u_7", catalog_owner="u_7", metastore_owner="g_1",
          storage_path="s3://lake/ASIA/NATION_2/managed")


def _preflight_sql() -> str:
    c, r, mo, sp = PF["catalog"], PF["runner"], PF["metastore_owner"], PF["storage_path"]
    loc = _LOC_SQL.format(paths=f"(SELECT 0 AS path_id, '{sp}' AS path)")
    admin = (f"CASE WHEN '{r}' = '{mo}' THEN true WHEN n_member = 0 THEN NULL ELSE n_owner_group > 0 END")
    return f"""
WITH facts0 AS (SELECT
  (SELECT count(*) FROM m_catalogs WHERE catalog = '{c}') AS n_cat,
  (SELECT count(*) FROM m_catalogs WHERE catalog = '{c}_aux') AS n_aux,
  (SELECT count(*) FROM m_catalogs WHERE catalog = '{c}_bkp') AS n_bkp,
  (SELECT count(*) FROM m_schemata WHERE schema_name <> 'information_schema') AS n_schema,
  (SELECT count(*) FROM m_memberships WHERE principal = '{r}') AS n_member,
  (SELECT count(*) FROM m_memberships WHERE principal = '{r}' AND group_name = '{mo}') AS n_owner_group,
  (SELECT string_agg(DISTINCT a, ', ' ORDER BY a) FROM (SELECT {_norm('action_type')} AS a FROM m_grants
     WHERE principal = '{r}' AND upper(object_type) = 'METASTORE') g) AS ms_grants,
  (SELECT count(*) FROM m_grants WHERE principal = '{r}' AND upper(object_type) = 'METASTORE'
     AND {_norm('action_type')} IN ('CREATECATALOG', 'ALLPRIVILEGES')) AS n_create,
  (SELECT max(name) FROM {loc} lm) AS loc,
  (SELECT string_agg(DISTINCT a, ', ' ORDER BY a) FROM (SELECT {_norm('g.action_type')} AS a FROM m_grants g
     WHERE g.principal = '{r}' AND upper(g.object_type) = 'EXTERNAL LOCATION'
       AND g.object_key IN (SELECT name FROM {loc} lm2)) lg) AS loc_grants,
  (SELECT count(*) FROM m_grants g WHERE g.principal = '{r}' AND upper(g.object_type) = 'EXTERNAL LOCATION'
     AND g.object_key IN (SELECT name FROM {loc} lm3)
     AND {_norm('g.action_type')} IN ('CREATEMANAGEDSTORAGE', 'ALLPRIVILEGES')) AS n_loc_create),
facts AS (SELECT *, {admin} AS admin FROM facts0),
findings AS (
  SELECT CASE WHEN admin IS NULL THEN 'WARN' ELSE 'OK' END AS severity, 'metastore_admin' AS "check",
    CASE WHEN admin THEN 'runner is a metastore admin (via owner ''{mo}'')' WHEN NOT admin THEN 'runner is NOT a metastore admin (metastore owner: ''{mo}'')'
         ELSE 'could not determine metastore admin status' END AS detail FROM facts
  UNION ALL SELECT CASE WHEN n_cat = 0 THEN 'FAIL' ELSE 'OK' END, 'source_catalog_exists',
    CASE WHEN n_cat = 0 THEN 'Catalog ''{c}'' not found or inaccessible' ELSE 'owner={PF['catalog_owner']}' END FROM facts
  UNION ALL SELECT 'OK', 'source_catalog_rename_privilege', 'runner is the catalog owner' FROM facts
  UNION ALL SELECT CASE WHEN n_schema > 0 THEN 'OK' ELSE 'FAIL' END, 'source_catalog_use_catalog',
    CASE WHEN n_schema > 0 THEN '' ELSE 'Cannot list schemas in source catalog' END FROM facts
  UNION ALL SELECT CASE WHEN n_aux > 0 THEN 'FAIL' ELSE 'OK' END, 'aux_catalog_free',
    CASE WHEN n_aux > 0 THEN 'Catalog ''{c}_aux'' already exists — drop it before running' ELSE '''{c}_aux'' is available' END FROM facts
  UNION ALL SELECT CASE WHEN n_bkp > 0 THEN 'FAIL' ELSE 'OK' END, 'bkp_catalog_free',
    CASE WHEN n_bkp > 0 THEN 'Catalog ''{c}_bkp'' already exists — drop or rename it before running' ELSE '''{c}_bkp'' is available' END FROM facts
  UNION ALL SELECT CASE WHEN coalesce(admin, false) OR n_create > 0 THEN 'OK' ELSE 'FAIL' END, 'metastore_create_catalog',
    CASE WHEN coalesce(admin, false) THEN 'implicit via metastore admin' WHEN n_create > 0 THEN 'CREATE CATALOG granted at metastore'
         ELSE 'Runner lacks CREATE CATALOG on the metastore. Granted: ' || coalesce(ms_grants, 'none') || '. Request CREATE CATALOG from your metastore admin.' END FROM facts
  UNION ALL SELECT CASE WHEN loc IS NOT NULL THEN 'OK' ELSE 'FAIL' END, 'external_location_exists',
    CASE WHEN loc IS NOT NULL THEN '''' || loc || ''' covers ''{sp}''' ELSE 'No external location covers path ''{sp}''.' END FROM facts
  UNION ALL SELECT CASE WHEN coalesce(admin, false) OR n_loc_create > 0 THEN 'OK' ELSE 'FAIL' END, 'external_location_privilege',
    CASE WHEN coalesce(admin, false) THEN 'implicit via metastore admin on ''' || loc || ''''
         WHEN n_loc_create > 0 THEN 'CREATE MANAGED STORAGE granted on ''' || loc || ''''
         ELSE 'Runner lacks CREATE MANAGED STORAGE on ''' || loc || '''. Granted: ' || coalesce(loc_grants, 'none')
           || '. Request CREATE MANAGED STORAGE from the location owner.' END FROM facts WHERE loc IS NOT NULL)
SELECT * FROM findings
UNION ALL SELECT CASE WHEN count_if(severity = 'FAIL') > 0 THEN 'FAIL' ELSE 'SUCCESS' END, 'SUMMARY',
  CASE WHEN count_if(severity = 'FAIL') > 0 THEN count_if(severity = 'FAIL') || ' failed, ' || count_if(severity = 'WARN') || ' warnings'
       ELSE count_if(severity = 'OK') || ' OK, ' || count_if(severity = 'WARN') || ' warnings' END FROM findings"""


@_register("preflight_report", _preflight_sql())
def q_preflight_report(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return pf.preflight_report(f["m_catalogs"], f["m_schemata"], f["m_grants"], f["m_memberships"], f["m_locations"],
                               **PF)


# ------------------------------------------- restore of functions, volumes, catalog

_TICK = "'`' || replace({}, '`', '``') || '`'"


@_register("volume_plan", f"""
WITH v AS (SELECT v.volume_schema AS s, v.volume_name AS n, coalesce(v.comment, '') AS c, o.volume_owner AS o,
  {_TICK.format("'prod_new'")} || '.' || {_TICK.format('v.volume_schema')} || '.' || {_TICK.format('v.volume_name')} AS q
  FROM m_volumes v LEFT JOIN m_volume_owners o ON o.volume_schema = v.volume_schema AND o.volume_name = v.volume_name WHERE v.volume_type = 'MANAGED')
SELECT 'VOLUME' AS object_type, 'prod.' || s || '.' || n AS object_name, 0 AS seq,
  'CREATE VOLUME ' || q || CASE WHEN c <> '' THEN ' COMMENT ' || {_lit('c')} ELSE '' END AS statement FROM v
UNION ALL SELECT 'VOLUME', 'prod.' || s || '.' || n, 1, 'ALTER VOLUME ' || q || ' SET OWNER TO ' || {_TICK.format('o')} FROM v WHERE o <> ''""")
def q_volume_plan(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return st.volume_plan(f["m_volumes"], f["m_volume_owners"], CATALOG, "prod_new")


@_register("object_tag_plan", f"""
WITH p AS (SELECT object_type, schema_name, object_name AS n,
  string_agg({_lit('tag_name')} || ' = ' || {_lit("coalesce(tag_value, '')")}, ', ' ORDER BY tag_name) AS pairs
  FROM m_object_tags GROUP BY object_type, schema_name, object_name)
SELECT object_type, 'prod' || coalesce('.' || schema_name, '') || coalesce('.' || n, '') AS object_name,
  'ALTER ' || object_type || ' ' || {_TICK.format("'prod_new'")} || coalesce('.' || {_TICK.format('schema_name')}, '')
    || coalesce('.' || {_TICK.format('n')}, '') || ' SET TAGS (' || pairs || ')' AS statement FROM p""")
def q_object_tag_plan(spark, sf_dir):
    return st.object_tag_plan(_fx(spark, sf_dir)["m_object_tags"], CATALOG, "prod_new")


@_register("grant_plan_objects", f"""
WITH k AS (SELECT 'FUNCTION' AS t, routine_schema AS s, routine_name AS n FROM m_routines
  UNION ALL SELECT 'VOLUME', volume_schema, volume_name FROM m_volumes)
SELECT DISTINCT k.t AS object_type, g.object_key AS object_name, 'GRANT ' || g.action_type || ' ON ' || k.t || ' '
  || {_TICK.format("'prod_new'")} || '.' || {_TICK.format('k.s')} || '.' || {_TICK.format('k.n')} || ' TO ' || {_TICK.format('g.principal')} AS statement
FROM k JOIN m_object_grants g ON g.object_key = 'prod.' || k.s || '.' || k.n AND g.object_type = k.t WHERE g.action_type <> 'OWN'""")
def q_grant_plan_objects(spark, sf_dir):
    f = _fx(spark, sf_dir)
    objects = acc.securables(f["m_schemata"], None, CATALOG, f["m_routines"], f["m_volumes"])
    return st.grant_plan(acc.direct_grants(f["m_object_grants"], objects), CATALOG, "prod_new")


# ------------------------------------------------- training-data operators

try:  # the subpackage and the pipeline may be absent; everything above works without them
    import corpus_pipeline
    from vaultshift.llm import queries as llm_queries
except ModuleNotFoundError as gone:
    if gone.name not in ("corpus_pipeline", "vaultshift.llm", "vaultshift.llm.queries"):
        raise
    corpus_pipeline = llm_queries = None

if llm_queries is not None:
    _QUERIES.update(llm_queries.QUERIES)
    _ORACLE.update(llm_queries.ORACLE)
    _QUERIES["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL is not None:
        _ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL

# ------------------------------------------------------------------- setups

def _setup_of(name: str):
    """What a query finds ready in this session: a filled log, a laid-out volume, finished copies."""
    if name.startswith("log_") and name != "log_append":
        return _log
    if name in ("file_manifest", "file_copy", "file_copy_ranges", "file_check_edited"):
        return _volume
    if name == "file_check":
        return _copy
    if name in ("digest_check", "schema_diff"):
        return lambda spark, sf_dir: _clone_all(spark, sf_dir, "clone", edited=False)
    if name in ("rowcount_check", "validation_verdict"):
        return _new_side
    return None


def set_up(name: str, spark: SparkSession, sf_dir: str) -> None:
    """Forgets what earlier queries of the session left, then makes what ``name`` needs: for timing it apart."""
    _LOGS.clear()
    _CLONES.clear()
    _VOLUMES.clear()
    make = _setup_of(name)
    if make is not None:
        make(spark, sf_dir)


# ---------------------------------------------------------------- contract

def entry(spark: SparkSession) -> DataFrame:
    """Flagship: objects per table type and scope on the sf0.001 metadata."""
    return _QUERIES["inv_scope"](spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
