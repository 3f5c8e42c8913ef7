"""Metadata relations derived from the driver's tables.

The reference reads catalog metadata views; the test data holds none, so each
relation is derived from a driver table by SQL that runs unchanged in Spark
and DuckDB.  In Spark the inputs are bound as DataFrames (``{part}``); for the
DuckDB oracle the same text is used with the table names filled in and the
relations put in front of the query as CTEs.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# The derivation rules of the metadata fixtures (FIXTURES.md); rows
# that FIXTURES.md replicates with a cross join on a 2-3 row constant are written
# here as UNION ALL branches (same rows, no cross join in any plan).
FIXTURE_SQL: dict[str, str] = {
    "m_schemata": """
SELECT n_name AS schema_name, concat('owner_', CAST(n_nationkey % 7 AS STRING)) AS schema_owner,
  CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE concat('comment ', n_name) END AS comment FROM {nation}
UNION ALL SELECT 'information_schema', 'System', NULL UNION ALL SELECT 'default', 'owner_0', NULL""",
    "m_tables": """
SELECT p_partkey AS tid, concat('NATION_', CAST(p_partkey % 25 AS STRING)) AS table_schema,
  concat(CASE WHEN p_partkey % 17 = 0 THEN '__materialization_' WHEN p_partkey % 19 = 0 THEN 'event_log_'
              WHEN p_partkey % 23 = 0 THEN 'event_log_z' ELSE 't_' END, CAST(p_partkey AS STRING)) AS table_name,
  CASE WHEN p_partkey % 10 <= 2 THEN 'MANAGED' WHEN p_partkey % 10 = 3 THEN 'BASE TABLE' WHEN p_partkey % 10 = 4 THEN 'EXTERNAL'
       WHEN p_partkey % 10 <= 6 THEN 'VIEW' WHEN p_partkey % 10 = 7 THEN 'MATERIALIZED_VIEW' WHEN p_partkey % 10 = 8 THEN 'STREAMING_TABLE'
       WHEN p_partkey % 20 = 9 THEN 'METRIC_VIEW' ELSE 'FOREIGN' END AS table_type,
  concat('owner_', CAST(p_size % 7 AS STRING)) AS table_owner, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_name END AS comment
FROM {part}""",
    "m_views": """
SELECT tid, table_schema, table_name, table_type,
  CASE WHEN tid % 30 = 5 THEN NULL ELSE concat('CREATE VIEW ', table_schema, '.', table_name, ' AS SELECT ', CAST(tid AS STRING)) END AS ddl,
  CASE WHEN tid % 60 = 5 THEN NULL ELSE concat('SELECT ', CAST(tid AS STRING)) END AS view_body,
  CASE WHEN table_type = 'METRIC_VIEW' AND tid % 3 <> 0 THEN 'version: 0.1' ELSE NULL END AS yaml_body
FROM {m_tables} WHERE table_type IN ('VIEW', 'MATERIALIZED_VIEW', 'METRIC_VIEW')""",
    "m_view_deps": """
SELECT v.tid AS view_id, u.tid AS dep_id FROM {m_tables} v JOIN {m_tables} u ON u.tid = v.tid - 10
  WHERE v.table_type = 'VIEW' AND u.table_type = 'VIEW'
UNION ALL SELECT v.tid, u.tid FROM {m_tables} v JOIN {m_tables} u ON u.tid = v.tid - 40
  WHERE v.table_type = 'VIEW' AND u.table_type = 'VIEW' AND v.tid % 200 IN (95, 105)""",
    "m_view_missing": """
SELECT tid AS view_id, CAST(-1 AS BIGINT) AS dep_id FROM {m_tables} WHERE table_type = 'VIEW' AND tid % 200 = 106""",
    # Views that are run: over NEW.orders, where NEW stands for the schema they are made in.
    "m_run_views": """
SELECT CAST(r_regionkey AS BIGINT) AS tid, concat('a_', CAST(r_regionkey AS STRING)) AS table_name,
  concat('CREATE VIEW NEW.a_', CAST(r_regionkey AS STRING), CASE WHEN r_regionkey IN (1, 2) THEN ' AS SELECT gone FROM NEW.orders'
    ELSE concat(' AS SELECT o_orderkey, o_totalprice FROM NEW.orders WHERE o_custkey % 5 = ', CAST(r_regionkey AS STRING)) END) AS ddl,
  CASE WHEN r_regionkey = 2 THEN 'SELECT gone FROM NEW.orders'
    ELSE concat('SELECT o_orderkey, o_totalprice FROM NEW.orders WHERE o_custkey % 5 = ', CAST(r_regionkey AS STRING)) END AS view_body FROM {region}
UNION ALL SELECT 10 + r_regionkey, concat('b_', CAST(r_regionkey AS STRING)),
  CASE WHEN r_regionkey = 3 THEN NULL ELSE concat('CREATE VIEW NEW.b_', CAST(r_regionkey AS STRING), ' AS SELECT * FROM NEW.a_', CAST(r_regionkey AS STRING), ' WHERE o_orderkey % 2 = 0') END,
  concat('SELECT * FROM NEW.a_', CAST(r_regionkey AS STRING), ' WHERE o_orderkey % 2 = 0') FROM {region}
UNION ALL SELECT 20 + r_regionkey, concat('c_', CAST(r_regionkey AS STRING)), NULL,
  concat('SELECT * FROM NEW.b_', CAST(r_regionkey AS STRING), ' UNION ALL SELECT * FROM NEW.a_', CAST((r_regionkey + 1) % 5 AS STRING)) FROM {region}
UNION ALL SELECT 30 + r_regionkey, concat('d_', CAST(r_regionkey AS STRING)), NULL,
  concat('SELECT * FROM NEW.', CASE WHEN r_regionkey = 0 THEN 'lost' ELSE concat('c_', CAST(r_regionkey AS STRING)) END) FROM {region}""",
    "m_run_deps": """
SELECT tid AS view_id, tid - 10 AS dep_id FROM {m_run_views} WHERE tid >= 10 AND tid <> 30
UNION ALL SELECT tid, (tid - 19) % 5 FROM {m_run_views} WHERE tid BETWEEN 20 AND 29
UNION ALL SELECT tid, CAST(-1 AS BIGINT) FROM {m_run_views} WHERE tid = 30""",
    "m_table_constraints": """
SELECT tid, concat('pk_', CAST(tid AS STRING)) AS constraint_name, 'PRIMARY KEY' AS constraint_type, table_schema, table_name
FROM {m_tables} WHERE table_type = 'MANAGED'
UNION ALL SELECT tid, concat('fk_', CAST(CAST(floor(tid / 25) AS BIGINT) AS STRING)), 'FOREIGN KEY', table_schema, table_name
FROM {m_tables} WHERE table_type = 'MANAGED' AND tid % 3 = 0 AND tid >= 10""",
    "m_key_column_usage": """
SELECT t.constraint_name, t.table_schema, t.table_name, 'c1' AS column_name, 1 AS ordinal_position FROM {m_table_constraints} t
UNION ALL SELECT t.constraint_name, t.table_schema, t.table_name, 'c2', 2 FROM {m_table_constraints} t WHERE t.tid % 2 = 1""",
    "m_referential_constraints": """
SELECT constraint_name, table_schema AS constraint_schema, CASE WHEN tid % 4 = 0 THEN 'other' ELSE 'prod' END AS unique_constraint_catalog,
  concat('NATION_', CAST((tid - 10) % 25 AS STRING)) AS unique_constraint_schema, concat('pk_', CAST(tid - 10 AS STRING)) AS unique_constraint_name
FROM {m_table_constraints} WHERE constraint_type = 'FOREIGN KEY'""",
    "m_tags": """
SELECT 'TABLE' AS object_type, table_schema, table_name, CAST(NULL AS STRING) AS column_name, 'k1' AS tag_name,
  CASE WHEN tid % 7 = 0 THEN 'it''s' ELSE table_owner END AS tag_value FROM {m_tables} WHERE tid % 4 >= 1
UNION ALL SELECT 'TABLE', table_schema, table_name, CAST(NULL AS STRING), 'k2',
  CASE WHEN tid % 7 = 0 THEN 'it''s' ELSE table_owner END FROM {m_tables} WHERE tid % 4 >= 2
UNION ALL SELECT 'TABLE', table_schema, table_name, CAST(NULL AS STRING), 'k3',
  CASE WHEN tid % 7 = 0 THEN 'it''s' ELSE table_owner END FROM {m_tables} WHERE tid % 4 >= 3
UNION ALL SELECT 'COLUMN', table_schema, table_name, 'c1', 'pii', CAST(tid % 2 AS STRING) FROM {m_tables} WHERE tid % 5 = 0
UNION ALL SELECT 'COLUMN', table_schema, table_name, 'c2', 'pii', CAST(tid % 2 AS STRING) FROM {m_tables} WHERE tid % 5 = 0""",
    "m_grants": """
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'CATALOG' WHEN c_custkey % 4 = 1 THEN 'SCHEMA' ELSE 'TABLE' END AS object_type,
  CASE WHEN c_custkey % 4 = 0 THEN 'prod' WHEN c_custkey % 4 = 1 THEN concat('prod.NATION_', CAST(c_nationkey AS STRING))
       ELSE concat('prod.NATION_', CAST(c_nationkey AS STRING), '.t_', CAST(c_custkey AS STRING)) END AS object_key,
  concat('u_', CAST(c_custkey % 50 AS STRING)) AS principal,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 'SELECT' WHEN 'FURNITURE' THEN 'MODIFY' WHEN 'BUILDING' THEN 'CREATE_CATALOG'
       WHEN 'AUTOMOBILE' THEN 'OWN' ELSE 'ALL PRIVILEGES' END AS action_type FROM {customer}""",
    "m_grant_log": """
SELECT CASE WHEN c_custkey % 11 = 0 THEN 'owners' ELSE 'grants' END AS phase, object_key AS object_name,
  CASE WHEN action_type = 'OWN' THEN 'SKIPPED' WHEN c_custkey % 7 = 0 THEN 'FAILED' WHEN c_custkey % 13 = 0 THEN 'ERROR' ELSE 'SUCCESS' END AS status
FROM {m_grants}""",
    "m_memberships": """
SELECT DISTINCT concat('u_', CAST(c_custkey % 50 AS STRING)) AS principal, concat('g_', CAST(c_nationkey AS STRING)) AS group_name FROM {customer} WHERE c_custkey % 3 = 0""",
    "m_nested_members": """
SELECT concat('u_', CAST(c_custkey AS STRING)) AS principal, concat('h_', CAST(c_custkey % 400 AS STRING)) AS group_name FROM {customer}
UNION ALL SELECT concat('h_', CAST(c_custkey % 400 AS STRING)), concat('h_', CAST(CAST(floor(c_custkey % 400 / 3) AS BIGINT) AS STRING)) FROM {customer}
UNION ALL SELECT concat('h_', CAST(c_custkey % 400 AS STRING)), concat('h_', CAST(c_custkey % 400 + 7 AS STRING)) FROM {customer} WHERE c_custkey % 5 = 0 AND c_custkey % 400 < 90""",
    "m_group_grants": """
SELECT object_type, object_key, concat('h_', CAST(c_custkey % 400 AS STRING)) AS principal, action_type FROM {m_grants} WHERE c_custkey % 3 = 0
UNION ALL SELECT object_type, object_key, concat('u_', CAST(c_custkey AS STRING)), action_type FROM {m_grants} WHERE c_custkey % 3 > 0""",
    "m_asked": """
SELECT concat('u_', CAST(c_custkey AS STRING)) AS principal, concat('prod.NATION_', CAST(c_nationkey AS STRING), '.t_', CAST(c_custkey AS STRING)) AS object_key FROM {customer}""",
    "m_routines": """
SELECT s_suppkey AS rid, concat('NATION_', CAST(s_nationkey AS STRING)) AS routine_schema, concat('f_', CAST(s_suppkey AS STRING)) AS routine_name,
  CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE concat('x + ', CAST(s_suppkey AS STRING)) END AS routine_definition,
  CASE WHEN s_suppkey % 3 = 0 THEN 'SQL' ELSE 'EXTERNAL' END AS routine_body, CASE WHEN s_suppkey % 3 = 1 THEN 'Python' WHEN s_suppkey % 3 = 2 THEN 'JAVA' ELSE NULL END AS external_language,
  'INT' AS full_data_type, CASE WHEN s_suppkey % 2 = 0 THEN 'YES' ELSE 'NO' END AS is_deterministic,
  CASE WHEN s_suppkey % 4 = 0 THEN 'it''s' ELSE NULL END AS comment, concat('owner_', CAST(s_nationkey % 7 AS STRING)) AS routine_owner FROM {supplier}""",
    "m_parameters": """
SELECT routine_schema AS specific_schema, routine_name AS specific_name, 'p1' AS parameter_name, 'INT' AS full_data_type,
  1 AS ordinal_position, 'IN' AS parameter_mode FROM {m_routines} WHERE rid % 4 >= 1
UNION ALL SELECT routine_schema, routine_name, 'p2', 'DECIMAL(10,2)', 2, 'IN' FROM {m_routines} WHERE rid % 4 >= 2
UNION ALL SELECT routine_schema, routine_name, 'p3', 'DECIMAL(10,2)', 3, 'OUT' FROM {m_routines} WHERE rid % 4 >= 3""",
    "m_volumes": """
SELECT concat('NATION_', CAST(s_nationkey AS STRING)) AS volume_schema, concat('v_', CAST(s_suppkey AS STRING)) AS volume_name,
  CASE WHEN s_suppkey % 5 = 0 THEN 'EXTERNAL' ELSE 'MANAGED' END AS volume_type, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE NULL END AS comment FROM {supplier}""",
    "m_volume_owners": """
SELECT volume_schema, volume_name, concat('o', volume_name, CASE WHEN volume_type = 'MANAGED' THEN '`x' ELSE '' END) AS volume_owner FROM {m_volumes}
WHERE comment IS NULL""",
    "m_object_tags": """
SELECT 'CATALOG' AS object_type, CAST(NULL AS STRING) AS schema_name, CAST(NULL AS STRING) AS object_name, 'env' AS tag_name, 'pr''od' AS tag_value
UNION ALL SELECT 'CATALOG', CAST(NULL AS STRING), CAST(NULL AS STRING), 'cost', CAST(NULL AS STRING)
UNION ALL SELECT 'SCHEMA', concat('NATION_', CAST(n_nationkey AS STRING)), CAST(NULL AS STRING), 'region', CAST(n_regionkey AS STRING) FROM {nation}
UNION ALL SELECT 'VOLUME', volume_schema, volume_name, 'it''s', volume_type FROM {m_volumes}
UNION ALL SELECT 'VOLUME', volume_schema, volume_name, 'a', comment FROM {m_volumes} WHERE comment IS NOT NULL""",
    "m_object_grants": """
SELECT 'FUNCTION' AS object_type, concat('prod.', routine_schema, '.', routine_name) AS object_key, concat('u_', CAST(rid % 50 AS STRING)) AS principal,
  CASE WHEN rid % 5 = 0 THEN 'OWN' ELSE 'EXECUTE' END AS action_type FROM {m_routines}
UNION ALL SELECT 'VOLUME', concat('prod.', volume_schema, '.', volume_name), 'g`1', 'READ VOLUME' FROM {m_volumes}
UNION ALL SELECT 'SCHEMA', concat('prod.', volume_schema, '.', volume_name), 'inherited', 'USE SCHEMA' FROM {m_volumes}""",
    "m_locations": """
SELECT 'root' AS name, 's3://lake/' AS url UNION ALL SELECT r_name, concat('s3://lake/', r_name) FROM {region}
UNION ALL SELECT concat(r_name, '_', n_name), concat('s3://lake/', r_name, '/', n_name, '/') FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "m_paths": """
SELECT p_partkey AS path_id, CASE WHEN p_partkey % 11 = 0 THEN concat('s3://lake2/', r_name)
  ELSE concat('s3://lake/', r_name, '/', n_name, CASE WHEN p_partkey % 2 = 0 THEN concat('/t', CAST(p_partkey AS STRING)) ELSE '' END) END AS path
FROM {part} JOIN {nation} ON n_nationkey = p_partkey % 25 JOIN {region} ON n_regionkey = r_regionkey""",
    "m_catalogs": """
SELECT concat('cat', CAST(n_nationkey AS STRING)) AS catalog FROM {nation} UNION ALL SELECT concat('cat', CAST(n_nationkey AS STRING), '_aux') FROM {nation} WHERE n_nationkey % 6 = 0
UNION ALL SELECT concat('cat', CAST(n_nationkey AS STRING), '_bkp') FROM {nation} WHERE n_nationkey % 4 = 0""",
    "m_share_objects": """
SELECT concat('share_', CAST(s_nationkey AS STRING)) AS share_name,
  concat(CASE WHEN s_nationkey % 3 = 0 THEN 'Prod.' WHEN s_nationkey % 3 = 1 THEN 'prod2.' ELSE 'dev.' END, 's.t_', CAST(s_suppkey AS STRING)) AS object_name FROM {supplier}""",
    "m_describe_kv": """
SELECT n_name AS object_name, ' Owner ' AS info_name, concat('owner_', CAST(n_nationkey % 7 AS STRING)) AS info_value FROM {nation}
UNION ALL SELECT n_name, 'Comment', CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE concat(' c', n_name) END FROM {nation}
UNION ALL SELECT n_name, 'Properties', CASE WHEN n_nationkey % 2 = 0 THEN '(())' ELSE '((k,v))' END FROM {nation}""",
    "m_pointers": """
SELECT concat('cat', CAST(p_partkey % 40 AS STRING)) AS name, p_partkey AS version, concat('loc_', CAST(p_partkey AS STRING)) AS target FROM {part}""",
    "m_log": """
SELECT concat('b', CAST(user_id % 4 AS STRING)) AS batch_id, CASE WHEN user_id % 3 = 0 THEN 'prod' ELSE 'dev' END AS catalog_name,
  CASE WHEN event_id % 5 = 0 THEN 'inventory' WHEN event_id % 5 = 1 THEN 'tables' WHEN event_id % 5 = 2 THEN 'views' WHEN event_id % 5 = 3 THEN 'validation' ELSE 'preflight' END AS phase,
  CASE WHEN event_id % 5 = 3 THEN 'ROW_COUNT' WHEN event_id % 5 = 2 THEN 'VIEW' ELSE 'TABLE' END AS object_type, concat('prod.s.o', CAST(event_id AS STRING)) AS object_name,
  CASE event_type WHEN 'signup' THEN 'SUCCESS' WHEN 'error' THEN 'FAILED' WHEN 'click' THEN 'OUT_OF_SCOPE' WHEN 'view' THEN 'WARNING' ELSE 'ERROR' END AS status,
  concat('new=', CAST(user_id AS STRING), ' original=', CAST(user_id AS STRING)) AS message, value AS duration_seconds, ts AS logged_at FROM {events}""",
    # Target-side ("new") relations for the comparisons (FIXTURES.md section 3).
    "m_tables_new": """
SELECT * FROM {m_tables} WHERE tid % 97 <> 0""",
    "m_grants_new": """
SELECT * FROM {m_grants} WHERE c_custkey % 13 <> 0
UNION ALL SELECT CAST(-1 AS BIGINT), 'CATALOG', 'prod', 'u_extra', 'SELECT'""",
    "m_orders_new": """
SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 89 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
  o_orderdate, o_orderpriority FROM {orders} WHERE o_orderkey % 97 <> 0""",
    "m_lineitem_new": """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_orderkey % 89 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity,
  l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM {lineitem} WHERE l_orderkey % 97 <> 0""",
}

_BASE = set(BASE_TABLES)


def _deps(name: str) -> list[str]:
    import re

    return sorted(set(re.findall(r"\{(\w+)\}", FIXTURE_SQL[name])))


def closure(names: Iterable[str]) -> list[str]:
    """Fixture relations needed by ``names``, dependencies first."""
    order: list[str] = []
    seen: set[str] = set()

    def visit(n: str) -> None:
        if n in seen or n in _BASE:
            return
        seen.add(n)
        for d in _deps(n):
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return order


def cte_prefix(names: Iterable[str]) -> str:
    """``WITH m_a AS (...), m_b AS (...)`` for the DuckDB oracle (empty if none)."""
    needed = closure(names)
    if not needed:
        return ""
    parts = []
    for n in needed:
        body = FIXTURE_SQL[n].strip()
        for d in _deps(n):
            body = body.replace("{" + d + "}", d)
        parts.append(f"{n} AS (\n{body}\n)")
    return "WITH " + ",\n".join(parts) + "\n"


class Fixtures:
    """Lazy loader of base tables and derived metadata relations for one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            if name in _BASE:
                self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                refs = {d: self.table(d) for d in _deps(name)}
                self._cache[name] = self.spark.sql(FIXTURE_SQL[name], **refs)
        return self._cache[name]

    __getitem__ = table
