"""Metadata relations from a live Spark session catalog.

The catalog API is driver-side metadata (names, types, comments), read once
per object kind; no table data passes through here.  The relations have the
declared schemas of ``sources.relations`` so every operator runs on them
unchanged.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from vaultshift.sources.relations import SCHEMAS


def _id(*parts: str) -> int:
    """A 63-bit id of a qualified name; the parts' lengths are hashed too, so 'a.b','c' and 'a','b.c' differ."""
    data = b"".join(len(p.encode()).to_bytes(8, "big") + p.encode() for p in parts)
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big") >> 1


def _databases(spark: SparkSession, databases: list[str] | None) -> list:
    dbs = spark.catalog.listDatabases()
    return [d for d in dbs if databases is None or d.name in databases]


def harvest_schemata(spark: SparkSession, databases: list[str] | None = None) -> DataFrame:
    rows = [(d.name, None, d.description or None) for d in _databases(spark, databases)]
    return spark.createDataFrame(rows, SCHEMAS["schemata"])


def harvest_tables(spark: SparkSession, databases: list[str] | None = None) -> DataFrame:
    """Tables and views; ``table_type`` as the catalog reports it (MANAGED, EXTERNAL, VIEW)."""
    rows = []
    for d in _databases(spark, databases):
        for t in spark.catalog.listTables(d.name):
            if t.isTemporary:
                continue
            rows.append((_id(d.name, t.name), d.name, t.name, t.tableType, None, t.description or None))
    return spark.createDataFrame(rows, SCHEMAS["tables"])


def harvest_views(spark: SparkSession, tables: DataFrame) -> DataFrame:
    """Definition text of every view: ``SHOW CREATE TABLE`` and the DESCRIBE 'View Text'."""
    rows = []
    for t in tables.where("table_type = 'VIEW'").select("tid", "table_schema", "table_name").collect():
        name = f"`{t.table_schema}`.`{t.table_name}`"
        ddl = body = None
        try:
            ddl = spark.sql(f"SHOW CREATE TABLE {name}").first()[0]
        except Exception:  # noqa: BLE001 - no DDL: the view is skipped later
            pass
        try:
            for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect():
                if r[0] and r[0].strip() == "View Text":
                    body = r[1]
        except Exception:  # noqa: BLE001
            pass
        rows.append((t.tid, t.table_schema, t.table_name, "VIEW", ddl, body, None))
    return spark.createDataFrame(rows, SCHEMAS["views"])


def harvest_routines(spark: SparkSession, databases: list[str] | None = None) -> DataFrame:
    rows = []
    for d in _databases(spark, databases):
        for f in spark.catalog.listFunctions(d.name):
            if f.isTemporary or not f.namespace or f.namespace[-1] != d.name:
                continue
            rows.append((_id(d.name, f.name), d.name, f.name, None, "SQL", None, None, None, f.description, None))
    return spark.createDataFrame(rows, SCHEMAS["routines"])


def harvest_columns(spark: SparkSession, tables: DataFrame) -> DataFrame:
    """Column relation (table_name = schema.table) for ``validate.schema_diff``."""
    from vaultshift.operators.validate import COLUMNS_SCHEMA

    rows = []
    for t in tables.select("table_schema", "table_name").collect():
        for i, c in enumerate(spark.catalog.listColumns(f"`{t.table_schema}`.`{t.table_name}`"), start=1):
            rows.append((f"{t.table_schema}.{t.table_name}", c.name, i, c.dataType, c.nullable, c.description))
    return spark.createDataFrame(rows, COLUMNS_SCHEMA)


def harvest_describe(spark: SparkSession, databases: list[str] | None = None) -> DataFrame:
    """``describe_kv`` rows of databases from ``DESCRIBE DATABASE EXTENDED``
    (owner, comment, properties, location, ...), keys as printed."""
    rows = []
    for d in _databases(spark, databases):
        for r in spark.sql(f"DESCRIBE DATABASE EXTENDED `{d.name}`").collect():
            rows.append((d.name, r[0], r[1]))
    return spark.createDataFrame(rows, SCHEMAS["describe_kv"])
