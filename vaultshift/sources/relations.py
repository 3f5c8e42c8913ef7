"""Declared schemas of the metadata relations and a loader that never hides failure.

A relation that cannot be read becomes the empty relation *and* a finding
with status ERROR, so a later comparison of two unreadable sides cannot
pass silently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

S, L, I = T.StringType(), T.LongType(), T.IntegerType()


def _st(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in cols])


SCHEMAS: dict[str, T.StructType] = {
    "schemata": _st(("schema_name", S), ("schema_owner", S), ("comment", S)),
    "tables": _st(("tid", L), ("table_schema", S), ("table_name", S), ("table_type", S), ("table_owner", S),
                  ("comment", S)),
    "views": _st(("tid", L), ("table_schema", S), ("table_name", S), ("table_type", S), ("ddl", S),
                 ("view_body", S), ("yaml_body", S)),
    "view_deps": _st(("view_id", L), ("dep_id", L)),
    "table_constraints": _st(("tid", L), ("constraint_name", S), ("constraint_type", S), ("table_schema", S),
                             ("table_name", S)),
    "key_column_usage": _st(("constraint_name", S), ("table_schema", S), ("table_name", S), ("column_name", S),
                            ("ordinal_position", I)),
    "referential_constraints": _st(("constraint_name", S), ("constraint_schema", S),
                                   ("unique_constraint_catalog", S), ("unique_constraint_schema", S),
                                   ("unique_constraint_name", S)),
    "tags": _st(("object_type", S), ("table_schema", S), ("table_name", S), ("column_name", S), ("tag_name", S),
                ("tag_value", S)),
    "grants": _st(("object_type", S), ("object_key", S), ("principal", S), ("action_type", S)),
    "memberships": _st(("principal", S), ("group_name", S)),
    "routines": _st(("rid", L), ("routine_schema", S), ("routine_name", S), ("routine_definition", S),
                    ("routine_body", S), ("external_language", S), ("full_data_type", S), ("is_deterministic", S),
                    ("comment", S), ("routine_owner", S)),
    "parameters": _st(("specific_schema", S), ("specific_name", S), ("parameter_name", S), ("full_data_type", S),
                      ("ordinal_position", I), ("parameter_mode", S)),
    "volumes": _st(("volume_schema", S), ("volume_name", S), ("volume_type", S), ("comment", S)),
    "locations": _st(("name", S), ("url", S)),
    "paths": _st(("path_id", L), ("path", S)),
    "catalogs": _st(("catalog", S),),
    "share_objects": _st(("share_name", S), ("object_name", S)),
    "describe_kv": _st(("object_name", S), ("info_name", S), ("info_value", S)),
    "pointers": _st(("name", S), ("version", L), ("target", S)),
}

FINDING_SCHEMA = _st(("severity", S), ("check", S), ("detail", S))


def read_relation(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """(relation, findings): the relation with its declared schema, or the
    empty relation plus one ERROR finding when it cannot be read."""
    schema = SCHEMAS[name]
    try:
        df = spark.read.format(fmt).schema(schema).load(path)
        df.limit(0).collect()  # resolves the path now; no rows are read
        return df, spark.createDataFrame([], FINDING_SCHEMA)
    except Exception as e:  # noqa: BLE001 - turned into a finding
        detail = str(e)
        return (spark.createDataFrame([], schema),
                spark.createDataFrame([("ERROR", f"read_{name}", detail)], FINDING_SCHEMA))
