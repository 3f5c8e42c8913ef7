"""One order for all objects of a migration.

Every object is a node: schemas, functions, tables, volumes, primary and foreign keys, views.  What an object needs
before it can be made is an edge: its schema; for keys their table and, for a foreign key, the key
that it refers to; for views what they read.  The order is the longest path to an object
(``operators.views.creation_levels``), so everything comes after all that it needs, whatever the
kinds, and objects of equal step can be made at the same time.  Objects that need something absent,
or that need each other, are in the plan too, FAILED, with the reason.

Cases: names are compared as they are, a key's with its schema; a key of another catalog counts as present; objects listed
twice are one; an object without a schema in the list fails as a missing dependency.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultshift.operators import inventory, views
from vaultshift.session import written

# Own values: kinds of objects, in the order in which equal steps are listed.
KINDS = ("SCHEMA", "FUNCTION", "VOLUME", "TABLE", "PRIMARY KEY", "FOREIGN KEY", "VIEW", "MATERIALIZED_VIEW", "METRIC_VIEW")


def _id(kind: str, *names: Column | str) -> Column:
    """One text per object; names may hold any character, so each has its length before it."""
    parts = [F.col(n) if isinstance(n, str) else n for n in names]
    return F.concat(F.lit(kind), *[F.concat(F.lit("|"), F.length(p).cast("string"), F.lit(":"), p) for p in parts])


def objects(schemata: DataFrame, tables: DataFrame, routines: DataFrame, constraints: DataFrame, referential: DataFrame,
            view_deps: DataFrame, catalog: str, volumes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes (id, kind, object_name), edges (view_id, dep_id)) of a catalog's objects; ``view_deps`` is by ``tid`` (view_id, dep_id)."""
    made = inventory.classify_tables(tables)
    kind = F.when(F.col("class") == "managed", "TABLE").when(F.col("class") == "view", "VIEW").when(
        F.col("class") == "mv", "MATERIALIZED_VIEW").when(F.col("class") == "metric_view", "METRIC_VIEW")
    rel = made.select("tid", "table_schema", "table_name", kind.alias("kind")).where("kind is not null").withColumn("id", _id("T", "table_schema", "table_name"))
    schemas = schemata.where("schema_name <> 'information_schema'").select("schema_name")
    nodes = [schemas.select(_id("S", "schema_name").alias("id"), F.lit("SCHEMA").alias("kind"), F.col("schema_name").alias("object_name"))]
    nodes.append(rel.select("id", "kind", F.concat_ws(".", "table_schema", "table_name").alias("object_name")))
    edges = [rel.select(F.col("id").alias("view_id"), _id("S", "table_schema").alias("dep_id"))]
    members = [(routines.select(F.col("routine_schema").alias("s"), F.col("routine_name").alias("n")), "F", "FUNCTION")]
    if volumes is not None:
        members.append((volumes.where("volume_type = 'MANAGED'").select(F.col("volume_schema").alias("s"), F.col("volume_name").alias("n")), "V", "VOLUME"))
    for m, short, name in members:
        nodes.append(m.select(_id(short, "s", "n").alias("id"), F.lit(name).alias("kind"), F.concat_ws(".", "s", "n").alias("object_name")))
        edges.append(m.select(_id(short, "s", "n").alias("view_id"), _id("S", "s").alias("dep_id")))
    keys = constraints.where("constraint_type in ('PRIMARY KEY', 'FOREIGN KEY')").select("constraint_name", "constraint_type", "table_schema", "table_name")
    # A foreign key's name may be that of a primary key elsewhere in the schema, so its kind is part of its id.
    key_id = F.when(F.col("constraint_type") == "PRIMARY KEY", _id("P", "table_schema", "constraint_name")).otherwise(_id("K", "table_schema", "constraint_name"))
    nodes.append(keys.select(key_id.alias("id"), F.col("constraint_type").alias("kind"), F.concat_ws(".", "table_schema", "table_name", "constraint_name").alias("object_name")))
    edges.append(keys.select(key_id.alias("view_id"), _id("T", "table_schema", "table_name").alias("dep_id")))
    edges.append(referential.where(F.col("unique_constraint_catalog") == catalog).select(
        _id("K", "constraint_schema", "constraint_name").alias("view_id"), _id("P", "unique_constraint_schema", "unique_constraint_name").alias("dep_id")))
    own, read = rel.select(F.col("tid").alias("view_id"), F.col("id").alias("v")), made.select(F.col("tid").alias("dep_id"), _id("T", "table_schema", "table_name").alias("d"))
    edges.append(view_deps.select("view_id", "dep_id").join(own, "view_id").join(read, "dep_id", "left").select(
        F.col("v").alias("view_id"), F.coalesce("d", _id("T", F.col("dep_id").cast("string"))).alias("dep_id")))
    # Objects listed twice are one: of several kinds or names the least.
    whole = reduce(DataFrame.unionByName, nodes).groupBy("id").agg(F.min(F.struct("kind", "object_name")).alias("o")).select("id", "o.kind", "o.object_name")
    return whole, reduce(DataFrame.unionByName, edges).distinct()


def migration_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(step, object_type, object_name, status, reason): step 0 first; FAILED objects have none."""
    nodes, edges = written(nodes, "objects"), written(edges, "needs")
    items = nodes.select(F.col("id").alias("view_id"))
    order = views.recreate_order(items, edges, items.limit(0).withColumnRenamed("view_id", "id"))
    return nodes.join(order.withColumnRenamed("view_id", "id"), "id").select(
        F.col("level").alias("step"), F.col("kind").alias("object_type"), "object_name", "status", "reason")
