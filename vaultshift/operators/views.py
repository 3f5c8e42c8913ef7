"""Views, materialized views and metric views: capture, plan and creation order.

The creation order is what the reference's retry loop (up to N rounds over
the list, a failure retried next round) computes, worked out on the dependency
relation (``creation_levels``): chains are contracted, so rounds grow with the logarithm of a
chain's length.  Each round's views and edges are tables in the shared folder, so plans
stay short, a lost executor repeats one round at most, and placed views are not read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultshift.functions import names as N
from vaultshift.operators import inventory, metadata
from vaultshift.session import written

# Skip reasons of the reference.
NO_DDL = "No DDL captured"
NO_YAML = "No YAML body"
NO_WAREHOUSE = "sql_warehouse_id not provided"
# Why a view has no place in the order (own text).
MISSING, CYCLE = "missing dependency", "dependency cycle"


def view_capture(tables: DataFrame, views: DataFrame) -> DataFrame:
    """(table_schema, table_name, table_type, ddl, view_body, captured) for views and MVs."""
    t = inventory.classify_tables(tables).where(F.col("class").isin("view", "mv")).select(
        "table_schema", "table_name", "table_type", "class")
    v = views.select("table_schema", "table_name", "ddl", "view_body")
    j = t.join(v, ["table_schema", "table_name"], "left")
    body = F.when(F.col("class") == "view", F.col("view_body"))
    return j.select(
        "table_schema", "table_name", "table_type", "ddl", body.alias("view_body"),
        (F.col("ddl").isNotNull() | body.isNotNull()).alias("captured"),
    )


def metric_view_capture(tables: DataFrame, views: DataFrame, describe_kv: DataFrame | None = None) -> DataFrame:
    """(table_schema, table_name, yaml_body, captured); the YAML falls back to the
    DESCRIBE row whose trimmed key is 'View Text'."""
    t = inventory.classify_tables(tables).where(F.col("class") == "metric_view").select("table_schema", "table_name")
    j = t.join(views.select("table_schema", "table_name", "yaml_body"), ["table_schema", "table_name"], "left")
    yaml = F.col("yaml_body")
    if describe_kv is not None:
        vt = metadata.describe_value(describe_kv, "View Text", "view_text")
        j = j.join(vt, F.concat_ws(".", "table_schema", "table_name") == F.col("object_name"), "left")
        yaml = F.coalesce(F.col("yaml_body"), F.col("view_text"))
    return j.select("table_schema", "table_name", yaml.alias("yaml_body"), yaml.isNotNull().alias("captured"))


def recreate_plan(tables: DataFrame, views: DataFrame, catalog: str, warehouse: bool = True) -> DataFrame:
    """(object_type, object_name, status, reason, statement, fallback) for every
    view, MV and metric view; targets use the catalog name (made after the swap)."""
    t = inventory.classify_tables(tables).where(F.col("class").isin("view", "mv", "metric_view")).select(
        "table_schema", "table_name", "class", "comment")
    j = t.join(views.select("table_schema", "table_name", "ddl", "view_body", "yaml_body"),
               ["table_schema", "table_name"], "left")
    cls = F.col("class")
    tgt = N.quoted(F.lit(catalog), F.col("table_schema"), F.col("table_name"))
    has_comment = F.coalesce(F.col("comment"), F.lit("")) != ""
    view_fallback = F.when(
        F.col("view_body").isNotNull(),
        F.concat(F.lit("CREATE VIEW "), tgt,
                 F.when(has_comment, F.concat(F.lit(" COMMENT "), N.sql_string(F.col("comment")))).otherwise(F.lit("")),
                 F.lit(" AS "), F.col("view_body")))
    metric_stmt = F.concat(
        F.lit("CREATE VIEW "), tgt, F.lit("\nWITH METRICS\nLANGUAGE YAML"),
        F.when(has_comment, F.concat(F.lit("\nCOMMENT "), N.sql_string(F.col("comment")))).otherwise(F.lit("")),
        F.lit("\nAS $$\n"), F.col("yaml_body"), F.lit("\n$$"))
    reason = (
        F.when((cls == "mv") & F.lit(not warehouse), F.lit(NO_WAREHOUSE))
        .when((cls == "mv") & F.col("ddl").isNull(), F.lit(NO_DDL))
        .when((cls == "view") & F.col("ddl").isNull() & F.col("view_body").isNull(), F.lit(NO_DDL))
        .when((cls == "metric_view") & F.col("yaml_body").isNull(), F.lit(NO_YAML))
    )
    return j.select(
        F.when(cls == "view", "VIEW").when(cls == "mv", "MATERIALIZED_VIEW").otherwise("METRIC_VIEW").alias("object_type"),
        N.fqn(F.lit(catalog), F.col("table_schema"), F.col("table_name")).alias("object_name"),
        F.when(reason.isNull(), "PLANNED").otherwise("SKIPPED").alias("status"),
        reason.alias("reason"),
        F.when(cls == "metric_view", F.when(F.col("yaml_body").isNotNull(), metric_stmt)).otherwise(F.col("ddl"))
        .alias("statement"),
        F.when(cls == "view", view_fallback).alias("fallback"),
    )


def creation_list(tables: DataFrame) -> DataFrame:
    """(view_id) of the views and metric views to create."""
    return inventory.classify_tables(tables).where(F.col("class").isin("view", "metric_view")).select(
        F.col("tid").alias("view_id"))


def creation_levels(items: DataFrame, deps: DataFrame, existing: DataFrame) -> DataFrame:
    """(view_id, level, missing) of every view whose dependencies can be followed to their end.

    ``items``: (view_id); ``deps``: (view_id, dep_id); ``existing``: (id) of
    objects present before the views are made; a dependency on anything else
    is missing.  ``level`` is the longest dependency path; ``missing`` tells
    whether the view, or one that it needs, has a missing dependency.  Views
    in a cycle or downstream of one are absent.

    An edge (view, dep, w) says that the view is at least w levels above dep.  Per round
    edges to placed views are settled, and an edge to a view with a single open edge is
    carried on to that one's dependency, so paths through such views double in
    length and a chain of n views takes about log2(n) rounds.  Edges that come to lead to
    one place become one.  Views with several open edges that don't meet are placed one
    level after the other.  A chain longer than there are views is a cycle, and is dropped.
    """
    items = items.select("view_id").distinct()
    ex = existing.select(F.col("id").alias("dep_id")).distinct()
    d = written(
        deps.select("view_id", "dep_id").distinct().join(items, "view_id", "left_semi")
        .join(ex.withColumn("met", F.lit(True)), "dep_id", "left")
        .join(items.select(F.col("view_id").alias("dep_id"), F.lit(True).alias("is_view")), "dep_id", "left")
        .select("view_id", "dep_id", F.coalesce("is_view", F.lit(False)).alias("is_view"),
                (F.col("is_view").isNull() & F.col("met").isNull()).alias("is_missing")), "deps")
    edges = d.where("is_view").select("view_id", "dep_id", F.lit(1).cast("long").alias("w"))
    facts = d.groupBy("view_id").agg(F.max("is_missing").alias("missing"))
    state = items.join(facts, "view_id", "left").select(
        "view_id", F.lit(0).cast("long").alias("base"), F.coalesce("missing", F.lit(False)).alias("missing"))
    n_views, placed = items.count(), None
    while True:
        # Open views with their number of edges and, of a single one, where it leads; only these go on.
        ends = edges.groupBy("view_id").agg(F.count(F.lit(1)).alias("c"), F.min("dep_id").alias("via"), F.min("w").alias("via_w"))
        now = written(state.join(ends, "view_id", "left"), "views")
        done = now.where("c is null").select("view_id", F.col("base").alias("level"), "missing")
        placed = done if placed is None else placed.unionByName(done)
        state = now.where("c is not null").select("view_id", "base", "missing")
        # A view whose single edge leads to one placed in this round is as good as placed: all edges go on to open views.
        x = done.select(F.col("view_id").alias("via"), F.col("level").alias("x"), F.col("missing").alias("x_missing"))
        single = now.where("c = 1").join(x, "via", "left").select(
            F.col("view_id").alias("dep_id"), F.greatest("base", F.coalesce(F.col("x") + F.col("via_w"), F.lit(0))).alias("d_base"),
            (F.col("missing") | F.coalesce("x_missing", F.lit(False))).alias("d_missing"), F.when(F.col("x").isNull(), F.col("via")).alias("via"), "via_w")
        known = done.select(F.col("view_id").alias("dep_id"), F.col("level").alias("d_base"), F.col("missing").alias("d_missing"),
                            F.lit(None).cast(done.schema["view_id"].dataType).alias("via"), F.lit(None).cast("long").alias("via_w")).unionByName(single)
        told = written(edges.join(known, "dep_id", "left").select(
            "view_id", F.when(F.col("d_base").isNull(), F.col("dep_id")).otherwise(F.col("via")).alias("dep_id"),
            (F.col("w") + F.coalesce("via_w", F.lit(0))).alias("w"), (F.col("d_base") + F.col("w")).alias("up"), "d_missing"), "edges")
        moved, stuck = told.agg(F.count_if(F.col("up").isNotNull()), F.count_if(F.col("w") > n_views)).first()
        if not moved:
            return placed.select("view_id", "level", "missing")  # what is open waits for a cycle, if there is anything
        gain = told.where("up is not null").groupBy("view_id").agg(F.max("up").alias("up"), F.max("d_missing").alias("d_missing"))
        state = state.join(gain, "view_id", "left").select(
            "view_id", F.greatest("base", F.coalesce("up", F.lit(0))).alias("base"), (F.col("missing") | F.coalesce("d_missing", F.lit(False))).alias("missing"))
        edges = told.where("dep_id is not null").groupBy("view_id", "dep_id").agg(F.max("w").alias("w"))
        if stuck:
            endless = edges.where(F.col("w") > n_views).select("view_id").distinct()
            state, edges = state.join(endless, "view_id", "left_anti"), edges.join(endless, "view_id", "left_anti")


def recreate_order(items: DataFrame, deps: DataFrame, existing: DataFrame) -> DataFrame:
    """(view_id, level, status, reason) for a list of views to create.

    A view is FAILED, with a null level, if it or a view that it needs has a
    missing dependency or is in a cycle; any depth of dependencies is placed.
    """
    placed = creation_levels(items, deps, existing)
    out = items.select("view_id").join(placed, "view_id", "left")
    ok = F.col("level").isNotNull() & ~F.col("missing")
    return out.select(
        "view_id", F.when(ok, F.col("level")).cast("int").alias("level"),
        F.when(ok, "SUCCESS").otherwise("FAILED").alias("status"),
        F.when(ok, F.lit(None)).when(F.col("missing"), MISSING).otherwise(CYCLE).alias("reason"),
    )
