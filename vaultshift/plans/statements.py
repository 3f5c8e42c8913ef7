"""Plan relations: the statements that rebuild schemas, comments, owners,
grants, tags and keys on the new catalog, one row per statement.

Statements for schemas, tables and functions target the new catalog before
the swap (``aux``); views, materialized views and metric views are made
after the swap, so they target the catalog name itself.  Statements that
open-source Spark cannot run (GRANT, SET OWNER, SET TAGS, ADD CONSTRAINT)
stay rows of a plan; the caller decides where to run them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultshift.functions import names as N
from vaultshift.operators import constraints, inventory, metadata, tags

POST_SWAP = ("view", "mv", "metric_view")


def _explode_statements(df: DataFrame, statements: list[Column], keep: list[str]) -> DataFrame:
    """One row per non-null statement; ``seq`` is its position (the order to run them)."""
    return (
        df.select(*keep, F.posexplode(F.array(*statements)).alias("seq", "statement"))
        .where(F.col("statement").isNotNull())
    )


def properties_clause(props: Column) -> Column:
    """DESCRIBE prints properties as ``((k,v),(k2,v2))``; SET DBPROPERTIES needs
    ``('k' = 'v', 'k2' = 'v2')``.  Text in another form is kept as it is."""
    pairs = F.regexp_replace(props, r"\(([^(),]+),([^()]*)\)", "'$1' = '$2'")
    return F.replace(pairs, F.lit("','"), F.lit("', '"))


def schema_plan(schemata: DataFrame, describe_kv: DataFrame, catalog: str, target: str) -> DataFrame:
    """CREATE SCHEMA (with COMMENT), or only COMMENT ON for ``default``; DBPROPERTIES if any.

    Columns: object_type, object_name, seq (0 create/comment, 1 properties), statement.
    """
    info = metadata.describe_pivot(describe_kv).withColumnRenamed("object_name", "schema_name")
    s = inventory.list_schemas(schemata).join(info, "schema_name", "left").select(
        "schema_name",
        F.coalesce(F.col("comment"), F.lit("")).alias("comment"),
        F.coalesce(F.col("properties"), F.lit("")).alias("properties"),
    )
    q = N.quoted(F.lit(target), F.col("schema_name"))
    has_comment = F.col("comment") != ""
    is_default = F.lower(F.col("schema_name")) == "default"
    create = (
        F.when(is_default & has_comment,
               F.concat(F.lit("COMMENT ON SCHEMA "), q, F.lit(" IS "), N.sql_string(F.col("comment"))))
        .when(~is_default,
              F.concat(F.lit("CREATE SCHEMA "), q,
                       F.when(has_comment, F.concat(F.lit(" COMMENT "), N.sql_string(F.col("comment"))))
                       .otherwise(F.lit(""))))
    )
    props = F.when(~F.col("properties").isin("", "(())"),
                   F.concat(F.lit("ALTER SCHEMA "), q, F.lit(" SET DBPROPERTIES "), properties_clause(F.col("properties"))))
    s = s.withColumn("object_type", F.lit("SCHEMA")).withColumn(
        "object_name", N.fqn(F.lit(catalog), F.col("schema_name")))
    return _explode_statements(s, [create, props], ["object_type", "object_name"])


def _classified(tables: DataFrame, catalog: str, target: str) -> DataFrame:
    t = inventory.classify_tables(tables).where(F.col("class").isin("managed", *POST_SWAP))
    tgt_cat = F.when(F.col("class").isin(*POST_SWAP), F.lit(catalog)).otherwise(F.lit(target))
    return t.select(
        "*",
        N.quoted(tgt_cat, F.col("table_schema"), F.col("table_name")).alias("target_q"),
        N.fqn(F.lit(catalog), F.col("table_schema"), F.col("table_name")).alias("object_name"),
        F.col("log_type").alias("object_type"),
        F.when(F.col("class").isin("view", "metric_view"), F.lit("VIEW")).otherwise(F.lit("TABLE")).alias("kw"),
    )


def comment_plan(tables: DataFrame, catalog: str, target: str) -> DataFrame:
    """COMMENT ON TABLE for managed tables, views and MVs that have a comment
    (metric views carry theirs inside CREATE)."""
    t = _classified(tables, catalog, target).where(
        (F.col("class") != "metric_view") & (F.coalesce(F.col("comment"), F.lit("")) != ""))
    return t.select(
        "object_type", "object_name",
        F.concat(F.lit("COMMENT ON TABLE "), F.col("target_q"), F.lit(" IS "), N.sql_string(F.col("comment")))
        .alias("statement"),
    )


def _owner_stmt(kw: Column, target_q: Column, owner: Column) -> Column:
    return F.when(F.coalesce(owner, F.lit("")) != "",
                  F.concat(F.lit("ALTER "), kw, F.lit(" "), target_q, F.lit(" SET OWNER TO "), N.quote_part(owner)))


def owner_plan(schemata: DataFrame, describe_kv: DataFrame, tables: DataFrame, routines: DataFrame,
               catalog: str, target: str) -> DataFrame:
    """SET OWNER for schemas, tables, views and functions; empty owner = nothing to do."""
    info = metadata.describe_pivot(describe_kv).withColumnRenamed("object_name", "schema_name")
    s = inventory.list_schemas(schemata).join(info, "schema_name", "left").select(
        F.lit("SCHEMA").alias("object_type"), N.fqn(F.lit(catalog), F.col("schema_name")).alias("object_name"),
        _owner_stmt(F.lit("SCHEMA"), N.quoted(F.lit(target), F.col("schema_name")), F.col("owner")).alias("statement"))
    t = _classified(tables, catalog, target).select(
        "object_type", "object_name", _owner_stmt(F.col("kw"), F.col("target_q"), F.col("table_owner")).alias("statement"))
    f = routines.where(F.col("routine_schema") != "information_schema").select(
        F.lit("FUNCTION").alias("object_type"),
        N.fqn(F.lit(catalog), F.col("routine_schema"), F.col("routine_name")).alias("object_name"),
        _owner_stmt(F.lit("FUNCTION"), N.quoted(F.lit(target), F.col("routine_schema"), F.col("routine_name")),
                    F.col("routine_owner")).alias("statement"))
    return s.unionByName(t).unionByName(f).where(F.col("statement").isNotNull())


def grant_plan(direct: DataFrame, catalog: str, target: str) -> DataFrame:
    """GRANT statements for direct grants (ownership rows skipped)."""
    parts = F.split(F.col("object_key"), "\\.", 3)
    typ = F.upper(F.col("object_type"))
    tgt_cat = F.when(typ == "VIEW", F.lit(catalog)).otherwise(F.lit(target))
    target_q = (
        F.when(typ == "CATALOG", N.quoted(tgt_cat))
        .when(typ == "SCHEMA", N.quoted(tgt_cat, F.get(parts, 1)))
        .otherwise(N.quoted(tgt_cat, F.get(parts, 1), F.get(parts, 2)))
    )
    g = direct.where(~F.upper(F.col("action_type")).isin("OWN", "OWNERSHIP"))
    return g.select(
        "object_type", F.col("object_key").alias("object_name"),
        F.concat(F.lit("GRANT "), F.col("action_type"), F.lit(" ON "), typ, F.lit(" "), target_q,
                 F.lit(" TO "), N.quote_part(F.col("principal"))).alias("statement"),
    )


def tag_plan(tables: DataFrame, tag_rows: DataFrame, catalog: str, target: str) -> DataFrame:
    """SET TAGS statements: one batch statement per table / column, and one
    statement per tag as the fallback when a policy rejects the batch."""
    t = _classified(tables, catalog, target).select("table_schema", "table_name", "kw", "target_q")
    tg = tag_rows.where(F.upper(F.col("object_type")).isin("TABLE", "COLUMN")).select(
        "table_schema", "table_name",
        F.when(F.upper(F.col("object_type")) == "COLUMN", F.col("column_name")).alias("column_name"),
        "tag_name", "tag_value",
    ).join(t, ["table_schema", "table_name"])
    alter = F.concat(F.lit("ALTER "), F.col("kw"), F.lit(" "), F.col("target_q"),
                     F.when(F.col("column_name").isNotNull(),
                            F.concat(F.lit(" ALTER COLUMN "), N.quote_part(F.col("column_name"))))
                     .otherwise(F.lit("")),
                     F.lit(" SET TAGS ("))
    single = tg.select(
        "table_schema", "table_name", "column_name",
        F.concat(alter, tags.tag_pair(F.col("tag_name"), F.col("tag_value")), F.lit(")")).alias("statement"),
        F.lit("single").alias("mode"),
    )
    batch = tg.groupBy("table_schema", "table_name", "column_name", "kw", "target_q").agg(
        tags.ordered_pairs().alias("pairs")
    ).select(
        "table_schema", "table_name", "column_name",
        F.concat(alter, F.col("pairs"), F.lit(")")).alias("statement"),
        F.lit("batch").alias("mode"),
    )
    return batch.unionByName(single)


def volume_plan(volumes: DataFrame, owners: DataFrame | None, catalog: str, target: str) -> DataFrame:
    """CREATE VOLUME (seq 0, with its comment) and SET OWNER (seq 1, where one is known) of managed volumes.

    ``owners``: (volume_schema, volume_name, volume_owner).
    """
    v = volumes.where((F.upper("volume_type") == "MANAGED") & (F.col("volume_schema") != "information_schema")).select(
        "volume_schema", "volume_name", F.coalesce(F.col("comment"), F.lit("")).alias("comment"))
    if owners is None:
        v = v.withColumn("volume_owner", F.lit(None).cast("string"))
    else:
        v = v.join(owners.groupBy("volume_schema", "volume_name").agg(F.max("volume_owner").alias("volume_owner")),
                   ["volume_schema", "volume_name"], "left")
    q = N.quoted(F.lit(target), F.col("volume_schema"), F.col("volume_name"))
    create = F.concat(F.lit("CREATE VOLUME "), q, F.when(
        F.col("comment") != "", F.concat(F.lit(" COMMENT "), N.sql_string(F.col("comment")))).otherwise(F.lit("")))
    rows = v.select(F.lit("VOLUME").alias("object_type"),
                    N.fqn(F.lit(catalog), F.col("volume_schema"), F.col("volume_name")).alias("object_name"),
                    create.alias("made"), _owner_stmt(F.lit("VOLUME"), q, F.col("volume_owner")).alias("owned"))
    return _explode_statements(rows, [F.col("made"), F.col("owned")], ["object_type", "object_name"])


def object_tag_plan(object_tags: DataFrame, catalog: str, target: str) -> DataFrame:
    """One SET TAGS statement per catalog, schema and volume that has tags.

    ``object_tags``: (object_type, schema_name, object_name, tag_name, tag_value); schema and name are
    null where the type has none.
    """
    typ = F.upper(F.col("object_type"))
    t = object_tags.where(typ.isin("CATALOG", "SCHEMA", "VOLUME")).groupBy(
        typ.alias("object_type"), "schema_name", F.col("object_name").alias("name")).agg(tags.ordered_pairs().alias("pairs"))
    is_cat, is_schema = F.col("object_type") == "CATALOG", F.col("object_type") == "SCHEMA"

    def by_type(make, cat: str):
        return F.when(is_cat, make(F.lit(cat))).when(is_schema, make(F.lit(cat), F.col("schema_name"))).otherwise(
            make(F.lit(cat), F.col("schema_name"), F.col("name")))

    return t.select("object_type", by_type(N.fqn, catalog).alias("object_name"),
                    F.concat(F.lit("ALTER "), F.col("object_type"), F.lit(" "), by_type(N.quoted, target),
                             F.lit(" SET TAGS ("), F.col("pairs"), F.lit(")")).alias("statement"))


def constraint_plan(tc: DataFrame, kcu: DataFrame, rc: DataFrame, catalog: str, target: str) -> DataFrame:
    """All PKs (step 1) before all FKs (step 2), so an FK never waits for a table
    copied later."""
    pk = constraints.pk_constraints(tc, kcu).select(
        F.lit(1).alias("step"), "table_schema", "table_name",
        F.concat(F.lit("ALTER TABLE "), N.quoted(F.lit(target), F.col("table_schema"), F.col("table_name")),
                 F.lit(" ADD CONSTRAINT "), N.quote_part(F.col("constraint_name")),
                 F.lit(" PRIMARY KEY ("), N.quoted_list(F.col("col_list")), F.lit(")")).alias("statement"),
    )
    fk = constraints.fk_constraints(tc, kcu, rc, catalog, target).select(
        F.lit(2).alias("step"), "table_schema", "table_name",
        F.concat(F.lit("ALTER TABLE "), N.quoted(F.lit(target), F.col("table_schema"), F.col("table_name")),
                 F.lit(" ADD CONSTRAINT "), N.quote_part(F.col("constraint_name")),
                 F.lit(" FOREIGN KEY ("), N.quoted_list(F.col("col_list")), F.lit(") REFERENCES "),
                 N.quoted(F.col("ref_catalog"), F.col("ref_schema"), F.col("ref_table")),
                 F.lit(" ("), N.quoted_list(F.col("ref_list")), F.lit(")")).alias("statement"),
    )
    return pk.unionByName(fk)
