"""Grants, privileges, ownership, shares and catalog names.

Grants are one relation ``(object_type, object_key, principal, action_type)``;
every check is a join or aggregate over all objects at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultshift.functions import names as N
from vaultshift.session import written

OWNERSHIP = ("OWN", "OWNERSHIP")


def securables(schemata: DataFrame, tables: DataFrame | None, catalog: str, routines: DataFrame | None = None,
               volumes: DataFrame | None = None) -> DataFrame:
    """Objects whose grants are read: the catalog, its schemas, its tables and views, functions and volumes.

    ``object_type`` is the type the grants are asked for (views as VIEW,
    everything table-like as TABLE).
    """
    cat = schemata.sparkSession.range(1).select(
        F.lit("CATALOG").alias("object_type"), F.lit(catalog).alias("object_key"))
    sch = schemata.where(F.col("schema_name") != "information_schema").select(
        F.lit("SCHEMA").alias("object_type"), N.fqn(F.lit(catalog), F.col("schema_name")).alias("object_key"))
    sch = cat.unionByName(sch)
    for df, kind, schema, name in ((routines, "FUNCTION", "routine_schema", "routine_name"),
                                   (volumes, "VOLUME", "volume_schema", "volume_name")):
        if df is not None:
            sch = sch.unionByName(df.where(F.col(schema) != "information_schema").select(
                F.lit(kind).alias("object_type"), N.fqn(F.lit(catalog), F.col(schema), F.col(name)).alias("object_key")))
    if tables is None:
        return sch
    tab = tables.where(F.col("table_schema") != "information_schema").select(
        F.when(F.col("table_type").isin("VIEW", "METRIC_VIEW"), "VIEW").otherwise("TABLE").alias("object_type"),
        N.fqn(F.lit(catalog), F.col("table_schema"), F.col("table_name")).alias("object_key"))
    return sch.unionByName(tab)


def direct_grants(grants: DataFrame, objects: DataFrame) -> DataFrame:
    """Grants set directly on each asked object (inherited ones dropped), distinct.

    A grant is direct when its ``object_type`` equals the asked type,
    case-insensitively; a grant without a type is kept.
    """
    g = grants.select(F.col("object_type").alias("g_type"), "object_key", "principal", "action_type")
    return (
        objects.join(g, "object_key")
        .where(F.col("g_type").isNull() | (F.upper(F.col("g_type")) == F.upper(F.col("object_type"))))
        .select("object_type", "object_key", "principal", "action_type")
        .distinct()
    )


def drop_ownership(grants: DataFrame) -> DataFrame:
    return grants.where(~F.upper(F.col("action_type")).isin(*OWNERSHIP))


def rebase_key(key, old_catalog: str, new_catalog: str):
    """Replace the catalog part of a dotted key (first part only)."""
    parts = F.split(key, "\\.", 2)
    return F.when(parts.getItem(0) == F.lit(old_catalog),
                  F.concat_ws(".", F.lit(new_catalog), F.get(parts, 1))).otherwise(key)


def grant_diff(original: DataFrame, new: DataFrame, original_catalog: str, new_catalog: str,
               types=("CATALOG", "SCHEMA"), both_ways: bool = False,
               exclude_principals: tuple[str, ...] = ()) -> DataFrame:
    """Grants present on the original side and missing on the new side.

    Ownership pseudo-grants are ignored; keys of the new side are rebased to
    the original catalog name first.  ``both_ways`` adds extra grants too
    (column ``side``).  ``exclude_principals`` (e.g. the runner's own
    transient grants) are left out on both sides.
    """
    def prep(df: DataFrame, cat: str) -> DataFrame:
        if exclude_principals:
            df = df.where(~F.col("principal").isin(*exclude_principals))
        return (
            drop_ownership(df.where(F.upper(F.col("object_type")).isin(*types)))
            .select(F.upper(F.col("object_type")).alias("object_type"),
                    rebase_key(F.col("object_key"), cat, original_catalog).alias("object_key"),
                    "principal", "action_type")
            .distinct()
        )

    o, n = prep(original, original_catalog), prep(new, new_catalog)
    keys = ["object_type", "object_key", "principal", "action_type"]
    missing = o.join(n, keys, "left_anti")
    if not both_ways:
        return missing
    extra = n.join(o, keys, "left_anti")
    return missing.withColumn("side", F.lit("missing")).unionByName(extra.withColumn("side", F.lit("extra")))


def effective_privileges(grants: DataFrame) -> DataFrame:
    """Normalised privilege set per (object, principal) and the create test."""
    return (
        grants.groupBy("object_key", "principal")
        .agg(F.array_sort(F.collect_set(N.norm_privilege(F.col("action_type")))).alias("acts"))
        .select(
            "object_key", "principal",
            F.array_join("acts", ", ").alias("actions"),
            F.arrays_overlap("acts", F.array(F.lit("CREATECATALOG"), F.lit("ALLPRIVILEGES"))).alias("can_create"),
        )
    )


def grant_apply_stats(log: DataFrame) -> DataFrame:
    """Outcome of re-applied grants as logged: (object_name, succeeded, failed, skipped).

    ``log``: audit-log rows (phase, object_name, status) with one row per
    GRANT statement that was run or left out.
    """
    return (
        log.where(F.col("phase") == "grants").groupBy("object_name")
        .agg(F.count_if(F.col("status") == "SUCCESS").alias("succeeded"),
             F.count_if(F.col("status").isin("FAILED", "ERROR")).alias("failed"),
             F.count_if(F.col("status") == "SKIPPED").alias("skipped"))
    )


def admin_check(principals: DataFrame, memberships: DataFrame, owner: str | None) -> DataFrame:
    """Three-valued: is each principal the owner or a member of the owning group?

    true: principal is the owner or member of the owner group; false: its
    memberships are known and none is the owner; null: owner unknown or no
    membership visible.
    """
    p = principals.select("principal").distinct()
    if owner is None:
        return p.select("principal", F.lit(None).cast("boolean").alias("is_admin"))
    m = memberships.groupBy("principal").agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.count_if(F.col("group_name") == F.lit(owner)).alias("n_owner"),
    )
    return p.join(m, "principal", "left").select(
        "principal",
        F.when(F.col("principal") == F.lit(owner), F.lit(True))
        .when(F.col("n_groups").isNull(), F.lit(None).cast("boolean"))
        .otherwise(F.col("n_owner") > 0).alias("is_admin"),
    )


def name_collisions(catalogs: DataFrame) -> DataFrame:
    """For each catalog: does ``<c>_aux`` / ``<c>_bkp`` exist already (case-sensitive)?"""
    names = catalogs.select(F.col("catalog").alias("existing")).distinct()
    aux = names.select(F.col("existing").alias("aux_name"), F.lit(True).alias("aux_hit"))
    bkp = names.select(F.col("existing").alias("bkp_name"), F.lit(True).alias("bkp_hit"))
    c = catalogs.select("catalog").withColumn("aux_name", N.aux_name(F.col("catalog"))).withColumn(
        "bkp_name", N.bkp_name(F.col("catalog")))
    return (
        c.join(aux, "aux_name", "left").join(bkp, "bkp_name", "left")
        .select(
            "catalog",
            F.when(F.col("aux_hit"), "FAIL").otherwise("OK").alias("aux"),
            F.when(F.col("bkp_hit"), "FAIL").otherwise("OK").alias("bkp"),
        )
    )


def affected_shares(share_objects: DataFrame, catalog: str) -> DataFrame:
    """Shares with at least one object in the catalog (case-insensitive prefix)."""
    prefix = catalog.lower() + "."
    return (
        share_objects.where(F.startswith(F.lower(F.coalesce(F.col("object_name"), F.lit(""))), F.lit(prefix)))
        .select("share_name")
        .distinct()
    )


def group_closure(memberships: DataFrame) -> DataFrame:
    """(principal, group_name): every group that a principal is in, itself or through groups in groups.

    Semi-naive: a round joins only the pairs that the round before found new, so nested groups take
    as many rounds as they are deep, and groups in each other's circle end it.  Groups are closed first; principals that
    nobody is a member of, mostly users, are joined once with what their groups reach.
    """
    edges = written(memberships.select("principal", "group_name").where("principal is not null and group_name is not null").distinct(), "members")
    groups = edges.select(F.col("group_name").alias("principal")).distinct()
    nested = written(edges.join(groups, "principal", "left_semi"), "nested")
    known, fresh = nested, nested
    step = nested.select(F.col("principal").alias("group_name"), F.col("group_name").alias("above"))
    while not fresh.isEmpty():
        found = fresh.join(step, "group_name").select("principal", F.col("above").alias("group_name")).distinct()
        fresh = written(found.join(known, ["principal", "group_name"], "left_anti"), "fresh")
        known = known.unionByName(fresh)
    above = known.select(F.col("principal").alias("group_name"), F.col("group_name").alias("above"))
    users = edges.join(groups, "principal", "left_anti")
    through = users.join(above, "group_name").select("principal", F.col("above").alias("group_name"))
    return users.unionByName(through).unionByName(known).distinct()


def inherited_privileges(asked: DataFrame, grants: DataFrame, memberships: DataFrame) -> DataFrame:
    """(principal, object_key, actions, sources) of the pairs ``asked`` (principal, object_key).

    A privilege counts if it was granted to the principal or any group it is in, at any depth, on the object or
    any object above it (``a``, ``a.b``, ``a.b.c``).  ``actions`` are normalised, in order, without ownership;
    ``sources`` is the number of grants they come from.  Pairs without a privilege have empty actions and 0.
    Each pair meets its own few parents and groups by equi-joins; a grant that all inherit is one row of them.
    """
    pairs = asked.select("principal", "object_key").where("principal is not null and object_key is not null").distinct()
    parts = F.split("object_key", r"\.")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    above = pairs.select("principal", "object_key", F.explode(up).alias("on"))
    held = drop_ownership(grants).select(F.col("principal").alias("holder"), F.col("object_key").alias("on"),
                                         F.upper("object_type").alias("kind"), N.norm_privilege(F.col("action_type")).alias("action")).distinct()
    # Grants on objects that somebody asks for, by group; then by who is in the group.
    closure = group_closure(memberships)
    self_ = pairs.select("principal").distinct().withColumn("holder", F.col("principal"))
    who = closure.join(pairs.select("principal").distinct(), "principal", "left_semi").select("principal", F.col("group_name").alias("holder")).unionByName(self_).distinct()
    got = above.join(who, "principal").join(held, ["holder", "on"]).groupBy("principal", "object_key").agg(
        F.array_join(F.array_sort(F.collect_set("action")), ", ").alias("actions"), F.count(F.lit(1)).alias("sources"))
    return pairs.join(got, ["principal", "object_key"], "left").select(
        "principal", "object_key", F.coalesce("actions", F.lit("")).alias("actions"), F.coalesce("sources", F.lit(0)).alias("sources"))
