"""Preflight: storage location match and the consolidated findings report.

Findings are (severity, check, detail) with severity OK / WARN / FAIL; an
undecidable check is WARN, never silently OK.  All facts come from one
aggregate over a tagged union of the inputs; no cross joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultshift.functions import names as N


def location_match(paths: DataFrame, locations: DataFrame) -> DataFrame:
    """(path_id, name): the location whose url is the longest prefix of the path.

    A url matches when the path, trailing slashes removed, equals it or
    starts with it plus '/'.  Each path is expanded into its '/'-prefixes
    (bounded by the path depth) and equi-joined with the locations.  Only
    prefixes that are locations come back to the paths; each distinct prefix
    is looked up once, so 's3://lake', a candidate of nearly every path, is
    one row of that join.  Ties: longer original url, then name.  A location
    without a name or url matches nothing.
    """
    p = paths.select("path_id", N.trim_slashes(F.col("path")).alias("p"))
    parts = F.split(F.col("p"), "/")
    cands = p.select(
        "path_id",
        F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)),
                              lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("cand"),
    )
    locs = (
        locations.where("name is not null and url is not null")
        .select("name", F.length("url").alias("url_len"), N.trim_slashes(F.col("url")).alias("cand"))
        .where(F.col("cand") != "").groupBy("cand")
        .agg(F.min(F.struct((-F.col("url_len")).alias("l"), F.col("name").alias("n"))).alias("loc"))
    )
    hit = locs.join(cands.select("cand").distinct(), "cand", "left_semi")
    best = cands.join(hit, "cand").groupBy("path_id").agg(F.min("loc").alias("loc"))
    return paths.select("path_id").distinct().join(best, "path_id", "left").select("path_id", F.col("loc.n").alias("name"))


def _fact(tag: str, value: Column | None = None) -> Column:
    return F.col("tag") == tag if value is None else value


def preflight_report(catalogs: DataFrame, schemata: DataFrame, grants: DataFrame, memberships: DataFrame,
                     locations: DataFrame, catalog: str, runner: str, catalog_owner: str | None,
                     metastore_owner: str | None, storage_path: str) -> DataFrame:
    """Findings of all preflight checks plus one SUMMARY row (severity FAIL or SUCCESS)."""
    spark = catalogs.sparkSession
    aux, bkp = f"{catalog}_aux", f"{catalog}_bkp"
    match = location_match(spark.range(1).select(F.lit(0).alias("path_id"), F.lit(storage_path).alias("path")),
                           locations)
    norm = N.norm_privilege(F.col("action_type"))
    tagged = (
        catalogs.select(F.when(F.col("catalog") == catalog, "cat").when(F.col("catalog") == aux, "aux")
                        .when(F.col("catalog") == bkp, "bkp").alias("tag"), F.lit(None).cast("string").alias("v"))
        .unionByName(schemata.where(F.col("schema_name") != "information_schema").select(
            F.lit("schema").alias("tag"), F.lit(None).cast("string").alias("v")))
        .unionByName(memberships.where(F.col("principal") == runner).select(
            F.lit("member").alias("tag"), F.col("group_name").alias("v")))
        .unionByName(grants.where((F.col("principal") == runner) & (F.upper(F.col("object_type")) == "METASTORE"))
                     .select(F.lit("ms_grant").alias("tag"), norm.alias("v")))
        .unionByName(match.select(F.lit("loc").alias("tag"), F.col("name").alias("v")))
        .unionByName(grants.where((F.col("principal") == runner)
                                  & (F.upper(F.col("object_type")) == "EXTERNAL LOCATION"))
                     .join(match.select(F.col("name").alias("object_key")), "object_key", "left_semi")
                     .select(F.lit("loc_grant").alias("tag"), norm.alias("v")))
    )
    facts = tagged.agg(
        F.count_if(_fact("cat")).alias("n_cat"), F.count_if(_fact("aux")).alias("n_aux"),
        F.count_if(_fact("bkp")).alias("n_bkp"), F.count_if(_fact("schema")).alias("n_schema"),
        F.count_if(_fact("member")).alias("n_member"),
        F.count_if(_fact("member") & (F.col("v") == F.lit(metastore_owner))).alias("n_owner_group"),
        F.array_sort(F.collect_set(F.when(_fact("ms_grant"), F.col("v")))).alias("ms_grants"),
        F.max(F.when(_fact("loc"), F.col("v"))).alias("loc"),
        F.array_sort(F.collect_set(F.when(_fact("loc_grant"), F.col("v")))).alias("loc_grants"),
    )
    if metastore_owner is None:
        admin = F.lit(None).cast("boolean")
    else:
        admin = (F.when(F.lit(runner == metastore_owner), F.lit(True))
                 .when(F.col("n_member") == 0, F.lit(None).cast("boolean"))
                 .otherwise(F.col("n_owner_group") > 0))
    facts = facts.withColumn("admin", admin)
    a = F.col("admin")
    mo = metastore_owner or ""

    def finding(sev: Column, check: str, detail: Column) -> Column:
        return F.struct(sev.alias("severity"), F.lit(check).alias("check"), detail.alias("detail"))

    # Severities and the wording of each finding follow the reference.
    ok, warn, fail = F.lit("OK"), F.lit("WARN"), F.lit("FAIL")
    granted = F.when(F.size("ms_grants") > 0, F.array_join("ms_grants", ", ")).otherwise(F.lit("none"))
    owner_known = F.lit(bool(catalog_owner))
    items = [
        finding(F.when(a.isNull(), warn).otherwise(ok), "metastore_admin",
                F.when(a, F.lit(f"runner is a metastore admin (via owner '{mo}')"))
                .when(~a, F.lit(f"runner is NOT a metastore admin (metastore owner: '{mo}')"))
                .otherwise(F.lit("could not determine metastore admin status"))),
        finding(F.when(F.col("n_cat") == 0, fail).when(owner_known, ok).otherwise(warn), "source_catalog_exists",
                F.when(F.col("n_cat") == 0, F.lit(f"Catalog '{catalog}' not found or inaccessible"))
                .when(owner_known, F.lit(f"owner={catalog_owner}"))
                .otherwise(F.lit("Catalog exists but owner could not be read"))),
        finding(F.when(F.lit(runner == catalog_owner) | a, ok).when(a.isNull(), warn).otherwise(fail),
                "source_catalog_rename_privilege",
                F.when(F.lit(runner == catalog_owner), F.lit("runner is the catalog owner"))
                .when(a, F.lit("runner is a metastore admin (implicit rename privilege)"))
                .otherwise(F.lit(f"Runner '{runner}' is neither the source catalog owner (owner='{catalog_owner or ''}') "
                                 "nor a confirmed metastore admin."))),
        finding(F.when(F.col("n_schema") > 0, ok).otherwise(fail), "source_catalog_use_catalog",
                F.when(F.col("n_schema") > 0, F.lit("")).otherwise(F.lit("Cannot list schemas in source catalog"))),
        finding(F.when(F.col("n_aux") > 0, fail).otherwise(ok), "aux_catalog_free",
                F.when(F.col("n_aux") > 0, F.lit(f"Catalog '{aux}' already exists — drop it before running"))
                .otherwise(F.lit(f"'{aux}' is available"))),
        finding(F.when(F.col("n_bkp") > 0, fail).otherwise(ok), "bkp_catalog_free",
                F.when(F.col("n_bkp") > 0, F.lit(f"Catalog '{bkp}' already exists — drop or rename it before running"))
                .otherwise(F.lit(f"'{bkp}' is available"))),
        finding(F.when(a | F.arrays_overlap("ms_grants", F.array(F.lit("CREATECATALOG"), F.lit("ALLPRIVILEGES"))), ok)
                .otherwise(fail), "metastore_create_catalog",
                F.when(a, F.lit("implicit via metastore admin"))
                .when(F.arrays_overlap("ms_grants", F.array(F.lit("CREATECATALOG"), F.lit("ALLPRIVILEGES"))),
                      F.lit("CREATE CATALOG granted at metastore"))
                .otherwise(F.concat(F.lit("Runner lacks CREATE CATALOG on the metastore. Granted: "), granted,
                                    F.lit(". Request CREATE CATALOG from your metastore admin.")))),
        finding(F.when(F.col("loc").isNotNull(), ok).otherwise(fail), "external_location_exists",
                F.when(F.col("loc").isNotNull(), F.concat(F.lit("'"), F.col("loc"), F.lit(f"' covers '{storage_path}'")))
                .otherwise(F.lit(f"No external location covers path '{storage_path}'."))),
    ]
    loc_ok = F.arrays_overlap("loc_grants", F.array(F.lit("CREATEMANAGEDSTORAGE"), F.lit("ALLPRIVILEGES")))
    loc_granted = F.when(F.size("loc_grants") > 0, F.array_join("loc_grants", ", ")).otherwise(F.lit("none"))
    items.append(F.when(F.col("loc").isNotNull(), finding(
        F.when(a | loc_ok, ok).otherwise(fail), "external_location_privilege",
        F.when(a, F.concat(F.lit("implicit via metastore admin on '"), F.col("loc"), F.lit("'")))
        .when(loc_ok, F.concat(F.lit("CREATE MANAGED STORAGE granted on '"), F.col("loc"), F.lit("'")))
        .otherwise(F.concat(F.lit("Runner lacks CREATE MANAGED STORAGE on '"), F.col("loc"), F.lit("'. Granted: "),
                            loc_granted, F.lit(". Request CREATE MANAGED STORAGE from the location owner."))))))
    findings = facts.select(F.explode(F.array(*items)).alias("f")).where(F.col("f").isNotNull()).select("f.*")
    summary = findings.agg(
        F.count_if(F.col("severity") == "OK").alias("oks"), F.count_if(F.col("severity") == "WARN").alias("warns"),
        F.count_if(F.col("severity") == "FAIL").alias("fails"),
    ).select(
        F.when(F.col("fails") > 0, "FAIL").otherwise("SUCCESS").alias("severity"),
        F.lit("SUMMARY").alias("check"),
        F.when(F.col("fails") > 0, F.concat(F.col("fails").cast("string"), F.lit(" failed, "),
                                            F.col("warns").cast("string"), F.lit(" warnings")))
        .otherwise(F.concat(F.col("oks").cast("string"), F.lit(" OK, "), F.col("warns").cast("string"),
                            F.lit(" warnings"))).alias("detail"),
    )
    return findings.unionByName(summary)
