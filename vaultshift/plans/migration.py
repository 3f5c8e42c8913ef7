"""One migration run (a batch): the steps a user calls, each appending its
log rows to the audit log once.

Re-running a batch skips tables already logged SUCCESS for it (resume).
"""

from __future__ import annotations

import datetime as _dt
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultshift.functions import names as N
from vaultshift.operators import auditlog, clone, files, inventory, validate


class Migration:
    def __init__(self, spark: SparkSession, catalog: str, log: auditlog.AuditLog, batch_id: str | None = None):
        self.spark = spark
        self.catalog = catalog
        self.log = log
        self.batch_id = batch_id or auditlog.batch_id_for()

    def _now(self) -> _dt.datetime:
        return _dt.datetime.now(_dt.timezone.utc)

    def _append(self, rows: DataFrame, phase: str, **cols) -> None:
        self.log.append(auditlog.log_rows(rows, self.batch_id, self.catalog, phase, self._now(), **cols))

    # -- inventory / dry run ----------------------------------------------------------
    def inventory(self, schemata: DataFrame, tables: DataFrame, volumes: DataFrame, routines: DataFrame) -> None:
        self._append(inventory.inventory_log(schemata, tables, volumes, routines, self.catalog), "inventory")

    def risks(self, tables: DataFrame, volumes: DataFrame, catalogs: DataFrame, share_objects: DataFrame) -> None:
        r = inventory.risk_report(tables, volumes, catalogs, share_objects, self.catalog)
        self._append(r, "inventory", object_type=F.lit("WARNING"), object_name=F.lit(self.catalog),
                     status=F.lit("WARNING"), message="detail")

    def dry_run(self, schemata, tables, volumes, routines, catalogs, share_objects) -> DataFrame:
        """Inventory and risks to the log; returns the dry-run summary (lazy, nothing written)."""
        self.inventory(schemata, tables, volumes, routines)
        self.risks(tables, volumes, catalogs, share_objects)
        done = self.spark.range(1).select(F.lit("CATALOG").alias("object_type"), F.lit(self.catalog).alias("object_name"),
                                          F.lit("SUCCESS").alias("status"), F.lit("Dry run completed").alias("message"))
        self._append(done, "dry_run")
        return inventory.inventory_summary(schemata, tables, volumes, routines)

    # -- plans ------------------------------------------------------------------------
    def plan(self, target: str, schemata: DataFrame, describe_kv: DataFrame, tables: DataFrame,
             routines: DataFrame, parameters: DataFrame, tag_rows: DataFrame | None = None,
             direct_grants: DataFrame | None = None, volumes: DataFrame | None = None,
             volume_owners: DataFrame | None = None, object_tags: DataFrame | None = None,
             constraints: tuple[DataFrame, DataFrame, DataFrame] | None = None, views: DataFrame | None = None,
             catalog_owner: str | None = None, view_order: DataFrame | None = None) -> DataFrame:
        """Every statement that rebuilds the catalog as ``target``, one relation:
        (step, level, object_type, object_name, statement) in the order to run them.
        ``level`` orders the views of step 9 by what they read, as ``view_order`` (object_type, object_name,
        step, status; ``plans.ordering.migration_order``) says; views without a place there are left out.

        Steps: 1 schemas; 2 their properties, comments of tables; 3 functions and volumes; 4 tags; 5 grants;
        6 owners; 7 primary and 8 foreign keys, after the data; 9 views, which name the catalog after the
        swap; 10 comments, tags, grants and owners of views; 11 the catalog's owner, last.
        """
        from vaultshift.operators import routines as rtn
        from vaultshift.operators import views as vw
        from vaultshift.plans import statements as st

        is_view = F.col("object_type").isin("VIEW", "MATERIALIZED_VIEW", "METRIC_VIEW")

        def at(step: int):
            return F.when(is_view, F.lit(10)).otherwise(F.lit(step))

        parts = [
            st.schema_plan(schemata, describe_kv, self.catalog, target).withColumn("step", F.col("seq") + 1)
            .drop("seq"),
            st.comment_plan(tables, self.catalog, target).withColumn("step", at(2)),
            rtn.function_ddl(routines, parameters, target).where(F.col("status") == "PLANNED").select(
                F.lit("FUNCTION").alias("object_type"),
                F.concat_ws(".", F.lit(self.catalog), "routine_schema", "routine_name").alias("object_name"),
                F.col("ddl").alias("statement"), F.lit(3).alias("step")),
        ]
        if volumes is not None:
            parts.append(st.volume_plan(volumes, volume_owners, self.catalog, target)
                         .withColumn("step", F.when(F.col("seq") == 0, F.lit(3)).otherwise(F.lit(6))).drop("seq"))
        if object_tags is not None:
            parts.append(st.object_tag_plan(object_tags, self.catalog, target).withColumn("step", F.lit(4)))
        if tag_rows is not None:
            made_later = inventory.classify_tables(tables).where(F.col("class").isin("view", "mv", "metric_view")).select(
                "table_schema", "table_name", F.lit(10).alias("later"))
            parts.append(st.tag_plan(tables, tag_rows, self.catalog, target).where(F.col("mode") == "batch")
                         .join(made_later, ["table_schema", "table_name"], "left").select(
                F.lit("TAG").alias("object_type"),
                F.concat_ws(".", F.lit(self.catalog), "table_schema", "table_name").alias("object_name"),
                "statement", F.coalesce("later", F.lit(4)).alias("step")))
        if direct_grants is not None:
            parts.append(st.grant_plan(direct_grants, self.catalog, target).withColumn("step", at(5)))
        parts.append(st.owner_plan(schemata, describe_kv, tables, routines, self.catalog, target)
                     .withColumn("step", at(6)))
        if constraints is not None:
            parts.append(st.constraint_plan(*constraints, self.catalog, target).select(
                F.lit("CONSTRAINT").alias("object_type"),
                F.concat_ws(".", F.lit(self.catalog), "table_schema", "table_name").alias("object_name"),
                "statement", (F.col("step") + 6).alias("step")))
        if views is not None:
            made = vw.recreate_plan(tables, views, self.catalog).where(F.col("status") == "PLANNED").select(
                "object_type", "object_name", F.coalesce("statement", "fallback").alias("statement"), F.lit(9).alias("step"))
            if view_order is not None:
                place = view_order.where("status = 'SUCCESS'").select(
                    "object_type", F.concat_ws(".", F.lit(self.catalog), "object_name").alias("object_name"), F.col("step").alias("level"))
                made = made.join(place, ["object_type", "object_name"])
            parts.append(made)
        if catalog_owner:
            parts.append(self.spark.range(1).select(
                F.lit("CATALOG").alias("object_type"), F.lit(self.catalog).alias("object_name"),
                F.concat(F.lit("ALTER CATALOG "), N.quote_part(F.lit(self.catalog)), F.lit(" SET OWNER TO "),
                         N.quote_part(F.lit(catalog_owner))).alias("statement"), F.lit(11).alias("step")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        level = F.coalesce("level", F.lit(0)) if "level" in out.columns else F.lit(0)
        return out.select("step", level.cast("int").alias("level"), "object_type", "object_name", "statement")

    # -- tables -------------------------------------------------------------------------
    def _done(self, phase: str) -> set[str]:
        """Objects already logged SUCCESS in this batch for ``phase`` (small: names only)."""
        log = self.log.read_or_empty()
        rows = (log.where((F.col("batch_id") == self.batch_id) & (F.col("phase") == phase)
                          & (F.col("status") == "SUCCESS")).select("object_name").distinct().collect())
        return {r[0] for r in rows}

    def copy_tables(self, sources: dict[str, DataFrame], target_root: str, schema_of: dict[str, str] | None = None,
                    parallel: int = 4) -> DataFrame:
        """Copy tables (name -> DataFrame) below ``target_root``; one log row per table.

        Tables already logged SUCCESS in this batch are skipped.
        """
        schema_of = schema_of or {}
        fq = {n: f"{self.catalog}.{schema_of.get(n, 'default')}.{n}" for n in sources}
        done = self._done("tables")
        todo = {n: df for n, df in sources.items() if fq[n] not in done}
        results = clone.clone_tables(self.spark, todo, target_root, parallel=parallel) if todo else []
        rows = self.spark.createDataFrame(
            [(fq[r.table_name], r.table_name, r.rows_target, r.status, r.message, float(r.seconds)) for r in results],
            "object_name string, table_name string, rows bigint, status string, message string, duration_seconds double")
        if results:
            self._append(rows, "tables", object_type=F.lit("TABLE"), duration="duration_seconds")
        return rows

    # -- volumes ------------------------------------------------------------------------
    def copy_volume(self, name: str, src_root: str, dst_root: str, work_dir: str) -> DataFrame:
        """Copy all files of a volume and check them; the volume is SUCCESS only if
        every file arrived with the same bytes.  Files are counted recursively.

        ``work_dir`` (shared folder) keeps the file list and per-file results.
        """
        t0 = time.time()
        listed = files.snapshot_manifest(self.spark, src_root, f"{work_dir}/manifest")
        files.copy_files(self.spark, listed, src_root, dst_root).write.parquet(f"{work_dir}/copied")
        copied = self.spark.read.schema(files.COPY_SCHEMA).parquet(f"{work_dir}/copied")
        target = files.hash_files(self.spark, files.snapshot_manifest(self.spark, dst_root, f"{work_dir}/manifest-dst"),
                                  dst_root)
        issues = files.file_check(files.with_hashes(listed, copied), target).cache()
        c = copied.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") != "COPIED").alias("failed")).first()
        bad = issues.where(F.col("issue") != "OK").count()
        status = "SUCCESS" if c["failed"] == 0 and bad == 0 else "FAILED"
        row = self.spark.range(1).select(
            F.lit("VOLUME").alias("object_type"), F.lit(f"{self.catalog}.{name}").alias("object_name"),
            F.lit(status).alias("status"),
            F.lit(f"files={c['n']} failed={c['failed']} mismatched={bad}").alias("message"),
            F.lit(time.time() - t0).alias("d"))
        self._append(row, "volumes", duration="d")
        return issues

    # -- validation and summary -----------------------------------------------------
    def validate(self, count_checks: DataFrame | None = None, rowcount_checks: DataFrame | None = None,
                 grant_checks: DataFrame | None = None) -> None:
        if count_checks is not None:
            self._append(count_checks, "validation", object_type=F.lit("COUNT_CHECK"))
        if rowcount_checks is not None:
            self._append(rowcount_checks, "validation", object_type=F.lit("ROW_COUNT"))
        if grant_checks is not None:
            self._append(grant_checks, "validation", object_type=F.lit("GRANT_CHECK"))

    def summary(self) -> DataFrame:
        return auditlog.summary(self.log.read(), self.batch_id)

    def verdict(self) -> DataFrame:
        """Judged by the latest row of each object, so a repeated step or check replaces what failed before."""
        log = auditlog.latest(self.log.read(), self.batch_id)
        checks = log.where(F.col("phase") == "validation").select("status")
        return validate.verdict(checks, auditlog.failure_count(log, self.batch_id))

