"""End to end on a live session catalog: harvest, dry run, copy, validate, verdict."""

from pyspark.sql import functions as F

from vaultshift.operators import auditlog, inventory, validate
from vaultshift.plans.migration import Migration
from vaultshift.session import fresh_dir
from vaultshift.sources import harvest
from vaultshift.sources.relations import SCHEMAS, read_relation


def test_harvest_and_migrate(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS vs_src")
    spark.sql("DROP VIEW IF EXISTS vs_src.v_orders")
    spark.sql("DROP TABLE IF EXISTS vs_src.t_orders")
    spark.range(100).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).write.saveAsTable("vs_src.t_orders")
    spark.sql("CREATE VIEW vs_src.v_orders AS SELECT k FROM vs_src.t_orders WHERE v > 10")
    schemata = harvest.harvest_schemata(spark, ["vs_src"])
    tables = harvest.harvest_tables(spark, ["vs_src"])
    kinds = {r["table_name"]: r["table_type"] for r in tables.collect()}
    assert kinds == {"t_orders": "MANAGED", "v_orders": "VIEW"}
    views = harvest.harvest_views(spark, tables).first()
    assert views["ddl"].startswith("CREATE VIEW") and "v > 10" in views["view_body"]
    empty = {n: spark.createDataFrame([], SCHEMAS[n]) for n in ("volumes", "routines", "catalogs", "share_objects")}

    log = auditlog.AuditLog(spark, fresh_dir(spark, "t-mig-log"))
    m = Migration(spark, "spark_catalog", log, batch_id="20260101_000000")
    summary = m.dry_run(schemata, tables, empty["volumes"], empty["routines"], empty["catalogs"], empty["share_objects"]).first()
    assert summary["tables"] == 1 and summary["views"] == 1

    src = {"t_orders": spark.table("vs_src.t_orders")}
    target = fresh_dir(spark, "t-mig-data")
    report = m.copy_tables(src, target, schema_of={"t_orders": "vs_src"}).collect()
    assert [r["status"] for r in report] == ["SUCCESS"]
    again = m.copy_tables(src, target, schema_of={"t_orders": "vs_src"}).collect()
    assert again == []  # resumed: already copied in this batch
    new = {"t_orders": spark.read.parquet(f"{target}/t_orders")}
    m.validate(rowcount_checks=validate.rowcount_check(new, src))
    v = m.verdict().first()
    assert v["failed"] == 0 and v["verdict"] == validate.VERDICT_OK
    phases = {r["phase"] for r in m.summary().collect()}
    assert {"inventory", "dry_run", "tables", "validation"} <= phases
    assert inventory.classify_tables(tables).where("scope = 'IN_SCOPE'").count() == 2


def test_unreadable_relation_is_an_error_finding(spark, tmp_path):
    df, findings = read_relation(spark, str(tmp_path / "nowhere"), "grants")
    assert df.count() == 0
    assert [r["severity"] for r in findings.collect()] == ["ERROR"]


def test_copy_volume_logs_recursive_count(spark, tmp_path):
    src = tmp_path / "vol"
    (src / "x" / "y").mkdir(parents=True)
    for i in range(5):
        (src / "x" / "y" / f"f{i}.txt").write_text("z" * i)
    (src / "top.bin").write_bytes(b"\x00\x01")
    log = auditlog.AuditLog(spark, fresh_dir(spark, "t-vol-log"))
    m = Migration(spark, "cat", log, batch_id="b_vol")
    issues = m.copy_volume("s.v", str(src), str(tmp_path / "dst"), fresh_dir(spark, "t-vol-work"))
    assert {r["issue"] for r in issues.collect()} == {"OK"}
    row = log.read().where("phase = 'volumes'").first()
    assert row["status"] == "SUCCESS" and row["message"].startswith("files=6 ")


def test_run_statements_and_create_views(spark):
    from vaultshift.operators import routines, views
    from vaultshift.plans import execute, statements

    spark.sql("DROP DATABASE IF EXISTS vs_exec CASCADE")
    schemata = spark.createDataFrame([("vs_exec", "o", None)], SCHEMAS["schemata"])
    kv = spark.createDataFrame([("vs_exec", "Comment", "made here"), ("vs_exec", "Owner", "o")], SCHEMAS["describe_kv"])
    res = {r["statement"].split(" ")[0]: r["status"]
           for r in execute.run_statements(spark, statements.schema_plan(schemata, kv, "x", "spark_catalog")).collect()}
    assert res == {"CREATE": "SUCCESS"}
    r = spark.createDataFrame(
        [(1, "vs_exec", "f_sql", "p1 + 1", "SQL", None, "INT", "YES", "it's", "o"),
         (2, "vs_exec", "f_py", "return 1", "EXTERNAL", "Python", "INT", "NO", None, "o")], SCHEMAS["routines"])
    p = spark.createDataFrame([("vs_exec", "f_sql", "p1", "INT", 1, "IN")], SCHEMAS["parameters"])
    ddl = routines.function_ddl(r, p, "spark_catalog").select(
        F.lit("FUNCTION").alias("object_type"), "routine_name", F.col("ddl").alias("statement")
    ).withColumnRenamed("routine_name", "object_name")
    got = {x["object_name"]: x["status"] for x in execute.run_statements(spark, ddl).collect()}
    assert got == {"f_sql": "SUCCESS", "f_py": "SKIPPED"}
    assert spark.sql("SELECT vs_exec.f_sql(41)").first()[0] == 42
    # two views, the second reads the first: created in level order
    plan = spark.createDataFrame(
        [("VIEW", "v2", "PLANNED", "CREATE VIEW vs_exec.v2 AS SELECT x + 1 AS y FROM vs_exec.v1", None),
         ("VIEW", "v1", "PLANNED", "CREATE VIEW vs_exec.v1 AS SELECT 1 AS x", None),
         ("VIEW", "v3", "SKIPPED", None, None)],
        "object_type string, object_name string, status string, statement string, fallback string")
    order = spark.createDataFrame([("v1", 0, "SUCCESS"), ("v2", 1, "SUCCESS"), ("v3", None, "FAILED")],
                                  "object_name string, level int, order_status string")
    made = {x["object_name"]: x["status"] for x in execute.create_views(spark, plan, order).collect()}
    assert made == {"v1": "SUCCESS", "v2": "SUCCESS", "v3": "SKIPPED"}
    assert spark.sql("SELECT y FROM vs_exec.v2").first()[0] == 2
    assert views is not None


def test_create_views_fallback_and_failure_downstream(spark):
    from vaultshift.plans import execute

    spark.sql("DROP DATABASE IF EXISTS vs_level CASCADE")
    spark.sql("CREATE DATABASE vs_level")
    spark.sql("CREATE VIEW vs_level.present AS SELECT 7 AS x")
    ok, bad = "CREATE VIEW vs_level.{} AS SELECT x FROM vs_level.{}", "CREATE VIEW vs_level.{} AS SELECT nothing_here FROM vs_level.{}"
    rows = [("VIEW", "a", "PLANNED", bad.format("a", "present"), ok.format("a", "present")),  # made by its fallback
            ("VIEW", "b", "PLANNED", bad.format("b", "present"), bad.format("b", "present")),  # fails
            ("VIEW", "c", "PLANNED", None, ok.format("c", "a")),  # no statement: fallback
            ("VIEW", "d", "PLANNED", ok.format("d", "b"), None),  # reads one that failed
            ("VIEW", "e", "PLANNED", ok.format("e", "d"), None),  # and so on
            ("VIEW", "f", "PLANNED", None, None),
            ("VIEW", "g", "PLANNED", ok.format("g", "c"), None),
            ("VIEW", "h", "PLANNED", ok.format("h", "g"), None)]  # its order can't be met
    plan = spark.createDataFrame(rows, "object_type string, object_name string, status string, statement string, fallback string")
    order = spark.createDataFrame([("a", 0, "SUCCESS"), ("b", 0, "SUCCESS"), ("c", 1, "SUCCESS"), ("d", 1, "SUCCESS"), ("e", 2, "SUCCESS"),
                                   ("f", 0, "SUCCESS"), ("g", 2, "SUCCESS"), ("h", None, "FAILED")], "object_name string, level int, order_status string")
    deps = spark.createDataFrame([("a", "present"), ("c", "a"), ("c", "a"), ("d", "b"), ("d", "a"), ("e", "d"), ("g", "c"), ("h", "g")], "object_name string, reads string")
    res = {r["object_name"]: r for r in execute.create_views(spark, plan, order, deps).collect()}
    assert {k: (r["status"], r["used"]) for k, r in res.items()} == {
        "a": ("SUCCESS", "FALLBACK"), "b": ("FAILED", None), "c": ("SUCCESS", "FALLBACK"), "d": ("SKIPPED", None), "e": ("SKIPPED", None),
        "f": ("FAILED", None), "g": ("SUCCESS", "STATEMENT"), "h": ("SKIPPED", None)}
    assert "b" in res["d"]["error"] and "d" in res["e"]["error"] and "nothing_here" in res["b"]["error"]
    assert spark.sql("SELECT x FROM vs_level.g").first()[0] == 7
    assert execute.create_views(spark, plan.limit(0), order, deps).count() == 0


def test_plan_from_harvest_and_run(spark):
    from vaultshift.plans import execute

    spark.sql("DROP DATABASE IF EXISTS vs_plan_src CASCADE")
    spark.sql("CREATE DATABASE vs_plan_src COMMENT 'source db' WITH DBPROPERTIES ('team' = 'x')")
    spark.range(3).write.saveAsTable("vs_plan_src.t1")
    kv = harvest.harvest_describe(spark, ["vs_plan_src"])
    assert {r["info_name"] for r in kv.collect()} >= {"Comment", "Owner"}
    schemata = harvest.harvest_schemata(spark, ["vs_plan_src"]).selectExpr("'vs_plan_dst' AS schema_name",
                                                                        "schema_owner", "comment")
    kv2 = kv.selectExpr("'vs_plan_dst' AS object_name", "info_name", "info_value")
    tables = harvest.harvest_tables(spark, ["vs_plan_src"])
    routines = spark.createDataFrame([], SCHEMAS["routines"])
    params = spark.createDataFrame([], SCHEMAS["parameters"])
    m = Migration(spark, "spark_catalog", auditlog.AuditLog(spark, fresh_dir(spark, "t-plan-log")), batch_id="bp")
    plan = m.plan("spark_catalog", schemata, kv2, tables, routines, params)
    spark.sql("DROP DATABASE IF EXISTS vs_plan_dst CASCADE")
    res = execute.run_statements(spark, plan, order=["step"]).collect()
    created = [r for r in res if r["statement"].startswith("CREATE SCHEMA")]
    assert created and created[0]["status"] == "SUCCESS"
    assert "source db" in created[0]["statement"]
    assert spark.sql("DESCRIBE DATABASE EXTENDED vs_plan_dst").where("info_name = 'Comment'").first()[1] == "source db"
    props = [r for r in res if "DBPROPERTIES" in r["statement"]]
    assert props and props[0]["status"] == "SUCCESS", props
    desc = {r[0]: r[1] for r in spark.sql("DESCRIBE DATABASE EXTENDED vs_plan_dst").collect()}
    assert "team" in desc.get("Properties", "")


def test_schema_diff_on_harvested_columns(spark):
    spark.sql("DROP DATABASE IF EXISTS vs_cols CASCADE")
    spark.sql("CREATE DATABASE vs_cols")
    spark.sql("CREATE TABLE vs_cols.a (id BIGINT COMMENT 'key', name STRING, amount DOUBLE) USING parquet")
    spark.sql("CREATE TABLE vs_cols.b (id BIGINT, name STRING COMMENT 'label', amount DECIMAL(12,2)) USING parquet")
    cols = harvest.harvest_columns(spark, harvest.harvest_tables(spark, ["vs_cols"]))
    a = cols.where("table_name = 'vs_cols.a'").withColumn("table_name", F.lit("t"))
    b = cols.where("table_name = 'vs_cols.b'").withColumn("table_name", F.lit("t"))
    got = sorted((r["column_name"], r["issue"]) for r in validate.schema_diff(a, b, check_comments=True).collect())
    assert got == [("amount", "type_changed"), ("id", "comment_changed"), ("name", "comment_changed")]


def test_whole_plan_in_order(spark):
    from tests.conftest import SF_SMALL
    from vaultshift.operators import access, auditlog
    from vaultshift.plans.migration import Migration
    from vaultshift.session import fresh_dir
    from vaultshift.sources.fixtures import Fixtures

    f = Fixtures(spark, SF_SMALL)
    run = Migration(spark, "prod", auditlog.AuditLog(spark, fresh_dir(spark, "t-plan")))
    objects = access.securables(f["m_schemata"], f["m_tables"], "prod", f["m_routines"], f["m_volumes"])
    plan = run.plan("prod_new", f["m_schemata"], f["m_describe_kv"], f["m_tables"], f["m_routines"], f["m_parameters"], f["m_tags"],
                    access.direct_grants(f["m_grants"], objects), f["m_volumes"], f["m_volume_owners"], f["m_object_tags"],
                    (f["m_table_constraints"], f["m_key_column_usage"], f["m_referential_constraints"]), f["m_views"], "boss").collect()
    by = {}
    for r in plan:
        by.setdefault(r["step"], []).append(r)
        assert r["statement"]
    assert set(by) == set(range(1, 12)) and [r["statement"] for r in by[11]] == ["ALTER CATALOG `prod` SET OWNER TO `boss`"]
    assert all("PRIMARY KEY" in r["statement"] for r in by[7]) and all("FOREIGN KEY" in r["statement"] for r in by[8])
    assert all("`prod_new`" not in r["statement"] for r in by[9] + by[10])
    assert all("`prod_new`" in r["statement"] for s in (1, 3, 4, 6) for r in by[s])
    assert {r["object_type"] for r in by[3]} == {"FUNCTION", "VOLUME"}


def test_views_of_a_plan_come_after_what_they_read(spark):
    from vaultshift.plans import ordering
    from vaultshift.sources.fixtures import Fixtures

    f = Fixtures(spark, "/root/testdata/sf0.001")
    named = f["m_tables"].selectExpr("table_schema AS schema_name").distinct()
    order = ordering.migration_order(*ordering.objects(named, f["m_tables"], f["m_routines"], f["m_table_constraints"],
                                                       f["m_referential_constraints"], f["m_view_deps"], "prod"))
    m = Migration(spark, "prod", auditlog.AuditLog(spark, fresh_dir(spark, "t-view-order")))
    plan = m.plan("prod_new", f["m_schemata"], f["m_describe_kv"], f["m_tables"], f["m_routines"], f["m_parameters"], views=f["m_views"], view_order=order)
    level = {r.object_name: r.level for r in plan.where("step = 9").collect()}
    name = {r.tid: f"prod.{r.table_schema}.{r.table_name}" for r in f["m_tables"].collect()}
    pairs = [(name[r.view_id], name[r.dep_id]) for r in f["m_view_deps"].collect()]
    held = [(v, d) for v, d in pairs if v in level and d in level]
    assert len(held) > 20 and all(level[v] > level[d] for v, d in held) and max(level.values()) > 10
    placed = {(r.object_type, r.object_name): r for r in order.collect()}
    assert all(r.step >= 1 for (kind, _), r in placed.items() if kind != "SCHEMA" and r.step is not None)
    assert {r.status for (kind, _), r in placed.items() if kind == "FOREIGN KEY"} == {"SUCCESS", "FAILED"}
