"""Edge cases: names, internal tables, digests over awkward types, files, log, pointers."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from vaultshift.functions import names as N
from vaultshift.operators import auditlog, clone, files, inventory, publish, routines
from vaultshift.session import fresh_dir


def test_quoting_and_escaping(spark):
    df = spark.createDataFrame([("we`ird", "it's a \\ path", "a.b")], "a string, b string, c string")
    r = df.select(N.quoted(F.lit("cat"), F.col("a"), F.col("c")).alias("q"), N.escape_literal(F.col("b")).alias("e"),
                  N.fqn(F.lit("cat"), F.col("c")).alias("f"), N.norm_privilege(F.lit("create_catalog ")).alias("p"),
                  N.trim_slashes(F.lit("s3://x//")).alias("t")).first()
    assert r["q"] == "`cat`.`we``ird`.`a.b`"
    assert r["e"] == "it\\'s a \\\\ path"
    assert r["f"] == "cat.a.b"
    assert r["p"] == "CREATECATALOG"
    assert r["t"] == "s3://x"


def test_internal_table_patterns(spark):
    df = spark.createDataFrame(
        [("event_log_7a",), ("event_log_zz",), ("__materialization_x",), ("EVENT_LOG_7",), ("t_event_log_1",)],
        "table_name string")
    got = [r[0] for r in df.select(inventory.is_internal(F.col("table_name"))).collect()]
    assert got == [True, False, True, False, False]


def test_unknown_type_is_out_of_scope(spark):
    t = spark.createDataFrame([(1, "s", "t", "FOREIGN", "o", None), (2, "s", "u", None, "o", None)],
                              "tid bigint, table_schema string, table_name string, table_type string, "
                              "table_owner string, comment string")
    rows = inventory.classify_tables(t).select("scope", "log_message").collect()
    assert [r["scope"] for r in rows] == ["OUT_OF_SCOPE", "OUT_OF_SCOPE"]
    assert rows[0]["log_message"] == "type=FOREIGN (unknown)"


def test_zero_parameter_function(spark):
    r = spark.createDataFrame(
        [(1, "s", "f", "1", "SQL", None, "INT", "YES", None, "o")],
        "rid bigint, routine_schema string, routine_name string, routine_definition string, routine_body string, "
        "external_language string, full_data_type string, is_deterministic string, comment string, routine_owner string")
    p = spark.createDataFrame([], "specific_schema string, specific_name string, parameter_name string, "
                                  "full_data_type string, ordinal_position int, parameter_mode string")
    row = routines.function_ddl(r, p, "cat_aux").first()
    assert row["ddl"] == "CREATE FUNCTION `cat_aux`.`s`.`f`()\nRETURNS INT\nDETERMINISTIC\nRETURN 1"


def test_digest_awkward_types(spark):
    schema = "k int, d double, m map<string,int>, a array<float>"
    a = spark.createDataFrame([(1, -0.0, {"x": 1, "y": 2}, [0.0, float("nan")]), (2, None, None, None)], schema)
    b = spark.createDataFrame([(2, None, None, None), (1, 0.0, {"y": 2, "x": 1}, [-0.0, float("nan")])], schema)
    assert clone.digest_value(a) == clone.digest_value(b)
    c = spark.createDataFrame([(1, None, None, None), (2, 0.0, {"x": 1, "y": 2}, [0.0, float("nan")])], schema)
    assert clone.digest_value(a) != clone.digest_value(c)


def test_nulls_in_different_columns_differ(spark):
    a = spark.createDataFrame([(None, "x")], "a string, b string")
    b = spark.createDataFrame([("x", None)], "a string, b string")
    assert clone.digest_value(a) != clone.digest_value(b)


def test_clone_empty_and_partitioned(spark):
    empty = spark.createDataFrame([], "id bigint, part string")
    res = clone.clone_one(spark, "empty", empty, fresh_dir(spark, "t-empty"))
    assert res.status == "SUCCESS" and res.rows_target == 0
    df = spark.createDataFrame([(1, "01"), (2, "02"), (3, "01")], "id bigint, part string")
    res = clone.clone_one(spark, "parted", df, fresh_dir(spark, "t-parted"), partition_by=["part"])
    assert res.status == "SUCCESS" and res.rows_target == 3


def test_file_copy_nested_and_check(spark, tmp_path):
    src = tmp_path / "src"
    (src / "a" / "b").mkdir(parents=True)
    (src / "top.txt").write_bytes(b"hello")
    (src / "a" / "b" / "deep.bin").write_bytes(os.urandom(3 * 1024 * 1024 + 5))
    (src / "a" / "empty.txt").write_bytes(b"")
    dst = tmp_path / "dst"
    m = files.manifest(spark, str(src))
    assert sorted(r["path"] for r in m.collect()) == ["a/b/deep.bin", "a/empty.txt", "top.txt"]
    copied = files.copy_files(spark, m, str(src), str(dst)).collect()
    assert {r["status"] for r in copied} == {"COPIED"}
    target = files.hash_files(spark, files.manifest(spark, str(dst)), str(dst))
    src_rows = spark.createDataFrame([(r["path"], r["bytes"], r["sha2"]) for r in copied], "path string, bytes bigint, sha2 string")
    assert {r["issue"] for r in files.file_check(src_rows, target).collect()} == {"OK"}
    (dst / "a" / "b" / "deep.bin").write_bytes(b"x")
    (dst / "extra.txt").write_bytes(b"e")
    target = files.hash_files(spark, files.manifest(spark, str(dst)), str(dst))
    issues = {r["path"]: r["issue"] for r in files.file_check(src_rows, target).collect()}
    assert issues["a/b/deep.bin"] == "SIZE" and issues["extra.txt"] == "EXTRA" and issues["top.txt"] == "OK"


def test_failed_clone_heals(spark):
    root = fresh_dir(spark, "t-heal")
    good = spark.createDataFrame([(1, "x")], "id bigint, _h string")
    bad = good.selectExpr("id", "raise_error('no source') AS _h")
    res = clone.clone_one(spark, "t", bad.selectExpr("id", "CAST(_h AS STRING) AS _h"), f"{root}/t")
    assert res.status == "FAILED" and "no source" in res.message
    res = clone.clone_one(spark, "t", good, f"{root}/t")
    assert res.status == "SUCCESS" and spark.read.parquet(f"{root}/t").collect() == good.collect()
    again = clone.clone_one(spark, "t", good, f"{root}/t")
    assert again.status == "FAILED" and "exists" in again.message


def test_second_row_hash_is_independent(spark):
    df = spark.createDataFrame([(1, None), (None, 1), (1, 1)], "a bigint, b bigint")
    assert df.select(clone.row_hash2(df)).distinct().count() == 3
    p = df.select(clone.row_hash2(df))._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" not in p


def test_failed_and_packed_files(spark, tmp_path):
    import gzip

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.gz").write_bytes(gzip.compress(b"packed"))
    (tmp_path / "src" / "gone.txt").write_bytes(b"1")
    m = files.snapshot_manifest(spark, str(tmp_path / "src"), fresh_dir(spark, "t-manifest"))
    (tmp_path / "src" / "gone.txt").unlink()
    copied = files.copy_files(spark, m, str(tmp_path / "src"), str(tmp_path / "dst")).cache()
    assert {r["path"]: r["status"] for r in copied.collect()} == {"a.gz": "COPIED", "gone.txt": "FAILED"}
    assert gzip.decompress((tmp_path / "dst" / "a.gz").read_bytes()) == b"packed"
    target = files.hash_files(spark, files.manifest(spark, str(tmp_path / "dst")), str(tmp_path / "dst"))
    issues = {r["path"]: r["issue"] for r in files.file_check(files.with_hashes(m, copied), target).collect()}
    assert issues == {"a.gz": "OK", "gone.txt": "MISSING"}
    lost = spark.createDataFrame([("a.gz", 5), ("none", 1)], "path string, bytes bigint")
    unread = files.hash_files(spark, lost, str(tmp_path / "dst"))
    assert {r["path"]: r["issue"] for r in files.file_check(lost, unread).collect()}["none"] == "UNREADABLE"


def test_ids_of_names_differ():
    from vaultshift.sources.harvest import _id

    names = {_id(f"s{i % 500}", f"t{i}") for i in range(200_000)}
    assert len(names) == 200_000 and _id("a.b", "c") != _id("a", "b.c")


def test_statement_heads():
    from vaultshift.plans.execute import runnable

    assert runnable("CREATE VIEW v AS WITH metrics AS (SELECT 1) SELECT * FROM metrics")
    assert runnable("CREATE VIEW `a b`.`c``d` AS SELECT 'LANGUAGE PYTHON'")
    assert runnable("ALTER SCHEMA `my db` SET DBPROPERTIES ('a' = 'b')")
    assert not runnable("CREATE VIEW s.v\nWITH METRICS\nLANGUAGE YAML\nAS $$\nx\n$$")
    assert not runnable("CREATE FUNCTION s.f(x INT) RETURNS INT LANGUAGE PYTHON AS $$ return 1 $$")
    assert not runnable("GRANT SELECT ON x TO y")


def test_verdict_takes_the_latest_row(spark):
    import datetime as dt

    log = auditlog.AuditLog(spark, fresh_dir(spark, "t-latest"))
    assert log.read_or_empty().count() == 0
    for minute, status in ((0, "FAILED"), (5, "SUCCESS")):
        row = spark.createDataFrame([("TABLE", "c.s.t", status, "m")], "object_type string, object_name string, status string, message string")
        log.append(auditlog.log_rows(row, "b", "c", "tables", dt.datetime(2024, 1, 1, 0, minute, tzinfo=dt.timezone.utc)))
    last = auditlog.latest(log.read(), "b")
    assert [r["status"] for r in last.collect()] == ["SUCCESS"]
    assert auditlog.failure_count(last, "b").first()[0] == 0 and auditlog.failure_count(log.read(), "b").first()[0] == 1


def test_audit_log_append_and_not_null(spark):
    log = auditlog.AuditLog(spark, fresh_dir(spark, "t-log"))
    base = spark.createDataFrame([("TABLE", "c.s.t", "SUCCESS", "grants=2 owner=o", 1.5)],
                                 "object_type string, object_name string, status string, message string, d double")
    now = dt.datetime(2026, 4, 13, 14, 30, 22, tzinfo=dt.timezone.utc)
    rows = auditlog.log_rows(base, auditlog.batch_id_for(now), "c", "tables", now, duration="d")
    log.append(rows)
    got = log.read().collect()
    assert got[0]["batch_id"] == "20260413_143022" and got[0]["duration_seconds"] == 1.5
    bad = auditlog.log_rows(base.withColumn("object_name", F.lit(None).cast("string")), "b", "c", "tables", now)
    with pytest.raises(Exception):
        log.append(bad)


def test_publish_swap_single_pointer_change(spark):
    path = fresh_dir(spark, "t-pointers")
    publish.create_pointers(spark, path, spark.createDataFrame([("cat", 1, "loc_old")], publish.POINTER_SCHEMA))
    publish.publish_swap(spark, path, "cat", "loc_new")
    cur = {r["name"]: (r["version"], r["target"]) for r in publish.resolve(publish.read_pointers(spark, path)).collect()}
    assert cur == {"cat": (2, "loc_new"), "cat_bkp": (2, "loc_old")}


def test_audit_log_registered_as_table(spark):
    log = auditlog.AuditLog(spark, fresh_dir(spark, "t-log-reg"))
    now = dt.datetime(2026, 1, 2, 3, 4, 5)
    base = spark.createDataFrame([("CHECK", "x", "OK", None)],
                                 "object_type string, object_name string, status string, message string")
    log.append(auditlog.log_rows(base, "b9", "cat", "preflight", now))
    spark.sql("DROP TABLE IF EXISTS vs_migration_log")
    log.register("vs_migration_log")
    assert spark.sql("SELECT count(*) FROM vs_migration_log WHERE batch_id = 'b9'").first()[0] == 1
    assert N.current_user(spark)


def test_statement_text_with_awkward_names(spark):
    from vaultshift.plans import statements
    from vaultshift.sources.relations import SCHEMAS

    tables = spark.createDataFrame(
        [(1, "sch`x", "t'1", "MANAGED", "own`er", "it's a \\ comment"),
         (2, "sch`x", "v.1", "VIEW", "o", None)], SCHEMAS["tables"])
    cp = {r["object_name"]: r["statement"] for r in statements.comment_plan(tables, "cat", "cat_aux").collect()}
    assert cp == {"cat.sch`x.t'1": "COMMENT ON TABLE `cat_aux`.`sch``x`.`t'1` IS 'it\\'s a \\\\ comment'"}
    op = {r["object_name"]: r["statement"] for r in statements.owner_plan(
        spark.createDataFrame([], SCHEMAS["schemata"]), spark.createDataFrame([], SCHEMAS["describe_kv"]),
        tables, spark.createDataFrame([], SCHEMAS["routines"]), "cat", "cat_aux").collect()}
    assert op["cat.sch`x.t'1"] == "ALTER TABLE `cat_aux`.`sch``x`.`t'1` SET OWNER TO `own``er`"
    assert op["cat.sch`x.v.1"] == "ALTER VIEW `cat`.`sch``x`.`v.1` SET OWNER TO `o`"


def test_constraint_and_grant_statements(spark):
    from vaultshift.plans import statements
    from vaultshift.sources.relations import SCHEMAS

    tc = spark.createDataFrame([(1, "pk_a", "PRIMARY KEY", "s", "a"), (2, "fk_b", "FOREIGN KEY", "s", "b")],
                               SCHEMAS["table_constraints"])
    kcu = spark.createDataFrame([("pk_a", "s", "a", "id2", 2), ("pk_a", "s", "a", "id1", 1), ("fk_b", "s", "b", "a_id", 1)],
                                SCHEMAS["key_column_usage"])
    rc = spark.createDataFrame([("fk_b", "s", "cat", "s", "pk_a")], SCHEMAS["referential_constraints"])
    rows = sorted((r["step"], r["statement"]) for r in statements.constraint_plan(tc, kcu, rc, "cat", "cat_aux").collect())
    assert rows == [
        (1, "ALTER TABLE `cat_aux`.`s`.`a` ADD CONSTRAINT `pk_a` PRIMARY KEY (`id1`, `id2`)"),
        (2, "ALTER TABLE `cat_aux`.`s`.`b` ADD CONSTRAINT `fk_b` FOREIGN KEY (`a_id`) REFERENCES "
            "`cat_aux`.`s`.`a` (`id1`, `id2`)"),
    ]
    direct = spark.createDataFrame([("SCHEMA", "cat.s", "team a", "USE SCHEMA"), ("TABLE", "cat.s.a", "u", "OWN")],
                                   "object_type string, object_key string, principal string, action_type string")
    g = [r["statement"] for r in statements.grant_plan(direct, "cat", "cat_aux").collect()]
    assert g == ["GRANT USE SCHEMA ON SCHEMA `cat_aux`.`s` TO `team a`"]


def test_one_decimal_texts(spark):
    values = [0.0, 0.04, 0.05, 0.25, 1.05, 1.15, 12.34, 99.95, 1234567.89, None]
    rows = [("b", "c", f"p{i}", v) for i, v in enumerate(values)]
    got = {r.phase: (r.shortest, r.longest) for r in auditlog.duration_texts(
        spark.createDataFrame(rows, "batch_id string, catalog_name string, phase string, duration_seconds double")).collect()}
    # the shown decimals are rounded, half of a unit up
    want = ["0.0", "0.0", "0.1", "0.3", "1.1", "1.2", "12.3", "100.0", "1234567.9", None]
    assert got == {f"p{i}": (w, w) for i, w in enumerate(want)}


def test_volumes_of_any_size_are_taken_in_small_parts(spark, tmp_path):
    """A task holds few entries of a folder and few texts at once, and folders are listed by several tasks."""
    import os

    import pyarrow as pa
    import pyarrow.fs as pafs

    from pyspark.sql import functions as F

    rows = spark.range(0, 1000, 1, 1).select(
        F.concat_ws("/", F.concat(F.lit("d"), F.col("id") % 40), F.concat(F.lit("f"), F.col("id"))).alias("path"),
        F.when(F.col("id") != 7, F.repeat(F.lit("ä"), (F.col("id") % 5).cast("int"))).alias("text"))
    root = str(tmp_path)
    made = {r["path"]: r["bytes"] for r in files.write_text_files(spark, rows, root).collect()}
    assert len(made) == 1000 and made["d7/f7"] == 0 and made["d4/f4"] == 8

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    assert rows.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] <= 256
    os.symlink(f"{root}/d1/f1", f"{root}/d1/link")
    os.symlink(f"{root}/nothing", f"{root}/d1/broken")
    local = pafs.LocalFileSystem()
    entries = files._entries(local, f"{root}/d1")
    assert next(entries)[0].startswith(f"{root}/d1/")  # one by one, not as a list
    want = {(x.path, x.size, x.mtime_ns // 1000, False) for x in local.get_file_info(pafs.FileSelector(f"{root}/d1")) if x.type == pafs.FileType.File}
    assert set(files._entries(local, f"{root}/d1")) == want and len(want) == 26
    folders = spark.createDataFrame([(f"d{i}",) for i in range(40)], "path string")
    assert files._listed(folders, root).select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert {r["path"]: r["bytes"] for r in files.manifest(spark, root).where("path not like '%link'").collect()} == made
    assert [b.num_rows for b in files.gathered(((str(i), i) for i in range(10_000)), files.WRITE_SCHEMA)] == [4096, 4096, 1808]
