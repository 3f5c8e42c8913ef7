"""Schemas from footers: nested columns, drift between files, files of other writers."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq

from vaultshift.operators import validate
from vaultshift.session import fresh_dir
from vaultshift.sources import footers as ft


def test_columns_match_the_schema_that_spark_reads(spark):
    root = fresh_dir(spark, "t-footers")
    df = spark.sql("""SELECT id, CAST(id AS DECIMAL(12,2)) AS price, named_struct('x', id, 'y', array(named_struct('z', 'q'))) AS s,
        map('k', id) AS m, timestamp_ntz '2020-01-02 03:04:05' AS t, CASE WHEN id > 3 THEN 'b' END AS n FROM range(10)""")
    df.repartition(3).write.parquet(f"{root}/one")
    found = ft.footers(ft.table_files(spark, root), root)
    got = {r.column_name: r for r in ft.columns_of(found).collect()}
    assert {"s.y.element.z", "m.key", "m.value", "s.x"} < got.keys()
    back = spark.read.parquet(f"{root}/one").schema
    for i, f in enumerate(back.fields, 1):
        assert (got[f.name].data_type, got[f.name].position) == (f.dataType.simpleString(), i)
    assert got["s.y.element.z"].data_type == "string" and ft.drift(found).where("issue <> 'nullability_differs'").collect() == []
    stats = found.where("column_name in ('id', 'n', 's.x')").groupBy("column_name").agg({"nulls": "sum", "rows": "sum"}).collect()
    assert {r.column_name: (r["sum(nulls)"], r["sum(rows)"]) for r in stats} == {"id": (0, 10), "n": (4, 10), "s.x": (0, 10)}
    assert found.where("column_name = 'id'").selectExpr("min(int(least))", "max(int(greatest))").first()[:] == (0, 9)


def test_drift_between_files_of_a_table_is_rows(spark):
    root = fresh_dir(spark, "t-drift")
    spark.range(4).selectExpr("id", "CAST(id AS INT) AS v", "'x' AS w").coalesce(1).write.parquet(f"{root}/t/a")
    spark.range(4).selectExpr("id", "CAST(id AS INT) AS v", "'x' AS w").coalesce(1).write.parquet(f"{root}/t/b")
    spark.range(4).selectExpr("id", "id AS v").coalesce(1).write.parquet(f"{root}/t/c")
    with open(f"{root}/t/broken.parquet", "wb") as f:
        f.write(b"PAR1 nothing")
    found = ft.footers(ft.table_files(spark, root), root)
    got = sorted(((r.column_name or "", r.issue, r.files) for r in ft.drift(found).collect()))
    assert got == [("", "unreadable", 1), ("v", "type_differs", 1), ("w", "missing_in_files", 1)]
    cols = {r.column_name: r for r in ft.columns_of(found).collect()}
    assert cols["v"].data_type == "int" and cols["w"].nullable and "id" in cols


def test_files_of_another_writer_and_no_files(spark):
    root = fresh_dir(spark, "t-arrow")
    import os

    os.makedirs(f"{root}/t")
    pq.write_table(pa.table({"a": pa.array([1, None], pa.int32()), "l": pa.array([["x"], []]), "d": [dt.date(2020, 1, 1)] * 2}), f"{root}/t/x.parquet")
    pq.write_table(pa.table({"a": pa.array([], pa.int32()), "l": pa.array([], pa.list_(pa.string())), "d": pa.array([], pa.date32())}), f"{root}/t/y.parquet")
    got = {r.column_name: r.data_type for r in ft.columns_of(ft.footers(ft.table_files(spark, root), root)).collect()}
    assert got == {"a": "int", "l": "array<string>", "l.element": "string", "d": "date"}
    empty = fresh_dir(spark, "t-none")
    os.makedirs(empty)
    assert ft.columns_of(ft.footers(ft.table_files(spark, empty), empty)).collect() == []


def test_schema_diff_over_files(spark):
    old, new = fresh_dir(spark, "t-old"), fresh_dir(spark, "t-new")
    spark.range(4).selectExpr("id", "named_struct('x', 1, 'y', 'a') AS s", "'q' AS gone").write.parquet(f"{old}/t")
    spark.range(4).selectExpr("id", "named_struct('x', 1L, 'y', 'a') AS s", "2 AS more").write.parquet(f"{new}/t")
    sides = [ft.columns_of(ft.footers(ft.table_files(spark, r), r)) for r in (old, new)]
    got = {(r.column_name, r.issue) for r in validate.schema_diff(*sides, check_nullability=False).collect()}
    assert got == {("s", "type_changed"), ("s.x", "type_changed"), ("gone", "missing_in_new"), ("more", "added_in_new")}
