"""Metamorphic checks: clone then validate passes; each kind of damage is caught."""

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from vaultshift.operators import access, clone, validate
from vaultshift.session import fresh_dir
from vaultshift.sources.fixtures import Fixtures


def _lineitem(spark):
    return spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")


def test_clone_then_validate_passes(spark):
    src = {"lineitem": _lineitem(spark), "orders": spark.read.parquet(f"{SF_SMALL}/orders.parquet")}
    res = clone.clone_tables(spark, src, fresh_dir(spark, "t-clone"))
    assert all(r.status == "SUCCESS" for r in res)
    new = {r.table_name: spark.read.parquet(r.target) for r in res}
    checks = validate.rowcount_check(new, src).collect()
    assert {r["status"] for r in checks} == {"PASS"}
    for r in res:
        assert r.digest_source == r.digest_target


def test_dropped_rows_fail_exactly_one_check(spark):
    li = _lineitem(spark)
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    new = {"lineitem": li.where(F.col("l_orderkey") != li.first()["l_orderkey"]), "orders": orders}
    rows = {r["object_name"]: r["status"] for r in validate.rowcount_check(new, {"lineitem": li, "orders": orders}).collect()}
    assert rows == {"lineitem": "FAIL", "orders": "PASS"}


def test_missing_table_is_error(spark):
    li = _lineitem(spark)
    rows = validate.rowcount_check({}, {"lineitem": li}).collect()
    assert rows[0]["status"] == "ERROR"


def test_swapped_values_keep_count_but_change_digest(spark):
    li = _lineitem(spark).orderBy("l_orderkey", "l_linenumber", "l_partkey").limit(50).cache()
    rows = li.collect()
    a, b = rows[0], rows[1]
    # swap the quantity of two rows that differ in it
    swapped = li.withColumn(
        "l_quantity",
        F.when((F.col("l_orderkey") == a["l_orderkey"]) & (F.col("l_linenumber") == a["l_linenumber"]) &
               (F.col("l_partkey") == a["l_partkey"]), F.lit(b["l_quantity"]))
        .when((F.col("l_orderkey") == b["l_orderkey"]) & (F.col("l_linenumber") == b["l_linenumber"]) &
              (F.col("l_partkey") == b["l_partkey"]), F.lit(a["l_quantity"]))
        .otherwise(F.col("l_quantity")))
    assert a["l_quantity"] != b["l_quantity"]
    d1, d2 = clone.digest_value(li), clone.digest_value(swapped)
    assert d1[0] == d2[0]
    assert d1 != d2


def test_shuffled_rows_same_digest(spark):
    li = _lineitem(spark)
    assert clone.digest_value(li) == clone.digest_value(li.repartition(7).sortWithinPartitions(F.rand(3)))


def test_duplicate_rows_do_not_cancel(spark):
    li = _lineitem(spark).limit(10).cache()
    twice = li.unionByName(li)
    assert clone.digest_value(twice) != clone.digest_value(li)


def test_grant_added_still_passes_removed_fails(spark):
    f = Fixtures(spark, SF_SMALL)
    g, s = f["m_grants"], f["m_schemata"]
    extra = g.sparkSession.createDataFrame([(-5, "CATALOG", "prod", "u_new", "SELECT")], g.schema)
    added = validate.grant_checks(g, g.unionByName(extra), s, "prod").collect()
    assert {r["status"] for r in added} == {"PASS"}
    victim = access.drop_ownership(g.where("object_type = 'CATALOG'")).first()
    removed = g.where(~((F.col("object_key") == victim["object_key"]) & (F.col("principal") == victim["principal"])
                        & (F.col("action_type") == victim["action_type"])))
    res = {r["object_name"]: r["status"] for r in validate.grant_checks(g, removed, s, "prod").collect()}
    assert res["prod"] == "FAIL"
    assert sum(1 for v in res.values() if v == "FAIL") == 1


def test_keyed_and_multiset_diff(spark):
    f = Fixtures(spark, SF_SMALL)
    keyed = {r["change"]: r["n"] for r in validate.row_diff(f["orders"], f["m_orders_new"], ["o_orderkey"]).collect()}
    assert keyed.get("removed", 0) > 0 and keyed.get("changed", 0) > 0 and "added" not in keyed
    same = {r["change"] for r in validate.row_diff(f["orders"], f["orders"], ["o_orderkey"]).collect()}
    assert same == {"unchanged"}
    dup = validate.row_diff(f["lineitem"], f["lineitem"], ["l_orderkey"]).collect()
    assert {r["change"] for r in dup} >= {"duplicate_key"}
    assert validate.row_diff_multiset(f["lineitem"], f["lineitem"]).count() == 0


def test_multiset_diff_hash_and_exact_agree(spark):
    f = Fixtures(spark, SF_SMALL)
    a = {r["change"]: r["n"] for r in validate.row_diff_multiset(f["lineitem"], f["m_lineitem_new"]).collect()}
    b = {r["change"]: r["n"] for r in validate.row_diff_multiset(f["lineitem"], f["m_lineitem_new"], exact=True).collect()}
    assert a == b and a.get("removed", 0) > 0
