"""Physical plans keep the properties the design relies on at scale."""

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from vaultshift.operators import auditlog, clone, preflight, validate
from vaultshift.session import fresh_dir
from vaultshift.sources.fixtures import Fixtures


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_clone_scan_has_no_shuffle(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    observed = li.select("*", clone.row_hash(li).alias("_h")).observe("o", *clone.digest_columns(F.col("_h")))
    p = plan(observed)
    assert "Exchange" not in p and "CollectMetrics" in p


def test_keyed_diff_is_hash_aggregate_on_fingerprints(spark):
    f = Fixtures(spark, SF_SMALL)
    p = plan(validate.row_diff(f["orders"], f["m_orders_new"], ["o_orderkey"]))
    assert "SortAggregate" not in p and "SortMergeJoin" not in p
    assert p.count("Exchange hashpartitioning(o_orderkey") == 1


def test_multiset_diff_shuffles_fingerprints_only(spark):
    f = Fixtures(spark, SF_SMALL)
    p = plan(validate.row_diff_multiset(f["lineitem"], f["m_lineitem_new"]))
    assert "Exchange hashpartitioning(h1" in p and "l_extendedprice" not in p.split("Exchange hashpartitioning(h1")[0]


def test_log_reader_pushes_batch_and_prunes_catalog(spark):
    log = auditlog.AuditLog(spark, fresh_dir(spark, "t-plan-log"))
    f = Fixtures(spark, SF_SMALL)
    log.append(f["m_log"])
    p1 = plan(auditlog.summary(log.read(), "b1"))
    assert "PushedFilters: [IsNotNull(batch_id), EqualTo(batch_id,b1)]" in p1
    p2 = plan(auditlog.failures_all(log.read(), "prod"))
    assert "PartitionFilters: [isnotnull(catalog_name" in p2


def test_location_match_looks_up_distinct_prefixes(spark):
    f = Fixtures(spark, SF_SMALL)
    p = plan(preflight.location_match(f["m_paths"], f["m_locations"]))
    assert "CartesianProduct" not in p and "NestedLoop" not in p and "Window" not in p
