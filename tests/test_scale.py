"""Scale check: data-heavy queries against the oracle at sf0.1."""

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.test_oracle import _rows
from vaultshift.sources.fixtures import BASE_TABLES

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def duck01():
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", ["row_diff", "row_diff_multiset", "digest_check", "log_summary",
                                  "location_match", "inventory_log", "grant_diff"])
def test_scale_query_matches_oracle(spark, duck01, name):
    df = E.queries()[name](spark, SF)
    res = duck01.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(ocols, res.fetchall())


def test_digest_check_deals_lineitem_to_the_partitions_of_the_session(spark, monkeypatch):
    calls, frame = [], type(spark.range(0))
    own = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *a: calls.append(a) or own(self, *a))
    got = {r.table_name: r.equal for r in E.queries()["digest_check"](spark, SF_SMALL).collect()}
    assert ("l_suppkey",) in calls and got["lineitem_reordered"] and not got["lineitem_edited"]
