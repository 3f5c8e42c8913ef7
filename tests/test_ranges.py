"""Files copied as byte ranges, against one-pass digests."""

import hashlib
import os

import pytest

from vaultshift.operators import files as fl
from vaultshift.operators import ranges as rg
from vaultshift.session import fresh_dir

SIZES = {"a/empty": 0, "a/one": 1, "b/leaf": 64, "b/leaf and one": 65, "c/range": 256, "huge": 256 * 40 + 17}


def _made(spark):
    root = fresh_dir(spark, "t-ranges")
    data = {}
    for rel, n in SIZES.items():
        os.makedirs(os.path.dirname(f"{root}/{rel}"), exist_ok=True)
        data[rel] = b"".join(hashlib.sha256(f"{rel}{i}".encode()).digest() for i in range(n // 32 + 1))[:n]
        with open(f"{root}/{rel}", "wb") as f:
            f.write(data[rel])
    return root, data


@pytest.mark.parametrize("in_place", [True, False])
def test_copies_are_equal_and_digests_are_those_of_a_stream(spark, in_place):
    src, data = _made(spark)
    dst = fresh_dir(spark, "t-ranges-dst")
    got = {r.path: r for r in rg.copy_ranges(spark, fl.manifest(spark, src), src, dst, size=250, leaf=64, in_place=in_place).collect()}
    assert got.keys() == data.keys() and {r.status for r in got.values()} == {"COPIED"}
    for rel, body in data.items():
        with open(f"{dst}/{got[rel].target}", "rb") as f:
            assert f.read() == body
        with open(f"{src}/{rel}", "rb") as f:
            assert rg.stream_digest(f.read, 64) == (len(body), got[rel].tree_sha2)
        assert got[rel].ranges == max(1, -(-len(body) // 256)) and got[rel].bytes == len(body)
    again = {r.path: r.tree_sha2 for r in rg.digest_ranges(fl.manifest(spark, src), src, size=1024, leaf=64).collect()}
    assert again == {p: r.tree_sha2 for p, r in got.items()}  # whatever the ranges


def test_a_repeated_range_changes_nothing(spark):
    """A task that is lost and run again writes the same bytes at the same place."""
    src, data = _made(spark)
    dst = fresh_dir(spark, "t-ranges-again")
    files = fl.manifest(spark, src).where("path = 'huge'")
    ranges = rg.ranges_of(files, 256)
    rg._copy_ranges(ranges, src, dst, "copy-x", 64, True).collect()
    rg._copy_ranges(ranges.where("no in (0, 7, 40)"), src, dst, "copy-x", 64, True).collect()
    with open(f"{dst}/huge.copy-x", "rb") as f:
        assert f.read() == data["huge"]


def test_changed_and_missing_files_fail_alone(spark):
    src, data = _made(spark)
    dst = fresh_dir(spark, "t-ranges-bad")
    files = spark.createDataFrame([("huge", 100), ("gone", 700), ("a/one", 1)], "path string, bytes long")
    got = {r.path: r for r in rg.copy_ranges(spark, files, src, dst, size=256, leaf=64).collect()}
    assert {p: r.status for p, r in got.items()} == {"huge": "FAILED", "gone": "FAILED", "a/one": "COPIED"}
    assert "manifest" in got["huge"].error and got["gone"].target is None and got["gone"].tree_sha2 is None


def test_published_names(spark):
    src, data = _made(spark)
    dst = fresh_dir(spark, "t-ranges-names")
    copied = rg.copy_ranges(spark, fl.manifest(spark, src), src, dst, size=256, leaf=64)
    assert {r.error for r in rg.publish(copied, dst).collect()} == {None}
    for rel, body in data.items():
        with open(f"{dst}/{rel}", "rb") as f:
            assert f.read() == body
    assert fl.manifest(spark, dst).count() == len(data)


def test_small_ranges_go_to_many_tasks_in_few_batches(spark):
    """Rows of ranges are small however large the ranges: many tasks take them, and their results are not one batch each."""
    from pyspark.sql import functions as F

    src, data = _made(spark)
    dst = fresh_dir(spark, "t-ranges-many")
    ranges = rg.ranges_of(fl.manifest(spark, src).where("path = 'huge'"), 256)
    done = rg._copy_ranges(ranges, src, dst, "copy-y", 64, True).withColumn("p", F.spark_partition_id())
    assert done.select("p").distinct().count() > 1
    leaves = [("f", i, 2048, ["x" * 64] * 2047, None) for i in range(5)]
    assert [b.num_rows for b in fl.gathered(iter(leaves), rg._DONE, lambda r: 1 + len(r[3]))] == [2, 2, 1]
    back = rg.digest_ranges(fl.manifest(spark, dst), dst, size=256, leaf=64).collect()
    with open(f"{src}/huge", "rb") as f:
        assert [(r.bytes, r.tree_sha2) for r in back] == [rg.stream_digest(f.read, 64)]
