"""Commit log, pointer swaps under contention, log table, snapshot clone."""

import datetime as dt
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest

from vaultshift.operators import auditlog, publish
from vaultshift.operators import files as fl
from vaultshift.operators import snapshot as sn
from vaultshift.session import fresh_dir
from vaultshift.sources.commits import CommitLog, CommittedTable


def test_racing_writers_lose_no_commit(spark):
    log = CommitLog(spark, fresh_dir(spark, "t-race"))
    gate = threading.Barrier(6)

    def writer(k):
        gate.wait()
        return [log.commit(lambda s, i=i: {**s, "live": [*s["live"], f"{k}-{i}"]}) for i in range(8)]

    with ThreadPoolExecutor(6) as pool:
        numbers = sorted(n for own in pool.map(writer, range(6)) for n in own)
    assert numbers == list(range(48)) and log.latest() == 47
    live = log.state()["live"]
    assert sorted(live) == sorted(f"{k}-{i}" for k in range(6) for i in range(8))
    for n in range(1, 48):  # each state is the one before and one more
        assert log.state(n)["live"][:-1] == log.state(n - 1)["live"]


def test_a_rename_that_refuses_is_an_atomic_put_too(spark):
    """The way of other file systems, on the local one."""
    log = CommitLog(spark, fresh_dir(spark, "t-rename"))
    own = log._fs

    class Other:
        def __getattr__(self, name):
            return (lambda: "other") if name == "getScheme" else getattr(own, name)

    log._fs = Other()
    assert log.commit(lambda s: {"live": ["a"]}) == 0
    assert log._put(f"{log.folder}/{0:020d}.json", "{}") is False
    assert log.state()["live"] == ["a"]


def test_a_half_written_commit_is_not_read(spark):
    log = CommitLog(spark, fresh_dir(spark, "t-half"))
    log.commit(lambda s: {"live": ["a"]})
    with open(f"{log.folder}/.halfway.tmp", "w") as f:
        f.write('{"live": [')
    assert log.latest() == 0 and log.state()["live"] == ["a"]


def test_two_swaps_of_one_name_at_once_give_two_versions(spark):
    path = fresh_dir(spark, "t-swap")
    publish.create_pointers(spark, path, spark.createDataFrame([("cat", 1, "l1"), ("dog", 4, "d4")], publish.POINTER_SCHEMA))
    gate = threading.Barrier(3)

    def writer(k):
        gate.wait()
        return publish.publish_swap(spark, path, "cat", f"new{k}")

    with ThreadPoolExecutor(3) as pool:
        assert sorted(pool.map(writer, range(3))) == [1, 2, 3]
    rows = sorted(tuple(r) for r in publish.read_pointers(spark, path).where("name = 'cat'").collect())
    assert [v for _, v, _ in rows] == [1, 2, 3, 4] and {t for _, _, t in rows} == {"l1", "new0", "new1", "new2"}
    backup = {r.version: r.target for r in publish.read_pointers(spark, path).where("name = 'cat_bkp'").collect()}
    assert backup == {v + 1: t for _, v, t in rows[:-1]}  # each backup is the target before
    assert {r.name for r in publish.resolve(publish.read_pointers(spark, path)).collect()} == {"cat", "cat_bkp", "dog"}


def test_a_new_name_has_no_backup_and_older_states_stay(spark):
    path = fresh_dir(spark, "t-new-name")
    assert publish.publish_swap(spark, path, "x", "a") == 0
    assert publish.publish_swap(spark, path, "x", "b") == 1
    assert [tuple(r) for r in publish.read_pointers(spark, path, 0).collect()] == [("x", 1, "a")]
    assert sorted(tuple(r) for r in publish.resolve(publish.read_pointers(spark, path)).collect()) == [("x", 2, "b"), ("x_bkp", 2, "a")]


def _log_rows(spark, n, batch):
    base = spark.createDataFrame([("TABLE", f"o{i}", "SUCCESS", None) for i in range(n)], "object_type string, object_name string, status string, message string")
    return auditlog.log_rows(base, batch, "cat", "tables", dt.datetime(2026, 1, 2, 3, 4, 5))


def test_log_table_is_read_by_name_and_stays_few_folders(spark):
    log = auditlog.LogTable(spark, fresh_dir(spark, "t-log-table"), folders=3)
    with pytest.raises(ValueError):
        log.register("vs_log_by_name")
    for i in range(10):
        log.append(_log_rows(spark, 5, f"b{i}"))
        log.register("vs_log_by_name")
        assert len(log.table.log.state()["live"]) <= 3
    assert spark.table("vs_log_by_name").count() == 50 == log.read().count()
    assert auditlog.summary(log.read(), "b7").first()["cnt"] == 5
    assert spark.table("vs_log_by_name").schema.fieldNames() == auditlog.LOG_COLUMNS
    spark.sql("DROP VIEW vs_log_by_name")


def test_appends_during_a_compaction_stay(spark):
    log = auditlog.LogTable(spark, fresh_dir(spark, "t-compact"), folders=100)
    for i in range(4):
        log.append(_log_rows(spark, 2, f"b{i}"))
    write = log.table.write

    def slow(rows):
        out = write(rows)
        CommittedTable.append(other, _log_rows(spark, 3, "late"))
        return out

    other = CommittedTable(spark, log.path, log.table.schema, log.table.partition_by)
    log.table.write = slow
    log.table.compact(2)
    assert len(log.table.log.state()["live"]) == 2 and log.read().count() == 11


ROWS = [(i, ("", None, "a/b=c", "é", "__HIVE_DEFAULT_PARTITION__")[i % 5], i % 2, f"t{i}") for i in range(200)]
SCHEMA = "id long, lang string, half int, text string"


def _source(spark):
    root = fresh_dir(spark, "t-snap")
    sn.write_table(spark.createDataFrame(ROWS, SCHEMA), root, ("lang", "half"), {"owner": "it's", "quality": "gold"})
    return root


def test_clone_keeps_rows_partitions_and_properties(spark):
    src, dst = _source(spark), fresh_dir(spark, "t-clone")
    report = sn.clone_snapshot(spark, src, dst).collect()
    assert {r.status for r in report} == {"COPIED"} and sum(r.rows for r in report) == 200
    assert sorted(map(repr, sn.read_table(spark, dst).collect())) == sorted(map(repr, sn.read_table(spark, src).collect()))
    assert sorted(repr(tuple(r)) for r in sn.read_table(spark, dst).collect()) == sorted(map(repr, ROWS))
    assert sn.properties_of(spark, dst) == {"owner": "it's", "quality": "gold"} and sn.partition_columns(spark, dst) == ["lang", "half"]
    parts = {tuple(r.part) for r in sn.manifest_of(spark, dst).collect()}
    assert parts == {(lang, str(half)) for _, lang, half, _ in ROWS}
    assert {r.issue for r in sn.verify(spark, dst).collect()} == {"OK"}
    with pytest.raises(FileExistsError):
        sn.clone_snapshot(spark, src, dst)


def test_a_killed_clone_copies_only_what_lacks(spark, monkeypatch):
    src, dst = _source(spark), fresh_dir(spark, "t-killed")
    copy, calls = sn._copy, []

    def killed(todo, *roots):
        if len(calls) == 2:
            raise KeyboardInterrupt
        calls.append(todo.count())
        return copy(todo, *roots)

    monkeypatch.setattr(sn, "_copy", killed)
    with pytest.raises(KeyboardInterrupt):
        sn.clone_snapshot(spark, src, dst)
    with pytest.raises(FileNotFoundError):
        sn.read_table(spark, dst)  # not a table yet
    before = {p for p, _ in _files(dst)}
    monkeypatch.setattr(sn, "_copy", lambda todo, *roots: calls.append(todo.count()) or copy(todo, *roots))
    report = sn.clone_snapshot(spark, src, dst).collect()
    assert sum(calls) == len(report) and 0 < len(before) < len(report)
    assert before <= {p for p, _ in _files(dst)} and {r.path for r in report} == {p for p, _ in _files(dst)}
    assert sn.read_table(spark, dst).count() == 200


def _files(root):
    import os

    return [(os.path.relpath(os.path.join(d, x), root), x) for d, _, names in os.walk(root) for x in names
            if x.endswith(".parquet") and os.path.relpath(d, root).startswith("files-")]


def test_files_of_lost_attempts_and_lost_files(spark):
    src, dst = _source(spark), fresh_dir(spark, "t-lost")
    path = f"{src}/{_files(src)[0][0]}"
    stray = path.replace("part-", "stray-part-")
    with open(path, "rb") as a, open(stray, "wb") as b:
        b.write(a.read())
    assert sn.read_table(spark, src).count() == 200  # no manifest names the stray
    import os

    os.rename(path, f"{path}.gone")
    report = sn.clone_snapshot(spark, src, dst)
    assert sorted({r.status for r in report.collect()}) == ["COPIED", "FAILED"] and report.where("error is not null").count() == 1
    with pytest.raises(FileNotFoundError):
        sn.table_state(spark, dst)
    os.rename(f"{path}.gone", path)
    assert {r.status for r in sn.clone_snapshot(spark, src, dst).collect()} == {"COPIED"}
    assert sn.read_table(spark, dst).count() == 200 and fl.manifest(spark, dst).count() > 0


def test_tables_without_partitions_or_rows(spark):
    src, dst = fresh_dir(spark, "t-empty"), fresh_dir(spark, "t-empty-clone")
    sn.write_table(spark.createDataFrame([], SCHEMA), src)
    sn.clone_snapshot(spark, src, dst)
    assert sn.read_table(spark, dst).collect() == [] and sn.read_table(spark, dst).columns == ["id", "lang", "half", "text"]
