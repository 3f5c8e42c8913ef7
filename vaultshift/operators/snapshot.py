"""Snapshot tables and their clone, file by file.

A snapshot table is Parquet files plus a committed manifest with a row per file: path, bytes, rows by
the footer, SHA-256 and the values of the partition columns.  Partition columns stay in the
files, and folder names are digests of their values, so an empty string, a null, or any other text is kept as it is.
Schema, partition columns and properties are part of the commit.

A clone takes one committed state of the source and copies its files as bytes, in tasks.  Each attempt
writes a name of its own, which counts only once a manifest names it: nothing is renamed, and
what a lost or repeated task leaves behind is not part of any table.  Files are copied in ``rounds``;
each round's rows are committed to the target's progress log, so a clone that was killed
copies only what lacks.  The target's manifest is committed at the end, once every file is
there with the bytes and rows of the source's manifest; until then the target is no table.

Cases: a table without rows has a manifest without rows, or files without rows; rows of equal
content are rows of their own; a target that is a table already is left as it is and raises.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultshift.operators import files as fl
from vaultshift.sources.commits import CommittedTable
from vaultshift.session import written

FILES = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("rows", T.LongType()),
    T.StructField("sha2", T.StringType()),
    T.StructField("part", T.ArrayType(T.StringType())),
])
COPIED = T.StructType([*FILES.fields, T.StructField("source", T.StringType()), T.StructField("error", T.StringType())])
PROGRESS = "_progress"


def _manifest(spark: SparkSession, root: str) -> CommittedTable:
    return CommittedTable(spark, root, FILES)


def table_state(spark: SparkSession, root: str) -> dict:
    """The committed state of a snapshot table; raises where there is none."""
    state = _manifest(spark, root).log.state()
    if "table" not in state:
        raise FileNotFoundError(f"{root}: no snapshot table is committed here")
    return state


def manifest_of(spark: SparkSession, root: str) -> DataFrame:
    return _manifest(spark, root).at(table_state(spark, root))


def read_table(spark: SparkSession, root: str) -> DataFrame:
    """Exactly the files of the manifest; of these the driver holds the names, as for any Parquet scan."""
    state = table_state(spark, root)
    schema = T.StructType.fromJson(state["table"]["schema"])
    paths = [f"{root.rstrip('/')}/{r.path}" for r in _manifest(spark, root).at(state).select("path").collect()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def properties_of(spark: SparkSession, root: str) -> dict[str, str]:
    return dict(table_state(spark, root)["table"]["properties"])


def partition_columns(spark: SparkSession, root: str) -> list[str]:
    return list(table_state(spark, root)["table"]["partition_by"])


def _footers(found: DataFrame, root: str) -> DataFrame:
    """(path, bytes, rows, sha2) of Parquet files, each opened once in a task: streamed digest, footer's row count."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        fs, base = fl.filesystem(root)
        for b in batches:
            out = []
            for rel in b["path"]:
                h, n, path = hashlib.sha256(), 0, fl._join(base, rel)
                with fs.open_input_stream(path, compression=None) as src:
                    while chunk := src.read(fl.BLOCK):
                        h.update(chunk)
                        n += len(chunk)
                with fs.open_input_file(path) as src:
                    rows = pq.ParquetFile(src).metadata.num_rows
                out.append((rel, n, rows, h.hexdigest()))
            yield pd.DataFrame(out, columns=["path", "bytes", "rows", "sha2"])

    return found.select("path").repartition(F.xxhash64("path")).mapInPandas(run, "path string, bytes long, rows long, sha2 string")


def write_table(df: DataFrame, root: str, partition_by: tuple[str, ...] = (), properties: dict[str, str] | None = None) -> int:
    """Writes ``df`` as a snapshot table at ``root`` and commits it; the commit's number.

    Rows of a partition are brought together, but a large partition stays many tasks (rebalance).
    """
    spark, root = df.sparkSession, root.rstrip("/")
    folder, own = f"files-{uuid.uuid4().hex[:16]}", f"_part_{uuid.uuid4().hex}"
    if partition_by:
        parts = [F.col(f"`{c}`") for c in partition_by]
        key = F.substring(F.sha2(F.to_json(F.struct(*[F.coalesce(F.concat(F.lit("v"), p.cast("string")), F.lit("n")).alias(str(i)) for i, p in enumerate(parts)])), 256), 1, 32)
        df.hint("rebalance", *parts).withColumn(own, key).write.partitionBy(own).parquet(f"{root}/{folder}")
    else:
        df.write.parquet(f"{root}/{folder}")
    listed = fl.manifest(spark, f"{root}/{folder}").where(F.col("path").endswith(".parquet"))
    found = _footers(listed, f"{root}/{folder}").withColumn("path", F.concat(F.lit(f"{folder}/"), "path"))
    if partition_by:
        # The partition columns alone are read back: one value of each per file.
        back = spark.read.schema(df.schema).parquet(f"{root}/{folder}").select(
            F.regexp_extract(F.col("_metadata.file_path"), f"({folder}/.*)$", 1).alias("path"),
            F.array(*[F.col(f"`{c}`").cast("string") for c in partition_by]).alias("part"))
        found = found.join(back.groupBy("path").agg(F.min("part").alias("part")), "path", "left")
    else:
        found = found.withColumn("part", F.array().cast("array<string>"))
    table = _manifest(spark, root)
    rows = table.write(found)
    about = {"schema": json.loads(df.schema.json()), "partition_by": list(partition_by), "properties": dict(properties or {})}
    return table.log.commit(lambda s: {**s, "live": [rows], "table": about})


def _copy(todo: DataFrame, src_root: str, dst_root: str) -> DataFrame:
    """Copies files as bytes, each to a new name; ``COPIED`` rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        sfs, sbase = fl.filesystem(src_root)
        dfs, dbase = fl.filesystem(dst_root)
        for b in batches:
            out = []
            for rel, part in zip(b["path"], b["part"]):
                folder, name = rel.rsplit("/", 1)
                to = f"{folder}/{uuid.uuid4().hex[:12]}-{name}"
                part = None if part is None else list(part)
                try:
                    dfs.create_dir(fl._join(dbase, folder), recursive=True)
                    h, n = hashlib.sha256(), 0
                    with sfs.open_input_stream(fl._join(sbase, rel), compression=None) as src, \
                            dfs.open_output_stream(fl._join(dbase, to), compression=None) as dst:
                        while chunk := src.read(fl.BLOCK):
                            h.update(chunk)
                            dst.write(chunk)
                            n += len(chunk)
                    with dfs.open_input_file(fl._join(dbase, to)) as back:
                        rows = pq.ParquetFile(back).metadata.num_rows
                    out.append((to, n, rows, h.hexdigest(), part, rel, None))
                except Exception as e:  # noqa: BLE001 - reported per file
                    out.append((None, None, None, None, part, rel, str(e)[:500]))
            frame = pd.DataFrame(out, columns=COPIED.fieldNames())
            frame[["bytes", "rows"]] = frame[["bytes", "rows"]].astype("Int64")
            yield frame

    return todo.select("path", "part").repartition(F.xxhash64("path")).mapInPandas(run, COPIED)


def clone_snapshot(spark: SparkSession, src_root: str, dst_root: str, rounds: int = 4) -> DataFrame:
    """Clones the latest committed state of ``src_root``; (source, path, bytes, rows, sha2, status, error) per file.

    A status other than COPIED leaves the target uncommitted; calling again copies what lacks.
    """
    state = table_state(spark, src_root)
    target = _manifest(spark, dst_root)
    if "table" in target.log.state():
        raise FileExistsError(f"{dst_root} is a table")
    want = _manifest(spark, src_root).at(state)
    progress = CommittedTable(spark, f"{dst_root.rstrip('/')}/{PROGRESS}", COPIED)
    for k in range(rounds):
        done = progress.read().where("error is null").select(F.col("source").alias("path"))
        todo = want.where(F.pmod(F.xxhash64("path"), F.lit(rounds)) == k).join(done, "path", "left_anti")
        if not todo.isEmpty():
            progress.append(_copy(todo, src_root, dst_root))
    # Two rounds of two drivers may have copied a file twice: one copy of each counts.
    got = progress.read().where("error is null").groupBy("source").agg(
        F.min_by(F.struct("path", "bytes", "rows", "sha2"), "path").alias("c"))
    failed = progress.read().where("error is not null").groupBy("source").agg(F.max("error").alias("error"))
    same = (F.col("c.bytes") == F.col("s_bytes")) & (F.col("c.rows") == F.col("s_rows")) & (F.col("c.sha2") == F.col("s_sha2"))
    status = F.when(F.col("c").isNull(), "FAILED").when(same, "COPIED").otherwise("DIFFERENT")
    checked = written(want.select(F.col("path").alias("source"), F.col("bytes").alias("s_bytes"), F.col("rows").alias("s_rows"),
                                  F.col("sha2").alias("s_sha2"), "part").join(got, "source", "left").join(failed, "source", "left")
                      .select("source", "c.path", "c.bytes", "c.rows", "c.sha2", "part", status.alias("status"), "error"), "clone")
    if checked.where("status <> 'COPIED'").isEmpty():
        rows = target.write(checked)
        target.log.commit(lambda s: None if "table" in s else {**s, "live": [rows], "table": state["table"]})
    return checked.drop("part")


def verify(spark: SparkSession, root: str) -> DataFrame:
    """(path, issue): files of the manifest read again, OK or what is wrong with them."""
    want = manifest_of(spark, root)
    return fl.file_check(want.select("path", "bytes", "sha2"), fl.hash_files(spark, want.select("path", "bytes"), root))
