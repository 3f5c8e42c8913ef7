"""Volumes: file manifests, distributed copy and checks.

A manifest lists files in tasks (directories spread over executors) without
reading their content.  The copy is a ``mapInArrow`` over the manifest: every task
streams its files in blocks between two roots that all executors can open
(local, mounted, or any filesystem ``pyarrow.fs`` resolves from a URI), and
returns one row per file with its byte count and SHA-256.  Files are spread
over tasks by a hash of their path, so no task gets a whole directory, and
a retried task simply rewrites its files.  Files are copied as they are: a
name that ends in ``.gz`` is not unpacked.
"""

from __future__ import annotations

import contextlib
import hashlib
import math
import os
import stat
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vaultshift.session import written

BLOCK = 8 * 1024 * 1024
TARGET_BYTES_PER_TASK = 256 * 1024 * 1024
#: Files of a task at most, small as they may be.
FILES_PER_TASK = 50_000
#: Rows of an Arrow batch that goes to or comes from a task: a worker holds so many texts or results at once.
ROWS, TEXTS = 4096, 256

COPY_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("sha2", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
])
HASH_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("sha2", T.StringType()),
    T.StructField("error", T.StringType()),
])
WRITE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("bytes", T.LongType()),
])


def filesystem(root: str):
    """(filesystem, base path) for a root given as a plain path or a URI."""
    import pyarrow.fs as pafs

    if "://" in root:
        scheme, rest = root.split("://", 1)
        # Hadoop spellings of object stores -> the schemes pyarrow knows
        scheme = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}.get(scheme, scheme)
        return pafs.FileSystem.from_uri(f"{scheme}://{rest}")
    if root.startswith("file:"):
        root = root[len("file:"):]
    return pafs.LocalFileSystem(), root


def _join(base: str, rel: str) -> str:
    return base.rstrip("/") + "/" + rel.lstrip("/")


def gathered(rows: Iterator[tuple], schema: T.StructType, cells=lambda row: 1) -> Iterator[pa.RecordBatch]:
    """``rows`` as Arrow batches of ``schema``, each ended when its rows have ``ROWS`` cells: not one for every row, nor one for a whole task."""
    arrow = to_arrow_schema(schema)
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += cells(row)
        if n >= ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)


MANIFEST_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("modified", T.TimestampType()),
])


LISTED_SCHEMA = T.StructType([*MANIFEST_SCHEMA.fields, T.StructField("is_dir", T.BooleanType())])


def _entries(fs, folder: str) -> Iterator[tuple]:
    """(path, bytes, time of change in microseconds, whether a directory) of each entry of a folder.

    A local or mounted folder is read entry by entry, however many it has; of others ``pyarrow.fs`` gives the whole list.
    """
    import pyarrow.fs as pafs

    if isinstance(fs, pafs.LocalFileSystem):
        with os.scandir(folder) as found:
            for x in found:
                try:
                    st = x.stat()
                except FileNotFoundError:  # gone since, or a link to nothing
                    continue
                if stat.S_ISREG(st.st_mode) or stat.S_ISDIR(st.st_mode):
                    is_dir = stat.S_ISDIR(st.st_mode)
                    yield _join(folder, x.name), None if is_dir else st.st_size, st.st_mtime_ns // 1000, is_dir
        return
    for x in fs.get_file_info(pafs.FileSelector(folder)):
        if x.type in (pafs.FileType.File, pafs.FileType.Directory):
            yield x.path, x.size if x.type == pafs.FileType.File else None, x.mtime, x.type == pafs.FileType.Directory


def _listed(dirs: DataFrame, root: str) -> DataFrame:
    """Entries of every directory of ``dirs`` (column ``path``, relative to root), without their subdirectories'."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        fs, base = filesystem(root)
        cut = len(base.rstrip("/")) + 1
        for b in batches:
            for d in b.column("path").to_pylist():
                for path, *rest in _entries(fs, _join(base, d) if d else base):
                    yield path[cut:], *rest

    # The number is given, or adaptive execution would put the few rows into one task.
    return dirs.repartition(dirs.sparkSession.sparkContext.defaultParallelism, F.xxhash64("path")).mapInArrow(
        lambda batches: gathered(rows(batches), LISTED_SCHEMA), LISTED_SCHEMA)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(path relative to root, bytes, modified) of every file below root, empty files included.

    Directories are listed inside tasks, one level of the tree after the
    other, spread by a hash of their path; each level is written to the shared
    folder, and the driver holds neither files nor directories at any width
    of the cluster.  No file content is read.  (Spark's ``binaryFile`` scan
    is not used: it drops zero-length files.)
    """
    level = spark.createDataFrame([("",)], "path string")
    levels = []
    while True:
        found = written(_listed(level, root), "listing")
        levels.append(found.where("not is_dir").select(*MANIFEST_SCHEMA.fieldNames()))
        level = found.where("is_dir").select("path")
        if level.isEmpty():
            break
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def snapshot_manifest(spark: SparkSession, root: str, out: str) -> DataFrame:
    """List ``root`` once and keep the list as a parquet table at ``out``.

    The copy and its checks then work on one fixed file list (files added
    during the copy are not half-taken), and the listing is not repeated.
    """
    manifest(spark, root).write.mode("errorifexists").parquet(out)
    return spark.read.schema(MANIFEST_SCHEMA).parquet(out)


def _spread(df: DataFrame, total_bytes: int | None, n_files: int | None, min_tasks: int, by: tuple[str, ...] = ("path",)) -> DataFrame:
    n = min_tasks
    if total_bytes:
        n = max(n, math.ceil(total_bytes / TARGET_BYTES_PER_TASK))
    if n_files:
        n = min(max(n, math.ceil(n_files / FILES_PER_TASK)), n_files)
    return df.repartition(max(1, n), F.xxhash64(*by))


def _sizes(df: DataFrame) -> tuple[int, int]:
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b")).first()
    return int(r["n"] or 0), int(r["b"] or 0)


def copy_files(spark: SparkSession, files: DataFrame, src_root: str, dst_root: str) -> DataFrame:
    """Copy every file of ``files`` (column ``path`` relative to ``src_root``,
    ``bytes`` optional) to the same relative path below ``dst_root``.

    Returns (path, bytes, sha2, status, error): COPIED or FAILED per file.
    """
    n_files, total = _sizes(files) if "bytes" in files.columns else (None, None)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        sfs, sbase = filesystem(src_root)
        dfs, dbase = filesystem(dst_root)
        made: set[str] = set()
        for b in batches:
            for rel in b.column("path").to_pylist():
                h, n = hashlib.sha256(), 0
                part = None
                try:
                    target = _join(dbase, rel)
                    parent = target.rsplit("/", 1)[0]
                    if parent not in made:
                        dfs.create_dir(parent, recursive=True)
                        made.add(parent)
                    # A name of this attempt's own, moved when complete: no half-written file at the target, and
                    # a repeated or speculative task writes another one.
                    part = f"{target}.part-{uuid.uuid4().hex[:12]}"
                    with sfs.open_input_stream(_join(sbase, rel), compression=None) as src, dfs.open_output_stream(part, compression=None) as dst:
                        while True:
                            chunk = src.read(BLOCK)
                            if not chunk:
                                break
                            h.update(chunk)
                            dst.write(chunk)
                            n += len(chunk)
                    dfs.move(part, target)
                    row = (rel, n, h.hexdigest(), "COPIED", None)
                except Exception as e:  # noqa: BLE001 - reported per file
                    row = (rel, None, None, "FAILED", str(e))
                    if part is not None:
                        with contextlib.suppress(Exception):
                            dfs.delete_file(part)
                yield row

    spread = _spread(files.select("path"), total, n_files, spark.sparkContext.defaultParallelism)
    return spread.mapInArrow(lambda batches: gathered(rows(batches), COPY_SCHEMA), COPY_SCHEMA)


def hash_files(spark: SparkSession, files: DataFrame, root: str) -> DataFrame:
    """(path, bytes, sha2, error) of files below root, streamed in blocks (no size limit)."""
    n_files, total = _sizes(files) if "bytes" in files.columns else (None, None)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        fs, base = filesystem(root)
        for b in batches:
            for rel in b.column("path").to_pylist():
                h, n = hashlib.sha256(), 0
                try:
                    with fs.open_input_stream(_join(base, rel), compression=None) as src:
                        while True:
                            chunk = src.read(BLOCK)
                            if not chunk:
                                break
                            h.update(chunk)
                            n += len(chunk)
                    row = (rel, n, h.hexdigest(), None)
                except Exception as e:  # noqa: BLE001 - reported per file
                    row = (rel, None, None, str(e))
                yield row

    spread = _spread(files.select("path"), total, n_files, spark.sparkContext.defaultParallelism)
    return spread.mapInArrow(lambda batches: gathered(rows(batches), HASH_SCHEMA), HASH_SCHEMA)


def file_check(source: DataFrame, target: DataFrame) -> DataFrame:
    """(path, issue) per file: OK, MISSING (not in the target), EXTRA (only there), UNREADABLE
    (there, but could not be read), SIZE or CONTENT (sha2 differs, when both sides carry ``sha2``).

    ``source`` is the source's manifest, so a file whose copy failed is a row too; ``with_hashes`` adds hashes.
    """
    has_hash = "sha2" in source.columns and "sha2" in target.columns
    s = source.select("path", F.lit(True).alias("in_s"), F.col("bytes").alias("s_bytes"),
                      (F.col("sha2") if has_hash else F.lit(None).cast("string")).alias("s_sha2"))
    t = target.select("path", F.lit(True).alias("in_t"), F.col("bytes").alias("t_bytes"),
                      (F.col("sha2") if has_hash else F.lit(None).cast("string")).alias("t_sha2"),
                      (F.col("error") if "error" in target.columns else F.lit(None).cast("string")).alias("t_error"))
    j = s.join(t, "path", "full")
    issue = (
        F.when(F.col("in_t").isNull(), "MISSING")
        .when(F.col("in_s").isNull(), "EXTRA")
        .when(F.col("t_error").isNotNull(), "UNREADABLE")
        .when(F.col("s_bytes") != F.col("t_bytes"), "SIZE")
        .when(~F.col("s_sha2").eqNullSafe(F.col("t_sha2")), "CONTENT")
        .otherwise("OK")
    )
    return j.select("path", issue.alias("issue"))


def with_hashes(source: DataFrame, copied: DataFrame) -> DataFrame:
    """The source's manifest (path, bytes) with the hashes that the copy took of it; of a failed file, none."""
    return source.select("path", "bytes").join(
        copied.where(F.col("status") == "COPIED").select("path", "sha2"), "path", "left")


def write_text_files(spark: SparkSession, rows: DataFrame, root: str, path_col: str = "path",
                     text_col: str = "text") -> DataFrame:
    """Write each row's text (UTF-8) as one file at ``root/<path>``; returns (path, bytes).

    Used to lay out a volume from a table of texts.  A worker holds ``TEXTS`` rows at once.
    """
    def written_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        fs, base = filesystem(root)
        made: set[str] = set()
        for b in batches:
            for rel, text in zip(b.column(0), b.column(1)):
                rel, text = rel.as_py(), text.as_py()
                data = ("" if text is None else text).encode("utf-8")
                target = _join(base, rel)
                parent = target.rsplit("/", 1)[0]
                if parent not in made:
                    fs.create_dir(parent, recursive=True)
                    made.add(parent)
                with fs.open_output_stream(target, compression=None) as dst:
                    dst.write(data)
                yield rel, len(data)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXTS))
    return rows.select(path_col, text_col).mapInArrow(lambda batches: gathered(written_rows(batches), WRITE_SCHEMA), WRITE_SCHEMA)
