"""Copying files as byte ranges, with a tree digest.

A file is as many tasks as it has ranges of ``RANGE`` bytes, so one huge file is spread over the cluster and a
lost task repeats one range.  Each task reads its range from the source, hashes it in leaves of ``LEAF``
bytes and writes it to its place.  On a local or mounted target that is the range's offset in
the file itself, under a name of the run's own; elsewhere ranges are objects beside it that one
task per file then streams into the target.  A file's digest is the SHA-256 of
its leaves' SHA-256 (hex) in order; it doesn't depend on ranges or tasks and ``stream_digest`` gives the same in one pass.

A run is committed by its report: the file's name at the target is in ``target``, and nothing is renamed.
``publish`` gives the copies of a report their own names by hard links where the file system has them.

Cases: an empty file is one range of no bytes, with the digest of no leaves; a file that is shorter or longer than
its manifest says, or can't be read, is FAILED with the reason, and the others go on.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultshift.operators import files as fl
from vaultshift.session import written

RANGE, LEAF = 256 << 20, 4 << 20
_DONE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("no", T.LongType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("leaves", T.ArrayType(T.StringType())),
    T.StructField("error", T.StringType()),
])


def ranges_of(files: DataFrame, size: int = RANGE) -> DataFrame:
    """(path, bytes, no, start, length) of each range of ``files`` (path, bytes)."""
    n = F.greatest(F.lit(1), F.ceil(F.col("bytes") / size)).cast("long")
    cut = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("no"))
    return cut.select("path", "bytes", "no", (F.col("no") * size).alias("start"), F.least(F.lit(size), F.col("bytes") - F.col("no") * size).alias("length"))


def tree_digest(leaves: list[str]) -> str:
    return hashlib.sha256("".join(leaves).encode()).hexdigest()


def stream_digest(read, leaf: int = LEAF) -> tuple[int, str]:
    """(bytes, tree digest) of a stream's ``read(n)``, in one pass."""
    n, leaves = 0, []
    while piece := _full(read, leaf):
        leaves.append(hashlib.sha256(piece).hexdigest())
        n += len(piece)
    return n, tree_digest(leaves)


def _full(read, n: int) -> bytes:
    """n bytes, fewer only at the end; a read may return less than it is asked for."""
    parts = []
    while n > 0 and (b := read(n)):
        parts.append(b)
        n -= len(b)
    return b"".join(parts)


def _copy_ranges(ranges: DataFrame, src_root: str, dst_root: str, run: str, leaf: int, in_place: bool) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        sfs, sbase = fl.filesystem(src_root)
        dfs, dbase = fl.filesystem(dst_root)
        made: set[str] = set()
        for b in batches:
            for rel, size, no, start, length in zip(*(b.column(c).to_pylist() for c in ("path", "bytes", "no", "start", "length"))):
                leaves, error = [], None
                try:
                    target = fl._join(dbase, f"{rel}.{run}")
                    folder = target.rsplit("/", 1)[0] if in_place else f"{target}.ranges"
                    if folder not in made:
                        dfs.create_dir(folder, recursive=True)
                        made.add(folder)
                    with sfs.open_input_file(fl._join(sbase, rel)) as src:
                        if src.size() != size:
                            raise OSError(f"{src.size()} bytes, {size} in the manifest")
                        src.seek(start)
                        if in_place:
                            # Ranges of one file are written by many tasks: opened without truncation, each at its offset.
                            with os.fdopen(os.open(target, os.O_WRONLY | os.O_CREAT, 0o644), "wb") as dst:
                                dst.seek(start)
                                _through(src, dst, length, leaf, leaves)
                        else:
                            with dfs.open_output_stream(f"{folder}/{no:08d}", compression=None) as dst:
                                _through(src, dst, length, leaf, leaves)
                except Exception as e:  # noqa: BLE001 - reported per file
                    leaves, error = [], str(e)[:500]
                yield rel, no, length, leaves, error

    return _by_range(ranges, rows)


def _by_range(ranges: DataFrame, rows: Callable) -> DataFrame:
    """What ``rows`` gives of each range.  By a hash of file and range: the ranges of a file go to many tasks.

    The number of tasks is given: of a range only its place is in the row, so adaptive execution would take
    gigabytes of files for a few small rows and read them in one task.
    """
    n, total = fl._sizes(ranges.select(F.col("length").alias("bytes")))
    spread = fl._spread(ranges, total, n, ranges.sparkSession.sparkContext.defaultParallelism, ("path", "no"))
    return spread.mapInArrow(lambda batches: fl.gathered(rows(batches), _DONE, lambda r: 1 + len(r[3])), _DONE)


def _through(src, dst, length: int, leaf: int, leaves: list[str]) -> None:
    while length > 0:
        piece = _full(src.read, min(leaf, length))
        if not piece:
            raise OSError("it ended early")
        leaves.append(hashlib.sha256(piece).hexdigest())
        dst.write(piece)
        length -= len(piece)


def _composed(whole: DataFrame, dst_root: str, run: str) -> DataFrame:
    """Streams the ranges of each file into it, in order; for targets that can't be written at offsets."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dfs, dbase = fl.filesystem(dst_root)
        for b in batches:
            errors = []
            for rel, n in zip(b["path"], b["n"].tolist()):
                target = fl._join(dbase, f"{rel}.{run}")
                try:
                    with dfs.open_output_stream(target, compression=None) as dst:
                        for no in range(n):
                            with dfs.open_input_stream(f"{target}.ranges/{no:08d}", compression=None) as src:
                                while piece := src.read(fl.BLOCK):
                                    dst.write(piece)
                    dfs.delete_dir(f"{target}.ranges")
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - reported per file
                    errors.append(str(e)[:500])
            yield pd.DataFrame({"path": b["path"], "failed": pd.Series(errors, dtype=object)})

    files, total = fl._sizes(whole)
    spread = fl._spread(whole.select("path", "n"), total, files, whole.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInPandas(work, "path string, failed string")


def copy_ranges(spark: SparkSession, files: DataFrame, src_root: str, dst_root: str, size: int = RANGE, leaf: int = LEAF,
                in_place: bool | None = None) -> DataFrame:
    """(path, target, bytes, ranges, tree_sha2, status, error) per file of ``files`` (path, bytes).

    ``size`` is made a multiple of ``leaf``.  ``in_place`` says whether the target can be written at offsets (None: if it is local).
    """
    import pyarrow.fs as pafs

    size = -(-size // leaf) * leaf
    run = f"copy-{uuid.uuid4().hex[:12]}"
    in_place = isinstance(fl.filesystem(dst_root)[0], pafs.LocalFileSystem) if in_place is None else in_place
    done = written(_copy_ranges(ranges_of(files.select("path", "bytes"), size), src_root, dst_root, run, leaf, in_place), "ranges")
    # A file's leaves are in proportion to its ranges: a row of 64 characters per LEAF bytes.
    per = done.groupBy("path").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.max("error").alias("error"),
        F.array_sort(F.collect_list(F.struct("no", "leaves"))).alias("parts"))
    per = per.withColumn("tree_sha2", F.sha2(F.array_join(F.flatten(F.col("parts.leaves")), ""), 256))
    if not in_place:
        per = written(per.drop("parts"), "ranged")
        per = per.join(written(_composed(per.where("error is null"), dst_root, run), "composed"), "path", "left").withColumn("error", F.coalesce("error", "failed"))
    ok = F.col("error").isNull()
    return written(per.select("path", F.when(ok, F.concat("path", F.lit(f".{run}"))).alias("target"), F.when(ok, F.col("bytes")).alias("bytes"),
                              F.col("n").alias("ranges"), F.when(ok, F.col("tree_sha2")).alias("tree_sha2"),
                              F.when(ok, "COPIED").otherwise("FAILED").alias("status"), "error"), "copied")


def digest_ranges(files: DataFrame, root: str, size: int = RANGE, leaf: int = LEAF) -> DataFrame:
    """(path, bytes, tree_sha2, error) of files below root, read by ranges."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        fs, base = fl.filesystem(root)
        for b in batches:
            for rel, no, start, length in zip(*(b.column(c).to_pylist() for c in ("path", "no", "start", "length"))):
                leaves, error = [], None
                try:
                    with fs.open_input_file(fl._join(base, rel)) as src:
                        src.seek(start)
                        _through(src, _Nowhere, length, leaf, leaves)
                except Exception as e:  # noqa: BLE001 - reported per file
                    leaves, error = [], str(e)[:500]
                yield rel, no, length, leaves, error

    size = -(-size // leaf) * leaf
    done = _by_range(ranges_of(files.select("path", "bytes"), size), rows)
    per = done.groupBy("path").agg(F.sum("bytes").alias("bytes"), F.max("error").alias("error"), F.array_sort(F.collect_list(F.struct("no", "leaves"))).alias("parts"))
    return per.select("path", "bytes", F.when(F.col("error").isNull(), F.sha2(F.array_join(F.flatten(F.col("parts.leaves")), ""), 256)).alias("tree_sha2"), "error")


class _Nowhere:
    @staticmethod
    def write(piece: bytes) -> None:
        return None


def publish(copied: DataFrame, dst_root: str) -> DataFrame:
    """(path, error): gives each COPIED file its own name, as a hard link to the run's file, on a local or mounted target.

    A name that is there already stays as it is, with an error.
    """
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, base = fl.filesystem(dst_root)
        for b in batches:
            errors = []
            for rel, target in zip(b["path"], b["target"]):
                try:
                    os.link(fl._join(base, target), fl._join(base, rel))
                    os.unlink(fl._join(base, target))
                    errors.append(None)
                except OSError as e:
                    errors.append(str(e)[:500])
            yield pd.DataFrame({"path": b["path"], "error": pd.Series(errors, dtype=object)})

    return copied.where("status = 'COPIED'").select("path", "target").mapInPandas(work, "path string, error string")
