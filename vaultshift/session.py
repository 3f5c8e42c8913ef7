"""Session helpers: a local session for tests and the shared work folder.

On a cluster the shared folder is the one the cluster names in
``spark.checkpoint.dir``; it is read from the session and never replaced.
Only when it is unset (local runs, tests) a private folder is created.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, partitions: int = 8, app: str = "vaultshift") -> SparkSession:
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def _checkpoint_dir(spark: SparkSession) -> str | None:
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    return None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder of the session.

    A private folder is made only where none is set *and* the master is
    local: on a cluster a machine-local folder would be lost with its machine,
    so that case raises.
    """
    found = _checkpoint_dir(spark)
    if found:
        return found
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="vaultshift-ckpt-")
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext.getCheckpointDir() or local


def shared_root(spark: SparkSession) -> str:
    """Shared folder for written tables, copies and the audit log.

    ``spark.checkpoint.dir`` of the cluster, or a private folder when unset.
    """
    base = ensure_checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    return base.rstrip("/")


def shared_uri(spark: SparkSession, label: str) -> str:
    """A new, unused folder below the checkpoint folder, with its scheme kept."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    base = base if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", base) else f"file:{base}"
    return f"{base}/vaultshift/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Cuts the lineage there: a lost executor repeats only what follows.
    """
    spark = df.sparkSession
    path = shared_uri(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused folder below the shared root for one run of one step."""
    return f"{shared_root(spark)}/vaultshift/{label}-{uuid.uuid4().hex[:12]}"
