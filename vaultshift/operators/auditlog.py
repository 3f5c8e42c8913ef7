"""Append-only audit log: schema, batch append and the readers of past runs.

The log is a parquet table partitioned by ``catalog_name`` in the shared
folder.  Each step appends its rows once (one write per step, not per
object).  NOT NULL columns are checked inside the write itself
(``raise_error``), so no extra pass over the rows is made.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultshift.sources.commits import CommittedTable

LOG_SCHEMA = T.StructType([
    T.StructField("batch_id", T.StringType(), False),
    T.StructField("catalog_name", T.StringType(), False),
    T.StructField("phase", T.StringType(), False),
    T.StructField("object_type", T.StringType(), False),
    T.StructField("object_name", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("message", T.StringType(), True),
    T.StructField("duration_seconds", T.DoubleType(), True),
    # UTC wall time; stored without zone so readers in any session zone agree.
    T.StructField("logged_at", T.TimestampNTZType(), False),
])
LOG_COLUMNS = [f.name for f in LOG_SCHEMA.fields]
NOT_NULL = [f.name for f in LOG_SCHEMA.fields if not f.nullable]

# Log table comment and status words (reference vocabulary).
LOG_COMMENT = "Migration log for catalog storage migration"
FAILURE_STATUSES = ("FAILED", "ERROR")
CHECK_FAILURE_STATUSES = ("FAIL",)


def batch_id_for(ts: _dt.datetime | None = None) -> str:
    """``yyyyMMdd_HHmmss`` of a UTC time (now when not given)."""
    ts = ts or _dt.datetime.now(_dt.timezone.utc)
    return ts.strftime("%Y%m%d_%H%M%S")


def log_rows(df: DataFrame, batch_id: str, catalog: str, phase: str, logged_at: _dt.datetime,
             object_type: Column | str = "object_type", object_name: Column | str = "object_name",
             status: Column | str = "status", message: Column | str | None = "message",
             duration: Column | str | None = None) -> DataFrame:
    """Shape the rows of one step as log rows (batch, catalog, phase and time are literals)."""
    def c(x, typ="string"):
        if x is None:
            return F.lit(None).cast(typ)
        return (F.col(x) if isinstance(x, str) else x).cast(typ)

    return df.select(
        F.lit(batch_id).alias("batch_id"), F.lit(catalog).alias("catalog_name"), F.lit(phase).alias("phase"),
        c(object_type).alias("object_type"), c(object_name).alias("object_name"), c(status).alias("status"),
        c(message).alias("message"), c(duration, "double").alias("duration_seconds"),
        F.lit(logged_at.replace(tzinfo=None)).cast("timestamp_ntz").alias("logged_at"),
    )


def _checked(df: DataFrame) -> DataFrame:
    cols = []
    for f in LOG_SCHEMA.fields:
        c = F.col(f.name).cast(f.dataType)
        if not f.nullable:
            c = F.when(c.isNull(), F.raise_error(F.lit(f"audit log: {f.name} must not be null"))
                       ).otherwise(c).cast(f.dataType)
        cols.append(c.alias(f.name))
    return df.select(*cols)


class AuditLog:
    """Parquet audit log at ``path`` (a folder every executor can reach)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def append(self, rows: DataFrame, max_records_per_file: int = 1_000_000) -> None:
        """One append per step.  Rows are sorted by batch and time inside each
        task (no shuffle), so parquet min/max statistics skip other batches."""
        (
            _checked(rows).sortWithinPartitions("batch_id", "logged_at").write.mode("append")
            .option("maxRecordsPerFile", max_records_per_file)
            .partitionBy("catalog_name")
            .parquet(self.path)
        )

    def read(self) -> DataFrame:
        return self.spark.read.schema(LOG_SCHEMA).parquet(self.path).select(*LOG_COLUMNS)

    def read_or_empty(self) -> DataFrame:
        """The log, or no rows where its folder does not exist yet; any other failure to read it is raised."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], LOG_SCHEMA).select(*LOG_COLUMNS)
        return self.read()

    def register(self, table: str, comment: str = LOG_COMMENT) -> None:
        """Make the log a catalog table over its folder (created only if absent)."""
        cols = ", ".join(f"{f.name} {f.dataType.simpleString().upper()}" for f in LOG_SCHEMA.fields)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({cols}) USING parquet PARTITIONED BY (catalog_name) "
            f"LOCATION '{self.path}' COMMENT '{comment}'")
        self.spark.sql(f"MSCK REPAIR TABLE {table}")


class LogTable(AuditLog):
    """An audit log behind a commit log, readable by name.

    Appends of steps at the same time commit one after the other.  Many small appends don't
    stay many files: beyond ``folders`` live folders they are merged into one.  ``register`` makes a view of
    the live folders and refreshes it with every append; readers see whole commits.
    """

    def __init__(self, spark: SparkSession, path: str, folders: int = 8):
        super().__init__(spark, path)
        self.table = CommittedTable(spark, self.path, T.StructType([T.StructField(f.name, f.dataType) for f in LOG_SCHEMA.fields]), ("catalog_name",))
        self.folders, self.name = folders, None

    def append(self, rows: DataFrame, max_records_per_file: int = 1_000_000) -> None:
        self.table.append(_checked(rows).sortWithinPartitions("batch_id", "logged_at"))
        self.table.compact(self.folders)
        if self.name:
            self.register(self.name)

    def read(self) -> DataFrame:
        return self.table.read().select(*LOG_COLUMNS)

    def read_or_empty(self) -> DataFrame:
        return self.read()

    def register(self, table: str, comment: str = LOG_COMMENT) -> None:
        """Makes or renews the view ``table`` over the live folders."""
        cols = ", ".join(LOG_COLUMNS)
        live = self.table.log.state()["live"]
        if not live:
            raise ValueError(f"{self.path}: nothing is committed yet")
        parts = " UNION ALL ".join(f"SELECT {cols} FROM parquet.`{self.path}/{x}`" for x in live)
        self.spark.sql(f"CREATE OR REPLACE VIEW {table} COMMENT '{comment}' AS {parts}")
        self.name = table


# ---- readers (the useful queries of the log) ---------------------------------

def _batch(log: DataFrame, batch_id: str) -> DataFrame:
    return log.where(F.col("batch_id") == batch_id)


def full(log: DataFrame, batch_id: str) -> DataFrame:
    return _batch(log, batch_id).orderBy("logged_at")


def latest(log: DataFrame, batch_id: str) -> DataFrame:
    """The last row of each (phase, object_type, object_name) of a batch."""
    keys = ["phase", "object_type", "object_name"]
    rest = [c for c in LOG_COLUMNS if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct("logged_at", "status")).alias("last")
    return _batch(log, batch_id).groupBy(*keys).agg(last).select(*keys, "last.*").select(*LOG_COLUMNS)


def summary(log: DataFrame, batch_id: str) -> DataFrame:
    return (
        _batch(log, batch_id).groupBy("phase", "object_type", "status")
        .agg(F.count(F.lit(1)).alias("cnt")).orderBy("phase", "object_type", "status")
    )


def phase_status(log: DataFrame, batch_id: str) -> DataFrame:
    return (
        _batch(log, batch_id).groupBy("phase", "status")
        .agg(F.count(F.lit(1)).alias("cnt")).orderBy("phase", "status")
    )


def failures(log: DataFrame, batch_id: str, include_check_failures: bool = False) -> DataFrame:
    st = FAILURE_STATUSES + (CHECK_FAILURE_STATUSES if include_check_failures else ())
    return (
        _batch(log, batch_id).where(F.col("status").isin(*st))
        .select("phase", "object_type", "object_name", "message").orderBy("phase", "object_name")
    )


def failure_count(log: DataFrame, batch_id: str) -> DataFrame:
    return _batch(log, batch_id).where(F.col("status").isin(*FAILURE_STATUSES)).agg(
        F.count(F.lit(1)).alias("failures"))


def failures_all(log: DataFrame, catalog: str) -> DataFrame:
    return (
        log.where((F.col("catalog_name") == catalog) & F.col("status").isin(*FAILURE_STATUSES))
        .select("batch_id", "phase", "object_name", "message", "logged_at")
        .orderBy(F.desc("batch_id"), "logged_at")
        .drop("logged_at")
    )


def inventory(log: DataFrame, batch_id: str) -> DataFrame:
    return (
        _batch(log, batch_id).where(F.col("phase") == "inventory")
        .select("object_type", "object_name", "status", "message").orderBy("object_type", "object_name")
    )


def out_of_scope(log: DataFrame, batch_id: str) -> DataFrame:
    return (
        _batch(log, batch_id).where((F.col("phase") == "inventory") & (F.col("status") == "OUT_OF_SCOPE"))
        .select("object_type", "object_name", "message").orderBy("object_type", "object_name")
    )


def warnings(log: DataFrame, batch_id: str) -> DataFrame:
    return (
        _batch(log, batch_id).where(F.col("status") == "WARNING")
        .select("object_name", "message", "logged_at").orderBy("logged_at").drop("logged_at")
    )


def compare(log: DataFrame, batch_ids: list[str], pivot: bool = False) -> DataFrame:
    sel = log.where(F.col("batch_id").isin(*batch_ids))
    if pivot:
        return sel.groupBy("phase", "status").pivot("batch_id", batch_ids).agg(F.count(F.lit(1)))
    return (
        sel.groupBy("batch_id", "phase", "status").agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy("batch_id", "phase", "status")
    )


def rowcount_results(log: DataFrame, batch_id: str) -> DataFrame:
    from vaultshift.functions.names import kv_read

    return (
        _batch(log, batch_id)
        .where((F.col("phase") == "validation") & (F.col("object_type") == "ROW_COUNT"))
        .select("object_name", "status", "message",
                kv_read(F.col("message"), "new").cast("bigint").alias("new"),
                kv_read(F.col("message"), "original").cast("bigint").alias("original"))
        .orderBy("object_name")
    )


def durations(log: DataFrame, batch_id: str, with_median: bool = False) -> DataFrame:
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("duration_seconds"), 6).alias("total_seconds"),
        F.max("duration_seconds").alias("max_seconds"),
    ]
    if with_median:
        aggs.append(F.percentile_approx("duration_seconds", 0.5).alias("p50_seconds"))
    return _batch(log, batch_id).groupBy("phase").agg(*aggs).orderBy("phase")


def duration_texts(log: DataFrame) -> DataFrame:
    """(batch_id, catalog_name, phase, shortest, longest): the durations of every phase of every run as messages show them,
    seconds with one decimal; null where nothing was timed."""
    from vaultshift.functions.names import one_decimal

    return log.groupBy("batch_id", "catalog_name", "phase").agg(
        F.min("duration_seconds").alias("shortest"), F.max("duration_seconds").alias("longest")).select(
        "batch_id", "catalog_name", "phase",
        *[F.when(F.col(c).isNotNull(), one_decimal(F.col(c))).alias(c) for c in ("shortest", "longest")])
