"""Publishing a new version of a catalog with a single pointer change.

Instead of two renames with a gap, a pointer log holds (name, version,
target); the current target of a name is its highest version.  A swap adds
two rows (name -> new target, name_bkp -> old target) in one commit of a commit
log (``sources.commits``), so readers see either the old or the new state, and of
writers at the same time each takes up the state that the one before left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultshift.sources.commits import CommittedTable

POINTER_SCHEMA = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("version", T.LongType(), False),
    T.StructField("target", T.StringType(), False),
])


def resolve(pointers: DataFrame) -> DataFrame:
    """(name, version, target) of the latest version per name.

    An aggregate, not a window: partial aggregation keeps a name with very
    many versions from landing whole in one task.
    """
    return pointers.groupBy("name").agg(
        F.max("version").alias("version"),
        F.max_by("target", "version").alias("target"),
    )


def pointers(spark: SparkSession, path: str) -> CommittedTable:
    return CommittedTable(spark, path, POINTER_SCHEMA)


def create_pointers(spark: SparkSession, path: str, rows: DataFrame) -> int:
    """Adds pointers as they are (name, version, target)."""
    return pointers(spark, path).append(rows.select([F.col(f.name).cast(f.dataType) for f in POINTER_SCHEMA.fields]))


def read_pointers(spark: SparkSession, path: str, commit: int | None = None) -> DataFrame:
    return pointers(spark, path).read(commit)


def swapped(current: DataFrame, changes: DataFrame, backup_suffix: str = "_bkp") -> DataFrame:
    """Pointer rows that ``changes`` (name, target) add to the resolved pointers ``current``.

    A name points to its new target, name + suffix to the former one, both
    with the version after the higher of the two names'.  Without a former target there is no backup row.
    """
    now = changes.select("name", F.col("target").alias("new_target"), F.concat("name", F.lit(backup_suffix)).alias("backup"))
    own = current.select(F.col("name"), F.col("version").alias("v"), F.col("target").alias("old"))
    kept = current.select(F.col("name").alias("backup"), F.col("version").alias("backup_v"))
    both = now.join(own, "name", "left").join(kept, "backup", "left").withColumn(
        "version", F.greatest(F.coalesce("v", F.lit(0)), F.coalesce("backup_v", F.lit(0))) + 1)
    rows = F.array(F.struct("name", "version", F.col("new_target").alias("target")),
                   F.struct(F.col("backup").alias("name"), "version", F.col("old").alias("target")))
    return both.select(F.explode(rows).alias("r")).select("r.*").where("target is not null").select(
        [F.col(f.name).cast(f.dataType) for f in POINTER_SCHEMA.fields])


def publish_swaps(spark: SparkSession, path: str, changes: DataFrame, backup_suffix: str = "_bkp") -> int:
    """Swaps all names of ``changes`` (name, target; a name once) in one commit, and returns its number.

    Two writers at once commit one after the other: the later one's rows are made from the earlier
    one's pointers, so versions differ and no swap is lost.
    """
    return pointers(spark, path).update(lambda before: swapped(resolve(before), changes, backup_suffix))


def publish_swap(spark: SparkSession, path: str, name: str, new_target: str, backup_suffix: str = "_bkp") -> int:
    """Points ``name`` at ``new_target`` and ``name_bkp`` at its former target; the commit's number."""
    return publish_swaps(spark, path, spark.createDataFrame([(name, new_target)], "name string, target string"), backup_suffix)


def resolver_view(spark: SparkSession, path: str, view_name: str = "catalog_pointers") -> None:
    """Readers resolve names through this view; it shows the pointers of the latest commit."""
    resolve(read_pointers(spark, path)).createOrReplaceTempView(view_name)
