"""Running plan relations in the session catalog.

DDL is a catalog operation that Spark executes on the driver, one statement
at a time; the loop below walks statements (one per object), never data.
Statements open-source Spark cannot run here (GRANT, SET OWNER, SET TAGS,
ADD CONSTRAINT, Python or metric-view bodies) are kept with status SKIPPED,
so the plan stays the full record of what is left to do elsewhere.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Statement kinds the session catalog runs.
_NAME = r"(?:`(?:[^`]|``)*`|[^\s.`(]+)(?:\s*\.\s*(?:`(?:[^`]|``)*`|[^\s.`(]+))*"
RUNNABLE = re.compile(
    r"^\s*(CREATE\s+(SCHEMA|DATABASE|VIEW|OR\s+REPLACE\s+VIEW|FUNCTION)\b"
    r"|COMMENT\s+ON\s+(SCHEMA|DATABASE|TABLE)\b"
    rf"|ALTER\s+SCHEMA\s+{_NAME}\s+SET\s+DBPROPERTIES\b)",
    re.IGNORECASE,
)
# Judged by the clauses after the object's name only: a query text may say the same words.
NOT_HERE = re.compile(
    rf"^\s*CREATE\s+(?:OR\s+REPLACE\s+)?VIEW\s+(?:IF\s+NOT\s+EXISTS\s+)?{_NAME}\s*(?:\([^)]*\)\s*)?WITH\s+METRICS\b"
    rf"|^\s*CREATE\s+(?:OR\s+REPLACE\s+)?FUNCTION\s+(?:IF\s+NOT\s+EXISTS\s+)?{_NAME}\s*\([^)]*\)(?:(?!\bRETURN\b|\$\$|\bAS\b).)*?\bLANGUAGE\s+PYTHON\b",
    re.IGNORECASE | re.DOTALL,
)

RESULT_SCHEMA = ("object_type string, object_name string, statement string, status string, error string, "
                 "seconds double")


def runnable(statement: str | None) -> bool:
    return bool(statement) and bool(RUNNABLE.match(statement)) and not NOT_HERE.search(statement)


def _run(spark: SparkSession, statement: str) -> tuple[str, str | None, float]:
    import time

    if not runnable(statement):
        return "SKIPPED", "not runnable in this catalog; kept as plan", 0.0
    t0 = time.time()
    try:
        spark.sql(statement)
        return "SUCCESS", None, time.time() - t0
    except Exception as e:  # noqa: BLE001 - reported per statement
        return "FAILED", str(e), time.time() - t0


def run_statements(spark: SparkSession, plan: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Run every statement of a plan relation (columns object_type, object_name,
    statement; ``order`` columns first, e.g. ``step``) and return one result row
    per statement: SUCCESS, FAILED (with the error) or SKIPPED."""
    cols = (order or []) + ["object_type", "object_name", "statement"]
    rows = plan.select(*cols).orderBy(*cols).collect()  # statements: one per object
    out = []
    for r in rows:
        status, error, secs = _run(spark, r["statement"])
        out.append((r["object_type"], r["object_name"], r["statement"], status, error, float(secs)))
    return spark.createDataFrame(out, RESULT_SCHEMA)


def create_views(spark: SparkSession, plan: DataFrame, order: DataFrame, deps: DataFrame | None = None, parallel: int = 8) -> DataFrame:
    """Create the views of ``recreate_plan`` level by level, those of one level at the same time.

    ``order``: (object_name, level, order_status); ``deps``: (object_name, reads), the planned
    views that each one reads.  If a statement fails, the fallback is tried.  Not tried (SKIPPED) are
    views that the plan doesn't hold ready, that the order can't place, or that read a view of the plan
    which wasn't created; so a failure is reported once, where it arose.  One result row per view:
    ``used`` tells which text made it, ``STATEMENT`` or ``FALLBACK``.

    Rows come to the driver in order, a partition at a time; what stays there is the name and outcome
    of each view and the texts of one level.
    """
    rows = plan.join(order, "object_name")
    if deps is None:
        rows = rows.withColumn("reads", F.array().cast("array<string>"))
    else:
        rows = rows.join(deps.groupBy("object_name").agg(F.collect_set("reads").alias("reads")), "object_name", "left")
    rows = rows.select("object_type", "object_name", "status", "statement", "fallback", "reads", "level", "order_status").orderBy(
        F.col("level").asc_nulls_last(), "object_name")
    planned = {r["object_name"] for r in plan.select("object_name").toLocalIterator()} if deps is not None else set()
    made: set[str] = set()

    def create(r) -> tuple:
        used, status, secs = None, "SKIPPED", 0.0
        if r["status"] != "PLANNED":
            error = "not planned"
        elif r["order_status"] != "SUCCESS":
            error = "dependencies cannot be met"
        elif lacking := sorted(x for x in r["reads"] or [] if x in planned and x not in made):
            error = f"reads a view that was not created: {', '.join(lacking)}"
        else:
            status, error = "FAILED", "no statement"
            for used, text in (("STATEMENT", r["statement"]), ("FALLBACK", r["fallback"])):
                if text:
                    status, error, more = _run(spark, text)
                    secs += more
                if status == "SUCCESS":
                    break
        return (r["object_type"], r["object_name"], r["statement"], status, error, float(secs), used if status == "SUCCESS" else None)

    out: list[tuple] = []
    with ThreadPoolExecutor(parallel) as pool:
        for _, level in groupby(rows.toLocalIterator(), key=lambda r: r["level"]):
            done = list(pool.map(create, level))
            made |= {r[1] for r in done if r[3] == "SUCCESS"}
            out += done
    return spark.createDataFrame(out, RESULT_SCHEMA + ", used string")
