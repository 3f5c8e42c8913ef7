"""URL rules by host suffix and path prefix, matched by hash prefix.

Every URL is expanded into (host suffix, path prefix) expressions; those and
the rules meet in an equi-join on the first 32 bits of their SHA-256, full
digests confirm, and the longest rule decides.  DataFrame functions only.

Defined cases: a null URL or one without ``://`` has an empty host and path
and meets no rule.  Equal expressions listed twice count as one rule; of an
``allow`` and a ``block`` for the same expression, ``block`` wins.  Repeated
rows each get their result; an empty table gives an empty result; a URL
column of any name and further columns (clashing names included) are kept out
of the way, as only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of the digest that the join uses (32 bits).
PREFIX_DIGITS = 8


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def _digested(df: DataFrame, expression: Column) -> DataFrame:
    return (df.withColumn("digest", F.sha2(expression, 256))
            .withColumn("short", F.substring("digest", 1, PREFIX_DIGITS)))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",),
               default: str = "allow") -> DataFrame:
    """``keep`` columns, host, path, rule and verdict of every row of ``pages``.

    ``rules`` has host, path and verdict (``allow`` or ``block``).  A rule fits
    its host and all subdomains where the path starts with the rule's path.
    """
    listed = (rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict"))
              .where("r_host is not null and r_path is not null")
              .groupBy("r_host", "r_path").agg(F.max(F.col("verdict") == "block").alias("blocks")))
    listed = _digested(listed.withColumn("rule", F.concat("r_host", "r_path")), F.col("rule"))
    # Two short facts about the rules bound the expansion: labels of a host, lengths of a path.
    bounds = listed.agg(F.max(F.size(F.split("r_host", r"\."))).alias("labels"),
                        F.array_sort(F.collect_set(F.length("r_path"))).alias("lengths")).first()
    labels, lengths = bounds["labels"] or 0, bounds["lengths"] or []

    urls = pages.select(*[F.col(f"`{c}`") for c in keep], url_host(F.col(f"`{url}`")).alias("host"),
                        url_path(F.col(f"`{url}`")).alias("path"))
    if not labels or not lengths:
        return urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # Equal (host, path) pairs are expanded once: a host with a third of all rows weighs little.
    places = urls.select("host", "path").distinct()
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -k) for k in range(1, labels + 1)]))
    prefixes = F.array_distinct(F.array(*[F.substring("path", 1, n) for n in lengths]))
    opened = (places.withColumn("suffix", F.explode(suffixes))
              .withColumn("prefix", F.explode(prefixes)))
    expressions = _digested(opened, F.concat("suffix", "prefix")).select("host", "path", "digest", "short")
    hits = expressions.join(listed.select("short", F.col("digest").alias("full"), "rule", "blocks"), "short")
    decided = (hits.where(F.col("digest") == F.col("full"))
               .groupBy("host", "path")
               .agg(F.max(F.struct(F.length("rule").alias("n"), F.col("blocks"), F.col("rule"))).alias("best")))
    verdict = F.when(F.col("best.blocks"), "block").when(~F.col("best.blocks"), "allow").otherwise(default)
    return urls.join(decided, ["host", "path"], "left").select(
        *[F.col(f"`{c}`") for c in keep], "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))
