"""Tags of tables and columns as ``'k' = 'v'`` lists.

Tag lists are built per object with an ordered ``collect_list`` (bounded: an
object carries few tags) and kept in tag-name order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultshift.functions import names as N


def tag_pair(tag_name, tag_value) -> Column:
    """``'name' = 'value'``, both escaped for a literal."""
    return F.concat(N.sql_string(tag_name), F.lit(" = "), N.sql_string(F.coalesce(tag_value, F.lit(""))))


def ordered_pairs(name_col: str = "tag_name", value_col: str = "tag_value") -> Column:
    """Aggregate: pairs joined with ', ' in tag-name order."""
    return F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col(name_col).alias("k"),
                                                 tag_pair(F.col(name_col), F.col(value_col)).alias("p")))),
            lambda x: x["p"],
        ),
        ", ",
    )


def table_tag_pairs(tags: DataFrame) -> DataFrame:
    return (
        tags.where(F.upper(F.col("object_type")) == "TABLE")
        .groupBy("table_schema", "table_name")
        .agg(ordered_pairs().alias("tags"), F.count(F.lit(1)).alias("n_tags"))
    )


def column_tag_pairs(tags: DataFrame) -> DataFrame:
    return (
        tags.where(F.upper(F.col("object_type")) == "COLUMN")
        .groupBy("table_schema", "table_name", "column_name")
        .agg(ordered_pairs().alias("tags"), F.count(F.lit(1)).alias("n_tags"))
    )
