"""Functions: definition text for all routines at once.

The parameter list is aggregated per routine (IN parameters only, in
position order) and joined to the routines; zero parameters give ``()``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultshift.functions import names as N

# Messages of the reference.
NO_DEFINITION = "Could not read function definition (must be owner or admin)"
UNSUPPORTED = "Unsupported function type ({body}/{lang}). Attempting SQL RETURN."


def parameter_lists(parameters: DataFrame) -> DataFrame:
    """(routine_schema, routine_name, param_list) from the parameter relation."""
    text = F.concat(N.quote_part(F.col("parameter_name")), F.lit(" "), F.col("full_data_type"))
    return (
        parameters.where(F.col("parameter_mode") == "IN")
        .groupBy(F.col("specific_schema").alias("routine_schema"), F.col("specific_name").alias("routine_name"))
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal_position", text.alias("t")))),
                                      lambda x: x["t"]), ", ").alias("param_list"))
    )


def function_ddl(routines: DataFrame, parameters: DataFrame, target_catalog: str) -> DataFrame:
    """(routine_schema, routine_name, status, warning, ddl) for every routine.

    SQL bodies become ``RETURN body``, external Python ``LANGUAGE PYTHON AS
    $$body$$``; anything else falls back to ``RETURN`` with a warning.  A
    routine without a readable definition is SKIPPED.
    """
    r = routines.where(F.col("routine_schema") != "information_schema").join(
        parameter_lists(parameters), ["routine_schema", "routine_name"], "left")
    body = F.upper(F.coalesce(F.col("routine_body"), F.lit("")))
    lang = F.upper(F.coalesce(F.col("external_language"), F.lit("")))
    definition = F.col("routine_definition")
    has_def = definition.isNotNull() & (definition != "")
    python = (body == "EXTERNAL") & (lang == "PYTHON")
    head = F.concat(
        F.lit("CREATE FUNCTION "), N.quoted(F.lit(target_catalog), F.col("routine_schema"), F.col("routine_name")),
        F.lit("("), F.coalesce(F.col("param_list"), F.lit("")), F.lit(")"),
        F.lit("\nRETURNS "), F.col("full_data_type"),
        F.when(F.coalesce(F.col("comment"), F.lit("")) != "",
               F.concat(F.lit("\nCOMMENT "), N.sql_string(F.col("comment")))).otherwise(F.lit("")),
        F.when(F.upper(F.coalesce(F.col("is_deterministic"), F.lit(""))) == "YES", F.lit("\nDETERMINISTIC"))
        .otherwise(F.lit("")),
    )
    tail = (
        F.when(body == "SQL", F.concat(F.lit("\nRETURN "), definition))
        .when(python, F.concat(F.lit("\nLANGUAGE PYTHON\nAS $$\n"), definition, F.lit("\n$$")))
        .otherwise(F.concat(F.lit("\nRETURN "), definition))
    )
    warning = (
        F.when(~has_def, F.lit(NO_DEFINITION))
        .when((body != "SQL") & ~python,
              F.concat(F.lit(UNSUPPORTED.split("{body}")[0]), body, F.lit("/"), lang,
                       F.lit(UNSUPPORTED.split("{lang}")[1])))
    )
    return r.select(
        "routine_schema", "routine_name",
        F.when(has_def, F.lit("PLANNED")).otherwise(F.lit("SKIPPED")).alias("status"),
        warning.alias("warning"),
        F.when(has_def, F.concat(head, tail)).alias("ddl"),
    )
