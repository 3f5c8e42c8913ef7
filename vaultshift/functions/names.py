"""Name and text helpers as Column expressions (JVM side, no Python UDF).

Covers quoting (backticks), dotted names, literal escaping, privilege
normalisation, path trimming, derived catalog names and ``k=v`` messages.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BT = "`"
QUOTE = "'"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def quote_part(part) -> Column:
    """One backtick-quoted identifier; inner backticks are doubled."""
    return F.concat(F.lit(BT), F.replace(_c(part), F.lit(BT), F.lit(BT + BT)), F.lit(BT))


def quoted(*parts) -> Column:
    """``q(a, b, c)`` -> `a`.`b`.`c`; inner backticks doubled."""
    return F.concat_ws(".", *[quote_part(p) for p in parts])


def quoted_list(arr) -> Column:
    """Array of names -> "`a`, `b`"."""
    return F.array_join(F.transform(_c(arr), lambda x: quote_part(x)), ", ")


def fqn(*parts) -> Column:
    """Plain dotted name; absent (null) parts are left out, no trailing dot."""
    return F.concat_ws(".", *[_c(p) for p in parts])


def escape_literal(s) -> Column:
    """Text for a single-quoted SQL literal: backslash first, then the quote.

    Null stays null.
    """
    c = _c(s)
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit(QUOTE), F.lit("\\'"))


def sql_string(s) -> Column:
    """'escaped text' including the surrounding quotes."""
    return F.concat(F.lit(QUOTE), escape_literal(s), F.lit(QUOTE))


def norm_privilege(action) -> Column:
    """'CREATE CATALOG', 'create_catalog' -> 'CREATECATALOG'."""
    return F.upper(F.translate(_c(action), "_ ", ""))


def trim_slashes(url) -> Column:
    """Trailing slashes removed; null -> ''."""
    return F.regexp_replace(F.coalesce(_c(url), F.lit("")), "/+$", "")


def aux_name(catalog) -> Column:
    return F.concat(_c(catalog), F.lit("_aux"))


def bkp_name(catalog) -> Column:
    return F.concat(_c(catalog), F.lit("_bkp"))


def kv_message(**pairs) -> Column:
    """``k=v k=v`` text, keys in the given order; null values print as ''."""
    items = []
    for k, v in pairs.items():
        items.append(F.concat(F.lit(f"{k}="), F.coalesce(_c(v).cast("string"), F.lit(""))))
    return F.concat_ws(" ", *items)


def kv_read(message, key: str) -> Column:
    """Value of ``key`` in a ``k=v k=v`` message (null if absent)."""
    return F.element_at(F.str_to_map(_c(message), F.lit(" "), F.lit("=")), F.lit(key))


def one_decimal(x) -> Column:
    return F.format_string("%.1f", _c(x))


def current_user(spark) -> str:
    """Identity of the runner as the session reports it."""
    return spark.sql("SELECT current_user()").first()[0]
