"""Column-expression helpers with warehouse-SQL null semantics.

All of these are built-in Spark expressions, so they stay inside whole-stage
codegen; no Python runs per row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_MINUTE = 60_000_000


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_divide(a: Column | str, b: Column | str) -> Column:
    """``SAFE_DIVIDE``: double result, null when the divisor is 0 or null."""
    return F.try_divide(col_(a).cast("double"), col_(b).cast("double"))


def regex_extract(s: Column | str, pattern: str) -> Column:
    """``REGEXP_EXTRACT(s, pattern)`` returning capture group 1, NULL on no match.

    Spark returns ``''`` when nothing matches; every pattern used here needs at
    least one character in group 1, so ``''`` never is a real match.
    """
    return F.nullif(F.regexp_extract(col_(s), pattern, 1), F.lit(""))


def regex_extract_int(s: Column | str, pattern: str) -> Column:
    """``SAFE_CAST(REGEXP_EXTRACT(...) AS INT64)``: overflow and no match give null."""
    return regex_extract(s, pattern).try_cast("bigint")


def literal_regex(text: str) -> str:
    """Quote user text (e.g. a test id) for use inside a regex."""
    return re.escape(text)


def minutes_between(later: Column | str, earlier: Column | str) -> Column:
    """Difference of two microsecond timestamps in minutes (double); null-propagating."""
    return (col_(later) - col_(earlier)) / F.lit(MICROS_PER_MINUTE)


def flag(cond: Column) -> Column:
    """``IF(cond, 1, 0)`` -- null condition counts as 0."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def array_lookup(arr: Column | str, key: str, key_field: str = "key",
                 value_path: tuple[str, ...] = ("value", "string_value"), on_duplicate: str = "first") -> Column:
    """Value of the first struct in ``arr`` whose ``key_field`` equals ``key``.

    Replaces the correlated ``(SELECT value.string_value FROM UNNEST(arr) WHERE
    key = ...)`` subquery with higher-order functions: no join, no shuffle.
    Null when there is no match. On more than one match the first is taken, or,
    with ``on_duplicate="raise"``, the query fails as the warehouse's scalar
    subquery does.
    """
    if on_duplicate not in ("first", "raise"):
        raise ValueError("on_duplicate must be 'first' or 'raise'")

    def pick(x):
        v = x
        for f in value_path:
            v = v.getField(f)
        return v

    matches = F.transform(F.filter(col_(arr), lambda x: x.getField(key_field) == F.lit(key)), pick)
    if on_duplicate == "first":
        return F.get(matches, 0)
    # one filter of the array, looked at twice
    several = F.raise_error(F.lit(f"more than one element has {key_field} {key!r}"))
    return F.get(F.transform(F.array(matches), lambda m: F.when(F.size(m) > 1, several).otherwise(F.get(m, 0))), 0)


def money_sum(c: Column | str) -> Column:
    """Exact sum of money amounts (nine decimals kept), returned as double.

    Summing as decimal makes the result independent of the order in which
    partitions are combined (double addition is not associative).
    """
    return F.sum(col_(c).cast("decimal(28,9)")).cast("double")


def money_mean(c: Column | str) -> Column:
    """Mean of 2-decimal amounts (e.g. rounded percentages) from an exact sum."""
    c = col_(c)
    return F.try_divide(F.sum(c.cast("decimal(28,9)")).cast("double"), F.count(c).cast("double"))
