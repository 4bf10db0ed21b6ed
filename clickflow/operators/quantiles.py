"""Exact quantiles per group by distributed rank selection.

``percentile_approx`` is exact only while a group has fewer values than its
accuracy. Here the value of a given rank is found by narrowing an interval
instead: per group and value column

1. one aggregation gives the number of values, the least and the greatest;
2. a pass cuts the interval between them into bins, counts the values of each
   bin (with their least and greatest), and keeps the bin that holds the rank;
3. the next pass looks at that bin's values only, until its least and greatest
   are equal: that is the quantile.

Least and greatest always fall into different bins, so every pass narrows; with
1,024 bins a few passes do (at most six for 64-bit integers). What is shuffled
is one row per group, column and bin, aggregated map-side, never the values;
nothing is collected. All columns of all groups narrow in the same pass, and
the values are written once as a narrow table that the passes read.

The result is the lower quantile (``quantile_disc``): the least value that at
least ``q`` of the group's values do not exceed. Null values count for nothing;
a group without values gets null; null group keys are one group. Values must
be finite numbers; the difference of two integers must fit 64 bits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickflow.plans.materialize import materialize

BINS = 1024


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null keys included; without keys, ``right`` is one row."""
    right = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] or [F.lit(True)]
    return left.join(right, reduce(lambda a, b: a & b, same), how).drop(*(f"__{k}" for k in keys))


def exact_quantiles(df: DataFrame, keys: list[str], values: dict[str, Column], q: float = 0.5, bins: int = BINS) -> DataFrame:
    """One row per group of ``keys`` with the exact lower ``q``-quantile of each of ``values`` (name -> expression)."""
    if not 0 <= q <= 1:
        raise ValueError(f"q must be between 0 and 1, not {q}")
    if bins < 2:
        raise ValueError("at least two bins are needed")
    keys, at = list(keys), range(len(values))
    rows = materialize(df.select(*keys, *[c.alias(f"v{i}") for i, c in enumerate(values.values())]))
    first = [x for i in at for x in (
        F.min(f"v{i}").alias(f"lo{i}"), F.max(f"v{i}").alias(f"hi{i}"),
        F.greatest(F.lit(1), F.ceil(F.count(f"v{i}") * F.lit(q))).alias(f"rank{i}"))]
    state = materialize(rows.groupBy(*keys).agg(*first) if keys else rows.agg(*first))
    unresolved = reduce(lambda a, b: a | b, (F.col(f"lo{i}") < F.col(f"hi{i}") for i in at))
    while state.where(unresolved).limit(1).count():
        state = materialize(_narrowed(rows, state, keys, at, unresolved, bins))
    return state.select(*keys, *[F.col(f"lo{i}").alias(name) for i, name in enumerate(values)])


def _narrowed(rows: DataFrame, state: DataFrame, keys: list[str], at: range, unresolved: Column, bins: int) -> DataFrame:
    """``state`` after one pass."""
    # one row per group, written, so Spark sees its size when it chooses the join
    near = _joined(rows, state.where(unresolved), keys)
    # columns of one type keep it; mixed ones meet as doubles
    kinds = {rows.schema[f"v{i}"].dataType for i in at}
    kind = kinds.pop() if len(kinds) == 1 else "double"
    held = []
    for i in at:
        v, lo, hi = F.col(f"v{i}"), F.col(f"lo{i}"), F.col(f"hi{i}")
        place = F.floor((v - lo).cast("double") / (hi - lo).cast("double") * F.lit(bins))
        held.append(F.when((lo < hi) & v.between(lo, hi), F.struct(
            F.lit(i).alias("i"), F.least(place, F.lit(bins - 1)).alias("bin"), v.cast(kind).alias("v"),
            F.col(f"rank{i}").alias("rank"))))
    counted = (near.select(*keys, F.explode(F.array_compact(F.array(*held))).alias("e")).select(*keys, "e.*")
               .groupBy(*keys, "i", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"),
                                               F.max("rank").alias("rank")))
    # at most ``bins`` rows per group and column
    along = Window.partitionBy(*keys, "i").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    chosen = (counted.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0)))
              .where((F.col("before") < F.col("rank")) & (F.col("before") + F.col("n") >= F.col("rank"))))
    new = [x for i in at for x in (
        F.max(F.when(F.col("i") == i, F.col("lo"))).alias(f"new_lo{i}"), F.max(F.when(F.col("i") == i, F.col("hi"))).alias(f"new_hi{i}"),
        F.max(F.when(F.col("i") == i, F.col("rank") - F.col("before"))).alias(f"new_rank{i}"))]
    found = chosen.groupBy(*keys).agg(*new) if keys else chosen.agg(*new)
    merged = _joined(state, found, keys, "left")
    return merged.select(*keys, *[F.coalesce(F.col(f"new_{c}{i}").cast(state.schema[f"{c}{i}"].dataType), F.col(f"{c}{i}")).alias(f"{c}{i}")
                                  for i in at for c in ("lo", "hi", "rank")])
