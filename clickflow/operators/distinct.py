"""Exact (conditional) distinct counts without Catalyst's ``Expand``.

``COUNT(DISTINCT IF(cond, id, NULL))`` repeated for several conditions makes
Spark duplicate every input row once per distinct expression (``Expand``),
then shuffle all copies. Here each id column gets one two-level aggregation
instead: ``groupBy(keys + [id])`` with ``max(flag)`` per condition (partial,
map-side), then ``groupBy(keys)`` with ``sum``. A hot key only meets one row
per map task after the partial aggregation.

Additive aggregates (sums) can ride along in a branch: they are summed at
both levels.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class DistinctBranch:
    """Distinct counts of one id column under several conditions.

    ``counts`` maps output name -> condition (``None`` = plain
    ``COUNT(DISTINCT id)``). ``sums`` maps output name -> additive column.
    """

    id_col: str
    counts: dict[str, Column | None]
    sums: dict[str, Column] = field(default_factory=dict)
    sum_types: dict[str, str] = field(default_factory=dict)


def _branch(df: DataFrame, keys: list[str], br: DistinctBranch) -> DataFrame:
    idc = F.col(br.id_col)
    first = [
        (F.max(F.when(cond, F.lit(1)).otherwise(F.lit(0))) if cond is not None else F.lit(1))
        .alias(f"__f_{name}")
        for name, cond in br.counts.items()
    ]
    first += [F.sum(c).alias(f"__s_{name}") for name, c in br.sums.items()]
    lvl1 = df.groupBy(*keys, br.id_col).agg(*first) if first else df.select(*keys, br.id_col).distinct()
    second = [
        F.sum(F.when(idc.isNotNull(), F.col(f"__f_{name}")).otherwise(F.lit(0))).cast("bigint").alias(name)
        for name in br.counts
    ]
    for name in br.sums:
        s = F.sum(F.col(f"__s_{name}"))
        if name in br.sum_types:
            s = s.cast(br.sum_types[name])
        second.append(s.alias(name))
    return lvl1.groupBy(*keys).agg(*second)


def merge_on_keys(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Merge per-group results that share ``keys`` into one row per group.

    Each frame holds one row per group and its own columns; a union plus a
    ``groupBy(keys)`` lines them up. Grouping treats null keys as equal (like
    ``GROUP BY``), so a null segment stays one segment. Inputs are already
    at group grain, so this shuffle is tiny.
    """
    if len(frames) == 1:
        return frames[0]
    cols: list[str] = []
    for f in frames:
        cols += [c for c in f.columns if c not in keys and c not in cols]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    aggs = [F.max(c).alias(c) for c in cols]
    return merged.groupBy(*keys).agg(*aggs) if keys else merged.agg(*aggs)


def distinct_counts(df: DataFrame, keys: list[str], branches: list[DistinctBranch]) -> DataFrame:
    """One row per ``keys`` group with every requested count and sum."""
    return merge_on_keys([_branch(df, keys, br) for br in branches], keys)
