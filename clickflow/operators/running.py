"""Running totals per user over unbounded history, kept up to date day by day.

A window over all history would read all of it for every new day. A prefix
sum in two levels does not: a *carry* table holds every user's totals up to a
day, and the days added are summed on their own, on top of it. Adding days reads
their purchases and one carry, whatever the history; its size follows the number of
users, not of days.

Folder layout: ``days/event_date=...`` (one row per user and day with a
purchase) and ``carry/through=...`` (one row per user, all purchases up to that
day). Carries stay until :func:`drop_carries`, so that late data can
re-open days: the days from a re-opened one on are computed again on top of
the carry before it.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickflow.operators.enrich import daily_purchases
from clickflow.plans.materialize import materialize
from clickflow.sources.days import _path, as_date, overwrite_days, partition_days, path_exists

_MONEY = "decimal(28,9)"


def added_days(daily: DataFrame, carry: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Rows of the days in ``daily`` (user, day, purchases, revenue) on top of ``carry``, and the carry after them.

    The window meets the days added only. Both sides of the join have a user
    once or once per day added, so a hot user is a few rows; the null user is one user.
    """
    daily = daily.select("user_pseudo_id", "event_date", "purchases", F.col("revenue").cast(_MONEY).alias("revenue"))
    along = Window.partitionBy("user_pseudo_id").orderBy("event_date").rowsBetween(Window.unboundedPreceding, 0)
    rows = daily.withColumns({"cumulative_purchases": F.sum("purchases").over(along),
                              "cumulative_revenue": F.sum("revenue").over(along).cast(_MONEY)})
    sums = daily.select("user_pseudo_id", "purchases", "revenue")
    if carry is not None:
        before = carry.select(F.col("user_pseudo_id").alias("__user"), F.col("purchases").alias("__purchases"),
                              F.col("revenue").alias("__revenue"))
        joined = rows.join(before, F.col("user_pseudo_id").eqNullSafe(F.col("__user")), "left")
        # a user without revenue so far has none, not zero
        total = F.when(F.col("cumulative_revenue").isNull(), F.col("__revenue")).otherwise(
            F.col("cumulative_revenue") + F.coalesce("__revenue", F.lit(0).cast(_MONEY))).cast(_MONEY)
        rows = joined.select("user_pseudo_id", "event_date", "purchases", "revenue",
                             (F.col("cumulative_purchases") + F.coalesce("__purchases", F.lit(0))).alias("cumulative_purchases"),
                             total.alias("cumulative_revenue"))
        sums = sums.unionByName(carry.select("user_pseudo_id", "purchases", "revenue"))
    after = sums.groupBy("user_pseudo_id").agg(F.sum("purchases").alias("purchases"), F.sum("revenue").cast(_MONEY).alias("revenue"))
    return rows, after


def _carry(spark: SparkSession, path: str, through: date) -> DataFrame:
    return spark.read.schema(f"user_pseudo_id string, purchases long, revenue {_MONEY}").parquet(f"{path}/carry/through={through}")


def carried_days(spark: SparkSession, path: str) -> list[date]:
    """The days up to which there is a complete carry."""
    base = path.rstrip("/")
    return [d for d in partition_days(spark, f"{base}/carry", "through") if path_exists(spark, f"{base}/carry/through={d}/_SUCCESS")]


def refresh_running_totals(events: DataFrame, path: str, start, end) -> DataFrame:
    """Add the days from ``start`` to ``end`` to the running totals at ``path``, and return them all.

    ``start`` is the day after the last one added, or an earlier one after a carry to
    re-open days for late data; then ``end`` may not leave out days added before.
    The days are written before their carry, so a run that stopped is repeated as it was.
    """
    spark, base, start, end = events.sparkSession, path.rstrip("/"), as_date(start), as_date(end)
    if end < start:
        raise ValueError(f"no days from {start} to {end}")
    known = carried_days(spark, base)
    before = [d for d in known if d < start]
    if known and known[-1] > end:
        raise ValueError(f"days up to {known[-1]} build on {start}: add the days up to there again")
    if known and (before[-1] if before else None) != start - timedelta(days=1):
        raise ValueError(f"there is no carry of {start - timedelta(days=1)}; there are {', '.join(map(str, known))}")
    daily = materialize(daily_purchases(events, start, end))
    rows, after = added_days(daily, _carry(spark, base, before[-1]) if before else None)
    overwrite_days(rows, f"{base}/days", "event_date", start, end)
    drop_carries(spark, base, [d for d in known if d >= start])
    after.write.mode("overwrite").parquet(f"{base}/carry/through={end}")
    return read_running_totals(spark, base)


def drop_carries(spark: SparkSession, path: str, days: list[date]) -> None:
    """Delete the carries of ``days``; days up to them can then no longer be re-opened there."""
    for day in days:
        where, fs = _path(spark, f"{path.rstrip('/')}/carry/through={day}")
        fs.delete(where, True)


def read_running_totals(spark: SparkSession, path: str) -> DataFrame:
    """All days, as ``enrich.running_totals`` gives them."""
    schema = (f"user_pseudo_id string, purchases long, revenue {_MONEY}, cumulative_purchases long, cumulative_revenue {_MONEY}, "
              "event_date date")
    rows = spark.read.schema(schema).parquet(f"{path.rstrip('/')}/days")
    return rows.select("user_pseudo_id", "event_date", "purchases", F.col("revenue").cast("double").alias("revenue"),
                       "cumulative_purchases", F.col("cumulative_revenue").cast("double").alias("cumulative_revenue"))
