"""Distinct users over any range of days, from day-level bitmap roll-ups.

Distinct counts do not add up over days, so a report over a new range would
read all its events again. The roll-up keeps, per day, segment and funnel
step, the *set* of users as bitmaps: users are numbered by a dictionary, a
number's high part is its bucket, its low part a bit in that bucket's bitmap
of 32,768 bits. Sets of days are united by OR and counted by popcount, so any
range is answered from the roll-up alone, exactly as from the events.

* :func:`number_users` extends the dictionary by the users it lacks. Numbers
  are given per partition, without a global sort; known users keep theirs.
* :func:`daily_user_bitmaps` makes the roll-up rows of some days.
* :func:`refresh_rollup` keeps dictionary and roll-up in a folder, recomputes
  the days given and leaves the others.
* :func:`rollup_counts` is ``funnel_counts`` over any days of a roll-up;
  :func:`active_users` counts, for every day, the distinct users of the days
  up to it.

All aggregations are partial: a hot day, segment or user is one bitmap per
task. The channel of a session is taken from the sessions as they are when a
day is (re)computed. Events without a user count for no one, but keep their
segment, as in ``funnel_counts``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickflow.operators.distinct import merge_on_keys
from clickflow.operators.funnel import DEFAULT_DIMS, FUNNEL_STEPS, base_events, in_date_range
from clickflow.plans.materialize import materialize
from clickflow.sources.days import overwrite_days, path_exists

#: Numbers a partition may give out in one extension of the dictionary.
BLOCK = 1 << 33


def number_users(events: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``user_pseudo_id`` and ``user_no`` of the users of ``events`` that ``known`` lacks."""
    users = events.select("user_pseudo_id").where("user_pseudo_id is not null").distinct()
    first = 0
    if known is not None:
        users = users.join(known, "user_pseudo_id", "left_anti")
        # from the block after the greatest number so far
        first = known.agg(F.floor(F.max("user_no") / BLOCK)).first()[0]
        first = 0 if first is None else (first + 1) * BLOCK
    return users.select("user_pseudo_id", (F.monotonically_increasing_id() + F.lit(first)).alias("user_no"))


def daily_user_bitmaps(events: DataFrame, sessions: DataFrame, dictionary: DataFrame, start, end,
                       dims=DEFAULT_DIMS, steps=FUNNEL_STEPS) -> DataFrame:
    """Per day, segment, step and bucket: the bitmap ``users``. The bucket of users unknown (null) is null."""
    dims = list(dims)
    if set(dims) - set(DEFAULT_DIMS):
        raise ValueError(f"roll-up dimensions are among {DEFAULT_DIMS}")
    # one row per user, day, segment and step before the number is looked up
    seen = base_events(events, sessions, start, end, steps).select("event_date", *dims, "event_name", "user_pseudo_id").distinct()
    numbered = seen.join(dictionary, "user_pseudo_id", "left")
    return numbered.groupBy("event_date", *dims, "event_name", F.bitmap_bucket_number("user_no").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("user_no")).alias("users"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame | None:
    folder = f"{path.rstrip('/')}/users"
    return spark.read.schema("user_pseudo_id string, user_no long").parquet(folder) if path_exists(spark, folder) else None


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/days")


def refresh_rollup(events: DataFrame, sessions: DataFrame, path: str, start, end, dims=DEFAULT_DIMS, steps=FUNNEL_STEPS) -> DataFrame:
    """Recompute the days from ``start`` to ``end`` in the roll-up at ``path`` and return the whole roll-up.

    The dictionary only grows, so a run that stopped half-way can be repeated:
    users that it had numbered keep their numbers.
    """
    spark, base = events.sparkSession, path.rstrip("/")
    names = [e for e, _ in steps]
    wanted = in_date_range(events, start, end).where(F.col("event_name").isin(names))
    number_users(wanted, read_dictionary(spark, base)).write.mode("append").parquet(f"{base}/users")
    rows = daily_user_bitmaps(events, sessions, read_dictionary(spark, base), start, end, dims, steps)
    overwrite_days(rows, f"{base}/days", "event_date", start, end)
    return read_rollup(spark, base)


def _united(rollup: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct users per ``keys``: bitmaps united per bucket, then counted."""
    return (rollup.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("users").alias("users"))
            .groupBy(*keys).agg(F.sum(F.bitmap_count("users")).alias("n")))


def rollup_counts(rollup: DataFrame, start, end, dims=DEFAULT_DIMS, steps=FUNNEL_STEPS) -> DataFrame:
    """``funnel_counts`` of the days from ``start`` to ``end``, by any of the roll-up's dimensions, without the events."""
    dims = list(dims)
    days = in_date_range(rollup, start, end).where(F.col("event_name").isin([e for e, _ in steps]))
    counted = materialize(_united(days, [*dims, "event_name"]))
    aggs = [F.coalesce(F.max(F.when(F.col("event_name") == e, F.col("n"))), F.lit(0)).cast("bigint").alias(f"users_{s}") for e, s in steps]
    return counted.groupBy(*dims).agg(*aggs) if dims else counted.agg(*aggs)


def active_users(rollup: DataFrame, start, end, days: int = 7, dims=("device_category",)) -> DataFrame:
    """Per day and segment: distinct users of the day (``users``) and of the ``days`` days up to it (``users_{days}d``).

    A day's bitmaps are handed to each of the days whose window holds it;
    segments that were seen on none of a day's window have no row for it.
    """
    dims = list(dims)
    # a day's users of any step: fewer bitmaps to hand on
    daily = materialize(in_date_range(rollup, F.lit(start).cast("date") - F.lit(days - 1), end)
                        .groupBy("event_date", *dims, "bucket").agg(F.bitmap_or_agg("users").alias("users")))
    until = F.explode(F.sequence(F.lit(0), F.lit(days - 1)))
    windows = daily.select("*", until.alias("__later")).select(
        F.date_add("event_date", F.col("__later")).alias("event_date"), *dims, "bucket", "users")
    windows = in_date_range(windows, start, end)
    # materialised per branch: a handful of numbers per day and segment
    wide = materialize(_united(windows, ["event_date", *dims]).withColumnRenamed("n", f"users_{days}d"))
    narrow = materialize(_united(in_date_range(daily, start, end), ["event_date", *dims]).withColumnRenamed("n", "users"))
    merged = merge_on_keys([narrow, wide], ["event_date", *dims])
    return merged.select("event_date", *dims, F.coalesce("users", F.lit(0)).cast("bigint").alias("users"),
                         F.col(f"users_{days}d").cast("bigint").alias(f"users_{days}d"))
