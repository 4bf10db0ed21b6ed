"""GA4 tables bucketed by a join key, so that joins and groupings on it need no shuffle.

Events and sessions dealt into the same number of buckets by ``session_id``
(or events by ``user_pseudo_id``) are read with that partitioning: Spark joins
bucket with bucket, and a grouping whose keys hold the bucket column runs in place.
The deal is paid once, when a table is written, instead of in every report.

A bucket is read by one task, and neither AQE nor a map-side aggregation can
split a key that a bucket holds whole. So :func:`write_bucketed` first looks
at the greatest share of rows that one key has and refuses a table where it is too
large; such a table is better left to the default layout, whose joins pre-aggregate and split.
The number of buckets grows with the rows, so a task sorts and reads about
``ROWS_PER_BUCKET`` of them however large the table is.
Rows without a key would all fall into one bucket: they match nothing and are
kept beside the buckets, in a table of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickflow.sources.ga4 import Ga4Tables

# Rows that one bucket holds about; whole events take some 2 KB each in memory.
ROWS_PER_BUCKET = 100_000


@dataclass(frozen=True)
class BucketedTable:
    """``rows`` have a key and are bucketed by it; ``without_key`` are the others."""

    rows: DataFrame
    without_key: DataFrame


def _key_sizes(df: DataFrame, key: str) -> tuple[int, int]:
    """Rows of the most frequent key, and rows with a key (partial aggregation)."""
    sizes = df.where(F.col(key).isNotNull()).groupBy(key).count()
    most, total = sizes.agg(F.max("count"), F.sum("count")).first()
    return most or 0, total or 0


def largest_share(df: DataFrame, key: str) -> float:
    """The greatest share of the rows with a key that one key has (0 for an empty table)."""
    most, total = _key_sizes(df, key)
    return most / total if total else 0.0


def _checked_rows(df: DataFrame, key: str, buckets: int, max_share: float) -> int:
    """The rows with a key; a table where one key has too many of them is refused."""
    most, total = _key_sizes(df, key)
    share = most / total if total else 0.0
    if share > max(max_share, 2 / buckets):
        raise ValueError(f"one {key} has {share:.0%} of the rows, which one task would read; use the default layout")
    return total


def _bucket_count(spark: SparkSession, rows: int, least: int) -> int:
    """At least ``least``, and one for every ``ROWS_PER_BUCKET`` rows up to what Spark allows."""
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    return max(least, min(most, -(-rows // ROWS_PER_BUCKET)))


def _write(df: DataFrame, name: str, path: str, key: str, buckets: int,
           shape: Callable[[DataFrame], DataFrame] | None) -> BucketedTable:
    spark, base = df.sparkSession, path.rstrip("/")
    shape = shape or (lambda rows: rows)
    # dealt by the hash that buckets use, so every task writes one bucket
    (shape(df.where(F.col(key).isNotNull()).repartition(buckets, key))
     .write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", f"{base}/{name}").saveAsTable(name))
    without = shape(df.where(F.col(key).isNull()))
    without.write.mode("overwrite").parquet(f"{base}/{name}_without_key")
    return BucketedTable(spark.table(name), spark.read.schema(without.schema).parquet(f"{base}/{name}_without_key"))


def write_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int, max_share: float = 0.05,
                   shape: Callable[[DataFrame], DataFrame] | None = None) -> BucketedTable:
    """Write ``df`` as table ``name`` under ``path``, bucketed and sorted by ``key``, one file per bucket.

    ``buckets`` is the least number; a table of more rows than ``ROWS_PER_BUCKET``
    each gets more. With ``shape``, a narrow function that leaves ``key`` as it is,
    the rows of ``df`` are dealt first and ``shape`` makes the written rows of
    them in place: what it adds is never shuffled.
    """
    rows = _checked_rows(df, key, buckets, max_share)
    return _write(df, name, path, key, _bucket_count(df.sparkSession, rows, buckets), shape)


def write_bucketed_sessions(tables: Ga4Tables, prefix: str, path: str, buckets: int, max_share: float = 0.05,
                            shape: Callable[[DataFrame], DataFrame] | None = None) -> tuple[BucketedTable, DataFrame]:
    """Events and sessions bucketed alike by ``session_id``: (events, sessions).

    Both get the number of buckets that the larger one needs. ``shape`` makes
    the events' rows after they are dealt, as in :func:`write_bucketed`.
    """
    key = "session_id"
    rows = max(_checked_rows(t, key, buckets, max_share) for t in (tables.events, tables.sessions))
    buckets = _bucket_count(tables.events.sparkSession, rows, buckets)
    events = _write(tables.events, f"{prefix}_events_by_session", path, key, buckets, shape)
    # sessions without an id match nothing
    sessions = _write(tables.sessions, f"{prefix}_sessions_by_session", path, key, buckets, None)
    return events, sessions.rows


def drop_tables(spark: SparkSession, *names: str) -> None:
    """Forget tables in the catalog (their files stay)."""
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")
