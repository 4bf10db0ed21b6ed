"""GA4-shaped tables: readers and writer.

Production layout (what the operators expect):

* ``ga4_events``       one row per event, Parquet partitioned by ``event_date``,
                        rows sorted by ``event_name, session_id`` inside files so
                        row-group min/max statistics skip data.
* ``ga4_sessions``     one row per session (``session_id`` +
                        ``last_non_direct_traffic_source.default_channel_grouping``).
* ``ga4_transactions`` one row per purchase event (``transaction_id``,
                        ``transaction_date``, ``event_name``, ``ecommerce``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Ga4Tables:
    events: DataFrame
    sessions: DataFrame
    transactions: DataFrame


def read_source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables (``{sf_dir}/{name}.parquet``)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin ``df`` over all task slots when its scan has fewer splits.

    A Parquet file is split by row group; a file written as one row group is
    read by one task, and every narrow operator after it (string
    building, regex parsing) would run single-threaded. Large inputs
    already have at least as many splits as slots, so this is a no-op there
    (the check only plans the scan, it reads no data).
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def events_write_layout(events: DataFrame, shape: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows of a day together (few files per day, AQE splits big days), each file
    clustered by ``event_name, session_id``.

    With ``shape``, a narrow function that leaves these three columns as they
    are, the rows of ``events`` are shuffled and sorted first and ``shape`` makes
    the written rows of them in place.
    """
    laid_out = (events.hint("rebalance", "event_date")
                .sortWithinPartitions("event_date", "event_name", "session_id"))
    return shape(laid_out) if shape else laid_out


def write_ga4_tables(tables: Ga4Tables, out_dir: str, mode: str = "overwrite",
                     shape: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Materialise the tables in the production layout.

    Events are partitioned by ``event_date`` (partition pruning for every
    date-range query) and clustered by ``event_name, session_id`` within each
    file (row-group statistics skip data). The ``rebalance`` hint groups rows
    of a day into the same tasks -- few files per day -- while AQE splits any
    day larger than the advisory partition size over several tasks, so a
    big or hot day is never written by a single task (a plain
    ``repartition(event_date)`` would send each whole day to one task).
    ``shape`` makes the events' rows after that shuffle and sort, as in
    :func:`events_write_layout`, so that wide rows need not pass through them.
    """
    out = out_dir.rstrip("/")
    (events_write_layout(tables.events, shape)
     .write.mode(mode).partitionBy("event_date").parquet(f"{out}/ga4_events"))
    (tables.sessions
     .hint("rebalance", "session_date")
     .write.mode(mode).partitionBy("session_date").parquet(f"{out}/ga4_sessions"))
    (tables.transactions
     .hint("rebalance", "transaction_date")
     .write.mode(mode).partitionBy("transaction_date").parquet(f"{out}/ga4_transactions"))


def read_ga4_tables(spark: SparkSession, base_dir: str) -> Ga4Tables:
    base = base_dir.rstrip("/")
    return Ga4Tables(
        events=spark.read.parquet(f"{base}/ga4_events"),
        sessions=spark.read.parquet(f"{base}/ga4_sessions"),
        transactions=spark.read.parquet(f"{base}/ga4_transactions"),
    )
