"""Day-partitioned tables on shared storage, through Spark's file system API."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    where, fs = _path(spark, path)
    return bool(fs.exists(where))


def partition_days(spark: SparkSession, path: str, col: str) -> list[date]:
    """The days that have a partition folder ``col=YYYY-MM-DD`` under ``path``, in order."""
    where, fs = _path(spark, path)
    if not fs.exists(where):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(where))
    return sorted(date.fromisoformat(n[len(col) + 1:]) for n in names if n.startswith(f"{col}=") and n[len(col) + 1:][:1].isdigit())


def as_date(day: date | str) -> date:
    return day if isinstance(day, date) else date.fromisoformat(day)


def overwrite_days(rows: DataFrame, path: str, col: str, start, end) -> None:
    """Replace the days from ``start`` to ``end`` of the table at ``path`` by ``rows``; days left without rows go.

    The folders of these days are deleted and then written. A run that stops
    in between is repeated with the same range.
    """
    spark = rows.sparkSession
    for day in partition_days(spark, path, col):
        if as_date(start) <= day <= as_date(end):
            where, fs = _path(spark, f"{path.rstrip('/')}/{col}={day}")
            fs.delete(where, True)
    rows.hint("rebalance", col).write.mode("append").partitionBy(col).parquet(path)
