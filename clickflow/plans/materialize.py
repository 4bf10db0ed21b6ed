"""Materialise an intermediate result that several branches consume.

Spark re-executes a shared subtree once per consumer unless the consumers'
plans happen to be identical (exchange reuse). The reports here aggregate
one session-grain table several ways (distinct users, distinct sessions,
medians), and column pruning makes each branch's plan different, so
without help the 100 TB event scan would run once per branch.

``materialize`` writes the table once into the shared folder named by
``spark.checkpoint.dir`` and returns a DataFrame reading it back: one scan of
the events, lineage cut (a lost executor re-reads those files instead of
re-scanning the events), and files on shared storage rather than on a
machine-local disk.

Two ways to write it:

* ``"parquet"`` (default): a Parquet table. Columnar and compressed, so each
  branch reads only the columns it aggregates (the user-count branch never
  reads the timestamps the median branch needs, and vice versa).
* ``"checkpoint"``: ``DataFrame.checkpoint()`` -- serialized rows, every
  branch reads whole rows; the files are removed by Spark's cleaner when
  ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.

Parquet tables live under ``<checkpoint dir>/clickflow-materialized/<app id>/``;
``drop_materialized`` removes the folder of the current application.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from clickflow.session import ensure_checkpoint_dir

DEFAULT_HOW = "parquet"


def _app_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/clickflow-materialized/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, enabled: bool = True, how: str = DEFAULT_HOW) -> DataFrame:
    """Write ``df`` once (eagerly) to shared storage and read it back, when ``enabled``."""
    if not enabled:
        return df
    spark = df.sparkSession
    if how == "checkpoint":
        ensure_checkpoint_dir(spark)
        return df.checkpoint(eager=True)
    if how != "parquet":
        raise ValueError(f"unknown materialisation {how!r}: use 'parquet' or 'checkpoint'")
    path = f"{_app_folder(spark)}/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    # the schema is known: no footer reading to infer it
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized(spark: SparkSession) -> bool:
    """Delete this application's materialised tables (call when the reports are consumed)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_app_folder(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.delete(path, True)) if fs.exists(path) else False
