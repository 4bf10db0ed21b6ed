"""Small helpers that several operators here share."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from clickflow.plans.materialize import materialize

#: Fixed byte classes of the word definitions.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: ``bytes.translate`` tables: A-Z to a-z, and for PLAIN_WORD also every
#: separator byte to a space (bytes from 0x80 on are always word bytes).
LOWER_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
PLAIN_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, lineage cut."""
    return materialize(df)


def release(*tables: DataFrame) -> None:
    """Delete the files of tables from :func:`keep` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            if "/clickflow-materialized/" in folder:
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def id_type(df: DataFrame, col: str) -> T.DataType:
    return df.schema[col].dataType


def utf8(column) -> list:
    """The values of an Arrow string column as UTF-8 bytes (None for null)."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def slices(batches, rows: int = 512):
    """Arrow batches cut into smaller ones, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def per_process(key, make):
    """``make()`` once per Python worker process and key.

    Functions are pickled by value, so module globals start afresh in every
    task; workers are reused, and what is slow to build may stay in them.
    """
    import types

    store = sys.modules.setdefault("_corpus_worker_store", types.ModuleType("_corpus_worker_store")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]
