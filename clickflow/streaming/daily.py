"""Incremental refresh of the daily purchase roll-up (U21) with Structured Streaming.

The events / transactions tables are incremental: new files land for recent
days, and late data can re-open a day. The daily roll-up counts *distinct*
transactions, which a streaming aggregation cannot update from new rows
alone (a transaction id may already have been counted). So each
micro-batch only tells us *which days* changed; those days are recomputed
exactly from the table (partition-pruned reads) and their output
partitions overwritten (dynamic partition overwrite). Re-running a batch
gives the same output, and the stream checkpoint makes the source
exactly-once, so the job survives restarts and lost executors.

The per-batch list of touched days is bounded by the calendar (days per
batch), not by data volume, so collecting it to the driver is safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clickflow.operators.reconcile import daily_totals


def refresh_days(transactions: DataFrame, days: list, out_path: str) -> None:
    """Recompute the roll-up for ``days`` and overwrite just those day partitions.

    A dynamic overwrite leaves partitions alone that get no row, so the
    partition of a day without purchases is deleted.
    """
    if not days:
        return
    touched = transactions.where(F.col("transaction_date").isin(days))
    daily = daily_totals(touched, min(days), max(days))
    (daily.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("date").parquet(out_path))
    bought = {r[0] for r in touched.where("event_name = 'purchase'").select("transaction_date").distinct().collect()}
    spark = transactions.sparkSession
    for day in set(days) - bought:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out_path.rstrip('/')}/date={day}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def start_daily_refresh(spark: SparkSession, transactions_path: str, out_path: str,
                        checkpoint_location: str, available_now: bool = True,
                        processing_time: str | None = None) -> StreamingQuery:
    """Watch ``transactions_path`` (Parquet, partitioned by ``transaction_date``)
    and keep ``out_path`` equal to ``ga4_daily`` over the whole table.

    ``available_now=True`` processes what has arrived and stops (scheduled
    incremental runs); otherwise it triggers every ``processing_time``.
    """
    schema = spark.read.parquet(transactions_path).schema
    stream = spark.readStream.schema(schema).parquet(transactions_path)

    def on_batch(batch: DataFrame, epoch_id: int) -> None:
        days = [r[0] for r in batch.select("transaction_date").distinct().collect()]
        refresh_days(spark.read.parquet(transactions_path), [d for d in days if d is not None], out_path)

    writer = (stream.select("transaction_date").writeStream
              .foreachBatch(on_batch)
              .option("checkpointLocation", checkpoint_location))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
