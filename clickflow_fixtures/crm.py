"""CRM exports.

A CRM export is a CSV with one row per day: a date, a transaction count and
revenue, under varying header names. ``clickflow.operators.reconcile``
normalises it. For the generated test data, :func:`crm_export_from_events`
derives such an export from the raw ``events`` table -- the CRM side counts
the rows whose ``event_type`` is ``purchase`` and sums their ``value`` --
with the messy headers and string cells a real export has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def crm_export_from_events(raw_events: DataFrame) -> DataFrame:
    """All-string daily export: `` Date ``, ``Note``, ``Orders``, ``Revenue``.

    Notes hold quotes, commas and line breaks; two days a month have a cell
    that is no number (``NaN`` orders on the 13th, ``1d`` revenue on the 17th).
    """
    daily = (raw_events.where(F.col("event_type") == "purchase")
             .groupBy(F.col("ts").cast("date").alias("d"))
             .agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.col("value").cast("decimal(28,9)")).alias("rev")))
    return daily.select(
        F.col("d").cast("string").alias(" Date "),
        F.concat(F.lit('called "late",\nday '), F.dayofmonth("d").cast("string")).alias("Note"),
        F.when(F.dayofmonth("d") == 13, "NaN").otherwise(F.col("n").cast("string")).alias("Orders"),
        F.when(F.dayofmonth("d") == 17, "1d").otherwise(F.col("rev").cast("string")).alias("Revenue"),
    )


def write_crm_csv(crm: DataFrame, path: str) -> str:
    """Write an export as CSV (header row); one row per day, so one file."""
    crm.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def write_untidy_crm_csv(crm: DataFrame, path: str) -> str:
    """An export as text with dates as ``15.01.2024`` and, for each day, a further row whose
    revenue has an unquoted decimal comma (one field too many)."""
    day = F.date_format(F.to_date(F.col(" Date ")), "dd.MM.yyyy")
    row = F.concat_ws(",", day, F.concat(F.lit('"'), F.lit('called ""late"", day'), F.lit('"')),
                      F.coalesce("Orders", F.lit("")), F.coalesce("Revenue", F.lit("")))
    wrong = F.concat_ws(",", day, F.lit("corrected"), F.coalesce("Orders", F.lit("")), F.lit("1"), F.lit("50"))
    lines = crm.select(day.alias("day"), F.explode(F.array(row, wrong)).alias("line"))
    header = crm.sparkSession.range(1).select(F.lit(0).alias("at"), F.lit(" Date ,Note,Orders,Revenue").alias("line"))
    # one line per day twice and the header before them: a bounded file
    (header.unionByName(lines.select(F.lit(1).alias("at"), "line")).coalesce(1).sortWithinPartitions("at", "line").select("line")
     .write.mode("overwrite").text(path))
    return path
