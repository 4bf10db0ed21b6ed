"""Daily reconciliation of analytics purchases against a CRM export.

Everything stays a DataFrame until the sink; only the one-row summary is
small enough to collect. The daily frames hold one row per day, so the full
outer join, the sort and the single-file CSV sink work on a bounded input.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickflow.functions.exprs import money_mean, money_sum
from clickflow.operators.funnel import in_date_range
from clickflow.plans.materialize import materialize

# ---------------------------------------------------------------------------
# Accepted CRM header aliases (first match wins) and the
# deviation threshold in percent.
# ---------------------------------------------------------------------------
DATE_ALIASES = ["date", "data", "transaction_date", "order_date"]
TRANSACTION_ALIASES = ["transactions", "orders", "count"]
REVENUE_ALIASES = ["revenue", "total", "amount", "value"]
DEVIATION_THRESHOLD_PCT = 10
# Date notations, the first that fits a whole column wins: name, pattern, order of year, month and day in it.
# Any may be followed by a time of day.
DATE_NOTATIONS = [
    ("yyyy-MM-dd", r"([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})", (1, 2, 3)),
    ("yyyy/MM/dd", r"([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})", (1, 2, 3)),
    ("yyyy.MM.dd", r"([0-9]{4})\.([0-9]{1,2})\.([0-9]{1,2})", (1, 2, 3)),
    ("yyyyMMdd", r"([0-9]{4})([0-9]{2})([0-9]{2})", (1, 2, 3)),
    ("MM/dd/yyyy", r"([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})", (3, 1, 2)),
    ("dd/MM/yyyy", r"([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})", (3, 2, 1)),
    ("dd.MM.yyyy", r"([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4})", (3, 2, 1)),
    ("MM-dd-yyyy", r"([0-9]{1,2})-([0-9]{1,2})-([0-9]{4})", (3, 1, 2)),
    ("dd-MM-yyyy", r"([0-9]{1,2})-([0-9]{1,2})-([0-9]{4})", (3, 2, 1)),
]
TIME_OF_DAY = r"(?:[ T][0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:[.,][0-9]+)?)?(?: ?[AaPp][Mm])?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?"
# ---------------------------------------------------------------------------


def default_date_range(today: date | None = None) -> tuple[date, date]:
    """The last 31 full days: (today - 31, today - 1)."""
    today = today or date.today()
    return today - timedelta(days=31), today - timedelta(days=1)


def ga4_daily(transactions: DataFrame, start, end) -> DataFrame:
    """Per day distinct purchase transactions and summed revenue, in date order."""
    return daily_totals(transactions, start, end).orderBy("date")


def daily_totals(transactions: DataFrame, start, end) -> DataFrame:
    """``ga4_daily`` in no order."""
    tx = in_date_range(transactions, start, end, "transaction_date").where(F.col("event_name") == "purchase")
    return (tx.groupBy(F.col("transaction_date").alias("date"))
            .agg(F.count_distinct("transaction_id").alias("ga4_transactions"),
                 money_sum("ecommerce.purchase_revenue").alias("ga4_revenue")))


def _first_present(columns: list[str], aliases: list[str]) -> str | None:
    return next((a for a in aliases if a in columns), None)


def _cell(name: str) -> Column:
    """A cell without surrounding space; empty is null."""
    return F.nullif(F.trim(F.col(name).cast("string")), F.lit(""))


def parsed_date(cell: Column, notation: str) -> Column:
    """The date of a cell in one of ``DATE_NOTATIONS``, null where it is none.

    Digits are taken by pattern and put in ISO order, so neither ANSI mode nor
    the time parser policy makes a difference.
    """
    pattern, order = next((p, o) for n, p, o in DATE_NOTATIONS if n == notation)
    whole = f"^{pattern}{TIME_OF_DAY}$"
    year, month, day = (F.regexp_extract(cell, whole, g) for g in order)
    iso = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(cell.rlike(whole), iso.try_cast("date"))


def date_votes(df: DataFrame, col: str) -> DataFrame:
    """One row: ``cells`` that are not empty, and per notation of ``DATE_NOTATIONS`` how many of them it reads."""
    cell = _cell(col)
    return df.agg(F.count(cell).alias("cells"), *[F.count(parsed_date(cell, n)).alias(n) for n, _, _ in DATE_NOTATIONS])


def infer_date_notation(df: DataFrame, col: str) -> str:
    """The first notation that reads every cell of the column.

    One aggregation in which every cell votes. Where the day and month could
    change places in every cell, the month comes first. When no notation reads
    all cells that is an error, which tells how far the best one came.
    """
    votes = date_votes(df, col).first().asDict()
    cells = votes.pop("cells")
    for name, n in votes.items():
        if n == cells:
            return name
    best = max(votes, key=votes.get)
    if votes[best]:
        raise ValueError(f"column {col!r} has no one date notation: {best} reads {votes[best]} of {cells} cells")
    raise ValueError(f"column {col!r} holds no dates in a known notation; name its format in date_format")


def _strict(cell: Column, parsed: Column, col: str) -> Column:
    """``parsed``; a cell without a date is an error in ANSI mode or not."""
    bad = cell.isNotNull() & parsed.isNull()
    return F.when(bad, F.raise_error(F.concat(F.lit(f"not a date in column {col!r}: "), cell)).cast("date")).otherwise(parsed)


def normalize_crm(raw: DataFrame, date_format: str | None = None) -> DataFrame:
    """S5..S7 on an all-string CRM frame.

    Headers are lower-cased and stripped; the date column is the first of
    ``DATE_ALIASES`` (error when none); dates parse strictly, whatever the ANSI
    setting (a bad date fails the job), and a time of day is dropped; empty
    cells are null; metrics are the first of their aliases, unparseable values
    become null, and a missing metric leaves its column out.

    The date notation is inferred from the whole column
    (:func:`infer_date_notation`, one small aggregation over the export) unless
    ``date_format`` names it: one of ``DATE_NOTATIONS`` or any Spark datetime pattern.
    """
    names = [c.lower().strip() for c in raw.columns]
    if len(set(names)) != len(names):
        raise ValueError(f"CRM headers collide after normalisation: {names}")
    df = raw.toDF(*names)
    date_col = _first_present(names, DATE_ALIASES)
    if date_col is None:
        raise ValueError(f"no date column in CRM export; available: {names}")
    cell = _cell(date_col)
    if df.schema[date_col].dataType.typeName() != "string":
        parsed = F.col(date_col).cast("date")
    elif date_format and date_format not in [n for n, _, _ in DATE_NOTATIONS]:
        parsed = F.to_date(F.try_to_timestamp(cell, F.lit(date_format)))
    else:
        parsed = parsed_date(cell, date_format or infer_date_notation(df, date_col))
    cols = [_strict(cell, parsed, date_col).alias("date")]
    trans_col = _first_present(names, TRANSACTION_ALIASES)
    rev_col = _first_present(names, REVENUE_ALIASES)
    if trans_col:
        cols.append(_number(trans_col).alias("crm_transactions"))
    if rev_col:
        cols.append(_number(rev_col).alias("crm_revenue"))
    return df.select(*cols)


def _number(name: str):
    """A CRM cell as a number, or null: plain decimal notation only (no ``NaN``, no ``1d``)."""
    cell = F.trim(F.col(name).cast("string"))
    return F.when(cell.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), cell.try_cast("double"))


def _csv(reader):
    return reader.option("header", True).option("inferSchema", False).option("escape", '"').option("multiLine", True)


def read_csv_checked(spark: SparkSession, path: str, malformed: str = "fail") -> DataFrame:
    """A CSV export (header row, every column as string) whose rows are checked for their number of fields.

    A row with more fields than the header has lost its alignment (a comma in
    a number, an unquoted note), so its cells cannot be trusted. ``malformed``
    says what to do: ``"fail"`` the job, showing the row, or ``"skip"`` such
    rows, which :func:`malformed_rows` reports. A row with fewer fields keeps
    those it has; the others are null.
    """
    if malformed not in ("fail", "skip"):
        raise ValueError("malformed must be 'fail' or 'skip'")
    rows, names, record = _with_record(spark, path)
    # Spark refuses plans that read the raw text alone, as a count would: nothing of a parsed column is put to it
    text = F.concat(F.col(record), F.left(F.coalesce(F.col(names[0]), F.lit("")), F.lit(0)))
    too_many = _n_fields(text) > len(names)
    if malformed == "fail":
        shown = F.concat(F.lit(f"a row has more than the header's {len(names)} fields: "), F.left(F.col(record), F.lit(200)))
        kept = rows.where(F.when(too_many, F.raise_error(shown).cast("boolean")).otherwise(F.lit(True)))
    else:
        kept = rows.where(F.coalesce(~too_many, F.lit(True)))
    return kept.select(*names)


def malformed_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows with more fields than the header: ``record`` (the raw text), ``fields`` and ``cells`` (as they were shifted)."""
    rows, names, record = _with_record(spark, path)
    fields = _n_fields(F.col(record))
    # written: Spark reads raw text only together with the parsed columns
    return materialize(rows.where(fields > len(names)).select(
        F.col(record).alias("record"), fields.alias("fields"), F.array(*names).alias("cells")))


def _with_record(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], str]:
    """The rows, the names (quoted where need be) and the column that holds the raw text of rows that do not fit the header."""
    header = _csv(spark.read).csv(path).columns
    record = "__record"
    while record in header:
        record += "_"
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, record]])
    rows = _csv(spark.read.schema(schema)).option("columnNameOfCorruptRecord", record).option("enforceSchema", False).csv(path)
    return rows, [f"`{c.replace('`', '``')}`" for c in header], record


def _n_fields(record: Column) -> Column:
    """Number of fields of a raw CSV row (null stays null): commas outside quotes, and one."""
    plain = F.regexp_replace(record, r'"(?:[^"]|"")*+"', "")
    return F.length(plain) - F.length(F.replace(plain, F.lit(","), F.lit(""))) + 1


def load_crm(spark, path: str, date_format: str | None = None, malformed: str = "fail") -> DataFrame:
    """Read a CRM CSV export; rows of too many fields fail or are skipped (:func:`read_csv_checked`)."""
    return normalize_crm(read_csv_checked(spark, path, malformed), date_format)


def _pct(a, b):
    return F.bround(F.try_divide(a - b, b) * F.lit(100.0), 2)


def _flag(pct_col, a, b, threshold):
    # x/0 with x != 0 is an infinite deviation (flagged); 0/0 is undefined (not).
    return F.coalesce(
        F.when(b == 0, (a - b) != 0).otherwise(F.abs(pct_col) > F.lit(threshold)),
        F.lit(False),
    )


def reconcile(ga4: DataFrame, crm: DataFrame, threshold: float = DEVIATION_THRESHOLD_PCT) -> DataFrame:
    """Full outer join on date (null dates match each other) + deviations.

    Differences are analytics minus CRM, percentages relative to CRM,
    rounded half-even to 2 decimals; a day is flagged when the rounded
    deviation exceeds the threshold strictly. Days missing on one side keep
    nulls and are not flagged.
    """
    g = ga4.alias("g")
    c = crm.alias("c")
    joined = g.join(c, F.col("g.date").eqNullSafe(F.col("c.date")), "full_outer")
    cols = [F.coalesce(F.col("g.date"), F.col("c.date")).alias("date"),
            F.col("g.ga4_transactions").alias("ga4_transactions"),
            F.col("g.ga4_revenue").alias("ga4_revenue")]
    has_t = "crm_transactions" in crm.columns
    has_r = "crm_revenue" in crm.columns
    if has_t:
        cols.append(F.col("c.crm_transactions").alias("crm_transactions"))
    if has_r:
        cols.append(F.col("c.crm_revenue").alias("crm_revenue"))
    out = joined.select(*cols)
    if has_t:
        gt, ct = F.col("ga4_transactions").cast("double"), F.col("crm_transactions")
        out = out.withColumns({
            "trans_diff": gt - ct,
            "trans_diff_pct": _pct(gt, ct),
        }).withColumn("trans_flag", _flag(F.col("trans_diff_pct"), gt, ct, threshold))
    if has_r:
        gr, cr = F.col("ga4_revenue"), F.col("crm_revenue")
        out = out.withColumns({
            "rev_diff": F.bround(gr - cr, 2),
            "rev_diff_pct": _pct(gr, cr),
        }).withColumn("rev_flag", _flag(F.col("rev_diff_pct"), gr, cr, threshold))
    return out.orderBy(F.asc_nulls_last("date"))


def reconcile_summary(rec: DataFrame) -> DataFrame:
    """One-row report totals (period, days, totals, mean deviation, flagged days).

    Totals of an all-null column are 0 (as pandas sums); means skip nulls.
    """
    aggs = [F.min("date").alias("period_start"), F.max("date").alias("period_end"),
            F.count(F.lit(1)).alias("days")]
    if "trans_diff_pct" in rec.columns:
        aggs += [
            F.coalesce(F.sum("ga4_transactions"), F.lit(0)).cast("double").alias("ga4_transactions_total"),
            F.coalesce(F.sum("crm_transactions"), F.lit(0.0)).alias("crm_transactions_total"),
            money_mean("trans_diff_pct").alias("trans_avg_diff_pct"),
            F.count_if(F.col("trans_flag")).alias("trans_flagged_days"),
        ]
    if "rev_diff_pct" in rec.columns:
        aggs += [
            F.coalesce(money_sum("ga4_revenue"), F.lit(0.0)).alias("ga4_revenue_total"),
            F.coalesce(money_sum("crm_revenue"), F.lit(0.0)).alias("crm_revenue_total"),
            money_mean("rev_diff_pct").alias("rev_avg_diff_pct"),
            F.count_if(F.col("rev_flag")).alias("rev_flagged_days"),
        ]
    return rec.agg(*aggs)


def flagged_days(rec: DataFrame, kind: str = "trans") -> DataFrame:
    """The days flagged for transactions (``kind='trans'``) or revenue (``'rev'``)."""
    if kind == "trans":
        cols = ["date", "ga4_transactions", "crm_transactions", "trans_diff_pct"]
    elif kind == "rev":
        cols = ["date", "ga4_revenue", "crm_revenue", "rev_diff_pct"]
    else:
        raise ValueError("kind must be 'trans' or 'rev'")
    return rec.where(F.col(f"{kind}_flag")).select(*cols).orderBy(F.asc_nulls_last("date"))


def report_path(out_dir: str, start, end) -> str:
    return f"{out_dir.rstrip('/')}/ga4_vs_crm_{start}_{end}.csv"


def write_report_csv(rec: DataFrame, path: str) -> str:
    """Write the daily comparison as one CSV file with a header, no index.

    Spark writes a directory named ``path`` holding one part file. One row
    per day keeps the single-partition write cheap.
    """
    rec.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def reconcile_job(spark, transactions: DataFrame, crm_path: str, start=None, end=None,
                  out_dir: str | None = None, output: str | None = None,
                  threshold: float = DEVIATION_THRESHOLD_PCT, today: date | None = None,
                  date_format: str | None = None, malformed: str = "fail") -> dict:
    """The whole analytics-vs-CRM run in one call.

    Dates default to the last 31 full days (each side on its own); the CRM
    CSV is loaded and normalised; the daily analytics roll-up is compared;
    the comparison is written as CSV to ``output`` or to
    ``{out_dir}/ga4_vs_crm_{start}_{end}.csv`` when ``out_dir`` is given.
    Returns the comparison, the one-row summary and the flagged days as
    DataFrames (the caller decides what to show or collect).
    """
    d_start, d_end = default_date_range(today)
    start = start or d_start
    end = end or d_end
    rec = reconcile(ga4_daily(transactions, start, end), load_crm(spark, crm_path, date_format, malformed), threshold)
    path = output or (report_path(out_dir, start, end) if out_dir else None)
    if path:
        write_report_csv(rec, path)
    out = {"comparison": rec, "summary": reconcile_summary(rec), "path": path}
    if "trans_flag" in rec.columns:
        out["flagged_transactions"] = flagged_days(rec, "trans")
    if "rev_flag" in rec.columns:
        out["flagged_revenue"] = flagged_days(rec, "rev")
    return out
