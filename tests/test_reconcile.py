"""Reconciliation: CRM loading rules and the golden comparison (FIXTURES.md section 5)."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from clickflow.operators import reconcile as rc

CRM_CSV = """ Data ,Orders,Revenue
2024-01-01,10,1000.00
2024-01-02,8,n/a
2024-01-03,0,0
2024-01-05,4,400
"""


def _csv(text):
    d = tempfile.mkdtemp(prefix="clickflow-crm-")
    p = os.path.join(d, "crm.csv")
    with open(p, "w") as f:
        f.write(text)
    return p


def _ga4(spark):
    return spark.createDataFrame(
        [("2024-01-01", 11, 950.0), ("2024-01-02", 6, 500.0), ("2024-01-03", 5, 100.0), ("2024-01-04", 7, 70.0)],
        "date string, ga4_transactions long, ga4_revenue double",
    ).withColumn("date", F.col("date").cast("date"))


def test_golden_reconciliation(spark):
    crm = rc.load_crm(spark, _csv(CRM_CSV))
    assert crm.columns == ["date", "crm_transactions", "crm_revenue"]
    rec = rc.reconcile(_ga4(spark), crm).collect()
    got = [(r["date"].isoformat(), r["ga4_transactions"], r["ga4_revenue"], r["crm_transactions"], r["crm_revenue"],
            r["trans_diff"], r["trans_diff_pct"], r["trans_flag"], r["rev_diff"], r["rev_diff_pct"], r["rev_flag"])
           for r in rec]
    assert got == [
        ("2024-01-01", 11, 950.0, 10.0, 1000.0, 1.0, 10.0, False, -50.0, -5.0, False),
        ("2024-01-02", 6, 500.0, 8.0, None, -2.0, -25.0, True, None, None, False),
        ("2024-01-03", 5, 100.0, 0.0, 0.0, 5.0, None, True, 100.0, None, True),
        ("2024-01-04", 7, 70.0, None, None, None, None, False, None, None, False),
        ("2024-01-05", None, None, 4.0, 400.0, None, None, False, None, None, False),
    ]


def test_summary_and_flagged_days(spark):
    rec = rc.reconcile(_ga4(spark), rc.load_crm(spark, _csv(CRM_CSV)))
    s = rc.reconcile_summary(rec).first()
    assert s["period_start"] == dt.date(2024, 1, 1) and s["period_end"] == dt.date(2024, 1, 5)
    assert s["days"] == 5
    assert s["ga4_transactions_total"] == 29 and s["crm_transactions_total"] == 22
    assert s["trans_avg_diff_pct"] == pytest.approx((10.0 - 25.0) / 2)
    assert s["trans_flagged_days"] == 2 and s["rev_flagged_days"] == 1
    flagged = [r["date"].isoformat() for r in rc.flagged_days(rec).collect()]
    assert flagged == ["2024-01-02", "2024-01-03"]


def test_missing_date_column_errors(spark):
    with pytest.raises(ValueError, match="no date column"):
        rc.load_crm(spark, _csv("day,orders\n2024-01-01,1\n"))


def test_date_only_file_drops_both_blocks(spark):
    crm = rc.load_crm(spark, _csv("Order_Date\n2024-01-01\n"))
    rec = rc.reconcile(_ga4(spark), crm)
    assert "trans_diff" not in rec.columns and "rev_diff" not in rec.columns
    assert rec.count() == 4


def test_duplicate_crm_date_repeats_ga4_row(spark):
    crm = rc.load_crm(spark, _csv("date,transactions\n2024-01-01,5\n2024-01-01,6\n"))
    rec = rc.reconcile(_ga4(spark), crm).where(F.col("date") == "2024-01-01")
    assert rec.count() == 2


def test_null_dates_match_each_other(spark):
    ga4 = spark.createDataFrame([(None, 1, 1.0)], "date date, ga4_transactions long, ga4_revenue double")
    crm = spark.createDataFrame([(None, 1.0, 1.0)], "date date, crm_transactions double, crm_revenue double")
    assert rc.reconcile(ga4, crm).count() == 1


def test_time_of_day_truncated(spark):
    crm = rc.load_crm(spark, _csv("date,transactions\n2024-01-01 10:30:00,5\n"))
    assert crm.first()["date"] == dt.date(2024, 1, 1)


def test_default_date_range():
    assert rc.default_date_range(dt.date(2024, 3, 1)) == (dt.date(2024, 1, 30), dt.date(2024, 2, 29))


def test_csv_sink_roundtrip(spark):
    rec = rc.reconcile(_ga4(spark), rc.load_crm(spark, _csv(CRM_CSV)))
    out = rc.write_report_csv(rec, rc.report_path(tempfile.mkdtemp(prefix="clickflow-out-"), "2024-01-01", "2024-01-05"))
    assert out.endswith("ga4_vs_crm_2024-01-01_2024-01-05.csv")
    back = spark.read.option("header", True).csv(out)
    assert back.columns == rec.columns and back.count() == 5
    assert [r["date"] for r in back.collect()] == ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04", "2024-01-05"]


def test_ga4_daily_counts_distinct_transactions(tables01):
    daily = rc.ga4_daily(tables01.transactions, "2024-01-01", "2024-01-31")
    tx = tables01.transactions
    assert daily.agg(F.sum("ga4_transactions")).first()[0] <= tx.count()
    assert daily.count() == 30


def test_reconcile_job_end_to_end(spark):
    tx = spark.createDataFrame(
        [("T1", "2024-01-01", "purchase", 100.0), ("T1", "2024-01-01", "purchase", 50.0),
         ("T2", "2024-01-02", "purchase", 10.0), ("T3", "2024-01-02", "refund", 99.0)],
        "transaction_id string, d string, event_name string, r double",
    ).select("transaction_id", F.col("d").cast("date").alias("transaction_date"), "event_name",
             F.struct(F.col("r").alias("purchase_revenue")).alias("ecommerce"))
    crm = _csv("date,transactions,revenue\n2024-01-01,1,150\n2024-01-02,2,10\n")
    out_dir = tempfile.mkdtemp(prefix="clickflow-job-")
    res = rc.reconcile_job(spark, tx, crm, out_dir=out_dir, today=dt.date(2024, 1, 3))
    assert res["path"] == f"{out_dir}/ga4_vs_crm_2023-12-03_2024-01-02.csv"
    rows = {r["date"].isoformat(): r for r in res["comparison"].collect()}
    assert rows["2024-01-01"]["ga4_transactions"] == 1 and rows["2024-01-01"]["ga4_revenue"] == 150.0
    assert rows["2024-01-02"]["ga4_transactions"] == 1 and rows["2024-01-02"]["trans_diff_pct"] == -50.0
    assert [r["date"].isoformat() for r in res["flagged_transactions"].collect()] == ["2024-01-02"]
    assert res["summary"].first()["days"] == 2
    assert spark.read.option("header", True).csv(res["path"]).count() == 2


def test_local_date_format(spark):
    crm = rc.load_crm(spark, _csv("Data,Orders\n05.01.2024,3\n"), date_format="dd.MM.yyyy")
    assert crm.first()["date"] == dt.date(2024, 1, 5)


def test_bad_date_fails(spark):
    with pytest.raises(Exception):
        rc.load_crm(spark, _csv("date,orders\nnot-a-date,3\n")).collect()
