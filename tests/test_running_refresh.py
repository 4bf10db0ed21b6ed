"""Running totals carried from day to day equal the window over all history."""

import pytest
from pyspark.sql import functions as F

from clickflow.operators import enrich, running
from clickflow.plans.inspect import physical_plan

S, E = "2024-01-01", "2024-01-31"


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_days_one_by_one_equal_the_whole(tables01, tmp_path):
    ev = tables01.events
    for start, end in ((S, "2024-01-01"), ("2024-01-02", "2024-01-09"), ("2024-01-10", "2024-01-10"), ("2024-01-11", E)):
        got = running.refresh_running_totals(ev, str(tmp_path), start, end)
        assert as_set(got) == as_set(enrich.running_totals(ev, S, end).select(*got.columns))


def test_late_data_reopens_days(spark, tables001, tmp_path):
    ev, path = tables001.events, str(tmp_path)
    early = ev.where("event_id % 5 != 0")
    for start, end in ((S, "2024-01-10"), ("2024-01-11", "2024-01-20"), ("2024-01-21", E)):
        running.refresh_running_totals(early, path, start, end)
    late = ev.where("event_id % 5 != 0 or event_date > date'2024-01-10'")
    with pytest.raises(ValueError, match="build on"):
        running.refresh_running_totals(late, path, "2024-01-11", "2024-01-20")
    with pytest.raises(ValueError, match="no carry"):
        running.refresh_running_totals(late, path, "2024-01-15", E)
    got = running.refresh_running_totals(late, path, "2024-01-11", E)
    assert as_set(got) == as_set(enrich.running_totals(late, S, E).select(*got.columns))
    assert [d.day for d in running.carried_days(spark, path)] == [10, 31]
    running.refresh_running_totals(late, path, "2024-02-01", "2024-02-02")  # days without purchases
    with pytest.raises(ValueError, match="no carry"):
        running.refresh_running_totals(late, path, "2024-02-04", "2024-02-05")
    with pytest.raises(ValueError):
        running.refresh_running_totals(late, path, "2024-02-04", "2024-02-03")


def test_users_without_id_or_revenue(spark):
    day = F.to_date(F.lit("2024-01-01"))
    daily = spark.createDataFrame([(None, 0, 1, 2.5), (None, 2, 1, None), ("a", 0, 2, None), ("a", 1, 1, None), ("a", 3, 1, 1.25)],
                                  "user_pseudo_id string, d int, purchases long, revenue double")
    daily = daily.select("user_pseudo_id", F.date_add(day, "d").alias("event_date"), "purchases", F.col("revenue").cast("decimal(28,9)"))
    whole, all_days = running.added_days(daily, None)
    first, carry = running.added_days(daily.where("event_date < date'2024-01-02'"), None)
    rest, after = running.added_days(daily.where("event_date >= date'2024-01-02'"), carry)
    assert as_set(first) | as_set(rest.select(*first.columns)) == as_set(whole)
    assert as_set(after) == as_set(all_days)


def test_a_refresh_reads_only_its_days(spark, tables001, tmp_path):
    """What is summed on top of the carry comes from the days added."""
    from clickflow.sources.ga4 import read_ga4_tables, write_ga4_tables

    write_ga4_tables(tables001, str(tmp_path))
    ev = read_ga4_tables(spark, str(tmp_path)).events
    plan = physical_plan(enrich.daily_purchases(ev, "2024-01-05", "2024-01-06"))
    assert "PartitionFilters: [isnotnull(event_date" in plan
