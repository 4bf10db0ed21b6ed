"""Bitmap roll-ups answer any range as the events do."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from clickflow.operators import funnel, rollups
from clickflow.plans.inspect import scan_count

S, E = "2024-01-01", "2024-01-31"


@pytest.fixture(scope="module")
def rollup(spark, tables001, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rollup"))
    t = tables001
    # days come out of order, and some twice
    for start, end in (("2024-01-11", "2024-01-20"), (S, "2024-01-12"), ("2024-01-20", E)):
        out = rollups.refresh_rollup(t.events, t.sessions, path, start, end)
    return out, path


def as_set(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("start,end", [(S, E), ("2024-01-03", "2024-01-03"), ("2024-01-07", "2024-01-25"), ("2025-01-01", "2025-02-01")])
@pytest.mark.parametrize("dims", [funnel.DEFAULT_DIMS, ("device_category",), ()])
def test_any_range_equals_the_events(tables001, rollup, start, end, dims):
    t = tables001
    pivot = funnel.funnel_pivot(t.events, t.sessions, start, end, dims=funnel.DEFAULT_DIMS)
    want = as_set(funnel.funnel_counts(pivot, list(dims))) - ({(0,) * 8} if not dims else set())
    got = rollups.rollup_counts(rollup[0], start, end, dims)
    assert as_set(got) - ({(0,) * 8, (None,) * 8} if not dims else set()) == {r for r in want if any(x is not None for x in r)}
    assert scan_count(got, "events.parquet") == 0


def test_numbers_are_kept_and_given_once(spark, tables001, rollup):
    users = rollups.read_dictionary(spark, rollup[1])
    assert users.count() == users.select("user_pseudo_id").distinct().count() == users.select("user_no").distinct().count()
    before = as_set(users)
    t = tables001
    rollups.refresh_rollup(t.events, t.sessions, rollup[1], "2024-01-05", "2024-01-06")
    assert as_set(rollups.read_dictionary(spark, rollup[1])) == before


def test_a_day_that_lost_its_events_goes(spark, tables001, tmp_path):
    t = tables001
    rollups.refresh_rollup(t.events, t.sessions, str(tmp_path), "2024-01-02", "2024-01-04")
    gone = t.events.where("event_date != date'2024-01-03'")
    left = rollups.refresh_rollup(gone, t.sessions, str(tmp_path), "2024-01-03", "2024-01-04")
    assert {r[0].day for r in left.select("event_date").distinct().collect()} == {2, 4}


def test_users_without_number_keep_their_segment(spark):
    rnd = random.Random(1)
    days = [dt.date(2024, 1, d) for d in range(1, 12)]
    rows = [(rnd.choice(days), rnd.choice(["x", None]), rnd.choice(["s", "t"]), rnd.choice([None, *map(str, range(9))])) for _ in range(300)]
    rows.append((days[0], "only null", "s", None))
    raw = spark.createDataFrame(rows, "event_date date, device_category string, event_name string, user_pseudo_id string")
    dictionary = rollups.number_users(raw)
    bitmaps = raw.distinct().join(dictionary, "user_pseudo_id", "left").groupBy(
        "event_date", "device_category", "event_name", F.bitmap_bucket_number("user_no").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("user_no")).alias("users"))
    got = as_set(rollups.rollup_counts(bitmaps, days[0], days[-1], ("device_category",), [("s", "s"), ("t", "t")]))
    want = {(g, *(len({u for _, d, e, u in rows if d == g and e == n and u}) for n in "st")) for g in {r[1] for r in rows}}
    assert got == want
    rolling = as_set(rollups.active_users(bitmaps, days[2], days[-1], 3))
    for day, g, n, n3 in rolling:
        span = [day - dt.timedelta(days=k) for k in range(3)]
        assert n == len({u for d, x, _, u in rows if d == day and x == g and u})
        assert n3 == len({u for d, x, _, u in rows if d in span and x == g and u})
    assert len(rolling) == len({(day, r[1]) for r in rows for day in days[2:] if 0 <= (day - r[0]).days < 3})
