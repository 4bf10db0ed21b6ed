"""Bucketed layouts: no exchange under joins and groupings on the bucket key, same rows, hot keys refused."""

import uuid

import pytest
from pyspark.sql import functions as F

from clickflow.operators import abtest, funnel
from clickflow.plans.inspect import physical_plan
from clickflow.sources.bucketed import drop_tables, largest_share, write_bucketed, write_bucketed_sessions

S, E = "2024-01-01", "2024-01-31"


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def as_set(df):
    return sorted(map(str, df.collect()))


def test_session_join_without_exchange(spark, tables001, tmp_path, no_broadcast):
    prefix, t = f"t_{uuid.uuid4().hex[:8]}", tables001
    # some events without a session
    t = type(t)(t.events.withColumn("session_id", F.when(F.col("event_id") % 50 != 0, F.col("session_id"))), t.sessions, t.transactions)
    events, sessions = write_bucketed_sessions(t, prefix, str(tmp_path), buckets=4)
    assert events.without_key.count() > 0
    pivot = funnel.funnel_pivot_bucketed(events, sessions, S, E)
    plan = physical_plan(pivot)
    assert "SortMergeJoin" in plan and "Exchange" not in plan.split("Union")[1].split("SortMergeJoin")[0]
    # the only exchange groups the events without a session
    assert plan.count("Exchange hashpartitioning") == 1
    assert as_set(pivot) == as_set(funnel.funnel_pivot(t.events, t.sessions, S, E))
    default = physical_plan(funnel.funnel_pivot(t.events, t.sessions, S, E))
    assert default.count("Exchange hashpartitioning") >= 3
    drop_tables(spark, f"{prefix}_events_by_session", f"{prefix}_sessions_by_session")


def test_cohort_join_without_exchange(spark, tables001, tmp_path, no_broadcast):
    name, ev = f"t_{uuid.uuid4().hex[:8]}", tables001.events
    by_user = write_bucketed(ev, name, str(tmp_path), "user_pseudo_id", 4).rows
    got = abtest.ab_events(by_user, abtest.ab_isolated_cohort(by_user, "TABW131", S, E), S, E)
    plan = physical_plan(got)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert as_set(got) == as_set(abtest.ab_events(ev, abtest.ab_isolated_cohort(ev, "TABW131", S, E), S, E))
    drop_tables(spark, name)


def test_a_hot_key_is_refused(spark, tmp_path):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, F.lit(None))
                                  .otherwise(F.col("id").cast("string")).alias("k"))
    assert 0.3 < largest_share(df, "k") < 0.5
    with pytest.raises(ValueError, match="default layout"):
        write_bucketed(df, "hot_table", str(tmp_path), "k", 64)
    assert largest_share(df.limit(0), "k") == 0.0


def bucket_number(spark, name):
    return int(spark.sql(f"DESCRIBE EXTENDED `{name}`").where("col_name = 'Num Buckets'").first()["data_type"])


def test_buckets_grow_with_the_rows(spark, tables001, tmp_path, no_broadcast, monkeypatch):
    monkeypatch.setattr("clickflow.sources.bucketed.ROWS_PER_BUCKET", 70)
    name, ev = f"t_{uuid.uuid4().hex[:8]}", tables001.events
    ev = ev.withColumn("user_pseudo_id", F.when(F.col("event_id") % 50 != 0, F.col("user_pseudo_id")))
    keyed = ev.where("user_pseudo_id is not null").count()
    table = write_bucketed(ev, name, str(tmp_path), "user_pseudo_id", 4, max_share=0.5)
    assert bucket_number(spark, name) == -(-keyed // 70) > 4
    got = abtest.ab_events(table.rows, abtest.ab_isolated_cohort(table.rows, "TABW131", S, E), S, E)
    plan = physical_plan(got)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    keyed_events = ev.where("user_pseudo_id is not null")
    assert as_set(got) == as_set(abtest.ab_events(ev, abtest.ab_isolated_cohort(keyed_events, "TABW131", S, E), S, E))
    assert as_set(table.rows.unionByName(table.without_key)) == as_set(ev)
    drop_tables(spark, name)


def test_flat_rows_are_dealt_before_they_are_made_wide(spark, tables001, tmp_path, monkeypatch):
    """What is dealt to the buckets are the flat rows; the query returns what the default layout does."""
    import __spark_entry__ as entry

    dealt, repartition = [], type(tables001.events).repartition
    monkeypatch.setattr(type(tables001.events), "repartition",
                        lambda self, n, *key: (key and dealt.append(self.columns), repartition(self, n, *key))[1])
    d = "/root/testdata/sf0.001"
    got = entry.queries()["ab_events_bucketed"](spark, d)
    assert dealt and all("items" not in columns for columns in dealt)
    monkeypatch.undo()
    assert as_set(got) == as_set(entry.queries()["ab_events"](spark, d))


def test_events_and_sessions_get_as_many_buckets(spark, tables001, tmp_path, no_broadcast, monkeypatch):
    monkeypatch.setattr("clickflow.sources.bucketed.ROWS_PER_BUCKET", 70)
    prefix, t = f"t_{uuid.uuid4().hex[:8]}", tables001
    events, sessions = write_bucketed_sessions(t, prefix, str(tmp_path), buckets=4)
    numbers = {bucket_number(spark, f"{prefix}_{x}_by_session") for x in ("events", "sessions")}
    assert numbers == {-(-t.events.count() // 70)}
    pivot = funnel.funnel_pivot_bucketed(events, sessions, S, E)
    plan = physical_plan(pivot)
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    assert as_set(pivot) == as_set(funnel.funnel_pivot(t.events, t.sessions, S, E))
    drop_tables(spark, f"{prefix}_events_by_session", f"{prefix}_sessions_by_session")


def test_the_bucketed_funnel_deals_flat_rows(spark, tables001, monkeypatch):
    import __spark_entry__ as entry

    dealt, repartition = [], type(tables001.events).repartition
    monkeypatch.setattr(type(tables001.events), "repartition",
                        lambda self, n, *key: (key and dealt.append(self.columns), repartition(self, n, *key))[1])
    d = "/root/testdata/sf0.001"
    got = entry.queries()["funnel_session_pivot_bucketed"](spark, d)
    assert len(dealt) == 2 and all("items" not in columns for columns in dealt)
    monkeypatch.undo()
    assert as_set(got) == as_set(entry.queries()["funnel_session_pivot"](spark, d))
