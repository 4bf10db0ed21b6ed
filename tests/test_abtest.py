"""A/B test: cohort facts on the sf0.01 fixture, invariants, z-test golden rows."""

import math

import pytest
from pyspark.sql import functions as F

from clickflow.operators import abtest

S, E = "2024-01-01", "2024-01-31"


def test_cohort_sizes(tables01):
    ev = tables01.events
    cohort = abtest.ab_cohort(ev, "TABW131", S, E)
    counts = {r["test_group"]: r["count"] for r in cohort.groupBy("test_group").count().collect()}
    assert counts == {"a": 60, "b": 60}
    iso = abtest.ab_isolated_cohort(ev, "TABW131", S, E)
    counts = {r["test_group"]: r["count"] for r in iso.groupBy("test_group").count().collect()}
    assert counts == {"a": 60, "b": 55}  # five users also saw TABW200_b; TABW1310_a users stay


def test_single_scan_isolation_equals_anti_join(tables01):
    ev = tables01.events
    textbook = abtest.ab_isolate(abtest.ab_cohort(ev, "TABW131", S, E), ev, "TABW131", S, E)
    single = abtest.ab_isolated_cohort(ev, "TABW131", S, E)
    assert sorted(textbook.collect()) == sorted(single.collect())
    others = abtest.users_in_other_tests(ev, "TABW131", S, E)
    assert single.join(others, "user_pseudo_id").count() == 0


def test_strict_mode_excludes_prefix_collisions(tables01):
    ev = tables01.events
    ref = abtest.ab_isolated_cohort(ev, "TABW131", S, E).count()
    strict = abtest.ab_isolated_cohort(ev, "TABW131", S, E, mode="strict").count()
    assert strict < ref  # TABW1310_a users are "another test" in strict mode


def test_event_grain_and_session_grain_metrics_agree(tables01):
    ev = tables01.events
    cohort = abtest.ab_isolated_cohort(ev, "TABW131", S, E)
    a = abtest.ab_metrics(abtest.ab_events(ev, cohort, S, E))
    b = abtest.ab_metrics(abtest.ab_session_grain(ev, cohort, S, E))
    assert sorted(a.collect()) == sorted(b.collect())


def test_split_shares_sum_to_one(tables01):
    ev = tables01.events
    cohort = abtest.ab_isolated_cohort(ev, "TABW131", S, E)
    split = abtest.split_check(abtest.ab_session_grain(ev, cohort, S, E)).collect()
    assert math.isclose(sum(r["user_share"] for r in split), 1.0)
    assert {r["split_status"] for r in split} <= {"OK", "UNEVEN_SPLIT"}


def test_report_columns(tables01):
    rep = abtest.ab_report(tables01.events, "TABW131", S, E)
    assert rep.columns[:2] == ["test_group", "device_category"]
    assert rep.columns[-2:] == ["user_share", "split_status"]
    rows = rep.collect()
    assert [(r["test_group"], r["device_category"]) for r in rows] == sorted(
        (r["test_group"], r["device_category"]) for r in rows)


def _z(spark, sa, ca, sb, cb):
    df = spark.createDataFrame([(sa, ca, sb, cb)], "sessions_a long, conversions_a long, sessions_b long, conversions_b long")
    return abtest.two_proportion_z(df).first()


def test_ztest_golden(spark):
    r = _z(spark, 1000, 50, 1020, 62)
    assert r["cr_a"] == pytest.approx(0.05)
    assert r["cr_b"] == pytest.approx(0.0607843, abs=1e-7)
    assert r["pooled_cr"] == pytest.approx(0.0554455, abs=1e-7)
    assert r["z_value"] == pytest.approx(1.0589369, abs=1e-6)
    assert r["relative_uplift"] == pytest.approx(0.2156863, abs=1e-6)
    assert r["significance"] == "not significant"


def test_ztest_zero_conversions(spark):
    r = _z(spark, 1000, 0, 1000, 0)
    assert r["z_value"] is None and r["relative_uplift"] is None
    assert r["significance"] == "not significant"


@pytest.mark.parametrize("cb,label", [(75, "p < 0.05"), (100, "p < 0.01"), (70, "p < 0.10"), (60, "not significant")])
def test_ztest_levels(spark, cb, label):
    assert _z(spark, 1000, 50, 1000, cb)["significance"] == label


def test_ztest_from_events(tables01):
    out = abtest.ab_ztest(tables01.events, "TABW131", S, E).collect()
    assert [r["test_group"] for r in out] == ["b"]
    r = out[0]
    assert r["sessions_a"] > 0 and r["sessions_b"] > 0
    assert r["cr_a"] == pytest.approx(r["conversions_a"] / r["sessions_a"])


def test_ab_metrics_no_expand(tables01):
    ev = tables01.events
    cohort = abtest.ab_isolated_cohort(ev, "TABW131", S, E)
    plan = abtest.ab_metrics(abtest.ab_session_grain(ev, cohort, S, E))._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_null_users_never_join(spark):
    ev = spark.createDataFrame(
        [("2024-01-01", None, "s1", "TABW131_a"), ("2024-01-01", "u1", "s2", "TABW131_b")],
        "d string, user_pseudo_id string, session_id string, test_ab string",
    ).select(F.col("d").cast("date").alias("event_date"), "user_pseudo_id", "session_id",
             F.struct("test_ab").alias("event_params_custom"))
    iso = abtest.ab_isolated_cohort(ev, "TABW131", S, E)
    assert sorted(iso.collect(), key=str) == sorted(
        abtest.ab_isolate(abtest.ab_cohort(ev, "TABW131", S, E), ev, "TABW131", S, E).collect(), key=str)


def test_session_grain_joins_the_cohort_first(spark, tables01):
    """Other users are gone before events are aggregated, whichever join Spark chooses."""
    ev = tables01.events
    cohort = abtest.ab_isolated_cohort(ev, "TABW131", S, E)
    cols = ["user_pseudo_id", "session_id", "device_category", "purchase_txn", "test_group", "rev"]
    chosen = sorted(abtest.ab_session_grain(ev, cohort, S, E).select(*cols).collect(), key=str)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        grain = abtest.ab_session_grain(ev, cohort, S, E)
        optimized = grain._jdf.queryExecution().optimizedPlan().toString()
        assert optimized.lstrip().startswith("Aggregate") and optimized.count("f_session_start") == 1
        assert sorted(grain.select(*cols).collect(), key=str) == chosen
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_no_control_group_no_test(spark, tables01):
    assert abtest.ab_ztest(tables01.events, "TABW131", S, E, control="nobody").count() == 0


def test_contamination_counts_users_in_both_groups(spark):
    cohort = spark.createDataFrame([("u1", "a"), ("u1", "b"), ("u2", "a"), ("u3", "b")],
                                   "user_pseudo_id string, test_group string")
    r = abtest.ab_contamination(cohort).first()
    assert (r["cohort_users"], r["contaminated_users"]) == (3, 1)
