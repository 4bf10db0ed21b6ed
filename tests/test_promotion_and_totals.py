"""Typed parameter promotion, item totals, the item cohort, medians of large groups."""

import pytest
from pyspark.sql import functions as F

from clickflow.operators import abtest, enrich, funnel, item_params

VALUE = "struct<string_value:string,int_value:bigint,double_value:double>"
KV = f"array<struct<key:string,value:{VALUE}>>"


def test_promoted_types_come_from_their_own_field(spark):
    kv = [("a", ("x", None, None)), ("n", (None, 7, None)), ("d", (None, None, 0.5))]
    df = spark.createDataFrame([(kv,), ([],), (None,)], f"item_params {KV}")
    config = ["a", ("n", "int"), ("d", "double"), ("n", "string"), "gone"]
    out = item_params.promote_params(df, config[:3] + config[4:]).select("item_params_custom.*").collect()
    assert [tuple(r) for r in out] == [("x", 7, 0.5, None)] + [(None,) * 4] * 2
    wrong = item_params.promote_params(df, [("n", "string")]).select("item_params_custom.n").first()
    assert wrong.n is None
    with pytest.raises(ValueError):
        item_params.promote_params(df, [("n", "decimal")])


def test_item_totals(spark):
    item = "struct<item_id:string,quantity:int,item_revenue:double,coupon:string>"
    schema = (f"event_date date, event_name string, ecommerce struct<transaction_id:string,purchase_revenue:double>, "
              f"items array<{item}>")
    rows = [
        ("purchase", ("T1", 0.004), [("A", 2, 0.0005, "Z"), ("B", None, None, None)]),
        ("purchase", ("T1", 0.004), [("A", 1, 0.0005, "C")]),
        ("purchase", ("T2", 1.0), None),
        ("purchase", (None, 9.0), [("A", 1, 1.0, "C")]),
        ("view_item", ("T1", 9.0), [("A", 1, 1.0, "C")]),
    ]
    df = spark.createDataFrame([("2024-01-01", *r) for r in rows], schema.replace("date date", "date string"))
    out = enrich.transaction_totals(df.withColumn("event_date", F.to_date("event_date")), "2024-01-01", "2024-01-02")
    got = {r.transaction_id: (r.purchase_events, r.total_items, r.unique_items, r.revenue, r.item_quantity, r.item_revenue, r.coupons)
           for r in out.collect()}
    assert got == {"T1": (2, 3, 2, 0.008, 3, 0.001, "C,Z"), "T2": (1, 0, 0, 1.0, 0, None, None)}


def test_item_cohort_matches_whole_test_ids(spark):
    item = "struct<item_id:string,item_name:string,item_brand:string,item_params_custom:struct<item_parameter_20:string>>"
    schema = f"event_date date, event_name string, session_id string, user_pseudo_id string, items array<{item}>"
    labels = [("u1", "test:_TABW131_ab:_a_qs:_s"), ("u1", "test:_TABW131_ab:_a_qs:_t"), ("u2", "test:_TABW131_ab:_b"),
              ("u3", "test:_TABW1310_ab:_a_qs:_s"), ("u4", None), ("u5", "test:_TABW131_qs:_s")]
    df = spark.createDataFrame([("e", "s", u, [("I", "n", "b", (p,))]) for u, p in labels],
                               schema.split(", ", 1)[1]).withColumn("event_date", F.lit("2024-01-01").cast("date"))
    out = abtest.ab_cohort_from_items(df, "TABW131", "2024-01-01", "2024-01-01")
    assert sorted(map(tuple, out.collect())) == [("u1", "a"), ("u2", "b")]


def test_report_labels_are_arguments(tables001):
    out = abtest.ab_report(tables001.events, "TABW131", "2024-01-01", "2024-01-31", low=0.9, high=1.0,
                           labels={"ok": "fine", "uneven": "look"})
    assert {r.split_status for r in out.collect()} == {"look"}


@pytest.mark.parametrize("accuracy", [100, funnel.PERCENTILE_ACCURACY])
def test_median_of_a_group_above_the_accuracy(spark, accuracy):
    """The rank is off by at most the group's size over the accuracy."""
    n = 40_001
    shuffled = (F.col("id") * 7919) % n
    pivot = spark.range(n, numPartitions=16).select(
        F.lit("s").alias("seg"), F.lit(0).cast("bigint").alias("ts_a"), (shuffled * 60_000_000).alias("ts_b"))
    got = funnel.funnel_medians(pivot, ("seg",), [("gap", "a", "b")], accuracy=accuracy).first().median_min_gap
    assert abs(got - n // 2) <= n / accuracy
