"""Golden rows for the item-parameter parsers (FIXTURES.md section 3)."""

import pytest
from pyspark.sql import functions as F

from clickflow.operators import item_params as ip


def _events(spark, n, values):
    """One event per value, one item each, value in item_parameter_n (custom and raw)."""
    data = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "i int, v string")
    custom = F.struct(*[
        (F.col("v") if m == n else F.lit(None).cast("string")).alias(f"item_parameter_{m}")
        for m in ip.PARAM_SPECS
    ])
    kv = F.filter(F.array(F.struct(F.lit(f"item_parameter_{n}").alias("key"),
                                   F.struct(F.col("v").alias("string_value")).alias("value"))),
                  lambda x: x["value"]["string_value"].isNotNull())
    item = F.struct(F.concat(F.lit("I"), F.col("i").cast("string")).alias("item_id"),
                    F.lit("n").alias("item_name"), F.lit("b").alias("item_brand"),
                    kv.alias("item_params"), custom.alias("item_params_custom"))
    return df.select(
        F.lit("2024-01-01").cast("date").alias("event_date"), F.lit("view_item").alias("event_name"),
        F.lit("s").alias("session_id"), F.lit("u").alias("user_pseudo_id"), "i",
        F.array(item).alias("items"),
    )


def _parse(spark, n, values, source="custom", mode="reference"):
    ev = _events(spark, n, values)
    out = ip.parse_param(ev, n, "2024-01-01", "2024-01-01", source=source, mode=mode)
    got = {r["item_id"]: r.asDict() for r in out.collect()}
    return [got[f"I{i}"] for i in range(len(values))]


@pytest.mark.parametrize("source", ["custom", "raw"])
def test_param1_prices(spark, source):
    r = _parse(spark, 1, ["per:_1234_room:_5678_filter:_person_summary:_1300_listing_price:_1200",
                          "per:_1234", "per:_99999999999999999999", None, ""], source=source)
    assert (r[0]["price_per_person"], r[0]["price_per_room"], r[0]["price_display_type"],
            r[0]["price_summary"], r[0]["listing_price"]) == (1234, 5678, "person_summary", 1300, 1200)
    assert r[1]["price_per_person"] == 1234 and r[1]["price_per_room"] is None
    assert r[2]["price_per_person"] is None  # overflow -> null (SAFE_CAST)
    for k in ("price_per_person", "price_display_type", "listing_price"):
        assert r[3][k] is None and r[4][k] is None
    assert r[0]["item_name"] == "n" and r[0]["item_brand"] == "b"


def test_param1_strict_mode(spark):
    r = _parse(spark, 1, ["per:_1_filter:_person_summary:_2", "filter:_total"], mode="strict")
    assert r[0]["price_display_type"] == "person"
    assert r[1]["price_display_type"] == "total"


def test_param5_trip(spark):
    r = _parse(spark, 5, ["d:_7_dtt:_30_offers:_12"])
    assert (r[0]["trip_duration_days"], r[0]["days_to_trip"], r[0]["listing_offers_count"]) == (7, 30, 12)


def test_param9_both_spellings(spark):
    r = _parse(spark, 9, ["adult:_2_child:_1", "a:_2_c:_1"])
    assert [(x["adults_count"], x["children_count"]) for x in r] == [(2, 1), (2, 1)]


def test_param19_anchor(spark):
    r = _parse(spark, 19, ["p:_1_i:_0_pr:_1_l:_0_s:_1", "x_p:_1_i:_0"])
    assert (r[0]["parking_available"], r[0]["insurance_available"], r[0]["promesa_available"],
            r[0]["luggage_available"], r[0]["seats_together_available"]) == (1, 0, 1, 0, 1)
    assert r[1]["parking_available"] is None and r[1]["insurance_available"] == 0
    assert r[1]["promesa_available"] is None


def test_param20_reference_and_strict(spark):
    v = ["test:_TABW131_ab:_a_qs:_seg1"]
    r = _parse(spark, 20, v)[0]
    assert (r["test_id"], r["test_group"], r["qs_segment"]) == ("TABW131_ab", "a_qs", "seg1")
    s = _parse(spark, 20, v, mode="strict")[0]
    assert (s["test_id"], s["test_group"], s["qs_segment"]) == ("TABW131", "a", "seg1")


def test_param25_names(spark):
    r = _parse(spark, 25, ["p:_1-Parking A_i:_0-Basic_pr:_1_l:_0", "p:_0_i:_1_pr:_0_l:_1"])
    assert (r[0]["parking_selected"], r[0]["parking_name"], r[0]["insurance_selected"],
            r[0]["insurance_name"], r[0]["promesa_selected"], r[0]["luggage_selected"]) == (1, "Parking A", 0, "Basic", 1, 0)
    assert (r[1]["parking_selected"], r[1]["parking_name"], r[1]["insurance_selected"],
            r[1]["insurance_name"], r[1]["promesa_selected"], r[1]["luggage_selected"]) == (0, None, 1, None, 0, 1)


def test_unnest_drops_events_without_items(tables001):
    ev = tables001.events
    n_items = ev.select(F.sum(F.size("items"))).first()[0]
    parsed = ip.parse_param(ev, 5, "2024-01-01", "2024-01-31")
    assert parsed.count() == n_items
    assert ev.where(F.size("items") == 0).count() > 0


def test_parse_items_matches_single_parsers(tables001):
    ev = tables001.events
    allp = ip.parse_items(ev, "2024-01-01", "2024-01-31")
    one = ip.parse_param(ev, 19, "2024-01-01", "2024-01-31")
    cols = ["event_date", "event_name", "session_id", "user_pseudo_id", "item_id", "raw_param_19",
            *[c for c, _, _ in ip.PARAM_SPECS[19]]]
    assert sorted(map(tuple, allp.select(*cols).collect())) == sorted(map(tuple, one.select(*cols).collect()))


def test_raw_and_custom_sources_agree(tables001):
    ev = tables001.events
    a = ip.parse_items(ev, "2024-01-01", "2024-01-31", source="custom")
    b = ip.parse_items(ev, "2024-01-01", "2024-01-31", source="raw")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_promote_params(spark):
    df = spark.createDataFrame(
        [([("a", ("1",)), ("b", ("2",)), ("a", ("3",))],)],
        "item_params array<struct<key:string,value:struct<string_value:string>>>")
    out = ip.promote_params(df, ["a", "b", "c"]).select("item_params_custom.*").first()
    assert (out["a"], out["b"], out["c"]) == ("1", "2", None)  # first match wins
