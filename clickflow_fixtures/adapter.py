"""GA4-shaped tables derived from the flat test ``events`` table (FIXTURES.md section 2).

Narrow DataFrame expressions whose mapping rules are conventions of the test
data, written once here and once as SQL in ``clickflow_fixtures.oracle``. The
library imports nothing from here.
"""

from __future__ import annotations

import hashlib
import threading
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickflow.session import ensure_checkpoint_dir
from clickflow.sources.ga4 import Ga4Tables, read_ga4_tables, read_source, spread, write_ga4_tables

# Custom item parameters configured on the items (fixed names).
ITEM_PARAM_NUMBERS = (1, 5, 9, 19, 20, 25)
# Markets named in the funnel documentation (fixed values), assigned to test
# users by user_id % 4 in this order.
COUNTRIES = ("Poland", "Czech Republic", "Slovakia", "Hungary")


def _s(c: Column) -> Column:
    return c.cast("string")


def _value(string: Column | None = None, int: Column | None = None, double: Column | None = None) -> Column:
    """A parameter's value: one field per type, the others null."""
    def typed(c, t):
        return (F.lit(None) if c is None else c).cast(t)
    return F.struct(typed(string, "string").alias("string_value"), typed(int, "bigint").alias("int_value"),
                    typed(double, "double").alias("double_value"))


def _page_location(eid: Column, name: Column) -> Column:
    """Page URLs as they come: some without query, with characters no URI may hold, encoded, or missing."""
    page = F.concat(F.lit("https://shop"), _s(eid % 3), F.lit(".example.com/"), name)
    kind = eid % 6
    query = (
        F.when(kind == 1, F.lit("?utm_source=news|letter&utm_medium=email&utm_campaign=spring%20sale"))
        .when(kind == 2, F.lit("?utm_source=ads&utm_content=big banner&utm_term=caf%C3%A9&search_query=CAF%C3%89%20Rzym"))
        .when(kind == 3, F.concat(F.lit("?utm_id="), _s(eid % 9), F.lit(
            "&utm_marketing_tactic=t&utm_source_platform=p&utm_creative_format=f#top")))
        .when(kind == 4, F.concat(F.lit("?gtm_debug="), _s(eid), F.lit("&_gl=1*x&utm_source=")))
        .otherwise(F.lit(""))
    )
    return F.when(kind != 5, F.concat(page, query))


def _item_struct(k: Column, event_name: Column) -> Column:
    """One item of an event; ``k`` is a per-item integer seed."""
    kid = k % 500
    p1 = F.when(
        event_name != F.lit("view_item_list"),
        F.concat(
            F.lit("per:_"), _s(1000 + k % 4000),
            F.lit("_room:_"), _s(2000 + k % 8000),
            F.lit("_filter:_"), F.when(k % 2 == 0, F.lit("person")).otherwise(F.lit("total")),
            F.lit("_summary:_"), _s(2100 + k % 8000),
            F.lit("_listing_price:_"), _s(990 + k % 4000),
        ),
    )
    p5 = F.concat(F.lit("d:_"), _s(k % 21 + 1), F.lit("_dtt:_"), _s(k % 300),
                  F.lit("_offers:_"), _s(k % 90))
    p9 = F.when(
        k % 2 == 0,
        F.concat(F.lit("adult:_"), _s(k % 4 + 1), F.lit("_child:_"), _s(k % 3)),
    ).otherwise(F.concat(F.lit("a:_"), _s(k % 4 + 1), F.lit("_c:_"), _s(k % 3)))
    p19 = F.concat(F.lit("p:_"), _s(k % 2), F.lit("_i:_"), _s(k % 3 % 2),
                   F.lit("_pr:_"), _s(k % 5 % 2), F.lit("_l:_"), _s(k % 7 % 2),
                   F.lit("_s:_"), _s(k % 11 % 2))
    p20 = F.concat(F.lit("test:_TABW131_ab:_"),
                   F.when(k % 2 == 0, F.lit("a")).otherwise(F.lit("b")),
                   F.lit("_qs:_seg"), _s(k % 3))
    p25 = F.when(
        k % 4 == 0,
        F.concat(F.lit("p:_1-Lot "), _s(k % 9), F.lit("_i:_1-Plan "), _s(k % 5),
                 F.lit("_pr:_"), _s(k % 2), F.lit("_l:_1")),
    ).otherwise(F.lit("p:_0_i:_0_pr:_0_l:_0"))
    params = dict(zip(ITEM_PARAM_NUMBERS, (p1, p5, p9, p19, p20, p25)))
    kv = F.filter(
        F.array(*[
            F.struct(F.lit(f"item_parameter_{n}").alias("key"),
                     _value(string=v).alias("value"))
            for n, v in params.items()
        ], F.struct(F.lit("position").alias("key"), _value(int=k % 2 + 1).alias("value"))),
        lambda x: x["value"]["string_value"].isNotNull() | x["value"]["int_value"].isNotNull(),
    )
    quantity = k % 3 + 1
    return F.struct(
        F.concat(F.lit("I"), _s(kid)).alias("item_id"),
        F.concat(F.lit("Offer "), _s(kid)).alias("item_name"),
        F.concat(F.lit("Brand "), _s(kid % 7)).alias("item_brand"),
        quantity.alias("quantity"),
        (k % 1000 + 0.125).alias("price"),
        ((k % 1000 + 0.125) * quantity).alias("item_revenue"),
        F.when(k % 5 == 0, F.concat(F.lit("C"), _s(k % 4))).alias("coupon"),
        kv.alias("item_params"),
        F.struct(*[v.alias(f"item_parameter_{n}") for n, v in params.items()]).alias("item_params_custom"),
    )


def _flat_events(raw: DataFrame) -> DataFrame:
    """Flat analytics columns from the raw test ``events`` table (one row per event)."""
    eid = F.col("event_id")
    uid = F.col("user_id")
    # ``ts`` is timestamp_ntz (a UTC wall clock). Microseconds since the epoch
    # are taken on the NTZ value itself, so the session time zone cannot
    # shift them; the UTC instant is rebuilt from those microseconds.
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    day_no = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    bucket = (day_no - day_no % 3) / 3
    step = eid % 100
    event_name = (
        F.when(step < 30, "session_start").when(step < 50, "view_item_list")
        .when(step < 55, "select_item").when(step < 75, "view_item")
        .when(step < 84, "add_to_cart").when(step < 90, "begin_checkout")
        .when(step < 94, "add_shipping_info").when(step < 97, "purchaseOnClick")
        .otherwise("purchase")
    )
    device = F.when(uid % 3 == 0, "desktop").when(uid % 3 == 1, "mobile").otherwise("tablet")
    country = F.when(uid % 4 == 0, COUNTRIES[0]).when(uid % 4 == 1, COUNTRIES[1]) \
        .when(uid % 4 == 2, COUNTRIES[2]).otherwise(COUNTRIES[3])
    df = raw.select(
        eid.alias("event_id"), uid.alias("user_id"), F.col("value"),
        F.col("ts").cast("date").alias("event_date"),
        micros.alias("event_timestamp"),
        F.timestamp_micros(micros).alias("event_timestamp_utc"),
        (bucket.cast("bigint") + 1).alias("bucket"),
        event_name.alias("event_name"),
        device.alias("device_category"),
        country.alias("country"),
        _s(uid % 5).alias("stream_id"),
    )
    b = F.col("bucket")
    chan_no = (uid + b) % 5
    channel = (F.when(chan_no == 0, "Organic Search").when(chan_no == 1, "Direct")
               .when(chan_no == 2, "Paid Search").when(chan_no == 3, "Email"))
    test_ab = (
        F.when((uid % 30 == 7) & (eid % 2 == 1), "TABW200_b")
        .when((uid % 30 == 11) & (eid % 7 == 0), "TABW1310_a")
        .when(uid % 10 < 4, "TABW131_a").when(uid % 10 < 8, "TABW131_b")
        .when(uid % 10 == 8, "TABW200_a")
    )
    is_purchase = F.col("event_name") == "purchase"
    return df.select(
        "*",
        F.concat(F.lit("u"), _s(uid)).alias("user_pseudo_id"),
        F.concat(_s(uid), F.lit("_"), _s(b)).alias("session_id"),
        channel.alias("channel"),
        test_ab.alias("test_ab"),
        F.when(is_purchase & (eid % 11 != 0), F.col("value") + (eid % 8) * F.lit(0.0003)).alias("purchase_revenue"),
        F.when(is_purchase, F.concat(F.lit("T"), _s(eid - eid % 2))).alias("transaction_id"),
        (eid % 3).cast("int").alias("n_items"),
    )


def ga4_events_from_flat(flat: DataFrame) -> DataFrame:
    """Nested ``ga4_events`` rows from the flat adapter columns."""
    eid = F.col("event_id")
    name = F.col("event_name")
    items = F.slice(
        F.array(_item_struct(eid * 2, name), _item_struct(eid * 2 + 1, name)),
        1, F.col("n_items"),
    )
    return flat.select(
        "event_date", "event_name", "session_id", "user_pseudo_id", "event_id", "stream_id",
        F.struct(F.col("event_timestamp"), F.col("event_timestamp_utc")).alias("time"),
        F.struct(F.col("device_category").alias("category")).alias("device"),
        F.struct(F.col("country")).alias("geo"),
        F.struct(F.col("bucket").alias("ga_session_number"), _page_location(eid, name).alias("page_location"))
        .alias("event_params"),
        F.array(
            F.struct(F.lit("page_type").alias("key"), _value(string=F.concat(F.lit("type "), _s(eid % 4))).alias("value")),
            F.struct(F.lit("engagement_time_msec").alias("key"), _value(int=eid * 7 % 5000).alias("value")),
            F.struct(F.lit("scroll_share").alias("key"), _value(double=eid % 8 / F.lit(8.0)).alias("value")),
        ).alias("event_params_raw"),
        F.struct(F.col("test_ab")).alias("event_params_custom"),
        F.struct(F.col("transaction_id"), F.col("purchase_revenue")).alias("ecommerce"),
        items.alias("items"),
    )


def ga4_sessions_from_flat(flat: DataFrame) -> DataFrame:
    """One row per session with a known channel (a fifth of sessions have none)."""
    return (
        flat.where(F.col("channel").isNotNull())
        .groupBy("session_id", "channel")
        .agg(F.min("event_date").alias("session_date"))
        .select(
            "session_id", "session_date",
            F.struct(F.col("channel").alias("default_channel_grouping"))
            .alias("last_non_direct_traffic_source"),
        )
    )


def ga4_transactions_from_flat(flat: DataFrame) -> DataFrame:
    """One row per purchase event carrying a transaction id (ids may repeat)."""
    return flat.where(F.col("transaction_id").isNotNull()).select(
        "transaction_id",
        F.col("event_date").alias("transaction_date"),
        "event_name",
        F.struct(F.col("purchase_revenue")).alias("ecommerce"),
    )


def ga4_from_events(raw_events: DataFrame) -> Ga4Tables:
    flat = _flat_events(raw_events)
    return Ga4Tables(
        events=ga4_events_from_flat(flat),
        sessions=ga4_sessions_from_flat(flat),
        transactions=ga4_transactions_from_flat(flat),
    )


def ga4_flat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat rows of ``{sf_dir}/events.parquet``: what layouts shuffle, before
    :func:`ga4_events_from_flat` makes the nested rows of them (eight times their shuffled bytes)."""
    return _flat_events(spread(read_source(spark, sf_dir, "events")))


def ga4_tables(spark: SparkSession, sf_dir: str) -> Ga4Tables:
    """GA4-shaped tables derived from ``{sf_dir}/events.parquet``."""
    return ga4_from_events(spread(read_source(spark, sf_dir, "events")))


# Derived GA4 tables already written in this application: (app id, source dir) -> folder.
_WRITTEN: dict[tuple[str, str], str] = {}
_WRITE_LOCK = threading.Lock()


def _complete(spark: SparkSession, base: str) -> bool:
    """Whether all three tables under ``base`` finished writing (``_SUCCESS``
    markers), checked through the Hadoop FileSystem API so it works on any
    shared storage."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for t in ("ga4_events", "ga4_sessions", "ga4_transactions"):
        path = jvm.org.apache.hadoop.fs.Path(f"{base}/{t}/_SUCCESS")
        if not path.getFileSystem(conf).exists(path):
            return False
    return True


def ga4_tables_materialized(spark: SparkSession, sf_dir: str) -> Ga4Tables:
    """GA4 tables derived from ``{sf_dir}/events.parquet``, read from
    :func:`ga4_tables_folder`.

    Queries then run on what production has: ``event_date`` partitions
    (partition pruning), files clustered by ``event_name, session_id``, and
    nested Parquet columns (nested column pruning) -- and the adapter's
    string building runs once instead of inside every query.
    """
    return read_ga4_tables(spark, ga4_tables_folder(spark, sf_dir))


def ga4_tables_folder(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the derived tables, written once per application in the
    production layout under the shared checkpoint folder."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    with _WRITE_LOCK:
        if key in _WRITTEN and not _complete(spark, _WRITTEN[key]):
            del _WRITTEN[key]  # the folder was cleaned up meanwhile
        if key not in _WRITTEN:
            tag = hashlib.sha1("|".join(key).encode()).hexdigest()[:16]
            out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ga4-tables-{tag}"
            flat = replace(ga4_tables(spark, sf_dir), events=ga4_flat_events(spark, sf_dir))
            write_ga4_tables(flat, out, shape=ga4_events_from_flat)
            _WRITTEN[key] = out
        return _WRITTEN[key]
