"""Incremental daily refresh stream; GA4 layout round trip; site lookup; spread."""

import os
import tempfile

from pyspark.sql import functions as F

from clickflow.operators import funnel
from clickflow.operators.reconcile import ga4_daily
from clickflow.sources.ga4 import read_source, spread
from clickflow.streaming.daily import start_daily_refresh


def _write_tx(df, path):
    df.write.mode("append").partitionBy("transaction_date").parquet(path)


def test_incremental_daily_refresh_equals_batch(spark, tables01):
    base = tempfile.mkdtemp(prefix="clickflow-stream-")
    src, out, ckpt = (os.path.join(base, x) for x in ("tx", "daily", "ckpt"))
    tx = tables01.transactions
    first = tx.where(F.col("transaction_date") <= "2024-01-15")
    second = tx.where(F.col("transaction_date") > "2024-01-12")  # re-opens three days (late data)
    _write_tx(first, src)
    start_daily_refresh(spark, src, out, ckpt).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 15
    _write_tx(second, src)
    start_daily_refresh(spark, src, out, ckpt).awaitTermination()
    got = spark.read.parquet(out).select("date", "ga4_transactions", "ga4_revenue")
    want = ga4_daily(spark.read.parquet(src), "2024-01-01", "2024-01-31")
    assert sorted(got.collect()) == sorted(want.collect())
    assert got.count() == 30


def test_day_rewritten_without_purchases_leaves_the_roll_up(spark):
    base = tempfile.mkdtemp(prefix="clickflow-stream-")
    src, out, ckpt = (os.path.join(base, x) for x in ("tx", "daily", "ckpt"))

    def rows(*given):
        return spark.createDataFrame(given, "transaction_id string, event_name string, day string, revenue double").select(
            "transaction_id", "event_name", F.to_date("day").alias("transaction_date"),
            F.struct(F.col("revenue").alias("purchase_revenue")).alias("ecommerce"))

    _write_tx(rows(("T1", "purchase", "2024-01-01", 5.0), ("T2", "purchase", "2024-01-02", 1.0)), src)
    start_daily_refresh(spark, src, out, ckpt).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    rewritten = rows(("T1", "refund", "2024-01-01", 5.0))
    rewritten.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("transaction_date").parquet(src)
    start_daily_refresh(spark, src, out, ckpt).awaitTermination()
    got = spark.read.parquet(out).select("date", "ga4_transactions", "ga4_revenue").collect()
    assert got == ga4_daily(spark.read.parquet(src), "2024-01-01", "2024-01-31").collect()
    assert len(got) == 1


def test_with_site_lookup(spark, tables001):
    lookup = spark.createDataFrame([("0", "Site A"), ("1", "Site B"), ("1", "Site B")], "stream_id string, site string")
    ev = funnel.with_site(tables001.events, lookup)
    assert ev.count() == tables001.events.count()  # no fan-out from duplicate keys
    sites = {r["site"] for r in ev.select("site").distinct().collect()}
    assert sites == {"Site A", "Site B", None}
    rep = funnel.funnel_by_segment(ev, tables001.sessions, "2024-01-01", "2024-01-31", dims=("site",))
    assert rep.count() == 3


def test_broadcast_only_when_small(spark):
    small = spark.range(10)
    big = spark.range(1000)
    assert "broadcast" in funnel.broadcast_if_small(small, 100)._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" not in funnel.broadcast_if_small(big, 100)._jdf.queryExecution().analyzed().toString().lower()


def test_spread_only_small_split_counts(spark):
    ev = read_source(spark, "/root/testdata/sf0.001", "events")
    assert ev.rdd.getNumPartitions() == 1
    assert spread(ev).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(0, 100, numPartitions=spark.sparkContext.defaultParallelism)
    assert spread(wide) is wide


def test_adapter_micros_ignore_session_time_zone(spark):
    from clickflow_fixtures.adapter import ga4_tables
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        ny = ga4_tables(spark, "/root/testdata/sf0.001").events.select("event_id", "time.event_timestamp").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    utc = ga4_tables(spark, "/root/testdata/sf0.001").events.select("event_id", "time.event_timestamp").collect()
    assert sorted(ny) == sorted(utc)
    import duckdb
    first = duckdb.sql("select event_id, epoch_us(ts) from '/root/testdata/sf0.001/events.parquet' "
                       "order by event_id limit 1").fetchall()[0]
    assert dict((r[0], r[1]) for r in utc)[first[0]] == first[1]


def test_cluster_conf_scales_with_input():
    from clickflow.session import cluster_conf
    small = cluster_conf(10 * 1024 ** 3)
    big = cluster_conf(100 * 1024 ** 4)
    assert small["spark.sql.shuffle.partitions"] == "200"
    assert big["spark.sql.shuffle.partitions"] == str(100 * 1024 ** 4 // 4 // (256 * 1024 ** 2))
    assert big["spark.sql.adaptive.enabled"] == "true"


def test_materialized_tables_rewritten_when_folder_is_gone(spark):
    import shutil
    from clickflow_fixtures import adapter as ga4
    n1 = ga4.ga4_tables_materialized(spark, "/root/testdata/sf0.001").events.count()
    key = (spark.sparkContext.applicationId, "/root/testdata/sf0.001")
    base = ga4._WRITTEN[key]
    assert ga4._complete(spark, base)
    shutil.rmtree(base.replace("file:", ""))
    assert not ga4._complete(spark, base)
    t2 = ga4.ga4_tables_materialized(spark, "/root/testdata/sf0.001")
    assert t2.events.count() == n1 == 1000


def test_url_enrichment_equals_per_key_parse_url(spark):
    from clickflow.operators.enrich import CUSTOM_URL_PARAMS, URL_PARAM_KEYS, url_enrichment
    urls = [r[0] for r in read_source(spark, "/root/testdata/sf0.01", "pages").select("url").collect()] + [
        "https://a.example.com/p?utm_source=&utm_medium=cpc", "https://a.example.com/p?xutm_source=1&utm_source=2",
        "https://a.example.com/p?utm_source=a&utm_source=b#utm_campaign=frag", "https://a.example.com/",
        "http://[bad", None, "https://a.example.com/s?search_query=Beach%20Trip&utm_term=x",
    ]
    df = spark.createDataFrame([(u,) for u in urls], "page_location string")
    got = url_enrichment(df)
    u = F.col("page_location")
    keys = URL_PARAM_KEYS + [n for n, _ in CUSTOM_URL_PARAMS]
    raw = {k: F.try_parse_url(u, F.lit("QUERY"), F.lit(k)) for k in keys}
    want = df.select(u, *[F.coalesce(F.try_url_decode(c), c).alias(k) for k, c in raw.items()])
    got = got.select(u, *[F.col(f"url_params.{k}").alias(k) for k in URL_PARAM_KEYS],
                     F.upper(F.col("url_params_custom.search_query")).alias("search_query"))
    want = want.withColumn("search_query", F.upper("search_query"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
