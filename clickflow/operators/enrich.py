"""Documented extensions: URL/UTM enrichment, transaction totals, session metrics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickflow.functions.exprs import money_sum
from clickflow.operators.distinct import DistinctBranch, distinct_counts
from clickflow.operators.funnel import dim_expr, in_date_range, order_by
from clickflow.plans.materialize import materialize

# ---------------------------------------------------------------------------
# Query-string keys promoted to ``url_params`` and the custom
# URL parameters (name, cleaning) promoted to ``url_params_custom``.
# ---------------------------------------------------------------------------
URL_PARAM_KEYS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_id", "utm_content", "utm_term",
    "utm_marketing_tactic", "utm_source_platform", "utm_creative_format",
    "gtm_debug", "_gl",
]
CUSTOM_URL_PARAMS = [("search_query", "lower")]
# ---------------------------------------------------------------------------


def _query_value(query: Column, key: str) -> Column:
    """Value of ``key`` in a raw query string, as ``parse_url(url, 'QUERY', key)``
    returns it: the first ``key=`` at the start or after ``&``, up to the next
    ``&``; null when the key is absent.

    The key is part of the group, so one pattern run tells an absent key from
    an empty value."""
    pair = F.nullif(F.regexp_extract(query, f"(?:&|^)({re.escape(key)}=[^&]*)", 1), F.lit(""))
    raw = F.substring(pair, len(key) + 2, 2**31 - 1)
    return F.coalesce(F.try_url_decode(raw), raw)


def _part(url: Column, pattern: str) -> Column:
    """The first group of ``pattern``, null where it doesn't match."""
    return F.when(url.rlike(pattern), F.regexp_extract(url, pattern, 1))


def url_enrichment(df: DataFrame, url_col: str = "page_location") -> DataFrame:
    """``page`` (location, hostname, path), ``url_params`` and ``url_params_custom``.

    Narrow projection on the URL column; runs in the scan stage. The query
    string is taken out of the URL once and each parameter is read from it and
    decoded. Parts are taken by pattern, so characters that a strict URI parser
    rejects (``|``, spaces) cost nothing; what is no URL gives nulls.
    """
    url = F.col(url_col)
    cleaners = {"lower": F.lower, "none": lambda c: c}
    out = df.withColumn("__query", _part(url, r"^[^?#]*\?([^#]*)"))
    query = F.col("__query")
    return out.withColumns({
        "page": F.struct(
            url.alias("location"),
            _part(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)").alias("hostname"),
            _part(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)").alias("path"),
        ),
        "url_params": F.struct(*[_query_value(query, k).alias(k) for k in URL_PARAM_KEYS]),
        "url_params_custom": F.struct(*[
            cleaners[how](_query_value(query, name)).alias(name) for name, how in CUSTOM_URL_PARAMS
        ]),
    }).drop("__query")


def _flat_url_fields() -> list[Column]:
    return [
        F.col("page.hostname").alias("hostname"), F.col("page.path").alias("path"),
        *[F.col(f"url_params.{k}").alias(k) for k in URL_PARAM_KEYS],
        *[F.col(f"url_params_custom.{name}").alias(name) for name, _ in CUSTOM_URL_PARAMS],
    ]


def page_url_params(pages: DataFrame) -> DataFrame:
    """X3 over a page table: one row per page with flattened URL fields."""
    enriched = url_enrichment(pages.select("page_id", F.col("url").alias("page_location")))
    return enriched.select("page_id", "page_location", *_flat_url_fields())


def event_url_params(events: DataFrame, start, end) -> DataFrame:
    """X3 over events: one row per event with the URL fields of ``event_params.page_location``."""
    located = in_date_range(events, start, end).select(
        "event_id", "event_date", F.col("event_params.page_location").alias("page_location"))
    return url_enrichment(located).select("event_id", "event_date", "page_location", *_flat_url_fields())


def transaction_totals(events: DataFrame, start, end) -> DataFrame:
    """Per transaction: purchase events, items, distinct items, revenue, first date,
    and the item totals: quantity, item revenue and the distinct coupons (sorted,
    comma-joined; null when none).

    One pass: items are exploded next to their event (``posexplode_outer``
    keeps events without items; only the item fields used are read) and only an event's first row carries the
    event-level measures. A single distinct aggregate plans as two
    partial-aggregation stages keyed (transaction, item) then transaction --
    no ``Expand``, and a hot transaction is spread over its items. Only
    fixed-width aggregation buffers are used, so it stays a hash
    aggregation (a string ``min`` would force a sort-based one); per-user
    figures are in :func:`running_totals`.
    """
    p = in_date_range(events, start, end).where(
        (F.col("event_name") == "purchase") & F.col("ecommerce.transaction_id").isNotNull())
    rows = p.select(
        F.col("ecommerce.transaction_id").alias("transaction_id"), "event_date",
        F.col("ecommerce.purchase_revenue").alias("purchase_revenue"),
        F.coalesce(F.size("items"), F.lit(0)).alias("n_items"),
        F.posexplode_outer(F.arrays_zip(*[
            F.col(f"items.{f}").alias(f) for f in ("item_id", "quantity", "item_revenue", "coupon")
        ])).alias("pos", "item"),
    ).withColumn("item_id", F.col("item.item_id"))
    coupons = F.array_sort(F.collect_set("item.coupon"))
    first = F.col("pos").isNull() | (F.col("pos") == 0)
    return rows.groupBy("transaction_id").agg(
        F.min("event_date").alias("transaction_date"),
        F.count_if(first).alias("purchase_events"),
        F.sum(F.when(first, F.col("n_items"))).cast("bigint").alias("total_items"),
        F.count_distinct("item_id").alias("unique_items"),
        money_sum(F.when(first, F.col("purchase_revenue"))).alias("revenue"),
        F.coalesce(F.sum("item.quantity"), F.lit(0)).cast("bigint").alias("item_quantity"),
        money_sum("item.item_revenue").alias("item_revenue"),
        F.nullif(F.array_join(coupons, ","), F.lit("")).alias("coupons"),
    ).select("transaction_id", "transaction_date", "purchase_events", "total_items",
             "unique_items", "revenue", "item_quantity", "item_revenue", "coupons")


def daily_purchases(events: DataFrame, start, end) -> DataFrame:
    """Purchases and revenue (exact decimal) per (user, day)."""
    p = in_date_range(events, start, end).where(F.col("event_name") == "purchase")
    return p.groupBy("user_pseudo_id", "event_date").agg(
        F.count(F.lit(1)).alias("purchases"),
        F.sum(F.col("ecommerce.purchase_revenue").cast("decimal(28,9)")).alias("revenue"))


def running_totals(events: DataFrame, start, end) -> DataFrame:
    """Per (user, day) purchases and revenue with running totals per user.

    Aggregating to user-day first bounds each window partition by the
    number of days in range, so a user with a huge share of events cannot
    overload one task.
    """
    daily = daily_purchases(events, start, end).withColumn("revenue", F.col("revenue").cast("double"))
    w = Window.partitionBy("user_pseudo_id").orderBy("event_date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumns({
        "cumulative_purchases": F.sum("purchases").over(w),
        "cumulative_revenue": F.sum(F.col("revenue").cast("decimal(28,9)")).over(w).cast("double"),
    }).select("user_pseudo_id", "event_date", "purchases", "revenue",
              "cumulative_purchases", "cumulative_revenue")


def session_metrics(events: DataFrame, start, end, dims=("event_date", "device_category"),
                    checkpoint: bool = True) -> DataFrame:
    """The three basic metrics -- distinct users, distinct sessions, events -- per segment.

    Events are first reduced to (segment, user, session) with their count
    (partial aggregation map-side); ``checkpoint`` writes that session grain
    once, and each distinct count reads only its own columns of it.
    """
    dims = list(dims)
    ev = in_date_range(events, start, end).select(
        "user_pseudo_id", "session_id", *[dim_expr(d).alias(d) for d in dims])
    grain = ev.groupBy(*dims, "user_pseudo_id", "session_id").agg(F.count(F.lit(1)).alias("n"))
    out = distinct_counts(materialize(grain, checkpoint), dims, [
        DistinctBranch("user_pseudo_id", {"users": None}, sums={"events": F.col("n")}, sum_types={"events": "bigint"}),
        DistinctBranch("session_id", {"sessions": None}),
    ])
    return order_by(out.select(*dims, "users", "sessions", "events"), dims)
