"""

Every query reads the given test tables (``events``, ``pages``) through the
GA4 adapter in ``clickflow_fixtures.adapter`` and runs over the whole table: the
date range below covers every event in the generated data.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Importable from any working directory (the package sits next to this file).
# The analytics part runs no Python on executors; the corpus operators' functions are pickled by value.
_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from clickflow.operators import abtest, enrich, funnel, item_params, reconcile, rollups, running
from clickflow.plans.materialize import materialize
from clickflow.session import ensure_checkpoint_dir
from clickflow.sources.bucketed import write_bucketed, write_bucketed_sessions
from clickflow.sources.ga4 import read_source
from clickflow.streaming.daily import start_daily_refresh
from clickflow_fixtures.adapter import ga4_events_from_flat, ga4_flat_events, ga4_tables_folder, ga4_tables_materialized
from clickflow_fixtures.crm import crm_export_from_events, write_crm_csv, write_untidy_crm_csv
from clickflow_fixtures.oracle import END, ORACLE_SQL, START

try:  # the corpus operators and their pipeline are an optional part
    import corpus_pipeline
    from clickflow.llm.queries import ORACLE_SQL as CORPUS_ORACLE_SQL
    from clickflow.llm.queries import QUERIES as CORPUS_QUERIES
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "clickflow.llm"):
        raise
    corpus_pipeline, CORPUS_QUERIES, CORPUS_ORACLE_SQL = None, {}, {}

TEST_ID = "TABW131"
SMOKE_DIR = "/root/testdata/sf0.001"


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the segmented funnel report on sf0.001."""
    return _funnel_by_segment(spark, SMOKE_DIR)


def _t(spark, sf_dir):
    """GA4 tables derived from the given ``events`` table, in the partitioned layout."""
    return ga4_tables_materialized(spark, sf_dir)


# --- funnel -----------------------------------------------------------------

def _funnel_by_segment(spark, d):
    t = _t(spark, d)
    return funnel.funnel_by_segment(t.events, t.sessions, START, END)


def _funnel_pivot(spark, d):
    t = _t(spark, d)
    return funnel.funnel_pivot(t.events, t.sessions, START, END)


def _funnel_counts(spark, d):
    return funnel.funnel_counts(_funnel_pivot(spark, d), list(funnel.DEFAULT_DIMS)).orderBy(*funnel.DEFAULT_DIMS)


def _funnel_medians(spark, d):
    return funnel.funnel_medians(_funnel_pivot(spark, d)).orderBy(*funnel.DEFAULT_DIMS)


def _funnel_by_segment_exact(spark, d):
    """U5 with medians selected by rank."""
    t = _t(spark, d)
    return funnel.funnel_by_segment(t.events, t.sessions, START, END, exact_medians=True)


def _funnel_medians_exact(spark, d):
    """Exact medians for groups of any size."""
    return funnel.funnel_medians_exact(_funnel_pivot(spark, d)).orderBy(*funnel.DEFAULT_DIMS)


def _funnel_long_exact(spark, d):
    t = _t(spark, d)
    return funnel.funnel_steps_long(t.events, t.sessions, START, END, exact_medians=True)


def _bucketed_folder(spark):
    """A folder and a table name prefix of their own."""
    tag = uuid.uuid4().hex[:12]
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/bucketed-{tag}", f"clickflow_{tag}"


def _funnel_session_pivot_bucketed(spark, d):
    """U2 / J1 over events and sessions bucketed by session."""
    path, prefix = _bucketed_folder(spark)
    flat = replace(_t(spark, d), events=ga4_flat_events(spark, d))
    events, sessions = write_bucketed_sessions(flat, prefix, path, buckets=8, shape=ga4_events_from_flat)
    return funnel.funnel_pivot_bucketed(events, sessions, START, END)


def _ab_events_bucketed(spark, d):
    """U15 / J3 over events bucketed by user."""
    path, prefix = _bucketed_folder(spark)
    ev = write_bucketed(ga4_flat_events(spark, d), f"{prefix}_events_by_user", path, "user_pseudo_id", buckets=8,
                        shape=ga4_events_from_flat).rows
    return abtest.ab_events(ev, abtest.ab_isolated_cohort(ev, TEST_ID, START, END), START, END)


def _user_rollup(spark, d):
    """The bitmap roll-up of all days, made in two refreshes that share a day."""
    t = _t(spark, d)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/user-rollup-{uuid.uuid4().hex[:12]}"
    rollups.refresh_rollup(t.events, t.sessions, path, START, "2024-01-15")
    return rollups.refresh_rollup(t.events, t.sessions, path, "2024-01-15", END)


def _funnel_counts_rollup(spark, d):
    """Distinct users of the range from the roll-up alone."""
    return rollups.rollup_counts(_user_rollup(spark, d), START, END).orderBy(*funnel.DEFAULT_DIMS)


def _active_users(spark, d):
    """Distinct users of every day and of the seven days up to it, from the roll-up alone."""
    return rollups.active_users(_user_rollup(spark, d), START, END).orderBy("event_date", "device_category")


def _funnel_rates(spark, d):
    counts = funnel.funnel_counts(_funnel_pivot(spark, d), list(funnel.DEFAULT_DIMS))
    return funnel.funnel_rates(counts).orderBy(*funnel.DEFAULT_DIMS)


def _funnel_base_events(spark, d):
    t = _t(spark, d)
    return funnel.base_events(t.events, t.sessions, START, END)


def _funnel_session_pivot(spark, d):
    return _funnel_pivot(spark, d)


def _funnel_long(spark, d):
    t = _t(spark, d)
    return funnel.funnel_steps_long(t.events, t.sessions, START, END)


def _funnel_by_country(spark, d):
    t = _t(spark, d)
    return funnel.funnel_by_segment(t.events, t.sessions, START, END, dims=("device_category", "country"))


def _site_events(spark, d):
    """Events with the site of their stream (the region table serves as the lookup)."""
    lookup = read_source(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("stream_id"), F.col("r_name").alias("site"))
    return funnel.with_site(_t(spark, d).events, lookup)


def _funnel_by_site(spark, d):
    return funnel.funnel_by_segment(_site_events(spark, d), _t(spark, d).sessions, START, END, dims=("site",))


def _listing_dedup_by_site(spark, d):
    return funnel.listing_sessions_dedup(_site_events(spark, d), START, END, dims=("site",))


def _listing_dedup(spark, d):
    return funnel.listing_sessions_dedup(_t(spark, d).events, START, END)


# --- item parameters ----------------------------------------------------------

def _parser(n: int, source: str = "custom", mode: str = "reference"):
    def q(spark, d):
        return item_params.parse_param(_t(spark, d).events, n, START, END, source=source, mode=mode)
    return q


def _parse_prices_view_item(spark, d):
    """P10: parsed prices of product-page views (the filter reaches the scan)."""
    ev = _t(spark, d).events.where("event_name = 'view_item'")
    return item_params.parse_param(ev, 1, START, END)


def _parse_all(spark, d):
    return item_params.parse_items(_t(spark, d).events, START, END)


def _parse_all_checked(spark, d):
    """The same with a lookup that fails on duplicate keys."""
    return item_params.parse_items(_t(spark, d).events, START, END, source="raw", on_duplicate="raise")


def _parse_all_raw(spark, d):
    """Every parameter from the raw key/value arrays."""
    return item_params.parse_items(_t(spark, d).events, START, END, source="raw")


# --- A/B ----------------------------------------------------------------------

def _ab_cohort(spark, d):
    return abtest.ab_cohort(_t(spark, d).events, TEST_ID, START, END)


def _ab_cohort_items(spark, d):
    """U13 from the items' ``item_parameter_20``."""
    return abtest.ab_cohort_from_items(_t(spark, d).events, TEST_ID, START, END)


def _ab_isolated(spark, d):
    return abtest.ab_isolated_cohort(_t(spark, d).events, TEST_ID, START, END)


def _ab_isolated_antijoin(spark, d):
    ev = _t(spark, d).events
    return abtest.ab_isolate(abtest.ab_cohort(ev, TEST_ID, START, END), ev, TEST_ID, START, END)


def _ab_contamination(spark, d):
    return abtest.ab_contamination(abtest.ab_isolated_cohort(_t(spark, d).events, TEST_ID, START, END))


def _ab_events(spark, d):
    ev = _t(spark, d).events
    return abtest.ab_events(ev, abtest.ab_isolated_cohort(ev, TEST_ID, START, END), START, END)


def _ab_grain(spark, d):
    ev = _t(spark, d).events
    cohort = materialize(abtest.ab_isolated_cohort(ev, TEST_ID, START, END), how="checkpoint")
    return materialize(abtest.ab_session_grain(ev, cohort, START, END))


def _ab_split(spark, d):
    return abtest.split_check(_ab_grain(spark, d)).orderBy("test_group")


def _ab_metrics(spark, d):
    return abtest.ab_metrics(_ab_grain(spark, d)).orderBy("test_group", "device_category")


def _ab_report(spark, d):
    return abtest.ab_report(_t(spark, d).events, TEST_ID, START, END)


def _ab_ztest(spark, d):
    return abtest.ab_ztest(_t(spark, d).events, TEST_ID, START, END)


# --- reconciliation -------------------------------------------------------------

def _ga4_daily(spark, d):
    return reconcile.ga4_daily(_t(spark, d).transactions, START, END)


def _ga4_daily_incremental(spark, d):
    """U21 kept up to date by the incremental refresh stream, read back as a table.

    The transactions derived from ``events`` are the incremental source; one
    ``availableNow`` run of the stream refreshes every day it finds.
    """
    transactions = f"{ga4_tables_folder(spark, d)}/ga4_transactions"
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/daily-refresh-{uuid.uuid4().hex[:12]}"
    start_daily_refresh(spark, transactions, f"{base}/daily", f"{base}/stream-checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/daily").select("date", "ga4_transactions", "ga4_revenue")


def _crm_daily(spark, d):
    return reconcile.normalize_crm(crm_export_from_events(read_source(spark, d, "events")))


def _crm_daily_csv(spark, d):
    """The CRM export as a CSV file in the shared folder, read back with ``load_crm``."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/crm-export-{uuid.uuid4().hex[:12]}.csv"
    write_crm_csv(crm_export_from_events(read_source(spark, d, "events")), path)
    return reconcile.load_crm(spark, path)


def _crm_daily_inferred(spark, d):
    """An export with dates as ``15.01.2024`` and rows of too many fields, which are skipped."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/crm-export-{uuid.uuid4().hex[:12]}"
    write_untidy_crm_csv(crm_export_from_events(read_source(spark, d, "events")), path)
    return reconcile.load_crm(spark, path, malformed="skip")


def _crm_malformed_rows(spark, d):
    """The report of such rows."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/crm-export-{uuid.uuid4().hex[:12]}"
    write_untidy_crm_csv(crm_export_from_events(read_source(spark, d, "events")), path)
    return reconcile.malformed_rows(spark, path).select("record", "fields")


def _reconcile(spark, d):
    return reconcile.reconcile(_ga4_daily(spark, d), _crm_daily(spark, d))


def _reconcile_summary(spark, d):
    return reconcile.reconcile_summary(_reconcile(spark, d))


def _reconcile_flagged(spark, d):
    return reconcile.flagged_days(_reconcile(spark, d), "trans")


def _reconcile_flagged_revenue(spark, d):
    return reconcile.flagged_days(_reconcile(spark, d), "rev")


def _reconcile_csv_roundtrip(spark, d):
    """The daily comparison written as CSV and read back."""
    rec = _reconcile(spark, d)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/reconcile-{uuid.uuid4().hex[:12]}.csv"
    reconcile.write_report_csv(rec, path)
    return spark.read.schema(rec.schema).option("header", True).csv(path)


def _ga4_daily_default_range(spark, d):
    """The default range, seen from the day after the data's last full month."""
    return reconcile.ga4_daily(_t(spark, d).transactions, *reconcile.default_date_range(date(2024, 2, 1)))


# --- extensions -----------------------------------------------------------------

def _url_params(spark, d):
    return enrich.page_url_params(read_source(spark, d, "pages"))


def _event_url_params(spark, d):
    return enrich.event_url_params(_t(spark, d).events, START, END)


def _promoted_params(spark, d):
    """Configured event and item parameters as typed columns."""
    return item_params.promoted_params(
        _t(spark, d).events, ["page_type", ("engagement_time_msec", "int"), ("scroll_share", "double")],
        ["item_parameter_1", ("item_parameter_25", "string"), ("position", "int")], START, END)


def _transaction_totals(spark, d):
    return enrich.transaction_totals(_t(spark, d).events, START, END)


def _running_totals(spark, d):
    return enrich.running_totals(_t(spark, d).events, START, END)


def _running_totals_carried(spark, d):
    """X4 day by day: three refreshes on top of the carry, the last days once more for late data."""
    ev = _t(spark, d).events
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/running-totals-{uuid.uuid4().hex[:12]}"
    for start, end in ((START, "2024-01-10"), ("2024-01-11", "2024-01-20"), ("2024-01-21", "2024-01-25")):
        running.refresh_running_totals(ev, path, start, end)
    return running.refresh_running_totals(ev, path, "2024-01-21", END)


def _param_types(spark, d):
    """Parameter keys and the types seen of each."""
    return item_params.all_param_types(_t(spark, d).events, START, END).orderBy("level", "key")


def _inferred_params(spark, d):
    """X5 without a configuration."""
    return item_params.inferred_params(_t(spark, d).events, START, END)


def _session_metrics(spark, d):
    return enrich.session_metrics(_t(spark, d).events, START, END)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    corpus = dict(CORPUS_QUERIES) if corpus_pipeline is None else {**CORPUS_QUERIES, "pipeline": corpus_pipeline.run}
    return {
        "funnel_by_segment": _funnel_by_segment,
        "funnel_counts": _funnel_counts,
        "funnel_medians": _funnel_medians,
        "funnel_by_segment_exact": _funnel_by_segment_exact,
        "funnel_medians_exact": _funnel_medians_exact,
        "funnel_long_exact": _funnel_long_exact,
        "funnel_session_pivot_bucketed": _funnel_session_pivot_bucketed,
        "ab_events_bucketed": _ab_events_bucketed,
        "funnel_counts_rollup": _funnel_counts_rollup,
        "active_users_rolling": _active_users,
        "funnel_rates": _funnel_rates,
        "funnel_base_events": _funnel_base_events,
        "funnel_session_pivot": _funnel_session_pivot,
        "funnel_long": _funnel_long,
        "funnel_by_country": _funnel_by_country,
        "funnel_by_site": _funnel_by_site,
        "listing_sessions_dedup": _listing_dedup,
        "listing_sessions_dedup_by_site": _listing_dedup_by_site,
        "parse_prices": _parser(1),
        "parse_prices_raw": _parser(1, source="raw"),
        "parse_trip": _parser(5),
        "parse_participants": _parser(9),
        "parse_cross_sell_availability": _parser(19),
        "parse_ab_item": _parser(20),
        "parse_ab_item_strict": _parser(20, mode="strict"),
        "parse_cross_sell_selected": _parser(25),
        "parse_prices_view_item": _parse_prices_view_item,
        "parse_items_all": _parse_all,
        "parse_items_raw": _parse_all_raw,
        "parse_items_checked": _parse_all_checked,
        "ab_cohort": _ab_cohort,
        "ab_cohort_items": _ab_cohort_items,
        "ab_isolated": _ab_isolated,
        "ab_isolated_antijoin": _ab_isolated_antijoin,
        "ab_events": _ab_events,
        "ab_contamination": _ab_contamination,
        "ab_split_check": _ab_split,
        "ab_metrics": _ab_metrics,
        "ab_report": _ab_report,
        "ab_ztest": _ab_ztest,
        "ga4_daily": _ga4_daily,
        "ga4_daily_incremental": _ga4_daily_incremental,
        "crm_daily": _crm_daily,
        "crm_daily_csv": _crm_daily_csv,
        "crm_daily_inferred": _crm_daily_inferred,
        "crm_malformed_rows": _crm_malformed_rows,
        "reconcile": _reconcile,
        "reconcile_summary": _reconcile_summary,
        "reconcile_flagged_days": _reconcile_flagged,
        "reconcile_flagged_revenue": _reconcile_flagged_revenue,
        "reconcile_csv_roundtrip": _reconcile_csv_roundtrip,
        "ga4_daily_default_range": _ga4_daily_default_range,
        "url_params": _url_params,
        "event_url_params": _event_url_params,
        "promoted_params": _promoted_params,
        "transaction_totals": _transaction_totals,
        "running_totals": _running_totals,
        "running_totals_carried": _running_totals_carried,
        "param_types": _param_types,
        "inferred_params": _inferred_params,
        "session_metrics": _session_metrics,
        **corpus,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for each key of ``queries()`` (same column names)."""
    return {**ORACLE_SQL, **CORPUS_ORACLE_SQL}
