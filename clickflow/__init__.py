"""Spark-native clickstream analytics: funnels, A/B tests, item-parameter parsing
and analytics-vs-CRM reconciliation on GA4-shaped event tables.

The main entry points are re-exported here; every function takes and returns
Spark DataFrames.
"""

from clickflow.operators.abtest import ab_report, ab_ztest, two_proportion_z
from clickflow.operators.enrich import running_totals, session_metrics, transaction_totals, url_enrichment
from clickflow.operators.funnel import funnel_by_segment, funnel_steps_long, listing_sessions_dedup
from clickflow.operators.item_params import parse_items, parse_param
from clickflow.operators.reconcile import load_crm, reconcile, reconcile_job, reconcile_summary
from clickflow.sources.ga4 import read_ga4_tables, write_ga4_tables

__version__ = "0.1.0"

__all__ = [
    "ab_report", "ab_ztest", "two_proportion_z",
    "funnel_by_segment", "funnel_steps_long", "listing_sessions_dedup",
    "parse_items", "parse_param",
    "load_crm", "reconcile", "reconcile_job", "reconcile_summary",
    "running_totals", "session_metrics", "transaction_totals", "url_enrichment",
    "read_ga4_tables", "write_ga4_tables",
]
