"""Report operators over GA4-shaped DataFrames: funnel, A/B test, item-parameter
parsing, CRM reconciliation, enrichment, and the exact multi-distinct helper."""
