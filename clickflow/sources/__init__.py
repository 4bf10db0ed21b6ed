"""Table sources and sinks: GA4 tables (readers, partitioned writer, test-data
adapter) and CRM exports."""
