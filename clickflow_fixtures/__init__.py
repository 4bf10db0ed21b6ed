"""Test data for the library: GA4 tables and CRM exports from the given tables, and the expected results as DuckDB SQL."""
