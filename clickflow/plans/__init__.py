"""Plan-level helpers: one-time materialisation of shared intermediates, physical-plan
checks, and the DuckDB oracle SQL for the registered queries."""
