"""Physical-plan checks used by tests and when tuning a query.

They read Spark's own plan strings (``explain`` output); nothing here
re-implements planning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def physical_plan(df: DataFrame) -> str:
    """The executed physical plan as text (adaptive plans show their initial form)."""
    return df._jdf.queryExecution().executedPlan().toString()


def optimized_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def has_operator(df: DataFrame, name: str) -> bool:
    return name in physical_plan(df)


def scan_count(df: DataFrame, path_fragment: str) -> int:
    """How many file scans of ``path_fragment`` the physical plan holds."""
    plan = physical_plan(df)
    return sum(1 for line in plan.splitlines() if "FileScan" in line and path_fragment in line)


def assert_no_python(df: DataFrame) -> None:
    plan = physical_plan(df)
    for op in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas", "MapInPandas"):
        if op in plan:
            raise AssertionError(f"plan runs Python ({op})")
