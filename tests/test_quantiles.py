"""Exact quantiles by rank selection: equal to DuckDB's ``quantile_disc`` on groups of any size and shape."""

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clickflow.operators import funnel
from clickflow.operators.quantiles import exact_quantiles

S, E = "2024-01-01", "2024-01-31"


def disc(rows, q):
    """rows: (group, value) -> {group: lower quantile}."""
    groups = {}
    for g, v in rows:
        groups.setdefault(g, [])
        if v is not None:
            groups[g].append(v)
    return {g: sorted(v)[max(1, -int(-len(v) * q // 1)) - 1] if v else None for g, v in groups.items()}


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_groups_far_larger_than_the_sketch_accuracy(spark, q):
    """300,000 values a group, long-tailed: a sketch of accuracy 100 misses what rank selection hits."""
    n = 600_000
    df = spark.range(n).select((F.col("id") % 2).alias("g"), F.pmod(F.xxhash64("id"), F.lit(10**6)).alias("u")).select(
        "g", (F.pow(F.col("u") / 1000.0, 4)).cast("long").alias("a"), (1 / (F.col("u") + 1)).alias("b"))
    got = {r["g"]: (r["x"], r["y"]) for r in exact_quantiles(df, ["g"], {"x": F.col("a"), "y": F.col("b")}, q).collect()}
    held = df.toArrow()  # noqa: F841 - read by DuckDB
    want = duckdb.sql(f"select g, quantile_disc(a, {q}), quantile_disc(b, {q}) from held group by g").fetchall()
    assert got == {g: (a, b) for g, a, b in want}


def test_sketch_differs_where_selection_is_exact(spark):
    df = spark.range(200_000).select(F.lit(1).alias("g"), F.pow(F.pmod(F.xxhash64("id"), F.lit(10**9)) / 1e3, 2).cast("long").alias("v"))
    exact = exact_quantiles(df, ["g"], {"m": F.col("v")}).first()["m"]
    ranks = df.agg(F.count_if(F.col("v") < exact), F.count_if(F.col("v") <= exact)).first()
    assert ranks[0] < 100_000 <= ranks[1]
    assert df.agg(F.percentile_approx("v", 0.5, 20)).first()[0] != exact


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(st.tuples(st.sampled_from(["a", "b", None]),
                               st.one_of(st.none(), st.integers(-5, 5), st.integers(-2**40, 2**40))), max_size=40),
       q=st.sampled_from([0.0, 0.3, 0.5, 1.0]))
def test_any_rows(spark, rows, q):
    df = spark.createDataFrame(rows, "g string, v long")
    got = {r["g"]: r["m"] for r in exact_quantiles(df, ["g"], {"m": F.col("v")}, q, bins=4).collect()}
    assert got == disc(rows, q)


def test_no_keys_nulls_ties_and_empty(spark):
    df = spark.createDataFrame([(None, 1.5), (3, None), (3, 2.5), (3, 2.5), (3, -1.0)], "g int, v double")
    assert exact_quantiles(df, [], {"m": F.col("v"), "g": F.col("g").cast("double")}).collect() == [(1.5, 3.0)]
    assert exact_quantiles(df.limit(0), ["g"], {"m": F.col("v")}).collect() == []
    assert {tuple(r) for r in exact_quantiles(df, ["g"], {"m": F.col("v")}).collect()} == {(None, 1.5), (3, 2.5)}
    with pytest.raises(ValueError):
        exact_quantiles(df, ["g"], {"m": F.col("v")}, 1.5)


def test_funnel_long_accuracy_is_an_argument(spark, tables001):
    t = tables001
    exact = funnel.funnel_steps_long(t.events, t.sessions, S, E, exact_medians=True).collect()
    assert exact == funnel.funnel_steps_long(t.events, t.sessions, S, E).collect()  # small groups: the sketch is exact
    assert exact != funnel.funnel_steps_long(t.events, t.sessions, S, E, accuracy=1).collect()
