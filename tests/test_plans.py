"""Plan checks: pushdown, partition pruning, no Expand / Python, anti-join, one scan."""

import re
import tempfile

from pyspark.sql import functions as F

import __spark_entry__ as se
from clickflow.operators import abtest, funnel, item_params
from clickflow.plans.inspect import assert_no_python, has_operator, physical_plan, scan_count
from clickflow.sources.ga4 import read_ga4_tables, write_ga4_tables

S, E = "2024-01-01", "2024-01-31"


def test_no_python_in_any_registered_query(spark):
    for name, fn in se.queries().items():
        if name in se.CORPUS_QUERIES or name == "pipeline":
            continue  # these are checked by their own tests
        df = fn(spark, "/root/testdata/sf0.001")
        assert_no_python(df)
        plan = physical_plan(df)
        # bitmaps are aggregated in binary buffers, which no hash aggregate holds
        bitmaps = name in ("funnel_counts_rollup", "active_users_rolling")
        for bad in (*(["SortAggregate"] * (not bitmaps)), "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert bad not in plan, (name, bad)
        assert "Expand" not in plan, name


def test_anti_join_is_left_anti(tables001):
    ev = tables001.events
    iso = abtest.ab_isolate(abtest.ab_cohort(ev, "TABW131", S, E), ev, "TABW131", S, E)
    assert "LeftAnti" in physical_plan(iso)


def test_funnel_has_no_expand(tables001):
    t = tables001
    rep = funnel.funnel_by_segment(t.events, t.sessions, S, E, checkpoint=False)
    assert not has_operator(rep, "Expand")


def test_report_scans_events_once_with_checkpoint(tables001):
    t = tables001
    lazy = funnel.funnel_by_segment(t.events, t.sessions, S, E, checkpoint=False)
    assert scan_count(lazy, "events.parquet") >= 2  # two branches, two scans when not materialised
    done = funnel.funnel_by_segment(t.events, t.sessions, S, E, checkpoint=True)
    assert scan_count(done, "events.parquet") == 0  # reads the checkpoint instead


def test_partitioned_layout_prunes_and_pushes_down(spark, tables001):
    out = tempfile.mkdtemp(prefix="clickflow-ga4-")
    write_ga4_tables(tables001, out)
    t = read_ga4_tables(spark, out)
    base = funnel.base_events(t.events, t.sessions, "2024-01-05", "2024-01-07")
    plan = physical_plan(base)
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert "PushedFilters: [In(event_name" in plan
    # nested column pruning: only the used struct fields are read
    assert "device:struct<category:string>" in plan
    assert base.count() == funnel.base_events(tables001.events, tables001.sessions,
                                              "2024-01-05", "2024-01-07").count()


def test_explode_not_outer(tables001):
    """UNNEST in a comma join drops events without items: Generate(outer=false)."""
    parsed = item_params.parse_param(tables001.events, 1, S, E)
    gen = [ln for ln in physical_plan(parsed).splitlines() if "Generate explode(" in ln]
    assert len(gen) == 1
    assert re.search(r"\], false, \[i#\d+\]\s*$", gen[0])  # Generate(..., outer=false, [i])


def test_item_parsing_is_narrow(tables001):
    parsed = item_params.parse_items(tables001.events, S, E)
    plan = physical_plan(parsed)
    # the only exchange is the round-robin spread of the single-row-group test file
    assert plan.count("Exchange") <= 1 and "hashpartitioning" not in plan


def test_nested_pruning_through_explode(spark, tables001):
    out = tempfile.mkdtemp(prefix="clickflow-ga4-")
    write_ga4_tables(tables001, out)
    ev = read_ga4_tables(spark, out).events
    parsed = ev.select(F.explode("items").alias("i")).select("i.item_id")
    plan = physical_plan(parsed)
    assert "ReadSchema: struct<items:array<struct<item_id:string>>>" in plan


def test_parsers_read_only_used_item_fields(spark, tables001):
    out = tempfile.mkdtemp(prefix="clickflow-ga4-")
    write_ga4_tables(tables001, out)
    ev = read_ga4_tables(spark, out).events
    plan = physical_plan(item_params.parse_param(ev, 5, S, E))
    schema = re.search(r"ReadSchema: (struct<.*)", plan).group(1)
    assert "items:array<struct<item_id:string,item_params_custom:struct<item_parameter_5:string>>>" in schema
    assert "item_params:" not in schema and "item_parameter_1" not in schema


def test_opt_in_session_dates_prune_sessions_scan(spark, tables001):
    out = tempfile.mkdtemp(prefix="clickflow-ga4-")
    write_ga4_tables(tables001, out)
    t = read_ga4_tables(spark, out)
    pivot = funnel.funnel_pivot(t.events, t.sessions, "2024-01-10", "2024-01-12",
                                session_dates=("2024-01-01", "2024-01-12"))
    plan = physical_plan(pivot)
    assert "PartitionFilters: [isnotnull(session_date" in plan
    default = funnel.funnel_pivot(t.events, t.sessions, "2024-01-10", "2024-01-12")
    assert "PartitionFilters: [isnotnull(session_date" not in physical_plan(default)
    # with a range covering every session the result is unchanged
    assert pivot.exceptAll(default).count() == 0 and default.exceptAll(pivot).count() == 0


def test_materialized_table_is_read_per_branch_columns(spark, tables001):
    from clickflow.plans.materialize import drop_materialized
    t = tables001
    rep = funnel.funnel_by_segment(t.events, t.sessions, S, E)
    plan = physical_plan(rep)
    schemas = re.findall(r"ReadSchema: (struct<[^\n]*?>)(?:,|\n|$)", plan)
    assert len(schemas) == 2  # one read per branch of the materialised pivot
    counts_side = [x for x in schemas if "step_session_start" in x]
    median_side = [x for x in schemas if "ts_session_start" in x]
    assert counts_side and "ts_" not in counts_side[0]
    assert median_side and "step_" not in median_side[0] and "user_pseudo_id" not in median_side[0]
    assert rep.count() == 30
    assert drop_materialized(spark)


def test_partitioned_writes_rebalance_by_day(tables001):
    from clickflow.sources.ga4 import events_write_layout
    plan = physical_plan(events_write_layout(tables001.events))
    assert "REBALANCE_PARTITIONS_BY_COL" in plan and "hashpartitioning(event_date" in plan
    assert "Sort [event_date" in plan


def test_the_layout_shuffles_flat_rows(spark, tables001, monkeypatch):
    """Day shuffle and sort of the derived events come before their nested columns are built."""
    from clickflow.sources import ga4
    from clickflow_fixtures import adapter

    plans, layout = [], ga4.events_write_layout

    def seen(*args, **kwargs):
        out = layout(*args, **kwargs)
        plans.append(physical_plan(out))
        return out

    monkeypatch.setattr(ga4, "events_write_layout", seen)
    monkeypatch.setattr(adapter, "_WRITTEN", {})
    events = adapter.ga4_tables_materialized(spark, "/root/testdata/sf0.001").events
    (plan,) = plans
    above, below = plan.split("Exchange hashpartitioning(event_date", 1)
    assert "Sort [event_date" in above and "item_parameter_1" in above
    assert "item_parameter_1" not in below
    names = tables001.events.columns
    assert sorted(map(str, events.select(*names).collect())) == sorted(map(str, tables001.events.collect()))
    # days as partitions, rows of a file in the order of the layout
    keys = ["event_date", "event_name", "session_id"]
    files = {}
    for r in events.select("_metadata.file_path", "_metadata.file_block_start", *keys, F.monotonically_increasing_id().alias("n")) \
            .orderBy("n").collect():
        files.setdefault((r["file_path"], r["file_block_start"]), []).append(tuple(r[k] for k in keys))
    assert all(found == sorted(found) for found in files.values())
