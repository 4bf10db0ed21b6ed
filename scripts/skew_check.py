"""Skew check: how much of each shuffle the busiest task reads, with one hot user.

Usage: python scripts/skew_check.py [sf_dir]

Derives a skewed copy of the given ``events`` table -- a third of all rows are
moved to one user on one day, so one user, one session and one day partition
each hold a third of the events -- writes it in the GA4 layout, runs the main operators, and reads Spark's event log (written to a
fresh scratch folder) to report, per shuffle-reading stage, the largest share
of shuffle records that a single task read. AQE partition coalescing is off so
the hash layout is visible. The textbook funnel (join events to sessions, then
pivot) is included for contrast: it shuffles raw events by session.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from clickflow.operators import abtest, enrich, funnel  # noqa: E402
from clickflow.session import BASE_CONF  # noqa: E402
from clickflow.sources.ga4 import read_ga4_tables, read_source, spread, write_ga4_tables  # noqa: E402
from clickflow_fixtures.adapter import ga4_from_events  # noqa: E402

S, E = "2024-01-01", "2024-01-31"
MIN_RECORDS = 1000


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    scratch = tempfile.mkdtemp(prefix="clickflow-skew-")
    logs = os.path.join(scratch, "eventlog")
    os.makedirs(logs)
    b = SparkSession.builder.master("local[8]").appName("clickflow-skew")
    conf = dict(BASE_CONF)
    conf.update({
        "spark.eventLog.enabled": "true",
        "spark.eventLog.dir": logs,
        "spark.eventLog.compress": "false",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        # joins shuffle, as they do when both sides are large
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        # local data is small; let AQE treat a 1 MB partition as skewed
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1m",
        "spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
    })
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.sparkContext.setCheckpointDir(conf["spark.checkpoint.dir"])

    raw = read_source(spark, sf_dir, "events")
    # A third of the rows: one user, moved to the first day (keeping the time of
    # day), so one session, one user and one day partition each hold a third.
    pick = F.col("event_id") % 3 == 0
    first_day = F.make_dt_interval(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")))
    hot = raw.withColumns({
        "user_id": F.when(pick, F.lit(0)).otherwise(F.col("user_id")),
        "ts": F.when(pick, F.col("ts") - first_day).otherwise(F.col("ts")),
    })
    layout = os.path.join(scratch, "ga4")
    spark.sparkContext.setJobGroup("write_ga4_layout", "write_ga4_layout")
    write_ga4_tables(ga4_from_events(spread(hot)), layout)
    t = read_ga4_tables(spark, layout)

    runs = {
        "write_ga4_layout": None,
        "funnel_textbook_join_then_pivot": lambda: funnel.session_step_pivot(
            funnel.base_events(t.events, t.sessions, S, E)),
        "funnel_by_segment": lambda: funnel.funnel_by_segment(t.events, t.sessions, S, E),
        "ab_report": lambda: abtest.ab_report(t.events, "TABW131", S, E),
        "transaction_totals": lambda: enrich.transaction_totals(t.events, S, E),
        "running_totals": lambda: enrich.running_totals(t.events, S, E),
        "session_metrics": lambda: enrich.session_metrics(t.events, S, E),
    }
    for name, build in runs.items():
        if build is None:
            continue
        spark.sparkContext.setJobGroup(name, name)
        build().write.format("noop").mode("overwrite").save()
    spark.stop()

    stage_group, task_records = {}, defaultdict(list)
    for path in sorted(glob.glob(os.path.join(logs, "**", "*"), recursive=True)):
        if os.path.isdir(path):
            continue
        with open(path) as f:
            for line in f:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in ev.get("Stage IDs", []):
                        stage_group[sid] = group
                elif kind == "SparkListenerTaskEnd":
                    m = ev.get("Task Metrics") or {}
                    rec = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                    task_records[ev["Stage ID"]].append(rec)
    report = defaultdict(list)
    for sid, recs in sorted(task_records.items()):
        total = sum(recs)
        if total == 0 or stage_group.get(sid) not in runs:
            continue
        report[stage_group[sid]].append((sid, total, max(recs), round(max(recs) / total, 3)))
    print(f"one user / session / day holds a third of all events; event log in {logs}")
    for name in runs:
        # final single-row merges (a count, a global aggregate) read a handful of
        # records in one task by design; judge only stages with real volume
        big = [r for r in report[name] if r[1] >= MIN_RECORDS]
        worst = max((r[3] for r in big), default=0.0)
        print(f"{name:34s} worst task share of a shuffle with >= {MIN_RECORDS} records = {worst:.3f}")
        for sid, total, mx, share in report[name]:
            print(f"    stage {sid:4d} shuffle records {total:9d}  busiest task {mx:8d}  share {share:.3f}")


if __name__ == "__main__":
    main()
