"""Property test: the segmented funnel report against a plain-Python brute force.

Random events (null users, several devices and session numbers), a sessions
table with missing sessions, duplicate rows and null channels. The brute
force follows the report's rules directly: left join on session (duplicates
fan out), pivot per (user, session, device, user type, channel) with step
flags and first timestamps, distinct users per step per segment, lower median
of minutes between first steps, and SAFE_DIVIDE rates.
"""

import math
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clickflow.operators import funnel

STEP_NAMES = [e for e, _ in funnel.FUNNEL_STEPS] + ["select_item", "page_view"]
EVENT = st.tuples(
    st.one_of(st.none(), st.sampled_from(["u1", "u2", "u3", "u4"])),  # user
    st.sampled_from(["s1", "s2", "s3", "s4", "s5"]),                   # session
    st.sampled_from(STEP_NAMES),
    st.integers(0, 5_000_000_000),                                     # micros
    st.sampled_from(["desktop", "mobile"]),
    st.one_of(st.none(), st.integers(1, 3)),                           # ga_session_number
)
SESSION = st.tuples(st.sampled_from(["s1", "s2", "s3", "s4", "s6"]),
                    st.one_of(st.none(), st.sampled_from(["Direct", "Email"])))


def _brute(events, sessions):
    chans = defaultdict(list)
    for sid, ch in sessions:
        chans[sid].append(ch)
    rows = []  # base events after the left join
    for user, sid, name, ts, dev, num in events:
        if name not in dict(funnel.FUNNEL_STEPS):
            continue
        ut = "New" if num == 1 else "Returning"
        for ch in (chans[sid] or [None]):
            rows.append((user, sid, dev, ut, ch, name, ts))
    pivot = {}
    for user, sid, dev, ut, ch, name, ts in rows:
        p = pivot.setdefault((user, sid, dev, ut, ch), {})
        p[name] = min(p.get(name, ts), ts)
    segs = defaultdict(lambda: {"users": defaultdict(set), "gaps": defaultdict(list)})
    for (user, sid, dev, ut, ch), first in pivot.items():
        seg = segs[(dev, ut, ch)]
        for ev, sfx in funnel.FUNNEL_STEPS:
            if ev in first and user is not None:
                seg["users"][sfx].add(user)
        for g, a, b in funnel.MEDIAN_GAPS:
            ea = dict((s, e) for e, s in funnel.FUNNEL_STEPS)[a]
            eb = dict((s, e) for e, s in funnel.FUNNEL_STEPS)[b]
            if ea in first and eb in first:
                seg["gaps"][g].append((first[eb] - first[ea]) / 60_000_000)
    out = {}
    for key, seg in segs.items():
        r = {f"users_{s}": len(seg["users"][s]) for _, s in funnel.FUNNEL_STEPS}
        for g, _, _ in funnel.MEDIAN_GAPS:
            vals = sorted(seg["gaps"][g])
            r[f"median_min_{g}"] = vals[(len(vals) - 1) // 2] if vals else None
        u = lambda s: r[f"users_{s}"]
        sd = lambda a, b: None if b == 0 else a / b
        for name, num, den in funnel.STEP_RATES:
            r[name] = sd(u(num), u(den))
        for name, num in funnel.OVERALL_RATES:
            r[name] = sd(u(num), u("session_start"))
        for name, num, den in funnel.DROPOFFS:
            v = sd(u(num), u(den))
            r[name] = None if v is None else 1 - v
        out[key] = r
    return out


@settings(max_examples=10, deadline=None)
@given(st.lists(EVENT, min_size=1, max_size=40), st.lists(SESSION, max_size=8))
def test_funnel_report_matches_brute_force(spark, events, sessions):
    ev = spark.createDataFrame(
        events, "user_pseudo_id string, session_id string, event_name string, ts long, dev string, num long"
    ).select(
        F.lit("2024-01-05").cast("date").alias("event_date"), "event_name", "session_id", "user_pseudo_id",
        F.struct(F.col("ts").alias("event_timestamp")).alias("time"),
        F.struct(F.col("dev").alias("category")).alias("device"),
        F.struct(F.col("num").alias("ga_session_number")).alias("event_params"),
    )
    ses = spark.createDataFrame(sessions or [("none", None)], "session_id string, channel string").select(
        "session_id", F.struct(F.col("channel").alias("default_channel_grouping")).alias("last_non_direct_traffic_source"))
    got = {(r["device_category"], r["user_type"], r["channel"]): r.asDict()
           for r in funnel.funnel_by_segment(ev, ses, "2024-01-01", "2024-01-31").collect()}
    want = _brute(events, sessions)
    assert set(got) == set(want)
    for key, w in want.items():
        for col, v in w.items():
            g = got[key][col]
            if v is None or g is None:
                assert v is None and g is None, (key, col, g, v)
            else:
                assert math.isclose(g, v, rel_tol=1e-12, abs_tol=1e-12), (key, col, g, v)
