"""Property test: transaction totals, running totals and session metrics against brute force."""

import datetime as dt
import math
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clickflow.operators import enrich

D0 = dt.date(2024, 1, 1)
EVENT = st.tuples(
    st.one_of(st.none(), st.sampled_from(["u1", "u2", "u3"])),      # user
    st.sampled_from(["s1", "s2", "s3", "s4"]),                        # session
    st.integers(0, 4),                                               # day offset
    st.sampled_from(["purchase", "view_item", "session_start"]),
    st.one_of(st.none(), st.sampled_from(["T1", "T2", "T3"])),       # transaction id
    st.one_of(st.none(), st.sampled_from([10.5, 99.99, 0.01])),      # revenue
    st.one_of(st.none(), st.lists(st.sampled_from(["I1", "I2", "I3"]), max_size=3)),  # item ids
    st.sampled_from(["desktop", "mobile"]),
)


def _events(spark, rows):
    df = spark.createDataFrame(
        [(u, s, D0 + dt.timedelta(days=d), n, t, r, items, dev) for u, s, d, n, t, r, items, dev in rows],
        "user_pseudo_id string, session_id string, event_date date, event_name string, txn string, rev double, "
        "item_ids array<string>, dev string")
    return df.select(
        "event_date", "event_name", "session_id", "user_pseudo_id",
        F.struct(F.col("dev").alias("category")).alias("device"),
        F.struct(F.col("txn").alias("transaction_id"), F.col("rev").alias("purchase_revenue")).alias("ecommerce"),
        F.transform("item_ids", lambda x: F.struct(
            x.alias("item_id"), F.lit(2).alias("quantity"), F.lit(0.0005).alias("item_revenue"),
            F.when(x != "I1", x).alias("coupon"))).alias("items"),
    )


def _sum_or_none(vals):
    vals = [v for v in vals if v is not None]
    return round(sum(vals), 2) if vals else None


@settings(max_examples=8, deadline=None)
@given(st.lists(EVENT, min_size=1, max_size=30))
def test_enrichment_matches_brute_force(spark, rows):
    ev = _events(spark, rows)
    S, E = "2024-01-01", "2024-01-31"

    # transaction totals
    tx = defaultdict(lambda: {"dates": [], "n": 0, "items": 0, "uniq": set(), "rev": []})
    for u, s, d, n, t, r, items, dev in rows:
        if n == "purchase" and t is not None:
            a = tx[t]
            a["dates"].append(d)
            a["n"] += 1
            a["items"] += len(items or [])
            a["uniq"].update(items or [])
            a["rev"].append(r)
    got = {r["transaction_id"]: r for r in enrich.transaction_totals(ev, S, E).collect()}
    assert set(got) == set(tx)
    for t, a in tx.items():
        g = got[t]
        assert g["transaction_date"] == D0 + dt.timedelta(days=min(a["dates"]))
        assert (g["purchase_events"], g["total_items"], g["unique_items"]) == (a["n"], a["items"], len(a["uniq"]))
        assert g["item_quantity"] == 2 * a["items"]
        assert g["item_revenue"] == (round(0.0005 * a["items"], 4) if a["items"] else None)
        assert g["coupons"] == (",".join(sorted(a["uniq"] - {"I1"})) or None)
        want_rev = _sum_or_none(a["rev"])
        assert (g["revenue"] is None and want_rev is None) or math.isclose(g["revenue"], want_rev)

    # running totals per (user, day)
    daily = defaultdict(lambda: {"n": 0, "rev": []})
    for u, s, d, n, t, r, items, dev in rows:
        if n == "purchase":
            daily[(u, d)]["n"] += 1
            daily[(u, d)]["rev"].append(r)
    got = {(r["user_pseudo_id"], (r["event_date"] - D0).days): r for r in enrich.running_totals(ev, S, E).collect()}
    assert set(got) == set(daily)
    for (u, d), a in daily.items():
        prior = [k for k in daily if k[0] == u and k[1] <= d]
        assert got[(u, d)]["purchases"] == a["n"]
        assert got[(u, d)]["cumulative_purchases"] == sum(daily[k]["n"] for k in prior)
        want = _sum_or_none([x for k in prior for x in daily[k]["rev"]])
        g = got[(u, d)]["cumulative_revenue"]
        assert (g is None and want is None) or math.isclose(g, want)

    # session metrics per (day, device)
    seg = defaultdict(lambda: {"users": set(), "sessions": set(), "events": 0})
    for u, s, d, n, t, r, items, dev in rows:
        a = seg[(d, dev)]
        if u is not None:
            a["users"].add(u)
        a["sessions"].add(s)
        a["events"] += 1
    got = {((r["event_date"] - D0).days, r["device_category"]): r for r in enrich.session_metrics(ev, S, E).collect()}
    assert set(got) == set(seg)
    for k, a in seg.items():
        assert (got[k]["users"], got[k]["sessions"], got[k]["events"]) == (len(a["users"]), len(a["sessions"]), a["events"])
