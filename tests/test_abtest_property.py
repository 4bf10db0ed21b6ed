"""Property test: the A/B report against a plain-Python brute force.

Random events with labels from the test, another test, a prefix-colliding
test id and none; users in both groups; null users; purchases with and
without revenue or transaction id. The brute force applies the rules
directly: cohort = (user, group) from labels starting with the id whose
``<id>_(\\w+)`` group exists; drop users with any other non-null label (a null
user is never dropped, but never joins either); metrics per (group, device)
over the cohort users' events; user share per group.
"""

import math
import re
from collections import defaultdict

from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clickflow.operators import abtest

TEST = "TABW131"
EVENT = st.tuples(
    st.one_of(st.none(), st.sampled_from(["u1", "u2", "u3", "u4", "u5"])),
    st.sampled_from(["s1", "s2", "s3"]),
    st.sampled_from(["session_start", "view_item", "add_to_cart", "begin_checkout", "purchase", "page_view"]),
    st.sampled_from(["desktop", "mobile"]),
    st.one_of(st.none(), st.sampled_from(["TABW131_a", "TABW131_b", "TABW200_a", "TABW1310_a", "TABW131"])),
    st.one_of(st.none(), st.sampled_from([10.5, 20.25, 0.0])),
    st.one_of(st.none(), st.sampled_from(["T1", "T2"])),
)


def _brute(events):
    groups, other = defaultdict(set), set()
    for user, sid, name, dev, label, rev, txn in events:
        if label is None:
            continue
        if label.startswith(TEST):
            m = re.search(TEST + r"_(\w+)", label)
            if m:
                groups[user].add(m.group(1))
        elif user is not None:
            other.add(user)
    cohort = {(u, g) for u, gs in groups.items() if u is not None and u not in other for g in gs}
    m = defaultdict(lambda: defaultdict(set))
    rev_parts = defaultdict(list)  # SUM(IF(purchase, revenue, 0)): NULL only if every part is NULL
    split = defaultdict(lambda: defaultdict(set))
    for user, sid, name, dev, label, rev, txn in events:
        for u, g in cohort:
            if u != user:
                continue
            k = (g, dev)
            m[k]["users"].add(user)
            m[k]["sessions"].add(sid)
            split[g]["users"].add(user)
            if name == "session_start":
                m[k]["sessions_start"].add(sid)
            if name in ("view_item", "add_to_cart", "begin_checkout", "purchase"):
                m[k][f"users_{name}"].add(user)
            rev_parts[k].append(rev if name == "purchase" else 0.0)
            if name == "purchase" and txn is not None:
                m[k]["transactions"].add(txn)
    total_users = sum(len(v["users"]) for v in split.values())
    out = {}
    for k, sets in m.items():
        r = {c: len(sets[c]) for c in ("users", "sessions", "sessions_start", "users_view_item", "users_add_to_cart",
                                      "users_begin_checkout", "users_purchase", "transactions")}
        parts = [x for x in rev_parts[k] if x is not None]
        r["total_revenue"] = sum(parts) if parts else None
        sd = lambda a, b: None if a is None or b == 0 else a / b
        r["cr_pdp_to_cart"] = sd(r["users_add_to_cart"], r["users_view_item"])
        r["cr_session_to_purchase"] = sd(r["users_purchase"], r["sessions"])
        r["aov"] = sd(r["total_revenue"], r["transactions"])
        r["user_share"] = len(split[k[0]]["users"]) / total_users
        out[k] = r
    return out


@settings(max_examples=10, deadline=None)
@given(st.lists(EVENT, min_size=1, max_size=40))
@example([("u1", "s1", "purchase", "mobile", "TABW131_a", None, "T1")])  # revenue sum of only NULLs
def test_ab_report_matches_brute_force(spark, events):
    ev = spark.createDataFrame(
        events, "user_pseudo_id string, session_id string, event_name string, dev string, label string, "
                "rev double, txn string",
    ).select(
        F.lit("2024-01-05").cast("date").alias("event_date"), "event_name", "session_id", "user_pseudo_id",
        F.struct(F.col("dev").alias("category")).alias("device"),
        F.struct(F.col("label").alias("test_ab")).alias("event_params_custom"),
        F.struct(F.col("txn").alias("transaction_id"), F.col("rev").alias("purchase_revenue")).alias("ecommerce"),
    )
    got = {(r["test_group"], r["device_category"]): r.asDict()
           for r in abtest.ab_report(ev, TEST, "2024-01-01", "2024-01-31").collect()}
    want = _brute(events)
    assert set(got) == set(want)
    for key, w in want.items():
        for col, v in w.items():
            g = got[key][col]
            if v is None or g is None:
                assert v is None and g is None, (key, col, g, v)
            else:
                assert math.isclose(g, v, rel_tol=1e-9, abs_tol=1e-9), (key, col, g, v)
