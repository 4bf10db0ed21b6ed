"""A/B test analysis with cohort isolation, split check, KPIs and z-test.

Cohort rules (reference mode):

* a user is *in the test* with group ``g`` when an event in range has a
  ``test_ab`` label starting with the test id and ``<id>_(\\w+)`` extracts
  ``g``; a user seen in both groups is in both;
* a user is *in another test* when any event in range has a non-null label
  that does not start with the test id (so ``TABW1310_a`` does not count as
  another test of ``TABW131``); such users are dropped (isolation).

At scale the two scans + anti-join of the textbook form are replaced by one
scan of ``(user, test_ab)``: a hash aggregation to (user, group) with an
"in another test" flag (partial, so a hot user collapses map-side), then a
window per user over at most (number of group labels + 1) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickflow.functions.exprs import literal_regex, regex_extract, safe_divide
from clickflow.operators.distinct import DistinctBranch, distinct_counts
from clickflow.operators.funnel import in_date_range
from clickflow.operators.item_params import parse_param
from clickflow.plans.materialize import materialize

# ---------------------------------------------------------------------------
# Split thresholds, z critical values and the reference labels.
# ---------------------------------------------------------------------------
SPLIT_LOW, SPLIT_HIGH = 0.45, 0.55
SPLIT_LABELS = {"ok": "OK", "uneven": "UNEVEN_SPLIT"}
# (critical |z|, label), checked from the top, strictly greater than.
Z_LEVELS = [
    (2.576, "p < 0.01"),
    (1.96, "p < 0.05"),
    (1.645, "p < 0.10"),
]
NOT_SIGNIFICANT = "not significant"
CONTROL_GROUP = "a"
# Steps counted per group; session_start is counted on sessions.
AB_USER_STEPS = ["view_item", "add_to_cart", "begin_checkout", "purchase"]
# ---------------------------------------------------------------------------


def _group_expr(test_id: str, mode: str) -> Column:
    if mode == "strict":
        pattern = literal_regex(test_id) + r"_(\w+?)$"
    else:
        pattern = literal_regex(test_id) + r"_(\w+)"
    return regex_extract(F.col("event_params_custom.test_ab"), pattern)


def _in_test(test_id: str, mode: str) -> Column:
    label = F.col("event_params_custom.test_ab")
    prefix = test_id + "_" if mode == "strict" else test_id
    return label.startswith(F.lit(prefix))


def ab_cohort(events: DataFrame, test_id: str, start, end, mode: str = "reference") -> DataFrame:
    """Distinct (user_pseudo_id, test_group) seen in the test."""
    grp = _group_expr(test_id, mode)
    return (in_date_range(events, start, end)
            .where(_in_test(test_id, mode) & grp.isNotNull())
            .select("user_pseudo_id", grp.alias("test_group"))
            .distinct())


def ab_cohort_from_items(events: DataFrame, test_id: str, start, end) -> DataFrame:
    """U13 from the second source, ``item_parameter_20`` (``test:_TABW131_ab:_a_qs:_segment``):
    distinct (user_pseudo_id, test_group).

    Test and group end at the next ``_key:_``, so the test id matches as a whole.
    """
    labels = parse_param(events, 20, start, end, mode="strict")
    return (labels.where((F.col("test_id") == F.lit(test_id)) & F.col("test_group").isNotNull())
            .select("user_pseudo_id", "test_group").distinct())


def users_in_other_tests(events: DataFrame, test_id: str, start, end, mode: str = "reference") -> DataFrame:
    label = F.col("event_params_custom.test_ab")
    return (in_date_range(events, start, end)
            .where(label.isNotNull() & ~_in_test(test_id, mode))
            .select("user_pseudo_id").distinct())


def ab_isolate(cohort: DataFrame, events: DataFrame, test_id: str, start, end,
               mode: str = "reference") -> DataFrame:
    """U14 (textbook form): cohort minus users seen in any other test (anti-join)."""
    return cohort.join(users_in_other_tests(events, test_id, start, end, mode), "user_pseudo_id", "left_anti")


def ab_isolated_cohort(events: DataFrame, test_id: str, start, end, mode: str = "reference") -> DataFrame:
    """U13 + U14 in one scan: isolated (user_pseudo_id, test_group) pairs.

    Same rows as ``ab_isolate(ab_cohort(...))``. Labelled events reduce to
    one row per (user, group-or-none) with "saw another test" -- a hash
    aggregation, partial map-side, so a hot user shrinks to a row per task
    -- then a window per user spreads the flag over the user's rows (at
    most the number of group labels plus one). A null user is never matched
    by the anti-join, so it is kept whatever its other labels.
    """
    label = F.col("event_params_custom.test_ab")
    grp = _group_expr(test_id, mode)
    in_test = _in_test(test_id, mode)
    per_label = (in_date_range(events, start, end)
                 .where(label.isNotNull())
                 .select("user_pseudo_id",
                         F.when(in_test, grp).alias("test_group"),
                         (~in_test).alias("other"))
                 .groupBy("user_pseudo_id", "test_group")
                 .agg(F.max("other").alias("other")))
    in_other = F.max("other").over(Window.partitionBy("user_pseudo_id"))
    return (per_label.withColumn("in_other", in_other)
            .where(F.col("test_group").isNotNull() & (~F.col("in_other") | F.col("user_pseudo_id").isNull()))
            .select("user_pseudo_id", "test_group"))


def ab_contamination(cohort: DataFrame) -> DataFrame:
    """Users of the cohort seen in more than one group (they count in each).

    One row: ``cohort_users`` (distinct users) and ``contaminated_users``.
    Two hash aggregations: per user the number of groups, then the totals.
    """
    per_user = cohort.groupBy("user_pseudo_id").agg(F.count("test_group").alias("groups"))
    return per_user.agg(
        F.count("user_pseudo_id").alias("cohort_users"),
        F.count_if(F.col("groups") > 1).alias("contaminated_users"),
    )


def ab_events(events: DataFrame, cohort: DataFrame, start, end) -> DataFrame:
    """Events of cohort users, tagged with the group (event grain).

    A user in both groups contributes every event to both groups.
    """
    ev = in_date_range(events, start, end).where(F.col("user_pseudo_id").isNotNull()).select(
        "event_name", "event_date", "session_id", "user_pseudo_id",
        F.col("device.category").alias("device_category"),
        F.col("ecommerce.purchase_revenue").alias("purchase_revenue"),
        F.col("ecommerce.transaction_id").alias("transaction_id"),
    )
    return ev.join(cohort, "user_pseudo_id", "inner")


def _session_grain_aggs() -> list[Column]:
    name = F.col("event_name")
    return [
        F.max(F.when(name == "session_start", 1).otherwise(0)).alias("f_session_start"),
        *[F.max(F.when(name == s, 1).otherwise(0)).alias(f"f_{s}") for s in AB_USER_STEPS],
        F.sum("rev").alias("rev"),
    ]


def ab_session_grain(events: DataFrame, cohort: DataFrame, start, end) -> DataFrame:
    """Cohort events pre-aggregated to (user, session, device, purchase txn, group).

    Everything the split check and the metrics need survives this: step
    flags are maxima, revenue is a sum and transaction ids stay a key.

    The narrow events meet the cohort first, so other users never reach the
    aggregation. Whether the cohort is broadcast is Spark's choice, by its
    measured bytes; otherwise AQE splits a user with very many events.
    """
    is_purchase = F.col("event_name") == "purchase"
    ev = in_date_range(events, start, end).where(F.col("user_pseudo_id").isNotNull()).select(
        "user_pseudo_id", "session_id", F.col("device.category").alias("device_category"),
        "event_name",
        F.when(is_purchase, F.col("ecommerce.transaction_id")).alias("purchase_txn"),
        F.when(is_purchase, F.col("ecommerce.purchase_revenue").cast("decimal(28,9)"))
        .otherwise(F.lit(0).cast("decimal(28,9)")).alias("rev"),
    )
    keys = ["user_pseudo_id", "session_id", "device_category", "purchase_txn"]
    return ev.join(cohort, "user_pseudo_id", "inner").groupBy(*keys, "test_group").agg(*_session_grain_aggs())


def split_check(grain: DataFrame, low: float = SPLIT_LOW, high: float = SPLIT_HIGH,
                labels: dict | None = None) -> DataFrame:
    """U16: users and sessions per group, share of users, split status.

    Works on event grain (``ab_events``) or session grain
    (``ab_session_grain``). The share uses a whole-result window; it runs
    after aggregation, on one row per group.
    """
    labels = labels or SPLIT_LABELS
    counts = distinct_counts(grain, ["test_group"], [
        DistinctBranch("user_pseudo_id", {"users": None}),
        DistinctBranch("session_id", {"sessions": None}),
    ])
    share = F.col("users") / F.sum("users").over(Window.partitionBy())
    return counts.withColumn("user_share", share).withColumn(
        "split_status",
        F.when(F.col("user_share").between(low, high), F.lit(labels["ok"])).otherwise(F.lit(labels["uneven"])),
    )


def ab_metrics(grain: DataFrame) -> DataFrame:
    """Per (test_group, device_category) users, sessions, steps, revenue, transactions."""
    keys = ["test_group", "device_category"]
    if "f_session_start" in grain.columns:  # session grain
        f = lambda s: F.col(f"f_{s}") == 1
        txn, rev = F.col("purchase_txn"), F.col("rev")
    else:  # event grain
        f = lambda s: F.col("event_name") == s
        is_p = F.col("event_name") == "purchase"
        txn = F.when(is_p, F.col("transaction_id"))
        rev = F.when(is_p, F.col("purchase_revenue").cast("decimal(28,9)")).otherwise(F.lit(0).cast("decimal(28,9)"))
        grain = grain.withColumns({"purchase_txn": txn, "rev": rev})
    out = distinct_counts(grain, keys, [
        DistinctBranch("user_pseudo_id",
                       {"users": None, **{f"users_{s}": f(s) for s in AB_USER_STEPS}},
                       sums={"total_revenue": F.col("rev")}, sum_types={"total_revenue": "double"}),
        DistinctBranch("session_id", {"sessions": None, "sessions_start": f("session_start")}),
        DistinctBranch("purchase_txn", {"transactions": None}),
    ])
    return out.select(
        *keys, "users", "sessions", "sessions_start",
        *[f"users_{s}" for s in AB_USER_STEPS], "total_revenue", "transactions",
    )


def ab_kpis(metrics: DataFrame) -> DataFrame:
    """Conversion rates and revenue KPIs (``SAFE_DIVIDE``)."""
    return metrics.withColumns({
        "cr_pdp_to_cart": safe_divide("users_add_to_cart", "users_view_item"),
        "cr_cart_to_checkout": safe_divide("users_begin_checkout", "users_add_to_cart"),
        "cr_session_to_purchase": safe_divide("users_purchase", "sessions"),
        "cr_pdp_to_purchase": safe_divide("users_purchase", "users_view_item"),
        "revenue_per_session": safe_divide("total_revenue", "sessions"),
        "aov": safe_divide("total_revenue", "transactions"),
        "transactions_per_buyer": safe_divide("transactions", "users_purchase"),
    })


def ab_report(events: DataFrame, test_id: str, start, end, mode: str = "reference",
              low: float = SPLIT_LOW, high: float = SPLIT_HIGH, checkpoint: bool = True,
              labels: dict | None = None) -> DataFrame:
    """KPIs per (group, device) with the group's user share and split status.

    The session-grain cohort facts feed five distinct-count branches;
    ``checkpoint`` writes them once to the shared folder so the events are
    scanned once for them.
    """
    cohort = materialize(ab_isolated_cohort(events, test_id, start, end, mode), checkpoint, how="checkpoint")
    grain = materialize(ab_session_grain(events, cohort, start, end), checkpoint)
    results = ab_kpis(ab_metrics(grain))
    split = split_check(grain, low, high, labels).select("test_group", "user_share", "split_status")
    # Both sides hold one row per group (x device); AQE picks the join from
    # their measured sizes (a broadcast of a few rows here).
    return results.join(split, "test_group", "left").orderBy("test_group", "device_category")


def two_proportion_z(df: DataFrame, levels=Z_LEVELS, not_significant: str = NOT_SIGNIFICANT) -> DataFrame:
    """Two-proportion z-test on ``sessions_a, conversions_a, sessions_b, conversions_b``.

    Adds ``cr_a, cr_b, pooled_cr, z_value, relative_uplift, significance``.
    Zero sessions or a pooled rate of 0 or 1 give a null z (reported as not
    significant) instead of a division error.
    """
    sa, ca, sb, cb = (F.col(c).cast("double") for c in ("sessions_a", "conversions_a", "sessions_b", "conversions_b"))
    out = df.withColumns({
        "cr_a": F.try_divide(ca, sa),
        "cr_b": F.try_divide(cb, sb),
        "pooled_cr": F.try_divide(ca + cb, sa + sb),
    })
    p = F.col("pooled_cr")
    se = F.sqrt(p * (F.lit(1.0) - p) * (F.try_divide(F.lit(1.0), sa) + F.try_divide(F.lit(1.0), sb)))
    out = out.withColumns({
        "z_value": F.try_divide(F.col("cr_b") - F.col("cr_a"), F.nullif(se, F.lit(0.0))),
        "relative_uplift": F.try_divide(F.col("cr_b") - F.col("cr_a"), F.col("cr_a")),
    })
    label = F.lit(not_significant)
    for crit, text in reversed(levels):
        label = F.when(F.abs(F.col("z_value")) > crit, F.lit(text)).otherwise(label)
    return out.withColumn("significance", label)


def ab_group_totals(grain: DataFrame) -> DataFrame:
    """Per-group sessions and converting users (re-aggregated, never summed over devices)."""
    conv = (F.col("f_purchase") == 1) if "f_purchase" in grain.columns else (F.col("event_name") == "purchase")
    return distinct_counts(grain, ["test_group"], [
        DistinctBranch("session_id", {"sessions": None}),
        DistinctBranch("user_pseudo_id", {"conversions": conv}),
    ])


def ab_ztest(events: DataFrame, test_id: str, start, end, control: str = CONTROL_GROUP,
             mode: str = "reference", checkpoint: bool = True) -> DataFrame:
    """Each variant group against the control group: z-test on purchase conversion.

    ``conversions`` are distinct purchasing users and ``sessions`` distinct
    sessions of the group (the reference's ``cr_session_to_purchase``).
    """
    cohort = materialize(ab_isolated_cohort(events, test_id, start, end, mode), checkpoint, how="checkpoint")
    grain = ab_session_grain(events, cohort, start, end)
    totals = ab_group_totals(materialize(grain, checkpoint))
    whole = Window.partitionBy()  # one row per group: tiny
    is_ctrl = F.col("test_group") == control
    paired = totals.select(
        F.col("test_group"),
        F.max(F.when(is_ctrl, F.col("sessions"))).over(whole).alias("sessions_a"),
        F.max(F.when(is_ctrl, F.col("conversions"))).over(whole).alias("conversions_a"),
        F.col("sessions").alias("sessions_b"),
        F.col("conversions").alias("conversions_b"),
    ).where(~is_ctrl & F.col("sessions_a").isNotNull())  # no control, no test
    return two_proportion_z(paired).orderBy("test_group")
