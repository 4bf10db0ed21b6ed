"""Segmented e-commerce conversion funnel.

Semantics: an *open* funnel. For every (user, session, segment) a step is
reached when any event of that name occurs in the date range; order is not
enforced, so rates can exceed 1 and time gaps can be negative. Users are
counted once per segment per step; a user whose device / user type / channel
changes between sessions counts in several segments (counts are not additive
across segments).

Plan shape (``funnel_by_segment``):

1. scan ``ga4_events`` with partition filter on ``event_date`` and the step
   ``IN`` list pushed to Parquet; prune to 6 columns;
2. pivot to session grain *before* joining sessions (partial aggregation
   map-side, so a hot session shrinks to one row per task);
3. reduce ``ga4_sessions`` to distinct (session id, channel) pairs with
   map-side partial aggregation, then left-join the much smaller pivot to it;
   AQE picks broadcast or sort-merge from runtime sizes; duplicate or hot
   session ids cannot fan out or skew the join;
4. per-segment distinct user counts via two-level aggregation (no
   ``Expand``) and mergeable ``percentile_approx`` medians.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickflow.functions.exprs import MICROS_PER_MINUTE, flag, minutes_between, safe_divide
from clickflow.operators.distinct import DistinctBranch, distinct_counts, merge_on_keys
from clickflow.operators.quantiles import exact_quantiles
from clickflow.plans.materialize import materialize

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference report's step names, column
# suffixes and metric definitions).
# ---------------------------------------------------------------------------
# (event_name, column suffix), in funnel order. select_item is not part of
# the segmented report.
FUNNEL_STEPS = [
    ("session_start", "session_start"),
    ("view_item_list", "view_item_list"),
    ("view_item", "view_item"),
    ("add_to_cart", "add_to_cart"),
    ("begin_checkout", "begin_checkout"),
    ("add_shipping_info", "add_shipping_info"),
    ("purchaseOnClick", "purchase_on_click"),
    ("purchase", "purchase"),
]
# The documented nine-step funnel (with the optional select_item).
NINE_STEPS = [
    ("session_start", "session_start"),
    ("view_item_list", "view_item_list"),
    ("select_item", "select_item"),
    ("view_item", "view_item"),
    ("add_to_cart", "add_to_cart"),
    ("begin_checkout", "begin_checkout"),
    ("add_shipping_info", "add_shipping_info"),
    ("purchaseOnClick", "purchase_on_click"),
    ("purchase", "purchase"),
]
# Median minutes between first occurrences: (name, from suffix, to suffix).
MEDIAN_GAPS = [
    ("start_to_listing", "session_start", "view_item_list"),
    ("listing_to_pdp", "view_item_list", "view_item"),
    ("pdp_to_cart", "view_item", "add_to_cart"),
    ("cart_to_checkout", "add_to_cart", "begin_checkout"),
    ("checkout_to_purchase", "begin_checkout", "purchase"),
]
# Step-to-step conversion: (column, numerator suffix, denominator suffix).
STEP_RATES = [
    ("cr_start_to_listing", "view_item_list", "session_start"),
    ("cr_listing_to_pdp", "view_item", "view_item_list"),
    ("cr_pdp_to_cart", "add_to_cart", "view_item"),
    ("cr_cart_to_checkout", "begin_checkout", "add_to_cart"),
    ("cr_checkout_step1_to_step2", "add_shipping_info", "begin_checkout"),
    ("cr_step2_to_pay_click", "purchase_on_click", "add_shipping_info"),
    ("cr_pay_click_to_purchase", "purchase", "purchase_on_click"),
]
# Overall conversion from session_start: (column, numerator suffix).
OVERALL_RATES = [
    ("overall_cr_listing", "view_item_list"),
    ("overall_cr_pdp", "view_item"),
    ("overall_cr_cart", "add_to_cart"),
    ("overall_cr_checkout", "begin_checkout"),
    ("overall_cr_purchase", "purchase"),
]
# Drop-off = 1 - numerator / denominator: (column, numerator, denominator).
DROPOFFS = [
    ("dropoff_start_to_listing", "view_item_list", "session_start"),
    ("dropoff_listing_to_pdp", "view_item", "view_item_list"),
    ("dropoff_pdp_to_cart", "add_to_cart", "view_item"),
    ("dropoff_cart_to_checkout", "begin_checkout", "add_to_cart"),
    ("dropoff_checkout_to_purchase", "purchase", "begin_checkout"),
]
DEFAULT_DIMS = ("device_category", "user_type", "channel")
# ---------------------------------------------------------------------------

PERCENTILE_ACCURACY = 10000


def in_date_range(events: DataFrame, start: date | str, end: date | str,
                  date_col: str = "event_date") -> DataFrame:
    """``date_col BETWEEN start AND end`` (inclusive) on a bare column, so a
    table partitioned by that column is pruned at planning time."""
    return events.where(F.col(date_col).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def order_by(df: DataFrame, cols) -> DataFrame:
    """``ORDER BY cols``; a report without segment columns is left as is."""
    cols = list(cols)
    return df.orderBy(*cols) if cols else df


def user_type_col() -> Column:
    """'New' for the first session, otherwise (including null) 'Returning'."""
    return F.when(F.col("event_params.ga_session_number") == 1, F.lit("New")).otherwise(F.lit("Returning"))


# How each segment dimension is read from ga4_events. "channel" comes from
# ga4_sessions; any other name is taken as a (possibly nested) column path.
EVENT_DIMS = {
    "device_category": lambda: F.col("device.category"),
    "user_type": user_type_col,
    "country": lambda: F.col("geo.country"),
}


def dim_expr(name: str) -> Column:
    return EVENT_DIMS[name]() if name in EVENT_DIMS else F.col(name)


def _event_columns(events: DataFrame, start, end, steps, dims) -> DataFrame:
    names = [n for n, _ in steps]
    return in_date_range(events, start, end).where(F.col("event_name").isin(names)).select(
        "event_name", "event_date", "session_id", "user_pseudo_id",
        F.col("time.event_timestamp").alias("event_timestamp"),
        *[dim_expr(d).alias(d) for d in dims if d != "channel"],
    )


def _session_channels(sessions: DataFrame) -> DataFrame:
    return sessions.select(
        "session_id",
        F.col("last_non_direct_traffic_source.default_channel_grouping").alias("channel"),
    )


def base_events(events: DataFrame, sessions: DataFrame, start, end,
                steps=FUNNEL_STEPS) -> DataFrame:
    """Event grain with device, user type and channel (left join on session)."""
    return _with_channel(_event_columns(events, start, end, steps, DEFAULT_DIMS), _session_channels(sessions),
                         "user_pseudo_id", "event_timestamp")


def _with_channel(rows: DataFrame, channels: DataFrame, *deal_by: str) -> DataFrame:
    """Left join on ``session_id``. Rows without one match nothing, so a hash of
    ``deal_by`` stands in for the key and spreads them over all partitions."""
    stand_in = F.concat(F.lit("\x00"), F.xxhash64(*deal_by).cast("string"))
    right = channels.select(F.col("session_id").cast("string").alias("__session"), "channel") \
        .where(F.col("__session").isNotNull())
    key = F.coalesce(F.col("session_id").cast("string"), stand_in)
    return rows.join(right, key == F.col("__session"), "left").drop("__session")


def _pivot_aggs(steps, counts: bool = False) -> list[Column]:
    name, ts = F.col("event_name"), F.col("event_timestamp")
    aggs = [F.max(flag(name == ev)).alias(f"step_{sfx}") for ev, sfx in steps]
    aggs += [F.min(F.when(name == ev, ts)).alias(f"ts_{sfx}") for ev, sfx in steps]
    if counts:
        aggs += [F.count_if(name == ev).alias(f"events_{sfx}") for ev, sfx in steps]
    return aggs


def session_step_pivot(base: DataFrame, dims=DEFAULT_DIMS, steps=FUNNEL_STEPS,
                       counts: bool = False) -> DataFrame:
    """One row per (user, session, dims): step flags and first timestamps."""
    return base.groupBy("user_pseudo_id", "session_id", *dims).agg(*_pivot_aggs(steps, counts))


def sessions_in(sessions: DataFrame, session_dates: tuple | None) -> DataFrame:
    """Opt-in ``session_date BETWEEN a AND b`` on the sessions table.

    The reference reads every session; restricting them prunes the sessions
    scan to the given ``session_date`` partitions but drops the channel of
    any session that started outside the range, so it is never applied by
    default.
    """
    if session_dates is None:
        return sessions
    return in_date_range(sessions, session_dates[0], session_dates[1], "session_date")


def funnel_pivot(events: DataFrame, sessions: DataFrame, start, end,
                 steps=FUNNEL_STEPS, dims=DEFAULT_DIMS, counts: bool = False,
                 session_dates: tuple | None = None) -> DataFrame:
    """Session-grain pivot with the channel joined on *after* aggregation.

    Equal to ``session_step_pivot(base_events(...))``: the channel depends
    on the session only, so aggregating events per (user, session, event
    dims) first and then attaching each distinct channel of the session
    gives the same rows (flags are maxima, timestamps minima) while shuffling
    far less. Per-step event counts (``counts=True``) count each event once,
    even where the sessions table holds duplicate rows for a session.
    """
    dims = list(dims)
    ev = _event_columns(events, start, end, steps, dims)
    keys = ["user_pseudo_id", "session_id"]
    if "channel" not in dims:
        return ev.groupBy(*keys, *dims).agg(*_pivot_aggs(steps, counts))
    pre = ev.groupBy(*keys, *[d for d in dims if d != "channel"]).agg(*_pivot_aggs(steps, counts))
    joined = _with_channel(pre, distinct_session_channels(sessions_in(sessions, session_dates)), "user_pseudo_id")
    return joined.select(*keys, *dims, *[c for c in pre.columns if c not in keys and c not in dims])


def funnel_pivot_bucketed(events, sessions: DataFrame, start, end, steps=FUNNEL_STEPS, dims=DEFAULT_DIMS,
                          counts: bool = False) -> DataFrame:
    """``funnel_pivot`` over tables bucketed alike by ``session_id`` (``sources.bucketed``): no row is shuffled.

    ``events`` is a ``BucketedTable``. Aggregation, distinct channels and the
    join all run within a bucket, so the join is on the bare column; events
    without a session match nothing and come from their own table.
    """
    dims, keys = list(dims), ["user_pseudo_id", "session_id"]
    own = [d for d in dims if d != "channel"]

    def pivot(rows):
        return _event_columns(rows, start, end, steps, dims).groupBy(*keys, *own).agg(*_pivot_aggs(steps, counts))

    with_session, without = pivot(events.rows), pivot(events.without_key)
    if "channel" in dims:
        channels = distinct_session_channels(sessions).where(F.col("session_id").isNotNull())
        with_session = with_session.join(channels, "session_id", "left")
        without = without.withColumn("channel", F.lit(None).cast(channels.schema["channel"].dataType))
    out = [*keys, *dims, *[c for c in without.columns if c not in keys and c not in dims]]
    return with_session.select(*out).unionByName(without.select(*out))


def distinct_session_channels(sessions: DataFrame) -> DataFrame:
    """Distinct ``(session_id, channel)`` pairs of the sessions table.

    Duplicate session rows (even one id holding a large share of the table)
    collapse map-side in a hash aggregation before any shuffle, so the join
    neither fans out nor meets a hot key on its non-splittable (right)
    side. A null channel stays its own pair, forming its own segment as a
    left-joined null does.
    """
    return _session_channels(sessions).distinct()


def funnel_counts(pivot: DataFrame, dims=DEFAULT_DIMS, steps=FUNNEL_STEPS) -> DataFrame:
    """U3 (counts): distinct users reaching each step, per segment."""
    return distinct_counts(pivot, list(dims), [
        DistinctBranch("user_pseudo_id",
                       {f"users_{sfx}": F.col(f"step_{sfx}") == 1 for _, sfx in steps}),
    ])


def funnel_medians_exact(pivot: DataFrame, dims=DEFAULT_DIMS, gaps=MEDIAN_GAPS) -> DataFrame:
    """U3 (medians), exact for groups of any size (:mod:`~clickflow.operators.quantiles`).

    Ranks are selected among whole microseconds, which minutes follow in order.
    """
    found = exact_quantiles(pivot, list(dims), {
        f"median_min_{name}": F.col(f"ts_{b}") - F.col(f"ts_{a}") for name, a, b in gaps})
    return found.select(*dims, *[(F.col(f"median_min_{name}") / F.lit(MICROS_PER_MINUTE)).alias(f"median_min_{name}")
                                 for name, _, _ in gaps])


def funnel_medians(pivot: DataFrame, dims=DEFAULT_DIMS, gaps=MEDIAN_GAPS,
                   accuracy: int = PERCENTILE_ACCURACY) -> DataFrame:
    """U3 (medians): approximate median minutes between first step events.

    ``percentile_approx`` is a mergeable sketch (partial aggregation), so it
    scales to any group size; with fewer values than ``accuracy`` (10,000)
    per group it is exact: the lower median. Above, its rank is off by at
    most the group's size divided by ``accuracy``.
    """
    return pivot.groupBy(*dims).agg(*[
        F.percentile_approx(minutes_between(F.col(f"ts_{b}"), F.col(f"ts_{a}")), 0.5,
                            accuracy).alias(f"median_min_{name}")
        for name, a, b in gaps
    ])


def funnel_rates(counts: DataFrame) -> DataFrame:
    """U4: step, overall and drop-off rates (``SAFE_DIVIDE`` semantics)."""
    u = lambda s: F.col(f"users_{s}")
    cols = {}
    for name, num, den in STEP_RATES:
        cols[name] = safe_divide(u(num), u(den))
    for name, num in OVERALL_RATES:
        cols[name] = safe_divide(u(num), u("session_start"))
    for name, num, den in DROPOFFS:
        cols[name] = F.lit(1) - safe_divide(u(num), u(den))
    return counts.withColumns(cols)


def funnel_by_segment(events: DataFrame, sessions: DataFrame, start, end,
                      dims=DEFAULT_DIMS, checkpoint: bool = True,
                      session_dates: tuple | None = None, exact_medians: bool = False) -> DataFrame:
    """The whole segmented funnel report, ordered by the segment columns.

    The session-grain pivot feeds two aggregations (distinct users and
    medians); ``checkpoint`` writes it once to the shared folder (see
    ``plans.materialize``) so the events are scanned once. ``exact_medians``
    selects medians by rank, exact for groups of any size.
    """
    dims = list(dims)
    pivot = materialize(funnel_pivot(events, sessions, start, end, FUNNEL_STEPS, dims,
                                     session_dates=session_dates), checkpoint)
    counts = funnel_counts(pivot, dims)
    medians = funnel_medians_exact(pivot, dims) if exact_medians else funnel_medians(pivot, dims)
    report = funnel_rates(merge_on_keys([counts, medians], dims))
    ordered = dims + [f"users_{s}" for _, s in FUNNEL_STEPS] + [f"median_min_{g}" for g, _, _ in MEDIAN_GAPS] \
        + [n for n, _, _ in STEP_RATES] + [n for n, _ in OVERALL_RATES] + [n for n, _, _ in DROPOFFS]
    return order_by(report.select(*ordered), dims)


def funnel_steps_long(events: DataFrame, sessions: DataFrame, start, end,
                      steps=NINE_STEPS, dims=("device_category",), checkpoint: bool = True,
                      session_dates: tuple | None = None, accuracy: int = PERCENTILE_ACCURACY,
                      exact_medians: bool = False) -> DataFrame:
    """Long-format funnel, one row per (segment, step).

    Per step: distinct users and sessions, event count, step CR (vs the
    previous step), overall CR (vs the first step), drop-off, and median /
    mean minutes from the step's first event to the next step's first event
    within the session. Medians are ``percentile_approx`` with ``accuracy``,
    or exact for groups of any size with ``exact_medians``.
    """
    dims = list(dims)
    pivot = materialize(funnel_pivot(events, sessions, start, end, steps, dims, counts=True,
                                     session_dates=session_dates), checkpoint)
    sfx = [s for _, s in steps]
    counts = distinct_counts(pivot, dims, [
        DistinctBranch("user_pseudo_id", {f"users_{s}": F.col(f"step_{s}") == 1 for s in sfx},
                       sums={f"events_{s}": F.col(f"events_{s}") for s in sfx},
                       sum_types={f"events_{s}": "bigint" for s in sfx}),
        DistinctBranch("session_id", {f"sessions_{s}": F.col(f"step_{s}") == 1 for s in sfx}),
    ])
    gap_aggs = []
    for a, b in zip(sfx, sfx[1:]):
        gap = minutes_between(F.col(f"ts_{b}"), F.col(f"ts_{a}"))
        # Mean of whole microseconds, then to minutes: exact integer sums
        # (below 2**53) make the result independent of combine order.
        gap_us = F.col(f"ts_{b}") - F.col(f"ts_{a}")
        if not exact_medians:
            gap_aggs.append(F.percentile_approx(gap, 0.5, accuracy).alias(f"median_{a}"))
        gap_aggs.append((F.avg(gap_us) / F.lit(MICROS_PER_MINUTE)).alias(f"avg_{a}"))
    times = [pivot.groupBy(*dims).agg(*gap_aggs)]
    if exact_medians:
        selected = exact_quantiles(pivot, dims, {a: F.col(f"ts_{b}") - F.col(f"ts_{a}") for a, b in zip(sfx, sfx[1:])})
        times.append(selected.select(*dims, *[(F.col(a) / F.lit(MICROS_PER_MINUTE)).alias(f"median_{a}") for a in sfx[:-1]]))
    wide = merge_on_keys([counts, *times], dims)
    # Unpivot the (tiny) per-segment row to one row per step.
    per_step = F.array(*[
        F.struct(
            F.lit(i + 1).alias("step_index"), F.lit(ev).alias("step_name"),
            F.col(f"users_{s}").alias("users"), F.col(f"sessions_{s}").alias("sessions"),
            F.col(f"events_{s}").alias("events"),
            (F.col(f"median_{s}") if i + 1 < len(sfx) else F.lit(None).cast("double")).alias("median_min_to_next"),
            (F.col(f"avg_{s}") if i + 1 < len(sfx) else F.lit(None).cast("double")).alias("avg_min_to_next"),
        )
        for i, (ev, s) in enumerate(steps)
    ])
    long = wide.select(*dims, F.inline(per_step))
    w = Window.partitionBy(*dims).orderBy("step_index")
    prev_users = F.lag("users").over(w)
    first_users = F.first("users").over(w)
    step_cr = F.when(F.col("step_index") == 1, F.lit(1.0)).otherwise(safe_divide(F.col("users"), prev_users))
    long = long.withColumns({
        "step_cr": step_cr,
        "overall_cr": safe_divide(F.col("users"), first_users),
    }).withColumn("dropoff", F.lit(1) - F.col("step_cr"))
    return long.select(*dims, "step_index", "step_name", "users", "sessions", "events",
                       "step_cr", "overall_cr", "dropoff", "median_min_to_next", "avg_min_to_next") \
        .orderBy(*dims, "step_index")


def listing_sessions_dedup(events: DataFrame, start, end,
                           dims=("device_category",)) -> DataFrame:
    """Listing views counted per event and deduplicated per session.

    Sites that fire ``view_item_list`` on every scroll inflate the event
    count; ``COUNT(DISTINCT IF(event = 'view_item_list', session_id, NULL))``
    is the comparable figure. All other events share one null session, so
    only listing sessions are shuffled; segments without listings stay, with 0.
    """
    dims = list(dims)
    is_listing = F.col("event_name") == "view_item_list"
    ev = in_date_range(events, start, end).select(
        F.when(is_listing, F.col("session_id")).alias("listing_session"), flag(is_listing).alias("listing"),
        *[dim_expr(d).alias(d) for d in dims])
    out = distinct_counts(ev, dims, [
        DistinctBranch("listing_session", {"listing_sessions": None},
                       sums={"listing_events": F.col("listing")}, sum_types={"listing_events": "bigint"}),
    ])
    return order_by(out.withColumn("events_per_session", safe_divide("listing_events", "listing_sessions")), dims)


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast hint for a lookup table whose row count is checked first.

    Above ``max_rows`` no hint is given and the planner / AQE choose (a
    shuffle join when it is large). The count is a distributed partial count
    on the lookup only (a ``limit`` would funnel rows through one task).
    """
    return F.broadcast(df) if df.count() <= max_rows else df


def with_site(events: DataFrame, site_lookup: DataFrame, key: str = "stream_id",
              site_col: str = "site", max_broadcast_rows: int = 100_000) -> DataFrame:
    """Attach a site name to events from a (stream or property id -> site) lookup.

    Left join: events of an unmapped stream keep a null site (their own
    segment). Repeated lookup rows are collapsed first so events never fan out;
    a key with two sites is an error.
    """
    lookup = site_lookup.select(key, site_col).distinct()
    twice = lookup.groupBy(key).count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"site lookup has several sites for {key} " + ", ".join(str(r[0]) for r in twice))
    return events.join(broadcast_if_small(lookup, max_broadcast_rows), key, "left")
