"""DuckDB SQL that states the expected result of every registered query.

Each string runs on DuckDB with the raw test tables registered as views
(``events``, ``pages``, ...). ``ADAPTER`` is the SQL form of
``clickflow_fixtures.adapter`` (written independently of the Spark code, so the
cross-check covers the adapter too); the report SQL follows the warehouse
definitions with DuckDB spellings: ``quantile_disc`` for the approximate
median, ``a / nullif(b, 0)`` for ``SAFE_DIVIDE``, ``round_even`` for
half-even rounding, and money sums as ``decimal(28,9)``.
"""

from __future__ import annotations

START = "2024-01-01"
END = "2024-01-31"

ADAPTER = """
x as (
  select event_id, user_id, value, event_type, cast(ts as date) as event_date,
         epoch_us(ts) as event_timestamp,
         date_diff('day', date '2024-01-01', cast(ts as date)) as day_no
  from events),
flat as (
  select *,
    'u' || cast(user_id as varchar) as user_pseudo_id,
    cast(user_id as varchar) || '_' || cast(bucket as varchar) as session_id,
    case when event_id % 100 < 30 then 'session_start' when event_id % 100 < 50 then 'view_item_list'
         when event_id % 100 < 55 then 'select_item' when event_id % 100 < 75 then 'view_item'
         when event_id % 100 < 84 then 'add_to_cart' when event_id % 100 < 90 then 'begin_checkout'
         when event_id % 100 < 94 then 'add_shipping_info'
         when event_id % 100 < 97 then 'purchaseOnClick' else 'purchase' end as event_name,
    case user_id % 3 when 0 then 'desktop' when 1 then 'mobile' else 'tablet' end as device_category,
    case user_id % 4 when 0 then 'Poland' when 1 then 'Czech Republic' when 2 then 'Slovakia'
         else 'Hungary' end as country,
    case (user_id + bucket) % 5 when 0 then 'Organic Search' when 1 then 'Direct'
         when 2 then 'Paid Search' when 3 then 'Email' end as channel,
    case when user_id % 30 = 7 and event_id % 2 = 1 then 'TABW200_b'
         when user_id % 30 = 11 and event_id % 7 = 0 then 'TABW1310_a'
         when user_id % 10 < 4 then 'TABW131_a' when user_id % 10 < 8 then 'TABW131_b'
         when user_id % 10 = 8 then 'TABW200_a' end as test_ab
  from (select *, cast((day_no - day_no % 3) / 3 as bigint) + 1 as bucket from x) b),
ev as (
  select *,
    case when event_name = 'purchase' and event_id % 11 <> 0
         then value + (event_id % 8) * 0.0003::double end as purchase_revenue,
    case when event_name = 'purchase' then 'T' || cast(event_id - event_id % 2 as varchar) end as transaction_id,
    event_id % 3 as n_items
  from flat),
sessions as (
  select session_id, channel, min(event_date) as session_date
  from ev where channel is not null group by session_id, channel),
item_rows as (
  select ev.*, ii.i as item_no, event_id * 2 + ii.i as k
  from ev, (select 0 as i union all select 1 as i) ii where ii.i < n_items),
it as (
  select *,
    'I' || cast(k % 500 as varchar) as item_id,
    'Offer ' || cast(k % 500 as varchar) as item_name,
    'Brand ' || cast(k % 500 % 7 as varchar) as item_brand,
    case when event_name <> 'view_item_list' then
      'per:_' || cast(1000 + k % 4000 as varchar) || '_room:_' || cast(2000 + k % 8000 as varchar)
      || '_filter:_' || case when k % 2 = 0 then 'person' else 'total' end
      || '_summary:_' || cast(2100 + k % 8000 as varchar)
      || '_listing_price:_' || cast(990 + k % 4000 as varchar) end as p1,
    'd:_' || cast(k % 21 + 1 as varchar) || '_dtt:_' || cast(k % 300 as varchar)
      || '_offers:_' || cast(k % 90 as varchar) as p5,
    case when k % 2 = 0 then 'adult:_' || cast(k % 4 + 1 as varchar) || '_child:_' || cast(k % 3 as varchar)
         else 'a:_' || cast(k % 4 + 1 as varchar) || '_c:_' || cast(k % 3 as varchar) end as p9,
    'p:_' || cast(k % 2 as varchar) || '_i:_' || cast(k % 3 % 2 as varchar) || '_pr:_' || cast(k % 5 % 2 as varchar)
      || '_l:_' || cast(k % 7 % 2 as varchar) || '_s:_' || cast(k % 11 % 2 as varchar) as p19,
    'test:_TABW131_ab:_' || case when k % 2 = 0 then 'a' else 'b' end || '_qs:_seg' || cast(k % 3 as varchar) as p20,
    case when k % 4 = 0 then 'p:_1-Lot ' || cast(k % 9 as varchar) || '_i:_1-Plan ' || cast(k % 5 as varchar)
         || '_pr:_' || cast(k % 2 as varchar) || '_l:_1'
         else 'p:_0_i:_0_pr:_0_l:_0' end as p25
  from item_rows),
located as (
  select event_id, event_date,
    case when event_id % 6 <> 5 then 'https://shop' || cast(event_id % 3 as varchar) || '.example.com/' || event_name
      || case event_id % 6
         when 1 then '?utm_source=news|letter&utm_medium=email&utm_campaign=spring%20sale'
         when 2 then '?utm_source=ads&utm_content=big banner&utm_term=caf%C3%A9&search_query=CAF%C3%89%20Rzym'
         when 3 then '?utm_id=' || cast(event_id % 9 as varchar)
              || '&utm_marketing_tactic=t&utm_source_platform=p&utm_creative_format=f#top'
         when 4 then '?gtm_debug=' || cast(event_id as varchar) || '&_gl=1*x&utm_source='
         else '' end end as url
  from ev)
"""


def with_adapter(body: str) -> str:
    return "with " + ADAPTER + "," + body


RANGE = f"event_date between date '{START}' and date '{END}'"

# Fixed values (step names, rate definitions, patterns): must equal the report's.
STEPS = [
    ("session_start", "session_start"), ("view_item_list", "view_item_list"),
    ("view_item", "view_item"), ("add_to_cart", "add_to_cart"),
    ("begin_checkout", "begin_checkout"), ("add_shipping_info", "add_shipping_info"),
    ("purchaseOnClick", "purchase_on_click"), ("purchase", "purchase"),
]
NINE = STEPS[:2] + [("select_item", "select_item")] + STEPS[2:]
GAPS = [("start_to_listing", "session_start", "view_item_list"),
        ("listing_to_pdp", "view_item_list", "view_item"),
        ("pdp_to_cart", "view_item", "add_to_cart"),
        ("cart_to_checkout", "add_to_cart", "begin_checkout"),
        ("checkout_to_purchase", "begin_checkout", "purchase")]


def _same(dims, a: str, b: str) -> str:
    return " and ".join(f"{a}.{d} is not distinct from {b}.{d}" for d in dims)


def _funnel_ctes(steps=STEPS, dims=("device_category", "user_type", "channel")) -> str:
    """``tagged``: step events with their segment; ``hits``: one row per session, segment and step reached."""
    names = ", ".join(f"'{e}'" for e, _ in steps)
    d = ", ".join(dims)
    return f"""
regions as (select r_regionkey, r_name from region),
tagged as (
  select event_name, event_date, ev.session_id, user_pseudo_id, event_timestamp, device_category, country,
         if(bucket = 1, 'New', 'Returning') as user_type, sessions.channel,
         (select r_name from regions where r_regionkey = ev.user_id % 5) as site
  from sessions right join ev on sessions.session_id = ev.session_id
  where {RANGE} and event_name in ({names})),
hits as (
  select {d}, user_pseudo_id, session_id, event_name, count(*) as n, min(event_timestamp) as first_ts
  from tagged group by all)"""


def _funnel_aggregated(dims=("device_category", "user_type", "channel")) -> str:
    """``agg``: users from distinct (segment, step, user) rows, medians from pairs of step rows of a session."""
    d = ", ".join(dims)
    users = ",\n    ".join(f"count(user_pseudo_id) filter (where event_name = '{e}') as users_{s}" for e, s in STEPS)
    event_of = {s: e for e, s in STEPS}
    meds = ",\n    ".join(
        f"quantile_disc(minutes, 0.5) filter (where earlier = '{event_of[a]}' and later = '{event_of[b]}') as median_min_{g}"
        for g, a, b in GAPS)
    return f"""
reached as (select distinct {d}, event_name, user_pseudo_id from hits),
user_counts as (
  select {d},
    {users}
  from reached group by {d}),
pairs as (
  select {", ".join("p." + x for x in dims)}, p.event_name as earlier, q.event_name as later,
         (q.first_ts - p.first_ts) / 60000000 as minutes
  from hits p join hits q on p.session_id = q.session_id and p.user_pseudo_id = q.user_pseudo_id and {_same(dims, "p", "q")}),
medians as (
  select {d},
    {meds}
  from pairs group by {d}),
agg as (
  select user_counts.*, medians.* exclude ({d})
  from user_counts left join medians on {_same(dims, "user_counts", "medians")})"""


def _sd(a: str, b: str) -> str:
    return f"cast({a} as double) / nullif(cast({b} as double), 0)"


RATES = [
    ("cr_start_to_listing", "view_item_list", "session_start"),
    ("cr_listing_to_pdp", "view_item", "view_item_list"),
    ("cr_pdp_to_cart", "add_to_cart", "view_item"),
    ("cr_cart_to_checkout", "begin_checkout", "add_to_cart"),
    ("cr_checkout_step1_to_step2", "add_shipping_info", "begin_checkout"),
    ("cr_step2_to_pay_click", "purchase_on_click", "add_shipping_info"),
    ("cr_pay_click_to_purchase", "purchase", "purchase_on_click"),
]
OVERALL = [("overall_cr_listing", "view_item_list"), ("overall_cr_pdp", "view_item"),
           ("overall_cr_cart", "add_to_cart"), ("overall_cr_checkout", "begin_checkout"),
           ("overall_cr_purchase", "purchase")]
DROPS = [("dropoff_start_to_listing", "view_item_list", "session_start"),
         ("dropoff_listing_to_pdp", "view_item", "view_item_list"),
         ("dropoff_pdp_to_cart", "add_to_cart", "view_item"),
         ("dropoff_cart_to_checkout", "begin_checkout", "add_to_cart"),
         ("dropoff_checkout_to_purchase", "purchase", "begin_checkout")]


def _rate_cols() -> str:
    cols = [f"{_sd('users_' + n, 'users_' + d)} as {c}" for c, n, d in RATES]
    cols += [f"{_sd('users_' + n, 'users_session_start')} as {c}" for c, n in OVERALL]
    cols += [f"1 - {_sd('users_' + n, 'users_' + d)} as {c}" for c, n, d in DROPS]
    return ",\n  ".join(cols)


FUNNEL_BY_SEGMENT = with_adapter(_funnel_ctes() + "," + _funnel_aggregated() + f"""
select *,
  {_rate_cols()}
from agg""")

FUNNEL_COUNTS = with_adapter(_funnel_ctes() + "," + _funnel_aggregated() + """
select device_category, user_type, channel,
  """ + ", ".join(f"users_{s}" for _, s in STEPS) + " from agg")

FUNNEL_MEDIANS = with_adapter(_funnel_ctes() + "," + _funnel_aggregated() + """
select device_category, user_type, channel,
  """ + ", ".join(f"median_min_{g}" for g, _, _ in GAPS) + " from agg")

# distinct users of a day, and of the seven days up to it, by segment of the day's window
ACTIVE_USERS = with_adapter(_funnel_ctes() + """,
seen as (select distinct event_date, device_category, user_pseudo_id from tagged),
handed as (
  select cast(event_date + to_days(cast(l.later as integer)) as date) as event_date, device_category, user_pseudo_id, l.later
  from seen, (select unnest(range(7)) as later) l)
select event_date, device_category, count(distinct user_pseudo_id) filter (where later = 0) as users,
       count(distinct user_pseudo_id) as users_7d
from handed where """ + RANGE + """ group by event_date, device_category""")

FUNNEL_RATES = with_adapter(_funnel_ctes() + "," + _funnel_aggregated() + """
select device_category, user_type, channel,
  """ + ", ".join(f"users_{s}" for _, s in STEPS) + f""",
  {_rate_cols()}
from agg""")

COUNTRY_DIMS = ("device_category", "country")
FUNNEL_BY_COUNTRY = with_adapter(_funnel_ctes(STEPS, COUNTRY_DIMS) + "," + _funnel_aggregated(COUNTRY_DIMS) + f"""
select *,
  {_rate_cols()}
from agg""")

SITE_DIMS = ("site",)
FUNNEL_BY_SITE = with_adapter(_funnel_ctes(STEPS, SITE_DIMS) + "," + _funnel_aggregated(SITE_DIMS) + f"""
select *,
  {_rate_cols()}
from agg""")

FUNNEL_BASE_EVENTS = with_adapter(_funnel_ctes() + """
select event_name, event_date, session_id, user_pseudo_id, event_timestamp,
       device_category, user_type, channel from tagged""")

FUNNEL_SESSION_PIVOT = with_adapter(_funnel_ctes() + """
select user_pseudo_id, session_id, device_category, user_type, channel,
  """ + ",\n  ".join(f"cast(count(*) filter (where event_name = '{e}') as integer) as step_{s}, "
                    f"any_value(first_ts) filter (where event_name = '{e}') as ts_{s}" for e, s in STEPS) + """
from hits group by user_pseudo_id, session_id, device_category, user_type, channel""")


def _funnel_long() -> str:
    order = ", ".join(f"({i + 1}, '{e}')" for i, (e, _) in enumerate(NINE))
    return with_adapter(_funnel_ctes(NINE, ("device_category",)) + f""",
steps(step_index, step_name) as (values {order}),
grid as (select * from steps, (select distinct device_category from hits)),
per_step as (
  select device_category, event_name, count(distinct user_pseudo_id) as users,
         count(distinct session_id) as sessions, sum(n) as events
  from hits group by all),
gaps as (
  select p.device_category, p.event_name, quantile_disc((q.first_ts - p.first_ts) / 60000000, 0.5) as median_gap,
         avg(q.first_ts - p.first_ts) / 60000000 as mean_gap
  from hits p join steps sp on sp.step_name = p.event_name join steps sq on sq.step_index = sp.step_index + 1
  join hits q on q.event_name = sq.step_name and q.session_id = p.session_id and q.user_pseudo_id = p.user_pseudo_id
    and q.device_category is not distinct from p.device_category
  group by all),
counted as (
  select g.device_category, g.step_index, g.step_name, coalesce(s.users, 0) as users, coalesce(s.sessions, 0) as sessions,
         cast(coalesce(s.events, 0) as bigint) as events, gaps.median_gap, gaps.mean_gap
  from grid g
  left join per_step s on s.event_name = g.step_name and s.device_category is not distinct from g.device_category
  left join gaps on gaps.event_name = g.step_name and gaps.device_category is not distinct from g.device_category),
rated as (
  select now.*, if(now.step_index = 1, 1.0::double, {_sd('now.users', 'before.users')}) as step_cr,
         {_sd('now.users', 'top.users')} as overall_cr
  from counted now
  left join counted before on before.step_index = now.step_index - 1
    and before.device_category is not distinct from now.device_category
  join counted top on top.step_index = 1 and top.device_category is not distinct from now.device_category)
select device_category, step_index, step_name, users, sessions, events, step_cr, overall_cr, 1 - step_cr as dropoff,
       median_gap as median_min_to_next, mean_gap as avg_min_to_next
from rated""")


FUNNEL_LONG = _funnel_long()

LISTING_SESSIONS_DEDUP = with_adapter(f"""
agg as (
  select device_category,
    count(*) filter (where event_name = 'view_item_list') as listing_events,
    count(distinct case when event_name = 'view_item_list' then session_id end) as listing_sessions
  from ev where {RANGE} group by device_category)
select device_category, listing_sessions, listing_events,
  {_sd('listing_events', 'listing_sessions')} as events_per_session
from agg""")

LISTING_DEDUP_BY_SITE = with_adapter(f"""
views as (
  select (select r_name from region where r_regionkey = user_id % 5) as site, session_id,
         cast(event_name = 'view_item_list' as integer) as listing
  from ev where {RANGE}),
per_session as (select site, session_id, sum(listing) as n from views group by all)
select site, count(session_id) filter (where n > 0) as listing_sessions, cast(sum(n) as bigint) as listing_events,
  {_sd('sum(n)', 'count(session_id) filter (where n > 0)')} as events_per_session
from per_session group by site""")

# --- item parameters --------------------------------------------------------

# The documented pattern of each field.
PARAMS = {
    1: [("price_per_person", r"per:_(\d+)", "int"), ("price_per_room", r"room:_(\d+)", "int"),
        ("price_display_type", r"filter:_(\w+)", "str"), ("price_summary", r"summary:_(\d+)", "int"),
        ("listing_price", r"listing_price:_(\d+)", "int")],
    5: [("trip_duration_days", r"d:_(\d+)", "int"), ("days_to_trip", r"dtt:_(\d+)", "int"),
        ("listing_offers_count", r"offers:_(\d+)", "int")],
    9: [("adults_count", r"(?:adult|a):_(\d+)", "int"), ("children_count", r"(?:child|c):_(\d+)", "int")],
    19: [("parking_available", r"^p:_(\d)", "int"), ("insurance_available", r"i:_(\d)", "int"),
         ("promesa_available", r"pr:_(\d)", "int"), ("luggage_available", r"l:_(\d)", "int"),
         ("seats_together_available", r"s:_(\d)", "int")],
    20: [("test_id", r"test:_(\w+)", "str"), ("test_group", r"ab:_(\w+)", "str"),
         ("qs_segment", r"qs:_(\w+)", "str")],
    25: [("parking_selected", r"^p:_(\d)", "int"), ("parking_name", r"^p:_\d-(.+?)_i:", "str"),
         ("insurance_selected", r"i:_(\d)", "int"), ("insurance_name", r"i:_\d-(.+?)_pr:", "str"),
         ("promesa_selected", r"pr:_(\d)", "int"), ("luggage_selected", r"l:_(\d)", "int")],
}
STRICT = {"price_display_type": r"filter:_(\w+?)(?:_\w+:_|$)", "test_id": r"test:_(\w+?)(?:_\w+:_|$)",
          "test_group": r"ab:_(\w+?)(?:_\w+:_|$)", "qs_segment": r"qs:_(\w+?)(?:_\w+:_|$)"}


def _extract(raw: str, name: str, pattern: str, typ: str) -> str:
    e = f"nullif(regexp_extract({raw}, '{pattern}', 1), '')"
    return f"try_cast({e} as bigint) as {name}" if typ == "int" else f"{e} as {name}"


def _parse(n: int, strict: bool = False) -> str:
    extra = "item_name, item_brand, " if n == 1 else ""
    cols = ",\n  ".join(_extract(f"p{n}", nm, STRICT.get(nm, pat) if strict else pat, t) for nm, pat, t in PARAMS[n])
    return with_adapter(f"""
x1 as (select 1)
select event_date, event_name, session_id, user_pseudo_id, item_id, {extra}p{n} as raw_param_{n},
  {cols}
from it where {RANGE}""")


def _parse_view_item() -> str:
    cols = ",\n  ".join(_extract("p1", nm, pat, t) for nm, pat, t in PARAMS[1])
    return with_adapter(f"""
x1 as (select 1)
select event_date, event_name, session_id, user_pseudo_id, item_id, item_name, item_brand, p1 as raw_param_1,
  {cols}
from it where {RANGE} and event_name = 'view_item'""")


def _parse_all() -> str:
    raws = ", ".join(f"p{n} as raw_param_{n}" for n in PARAMS)
    cols = ",\n  ".join(_extract(f"p{n}", nm, pat, t) for n in PARAMS for nm, pat, t in PARAMS[n])
    return with_adapter(f"""
x1 as (select 1)
select event_date, event_name, session_id, user_pseudo_id, item_id, item_name, item_brand, {raws},
  {cols}
from it where {RANGE}""")


# --- A/B test ---------------------------------------------------------------

def _ab_ctes(test_id: str = "TABW131") -> str:
    """Cohort by a window over each user's labels; everything else from distinct rows of its events."""
    group = f"nullif(regexp_extract(test_ab, '{test_id}_(\\w+)', 1), '')"
    reached = ",\n         ".join(
        f"count(distinct user_pseudo_id) filter (where event_name = '{e}') as users_{e}"
        for e in ("view_item", "add_to_cart", "begin_checkout", "purchase"))
    return f"""
labels_seen as (
  select distinct user_pseudo_id, starts_with(test_ab, '{test_id}') as ours,
         if(starts_with(test_ab, '{test_id}'), {group}, null) as test_group
  from ev where test_ab is not null and {RANGE}),
per_user as (
  select *, bool_or(not ours) over (partition by user_pseudo_id) as elsewhere from labels_seen),
members as (select user_pseudo_id, test_group from per_user where test_group is not null and not elsewhere),
member_events as (
  select ev.*, members.test_group from members, ev where members.user_pseudo_id = ev.user_pseudo_id and {RANGE}),
user_steps as (select distinct test_group, device_category, user_pseudo_id, event_name from member_events),
session_steps as (
  select test_group, device_category, session_id, bool_or(event_name = 'session_start') as started
  from member_events group by all),
group_sizes as (
  select test_group, count(distinct user_pseudo_id) as users, count(distinct session_id) as sessions,
         count(distinct user_pseudo_id) filter (where event_name = 'purchase') as conversions
  from member_events group by test_group),
shares as (
  select g.test_group, g.users, g.sessions, g.users / (select sum(users) from group_sizes) as user_share from group_sizes g),
kpi_users as (
  select test_group, device_category, count(distinct user_pseudo_id) as users,
         {reached}
  from user_steps group by test_group, device_category),
kpi_sessions as (
  select test_group, device_category, count(session_id) as sessions,
         count(session_id) filter (where started) as sessions_start
  from session_steps group by test_group, device_category),
kpi_money as (
  select test_group, device_category, count(distinct transaction_id) as transactions,
         cast(sum(if(event_name = 'purchase', cast(purchase_revenue as decimal(28,9)), 0)) as double) as total_revenue
  from member_events group by test_group, device_category),
kpi_base as (
  select * from kpi_users natural join kpi_sessions natural join kpi_money)"""


AB_COHORT = with_adapter(_ab_ctes() + """
select distinct user_pseudo_id, test_group from labels_seen where test_group is not null""")
AB_ISOLATED = with_adapter(_ab_ctes() + "\nselect user_pseudo_id, test_group from members")
SPLIT_STATUS = "if(user_share >= 0.45 and user_share <= 0.55, 'OK', 'UNEVEN_SPLIT') as split_status"
AB_SPLIT_CHECK = with_adapter(_ab_ctes() + f"\nselect *, {SPLIT_STATUS} from shares")
AB_METRICS = with_adapter(_ab_ctes() + "\nselect * from kpi_base")
AB_REPORT = with_adapter(_ab_ctes() + f"""
select k.*,
  {_sd('users_add_to_cart', 'users_view_item')} as cr_pdp_to_cart,
  {_sd('users_begin_checkout', 'users_add_to_cart')} as cr_cart_to_checkout,
  {_sd('users_purchase', 'k.sessions')} as cr_session_to_purchase,
  {_sd('users_purchase', 'users_view_item')} as cr_pdp_to_purchase,
  {_sd('total_revenue', 'k.sessions')} as revenue_per_session,
  {_sd('total_revenue', 'transactions')} as aov,
  {_sd('transactions', 'users_purchase')} as transactions_per_buyer,
  user_share, {SPLIT_STATUS}
from shares join kpi_base k on k.test_group = shares.test_group""")
AB_ZTEST = with_adapter(_ab_ctes() + f""",
against as (
  select v.test_group, c.sessions as sessions_a, c.conversions as conversions_a, v.sessions as sessions_b,
         v.conversions as conversions_b
  from group_sizes c, group_sizes v where c.test_group = 'a' and v.test_group <> c.test_group),
rates as (
  select *, {_sd('conversions_a', 'sessions_a')} as cr_a, {_sd('conversions_b', 'sessions_b')} as cr_b,
    {_sd('conversions_a + conversions_b', 'sessions_a + sessions_b')} as pooled_cr
  from against),
scored as (
  select *, (cr_b - cr_a) / nullif(sqrt(pooled_cr * (1.0::double - pooled_cr)
      * ({_sd('1', 'sessions_a')} + {_sd('1', 'sessions_b')})), 0) as z_value,
    (cr_b - cr_a) / nullif(cr_a, 0) as relative_uplift
  from rates),
levels(critical, label) as (values (2.576, 'p < 0.01'), (1.96, 'p < 0.05'), (1.645, 'p < 0.10'))
select *, coalesce((select arg_max(label, critical) from levels where abs(z_value) > critical), 'not significant')
  as significance
from scored""")

# --- reconciliation -------------------------------------------------------------

_RECON_CTES = f"""
ga4 as (
  select event_date as date, count(distinct transaction_id) as ga4_transactions,
         cast(sum(cast(purchase_revenue as decimal(28,9))) as double) as ga4_revenue
  from ev where transaction_id is not null and event_name = 'purchase' and {RANGE}
  group by event_date),
shop_days as (
  select cast(ts as date) as date, count(*) as n, sum(cast(value as decimal(28,9))) as rev
  from events where event_type = 'purchase' group by cast(ts as date)),
crm as (
  select date, cast(if(day(date) = 13, null, n) as double) as crm_transactions,
         cast(if(day(date) = 17, null, rev) as double) as crm_revenue
  from shop_days),
j as (
  select coalesce(g.date, c.date) as date, g.ga4_transactions, g.ga4_revenue, c.crm_transactions, c.crm_revenue
  from ga4 g full outer join crm c on g.date is not distinct from c.date),
rec as (
  select *,
    cast(ga4_transactions as double) - crm_transactions as trans_diff,
    round_even((cast(ga4_transactions as double) - crm_transactions) / nullif(crm_transactions, 0) * 100.0::double, 2)
      as trans_diff_pct,
    round_even(ga4_revenue - crm_revenue, 2) as rev_diff,
    round_even((ga4_revenue - crm_revenue) / nullif(crm_revenue, 0) * 100.0::double, 2) as rev_diff_pct
  from j),
flagged as (
  select *,
    coalesce(case when crm_transactions = 0 then cast(ga4_transactions as double) - crm_transactions <> 0
                  else abs(trans_diff_pct) > 10 end, false) as trans_flag,
    coalesce(case when crm_revenue = 0 then ga4_revenue - crm_revenue <> 0
                  else abs(rev_diff_pct) > 10 end, false) as rev_flag
  from rec)"""

GA4_DAILY = with_adapter(_RECON_CTES + "\nselect date, ga4_transactions, ga4_revenue from ga4")
CRM_DAILY = with_adapter(_RECON_CTES + "\nselect date, crm_transactions, crm_revenue from crm")
RECONCILE = with_adapter(_RECON_CTES + """
select date, ga4_transactions, ga4_revenue, crm_transactions, crm_revenue,
       trans_diff, trans_diff_pct, trans_flag, rev_diff, rev_diff_pct, rev_flag from flagged""")
RECONCILE_SUMMARY = with_adapter(_RECON_CTES + """
select min(date) as period_start, max(date) as period_end, count(*) as days,
  cast(coalesce(sum(ga4_transactions), 0) as double) as ga4_transactions_total,
  cast(coalesce(sum(crm_transactions), 0) as double) as crm_transactions_total,
  cast(sum(cast(trans_diff_pct as decimal(28,9))) as double) / nullif(count(trans_diff_pct), 0) as trans_avg_diff_pct,
  count(*) filter (where trans_flag) as trans_flagged_days,
  coalesce(cast(sum(cast(ga4_revenue as decimal(28,9))) as double), 0) as ga4_revenue_total,
  coalesce(cast(sum(cast(crm_revenue as decimal(28,9))) as double), 0) as crm_revenue_total,
  cast(sum(cast(rev_diff_pct as decimal(28,9))) as double) / nullif(count(rev_diff_pct), 0) as rev_avg_diff_pct,
  count(*) filter (where rev_flag) as rev_flagged_days
from flagged""")
RECONCILE_FLAGGED_REVENUE = with_adapter(_RECON_CTES + """
select date, ga4_revenue, crm_revenue, rev_diff_pct from flagged where rev_flag""")
RECONCILE_FLAGGED = with_adapter(_RECON_CTES + """
select date, ga4_transactions, crm_transactions, trans_diff_pct from flagged where trans_flag""")

# --- extensions -----------------------------------------------------------

# The promoted URL keys.
URL_KEYS = ["utm_source", "utm_medium", "utm_campaign", "utm_id", "utm_content", "utm_term", "utm_marketing_tactic",
            "utm_source_platform", "utm_creative_format", "gtm_debug", "_gl"]


def _url_value(key: str) -> str:
    """Value of the first ``key=`` among the parts of the query string (decoded), null when absent."""
    first = f"[x for x in parts if starts_with(x, '{key}=')][1]"
    return f"url_decode(substr({first}, {len(key) + 2}))"


def _url_fields() -> str:
    return """
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1) as hostname,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as path,
  """ + ",\n  ".join(f"{_url_value(k)} as {k}" for k in URL_KEYS) + f""",
  lower({_url_value("search_query")}) as search_query"""


URL_PARTS = "string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&') as parts"
URL_PARAMS = f"""
with split as (select page_id, url, {URL_PARTS} from pages)
select page_id, url as page_location,{_url_fields()}
from split"""
EVENT_URL_PARAMS = with_adapter(f"""
split as (select *, {URL_PARTS} from located where {RANGE})
select event_id, event_date, url as page_location,{_url_fields()}
from split""")
PROMOTED_PARAMS = with_adapter(f"""
x3 as (select 1)
select event_id, event_date, 'type ' || cast(event_id % 4 as varchar) as page_type,
  event_id * 7 % 5000 as engagement_time_msec, (event_id % 8) / 8.0::double as scroll_share,
  item_id, p1 as item_parameter_1, p25 as item_parameter_25, cast(k % 2 + 1 as bigint) as position
from it where {RANGE}""")
AB_COHORT_ITEMS = with_adapter(f"""
named as (
  select user_pseudo_id, string_split(p20, '_qs:_')[1] as test_part from it where {RANGE} and p20 is not null)
select distinct user_pseudo_id, string_split(test_part, '_ab:_')[2] as test_group
from named where string_split(test_part, '_ab:_')[1] = 'test:_TABW131'""")

TRANSACTION_TOTALS = with_adapter(f"""
p as (select * from ev where event_name = 'purchase' and transaction_id is not null and {RANGE}),
tot as (
  select transaction_id, min(event_date) as transaction_date,
         count(*) as purchase_events, cast(sum(n_items) as bigint) as total_items,
         cast(sum(cast(purchase_revenue as decimal(28,9))) as double) as revenue
  from p group by transaction_id),
u as (
  select p.transaction_id, count(distinct it.item_id) as unique_items,
         cast(sum(k % 3 + 1) as bigint) as item_quantity,
         cast(sum(cast((k % 1000 + 0.125) * (k % 3 + 1) as decimal(28,9))) as double) as item_revenue,
         string_agg(distinct if(k % 5 = 0, 'C' || cast(k % 4 as varchar), null), ','
                    order by if(k % 5 = 0, 'C' || cast(k % 4 as varchar), null)) as coupons
  from p join it on p.event_id = it.event_id group by p.transaction_id)
select tot.transaction_id, transaction_date, purchase_events, total_items,
       coalesce(u.unique_items, 0) as unique_items, revenue,
       coalesce(u.item_quantity, 0) as item_quantity, u.item_revenue, u.coupons
from tot left join u using (transaction_id)""")

RUNNING_TOTALS = with_adapter(f"""
d as (
  select user_pseudo_id, event_date, count(*) as purchases,
         sum(cast(purchase_revenue as decimal(28,9))) as rev
  from ev where event_name = 'purchase' and {RANGE} group by user_pseudo_id, event_date)
select user_pseudo_id, event_date, purchases, cast(rev as double) as revenue,
  cast(sum(purchases) over (partition by user_pseudo_id order by event_date
    rows between unbounded preceding and current row) as bigint) as cumulative_purchases,
  cast(sum(rev) over (partition by user_pseudo_id order by event_date rows between unbounded preceding and current row)
    as double) as cumulative_revenue
from d""")

PARAM_TYPES = with_adapter(f"""
event_keys as (
  select unnest([('engagement_time_msec', 'int'), ('page_type', 'string'), ('scroll_share', 'double')]) as k
  from ev where {RANGE}),
item_keys as (
  select unnest([{", ".join(f"('item_parameter_{n}', if(p{n} is null, null, 'string'))" for n in PARAMS)}, ('position', 'int')]) as k
  from it where {RANGE}),
entries as (
  select 'event' as level, k[1] as key, k[2] as type from event_keys
  union all select 'item', k[1], k[2] from item_keys where k[2] is not null)
select level, key, count(*) as n, count(*) filter (where type = 'string') as strings, count(*) filter (where type = 'int') as ints,
  count(*) filter (where type = 'double') as doubles, min(type) as type, min(type) <> max(type) as conflict
from entries group by level, key""")
INFERRED_PARAMS = with_adapter(f"""
x3 as (select 1)
select event_id, event_date, event_id * 7 % 5000 as engagement_time_msec, 'type ' || cast(event_id % 4 as varchar) as page_type,
  (event_id % 8) / 8.0::double as scroll_share, item_id, {", ".join(f"p{n} as item_parameter_{n}" for n in PARAMS)},
  cast(k % 2 + 1 as bigint) as position
from it where {RANGE}""")
CRM_MALFORMED = with_adapter(_RECON_CTES + """
select strftime(date, '%d.%m.%Y') || ',corrected,' || if(day(date) = 13, 'NaN', cast(n as varchar)) || ',1,50' as record,
  5 as fields
from shop_days""")

SESSION_METRICS = with_adapter(f"""
x2 as (select 1)
select event_date, device_category, count(distinct user_pseudo_id) as users,
       count(distinct session_id) as sessions, count(*) as events
from ev where {RANGE} group by event_date, device_category""")


ORACLE_SQL = {
    "funnel_by_segment": FUNNEL_BY_SEGMENT,
    "funnel_counts": FUNNEL_COUNTS,
    "funnel_medians": FUNNEL_MEDIANS,
    "funnel_by_segment_exact": FUNNEL_BY_SEGMENT,
    "funnel_medians_exact": FUNNEL_MEDIANS,
    "funnel_long_exact": FUNNEL_LONG,
    "funnel_session_pivot_bucketed": FUNNEL_SESSION_PIVOT,
    "ab_events_bucketed": with_adapter(_ab_ctes() + """
select event_name, event_date, session_id, user_pseudo_id, device_category, purchase_revenue,
       transaction_id, test_group from member_events"""),
    "funnel_counts_rollup": FUNNEL_COUNTS,
    "active_users_rolling": ACTIVE_USERS,
    "funnel_rates": FUNNEL_RATES,
    "funnel_base_events": FUNNEL_BASE_EVENTS,
    "funnel_session_pivot": FUNNEL_SESSION_PIVOT,
    "funnel_long": FUNNEL_LONG,
    "funnel_by_country": FUNNEL_BY_COUNTRY,
    "funnel_by_site": FUNNEL_BY_SITE,
    "listing_sessions_dedup_by_site": LISTING_DEDUP_BY_SITE,
    "listing_sessions_dedup": LISTING_SESSIONS_DEDUP,
    "parse_prices": _parse(1),
    "parse_prices_raw": _parse(1),
    "parse_trip": _parse(5),
    "parse_participants": _parse(9),
    "parse_cross_sell_availability": _parse(19),
    "parse_ab_item": _parse(20),
    "parse_ab_item_strict": _parse(20, strict=True),
    "parse_cross_sell_selected": _parse(25),
    "parse_prices_view_item": _parse_view_item(),
    "parse_items_all": _parse_all(),
    "parse_items_raw": _parse_all(),
    "parse_items_checked": _parse_all(),
    "ab_cohort": AB_COHORT,
    "ab_isolated": AB_ISOLATED,
    "ab_isolated_antijoin": AB_ISOLATED,
    "ab_contamination": with_adapter(_ab_ctes() + """,
seen_in as (select user_pseudo_id, count(*) as groups from members group by user_pseudo_id)
select count(user_pseudo_id) as cohort_users, count(*) filter (where groups > 1) as contaminated_users
from seen_in"""),
    "ab_events": with_adapter(_ab_ctes() + """
select event_name, event_date, session_id, user_pseudo_id, device_category, purchase_revenue,
       transaction_id, test_group from member_events"""),
    "ab_split_check": AB_SPLIT_CHECK,
    "ab_metrics": AB_METRICS,
    "ab_report": AB_REPORT,
    "ab_ztest": AB_ZTEST,
    "ga4_daily": GA4_DAILY,
    "ga4_daily_incremental": GA4_DAILY,
    "crm_daily": CRM_DAILY,
    "crm_daily_csv": CRM_DAILY,
    "crm_daily_inferred": CRM_DAILY,
    "crm_malformed_rows": CRM_MALFORMED,
    "reconcile": RECONCILE,
    "reconcile_summary": RECONCILE_SUMMARY,
    "reconcile_flagged_days": RECONCILE_FLAGGED,
    "reconcile_flagged_revenue": RECONCILE_FLAGGED_REVENUE,
    "reconcile_csv_roundtrip": RECONCILE,
    "ga4_daily_default_range": GA4_DAILY,
    "url_params": URL_PARAMS,
    "event_url_params": EVENT_URL_PARAMS,
    "promoted_params": PROMOTED_PARAMS,
    "ab_cohort_items": AB_COHORT_ITEMS,
    "transaction_totals": TRANSACTION_TOTALS,
    "running_totals": RUNNING_TOTALS,
    "running_totals_carried": RUNNING_TOTALS,
    "param_types": PARAM_TYPES,
    "inferred_params": INFERRED_PARAMS,
    "session_metrics": SESSION_METRICS,
}
