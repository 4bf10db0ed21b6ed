"""DuckDB SQL of the queries here that SQL can express."""

from __future__ import annotations

from clickflow.llm import lexical_search, licenses, secrets, vector_codes

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def secret_scan() -> str:
    """Offsets from the lengths of the matches and of the texts between them."""
    scans = "\n  union all ".join(
        f"select row, {at} as place, {_quoted(r.kind)} as kind, {r.least} as least, string_split_regex(t, {_quoted(r.pattern)}) as gaps, "
        f"regexp_extract_all(t, {_quoted(r.pattern)}, 0) as hits, regexp_extract_all(t, {_quoted(r.pattern)}, {r.group}) as vals "
        f"from texts where regexp_matches(t, {_quoted(r.pattern)})"
        for at, r in enumerate(secrets.RULES))
    listed = "string_agg(kind || ':' || start || ':' || stop, ',' order by start, place, stop)"
    counts = ", ".join(f"count(*) filter (where kind = '{k}') as n_{k}" for k in secrets.BASE)
    return f"""
with texts as (select row_number() over () as row, doc_id, coalesce(text, '') as t from documents),
scans as ({scans}),
places as (
  select row, place, kind, least, unnest(range(1, len(hits) + 1)) as i, gaps, hits, vals from scans),
ends as (
  select row, place, kind, least, length(vals[i]) as size, length(hits[i]) as hit,
         list_sum([length(x) for x in gaps[1:i]]) + list_sum([length(x) for x in hits[1:i]]) as stop
  from places),
spans as (
  select row, place, kind, cast(stop - hit as bigint) as start, cast(stop as bigint) as stop from ends where size >= least),
found as (
  select row, {counts}, {listed} filter (where place < {len(secrets.BASE)}) as base, {listed} as spans from spans group by row)
select doc_id, {", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in secrets.BASE)},
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from texts left join found using (row)"""


def license_scan() -> str:
    """Votes by diagonal over all runs of words, neighbouring diagonals merged."""
    k = licenses.K
    listed = [(p, x, "true") for p, x in licenses.BASE_PHRASES] + [(p, x, "false") for p, x in licenses.TEMPLATES]
    rows = ", ".join(f"({n}, {base}, '{label}', string_split('{text}', ' '))" for n, (text, label, base) in enumerate(listed))
    return f"""
with texts as (select row_number() over () as row, doc_id, {_WORDS} as w from documents),
templates(template, base, label, tw) as (values {rows}),
template_runs as (
  select template, base, label, len(tw) - {k - 1} as runs, unnest(range(len(tw) - {k - 1})) as place, tw from templates),
grams as (select * exclude (tw), array_to_string(tw[place + 1:place + {k}], ' ') as gram from template_runs),
places as (select row, unnest(range(len(w) - {k - 1})) as pos, w from texts where len(w) >= {k}),
text_grams as (select row, pos, array_to_string(w[pos + 1:pos + {k}], ' ') as gram from places),
votes as (
  select distinct row, template, base, label, runs, place, pos - place as diagonal from text_grams join grams using (gram)),
exact as (
  select row, label, diagonal as start, 1.0::double as cover from votes
  where base group by row, template, label, runs, diagonal having count(*) = runs),
diagonals as (
  select distinct row, template, diagonal from votes where not base),
steps as (
  select *, coalesce(diagonal - lag(diagonal) over (partition by row, template order by diagonal) > {licenses.MAX_SHIFT}, true) as fresh
  from diagonals),
bands as (
  select *, sum(cast(fresh as integer)) over (partition by row, template order by diagonal) as band from steps),
merged as (
  select row, label, runs, count(distinct place) as covered, max(diagonal + place) + {k} - min(diagonal + place) as length
  from votes join bands using (row, template, diagonal) where not base group by row, template, label, runs, band),
loose as (
  select row, label, covered / runs as cover from merged
  where covered / runs >= {licenses.LEAST_COVER} and length <= {licenses.MOST_LENGTH} * (runs + {k - 1})),
base_found as (
  select row, count(*) as n_base, min(start) as first_word, max(start) as last_word,
         string_agg(distinct label, ',' order by label) as base_labels
  from exact group by row),
all_found as (
  select row, string_agg(distinct label, ',' order by label) as labels, max(cover) as score
  from (select row, label, cover from exact union all select row, label, cover from loose) group by row)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0::double) as score
from texts left join base_found using (row) left join all_found using (row)"""


DECONTAMINATION = f"""
with texts as (select row_number() over () as row, doc_id, {_WORDS} as w from documents),
items as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark where item_id is not null),
item_places as (
  select item, w, least(10, len(w)) as n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from items where len(w) > 0),
windows as (select distinct item, n, array_to_string(w[i:i + n - 1], ' ') as gram from item_places),
lengths as (select distinct n from windows),
places as (select row, n, w, unnest(range(1, len(w) - n + 2)) as i from texts, lengths where len(w) >= n),
grams as (select row, n, i, array_to_string(w[i:i + n - 1], ' ') as gram from places),
hits as (select row, i, n, item from grams join windows using (n, gram)),
hit_words as (select row, count(distinct place) as n_hit from (select row, unnest(range(i, i + n)) as place from hits) group by row),
hit_items as (
  select row, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as names from hits group by row)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from texts left join hit_words using (row) left join hit_items using (row)"""

def vector_codes_sql() -> str:
    """Every part against every entry, round by round; distances as doubles, which hold these whole numbers exactly."""
    parts, rounds = vector_codes.PARTS, vector_codes.ROUNDS

    def assigned(r: int) -> str:
        return f"""
near{r} as materialized (
  select row, p.part, min((norm + size - 2 * list_inner_product(p.x, b.x))::hugeint * 1000 + entry) as best
  from parts p join (select *, list_inner_product(x, x) as size from book{r}) b on p.part = b.part group by row, p.part),
code{r} as materialized (select row, part, (best % 1000)::integer as entry, (best // 1000)::bigint as error from near{r})"""

    def refined(r: int) -> str:
        return f"""
sums{r} as (
  select part, entry, i, sum(x[i]::bigint) as s, count(*) as n
  from (select c.part, c.entry, p.x, unnest(range(1, len(p.x) + 1)) as i from code{r} c join parts p using (row, part))
  group by part, entry, i),
means{r} as (
  select part, entry, list(((s - ((s % n) + n) % n) // n)::double order by i) as x from sums{r} group by part, entry),
book{r + 1} as materialized (
  select b.part, b.entry, coalesce(m.x, b.x) as x from book{r} b left join means{r} m on m.part = b.part and m.entry = b.entry)"""

    steps = ",".join(assigned(r) + "," + refined(r) for r in range(rounds))
    return f"""
with whole as (
  select row_number() over () as row, vec_id, label, list_transform(embedding, lambda c: floor(c::double * {vector_codes.SCALE})) as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
parts as materialized (
  select row, part, x, list_inner_product(x, x) as norm
  from (select row, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] as x
        from (select row, v, unnest(range({parts})) as part from whole))),
first as (
  select row, row_number() over (order by vec_id nulls last, v) - 1 as entry from whole
  qualify row_number() over (order by vec_id nulls last, v) <= {vector_codes.ENTRIES}),
book0 as materialized (select part, entry, x from first join parts using (row)),{steps},{assigned(rounds)},
coded as (
  select row, string_agg(printf('%02x', entry), '' order by part) as code, sum(error)::bigint as error from code{rounds} group by row),
labelled as (select vec_id, label, code, error from whole join coded using (row))
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error,
  (select sha256(string_agg(array_to_string(list_transform(x, lambda c: c::bigint::varchar), ','), ',' order by part, entry))
   from book{rounds}) as codebooks_sha256
from labelled"""


_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

LEXICAL_SEARCH = f"""
with texts as (select row_number() over () as row, doc_id, {_TERMS} as t from documents),
totals as (select count(*)::bigint as n_docs, sum(len(t))::bigint as n_terms from texts where len(t) > 0),
counted as (select row, term, count(*) as tf from (select row, unnest(t) as term from texts) group by row, term),
items as (select row_number() over () as item, item_id, {_TERMS} as t from benchmark),
item_terms as (select distinct item, unnest(t) as term from items),
weights as (
  select term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::bigint as w
  from counted, totals where term in (select term from item_terms) group by term),
impacts as (
  select row, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(t) * n_docs) // n_terms))) as impact
  from counted join weights using (term) join texts using (row), totals),
scores as (select item, row, sum(impact)::bigint as score from item_terms join impacts using (term) group by item, row),
ranked as (
  select item, doc_id, score, row_number() over (partition by item order by score desc, doc_id nulls last) as rank
  from scores join texts using (row) where score > 0)
select item_id, rank::integer as rank, doc_id, score from ranked join items using (item) where rank <= {lexical_search.TOP}"""

ORACLE_SQL: dict[str, str] = {
    "op3_secret_scan": secret_scan(),
    "op7_license_scan": license_scan(),
    "op10_decontamination": DECONTAMINATION,
    "op11_vector_codes": vector_codes_sql(),
    "op12_lexical_search": LEXICAL_SEARCH,
}
