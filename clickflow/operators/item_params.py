"""Typed columns from encoded item parameters (``key:_value`` pairs joined by ``_``).

One declarative table drives every parser: ``param number -> [(column,
regex, type)]``. Parsing is a narrow stage (scan -> explode items ->
projection): no shuffle, the regexes run JVM-side in codegen, and nested
column pruning reads only the item fields used. ``parse_items`` explodes
once and extracts any number of parameters in that single pass.

Semantics follow the warehouse functions: no match -> null; integer
overflow -> null (``SAFE_CAST``); events with empty or null ``items`` drop
out (``UNNEST`` in a comma join, i.e. ``explode`` not ``explode_outer``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickflow.functions.exprs import array_lookup, regex_extract, regex_extract_int
from clickflow.operators.funnel import in_date_range
from clickflow.plans.materialize import materialize

# ---------------------------------------------------------------------------
# Output column, regex (capture group 1) and type for each
# custom item parameter, exactly as the reference parses them ("int" columns
# are SAFE_CAST to a 64-bit integer).
# ---------------------------------------------------------------------------
PARAM_SPECS: dict[int, list[tuple[str, str, str]]] = {
    1: [
        ("price_per_person", r"per:_(\d+)", "int"),
        ("price_per_room", r"room:_(\d+)", "int"),
        ("price_display_type", r"filter:_(\w+)", "str"),
        ("price_summary", r"summary:_(\d+)", "int"),
        ("listing_price", r"listing_price:_(\d+)", "int"),
    ],
    5: [
        ("trip_duration_days", r"d:_(\d+)", "int"),
        ("days_to_trip", r"dtt:_(\d+)", "int"),
        ("listing_offers_count", r"offers:_(\d+)", "int"),
    ],
    9: [
        ("adults_count", r"(?:adult|a):_(\d+)", "int"),
        ("children_count", r"(?:child|c):_(\d+)", "int"),
    ],
    19: [
        ("parking_available", r"^p:_(\d)", "int"),
        ("insurance_available", r"i:_(\d)", "int"),
        ("promesa_available", r"pr:_(\d)", "int"),
        ("luggage_available", r"l:_(\d)", "int"),
        ("seats_together_available", r"s:_(\d)", "int"),
    ],
    20: [
        ("test_id", r"test:_(\w+)", "str"),
        ("test_group", r"ab:_(\w+)", "str"),
        ("qs_segment", r"qs:_(\w+)", "str"),
    ],
    25: [
        ("parking_selected", r"^p:_(\d)", "int"),
        ("parking_name", r"^p:_\d-(.+?)_i:", "str"),
        ("insurance_selected", r"i:_(\d)", "int"),
        ("insurance_name", r"i:_\d-(.+?)_pr:", "str"),
        ("promesa_selected", r"pr:_(\d)", "int"),
        ("luggage_selected", r"l:_(\d)", "int"),
    ],
}
# Item attributes carried by the price parser (param 1) only.
PRICE_ITEM_FIELDS = ("item_name", "item_brand")
# ---------------------------------------------------------------------------

# Strict mode: ``\w`` includes ``_``, so the greedy reference patterns run on
# into the next key (``test:_TABW131_ab:_a`` gives ``TABW131_ab``). These lazy
# patterns stop at the next ``_key:_`` and give the documented values.
STRICT_OVERRIDES = {
    "price_display_type": r"filter:_(\w+?)(?:_\w+:_|$)",
    "test_id": r"test:_(\w+?)(?:_\w+:_|$)",
    "test_group": r"ab:_(\w+?)(?:_\w+:_|$)",
    "qs_segment": r"qs:_(\w+?)(?:_\w+:_|$)",
}

EVENT_FIELDS = ("event_date", "event_name", "session_id", "user_pseudo_id")


def param_key(n: int) -> str:
    return f"item_parameter_{n}"


def _param_path(n: int, source: str) -> tuple[str, str]:
    """(zipped field name, path inside one item) holding parameter ``n``."""
    if source == "custom":
        return f"p{n}", f"item_params_custom.{param_key(n)}"
    if source == "raw":
        return "item_params", "item_params"
    raise ValueError(f"unknown source {source!r}: use 'custom' or 'raw'")


def param_source(n: int, source: str = "custom", on_duplicate: str = "first") -> Column:
    """The raw string of parameter ``n`` on an exploded item ``i``.

    ``custom``: the configured struct field ``item_params_custom.item_parameter_N``.
    ``raw``: lookup in the item's key/value array ``item_params`` (no subquery);
    ``on_duplicate="raise"`` fails on an item that has the key twice.
    """
    name, _ = _param_path(n, source)
    if source == "custom":
        return F.col(f"i.{name}")
    return array_lookup(F.col(f"i.{name}"), param_key(n), on_duplicate=on_duplicate)


def parsed_columns(raw: Column, n: int, mode: str = "reference") -> list[Column]:
    out = []
    for name, pattern, typ in PARAM_SPECS[n]:
        if mode == "strict":
            pattern = STRICT_OVERRIDES.get(name, pattern)
        expr = regex_extract_int(raw, pattern) if typ == "int" else regex_extract(raw, pattern)
        out.append(expr.alias(name))
    return out


def exploded_items(events: DataFrame, start, end, fields: dict[str, str] | None = None) -> DataFrame:
    """One row per (event, item) with the item fields in struct ``i``.

    ``fields`` maps an output name to a path inside an item (default: just
    ``item_id``). The items are zipped from per-field array extractions
    before the explode, so Parquet reads only those nested fields -- a plain
    ``explode(items)`` followed by several field accesses reads every item
    field. Events with null or empty ``items`` produce no row, as with
    ``UNNEST`` in a comma join.
    """
    fields = fields or {"item_id": "item_id"}
    zipped = F.arrays_zip(*[F.col(f"items.{path}").alias(name) for name, path in fields.items()])
    return in_date_range(events, start, end).select(*EVENT_FIELDS, F.explode(zipped).alias("i"))


def _item_fields(params, source: str, with_names: bool) -> dict[str, str]:
    fields = {"item_id": "item_id"}
    if with_names:
        fields.update({f: f for f in PRICE_ITEM_FIELDS})
    for n in params:
        name, path = _param_path(n, source)
        fields[name] = path
    return fields


def parse_param(events: DataFrame, n: int, start, end, source: str = "custom",
                mode: str = "reference", on_duplicate: str = "first") -> DataFrame:
    """U6..U12: parse one parameter, with the event keys, ``item_id`` and ``raw_param_N``."""
    if n not in PARAM_SPECS:
        raise ValueError(f"no parser for item_parameter_{n}; known: {sorted(PARAM_SPECS)}")
    items = exploded_items(events, start, end, _item_fields([n], source, with_names=(n == 1)))
    raw = F.col(f"raw_param_{n}")
    extra = [F.col(f"i.{f}").alias(f) for f in PRICE_ITEM_FIELDS] if n == 1 else []
    base = items.select(*EVENT_FIELDS, F.col("i.item_id").alias("item_id"), *extra,
                        param_source(n, source, on_duplicate).alias(f"raw_param_{n}"))
    return base.select(*base.columns, *parsed_columns(raw, n, mode))


def parse_items(events: DataFrame, start, end, params=tuple(PARAM_SPECS), source: str = "custom",
                mode: str = "reference", on_duplicate: str = "first") -> DataFrame:
    """All requested parameters from a single explode (one pass over the items)."""
    items = exploded_items(events, start, end, _item_fields(params, source, with_names=True))
    base = items.select(
        *EVENT_FIELDS, F.col("i.item_id").alias("item_id"),
        *[F.col(f"i.{f}").alias(f) for f in PRICE_ITEM_FIELDS],
        *[param_source(n, source, on_duplicate).alias(f"raw_param_{n}") for n in params],
    )
    parsed = []
    for n in params:
        parsed += parsed_columns(F.col(f"raw_param_{n}"), n, mode)
    return base.select(*base.columns, *parsed)


# The field of a parameter's ``value`` struct that holds each type.
VALUE_FIELDS = {"string": "string_value", "int": "int_value", "double": "double_value"}
CAST_TYPES = {"string": "string", "int": "bigint", "double": "double"}


def promoted_struct(array: Column | str, config, on_duplicate: str = "first") -> Column:
    """The configured parameters of a key/value array as a typed struct.

    ``config`` lists names (strings) or ``(name, type)`` pairs with type
    ``string``, ``int`` or ``double``; each type is read from its own field of
    ``value``. An absent key, or one whose value has another type, is null. A
    third part of a pair lists several types to read, cast to the first one
    named; :func:`param_config` gives such entries for parameters of mixed type.
    """
    fields = []
    for entry in config:
        name, typ, *more = (entry, "string") if isinstance(entry, str) else entry
        seen = more[0] if more else [typ]
        for t in (typ, *seen):
            if t not in VALUE_FIELDS:
                raise ValueError(f"unknown parameter type {t!r}; known: {sorted(VALUE_FIELDS)}")
        if seen == [typ]:
            value = array_lookup(array, name, value_path=("value", VALUE_FIELDS[typ]), on_duplicate=on_duplicate)
        else:
            whole = array_lookup(array, name, value_path=("value",), on_duplicate=on_duplicate)
            value = F.coalesce(*[whole[VALUE_FIELDS[t]].cast(CAST_TYPES[typ]) for t in seen])
        fields += [F.lit(name), value]
    return F.named_struct(*fields)


def param_types(df: DataFrame, array_col: str) -> DataFrame:
    """What the key/value arrays of a table hold: one row per key.

    ``n`` is how many entries the key has, ``strings``, ``ints`` and
    ``doubles`` how many have a value of that type, ``type`` the type that
    holds all of them (``int`` and ``double`` meet as ``double``, anything and
    ``string`` as ``string``; null if no entry has a value), and ``conflict``
    whether more than one type was seen. Entries without a key are left out.
    One partial aggregation over the exploded keys.
    """
    entry = df.select(F.explode(array_col).alias("e")).where(F.col("e.key").isNotNull())
    counted = entry.groupBy(F.col("e.key").alias("key")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(F.col(f"e.value.{field}")).alias(f"{t}s") for t, field in VALUE_FIELDS.items()])
    held = (F.when(F.col("strings") > 0, F.lit("string")).when(F.col("doubles") > 0, F.lit("double"))
            .when(F.col("ints") > 0, F.lit("int")))
    kinds = sum((F.col(f"{t}s") > 0).cast("int") for t in VALUE_FIELDS)
    return counted.withColumns({"type": held, "conflict": kinds > 1})


def param_config(types: DataFrame, max_keys: int = 1000) -> list[tuple]:
    """A configuration for :func:`promoted_struct` of all keys of :func:`param_types`, in order of their names.

    Keys without any value come as strings. More than ``max_keys`` keys make
    no struct but an error (keys made from data, such as ids), and so do keys
    that differ in case only.
    """
    rows = types.orderBy("key").limit(max_keys + 1).collect()
    if len(rows) > max_keys:
        raise ValueError(f"more than {max_keys} parameter keys; promote a chosen list instead")
    folded: dict[str, str] = {}
    for r in rows:
        if folded.setdefault(r["key"].lower(), r["key"]) != r["key"]:
            raise ValueError(f"parameter keys differ in case only: {folded[r['key'].lower()]!r}, {r['key']!r}")
    order = ("string", "double", "int")
    return [(r["key"], r["type"] or "string", [t for t in order if r[f"{t}s"]] or ["string"]) for r in rows]


def promote_params(df: DataFrame, config, array_col: str = "item_params",
                   struct_name: str = "item_params_custom") -> DataFrame:
    """Turn a key/value array column into a typed struct of the configured parameters.

    Serves events (``array_col="event_params_raw"``) and exploded items alike.
    """
    return df.withColumn(struct_name, promoted_struct(array_col, config))


def all_param_types(events: DataFrame, start, end) -> DataFrame:
    """:func:`param_types` of the events' and the items' arrays (``level`` is ``event`` or ``item``)."""
    ev = in_date_range(events, start, end)
    items = ev.select(F.explode(F.col("items.item_params")).alias("item_params"))
    return param_types(ev, "event_params_raw").select(F.lit("event").alias("level"), "*").unionByName(
        param_types(items, "item_params").select(F.lit("item").alias("level"), "*"))


def inferred_params(events: DataFrame, start, end, max_keys: int = 1000) -> DataFrame:
    """X5 without a configuration: one row per (event, item), every parameter seen as a typed column.

    Types come from the data (:func:`param_types`, whose ``conflict`` column reports
    mixed ones); event and item parameters of one name are an error.
    """
    types = materialize(all_param_types(events, start, end))
    event_config, item_config = (param_config(types.where(F.col("level") == level), max_keys) for level in ("event", "item"))
    both = {e[0].lower() for e in event_config} & ({i[0].lower() for i in item_config} | {"event_id", "event_date", "item_id"})
    both |= {i[0].lower() for i in item_config} & {"event_id", "event_date", "item_id"}
    if both:
        raise ValueError(f"parameters that would share a column: {sorted(both)}")
    return promoted_params(events, event_config, item_config, start, end)


def promoted_params(events: DataFrame, event_config, item_config, start, end) -> DataFrame:
    """X5 over events and their items: one row per (event, item), configured parameters as columns.

    Event parameters come from ``event_params_raw``, item parameters from
    ``items.item_params``. A narrow stage: explode and projection, no shuffle.
    """
    items = F.arrays_zip(F.col("items.item_id").alias("item_id"), F.col("items.item_params").alias("item_params"))
    rows = in_date_range(events, start, end).select(
        "event_id", "event_date", promoted_struct("event_params_raw", event_config).alias("e"), F.explode(items).alias("i"))
    typed = rows.select("event_id", "event_date", "e", F.col("i.item_id").alias("item_id"),
                        promoted_struct("i.item_params", item_config).alias("p"))
    return typed.select("event_id", "event_date", "e.*", "item_id", "p.*")
