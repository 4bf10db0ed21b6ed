"""Parameters typed from the data, and lookups that fail on duplicate keys."""

import pytest
from pyspark.sql import functions as F

from clickflow.functions.exprs import array_lookup
from clickflow.operators import item_params

S, E = "2024-01-01", "2024-01-31"
VALUE = "struct<string_value:string,int_value:bigint,double_value:double>"


def arrays(spark, rows):
    return spark.createDataFrame([(k, [(key, v) for key, v in entries] if entries is not None else None) for k, entries in enumerate(rows)],
                                 f"row int, p array<struct<key:string,value:{VALUE}>>")


def s(x):
    return (x, None, None)


def i(x):
    return (None, x, None)


def d(x):
    return (None, None, x)


ROWS = [
    [("a", s("x")), ("n", i(1)), ("mixed", i(7))], [("a", s("y")), ("n", i(None)), ("mixed", s("seven"))],
    [("num", i(2)), ("mixed", d(0.5))], [("num", d(2.5)), (None, s("no key"))], [("empty", s(None)), ("null", None)], [], None,
]


def test_types_seen(spark):
    got = {r["key"]: (r["n"], r["strings"], r["ints"], r["doubles"], r["type"], r["conflict"])
           for r in item_params.param_types(arrays(spark, ROWS), "p").collect()}
    assert got == {
        "a": (2, 2, 0, 0, "string", False), "n": (2, 0, 1, 0, "int", False), "mixed": (3, 1, 1, 1, "string", True),
        "num": (2, 0, 1, 1, "double", True), "empty": (1, 0, 0, 0, None, False), "null": (1, 0, 0, 0, None, False)}


def test_struct_of_all_keys(spark):
    df = arrays(spark, ROWS)
    config = item_params.param_config(item_params.param_types(df, "p"))
    out = item_params.promote_params(df, config, "p", "all")
    assert {f.name: f.dataType.simpleString() for f in out.schema["all"].dataType.fields} == {
        "a": "string", "empty": "string", "mixed": "string", "n": "bigint", "null": "string", "num": "double"}
    rows = {r["row"]: r["all"].asDict() for r in out.collect()}
    assert [rows[k]["mixed"] for k in range(3)] == ["7", "seven", "0.5"] and [rows[k]["num"] for k in (2, 3)] == [2.0, 2.5]
    assert rows[0]["n"] == 1 and rows[1]["n"] is None and all(v is None for v in rows[6].values())


def test_key_sets_that_make_no_struct(spark):
    many = arrays(spark, [[(f"id{k}", i(k)) for k in range(50)]])
    with pytest.raises(ValueError, match="more than 20"):
        item_params.param_config(item_params.param_types(many, "p"), max_keys=20)
    with pytest.raises(ValueError, match="case only"):
        item_params.param_config(item_params.param_types(arrays(spark, [[("Key", i(1)), ("key", i(2))]]), "p"))
    assert item_params.param_config(item_params.param_types(arrays(spark, []), "p")) == []


def test_event_and_item_parameters_of_one_name(spark, tables001):
    ev = tables001.events.limit(20).withColumn("event_params_raw", F.transform("event_params_raw", lambda e: F.struct(
        F.lit("position").alias("key"), e["value"].alias("value"))))
    with pytest.raises(ValueError, match="share a column"):
        item_params.inferred_params(ev, S, E)


def test_checked_lookup(spark):
    once = arrays(spark, [[("a", s("x"))], [], None, [("b", s("y")), ("a", s(None))]])
    twice = arrays(spark, [[("a", s("x")), ("a", s("x"))]])
    first, checked = array_lookup("p", "a"), array_lookup("p", "a", on_duplicate="raise")
    assert [r[0] for r in once.select(checked).collect()] == [r[0] for r in once.select(first).collect()] == ["x", None, None, None]
    assert twice.select(first).first()[0] == "x"
    with pytest.raises(Exception, match="more than one element has key 'a'"):
        twice.select(checked).collect()
    with pytest.raises(ValueError):
        array_lookup("p", "a", on_duplicate="last")


def test_checked_parsers_fail_on_duplicate_keys(spark, tables001):
    ev = tables001.events.where("n_items > 0") if "n_items" in tables001.events.columns else tables001.events
    assert item_params.parse_param(ev, 5, S, E, source="raw", on_duplicate="raise").collect() == \
        item_params.parse_param(ev, 5, S, E, source="raw").collect()
    doubled = ev.withColumn("items", F.transform("items", lambda it: it.withField(
        "item_params", F.concat(it["item_params"], it["item_params"]))))
    item_params.parse_param(doubled, 5, S, E, source="raw").count()
    with pytest.raises(Exception, match="more than one element"):
        item_params.parse_param(doubled, 5, S, E, source="raw", on_duplicate="raise").collect()
