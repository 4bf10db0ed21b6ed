"""Property test: Spark parsers equal a brute-force Python evaluation of the same rules."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clickflow.operators import item_params as ip

KEYS = ["per", "room", "filter", "summary", "listing_price", "d", "dtt", "offers", "adult", "a",
        "child", "c", "p", "i", "pr", "l", "s", "test", "ab", "qs", "x"]
VALUE = st.one_of(
    st.integers(min_value=0, max_value=10**22).map(str),  # includes 64-bit overflow
    st.sampled_from(["person", "total", "TABW131", "seg1", "a", "b", "0", "1"]),
    st.from_regex(r"[0-9]-[A-Za-z ]{1,8}", fullmatch=True),  # "1-Parking A"
)
PARAM = st.lists(st.tuples(st.sampled_from(KEYS), VALUE), min_size=0, max_size=6).map(
    lambda kv: "_".join(f"{k}:_{v}" for k, v in kv))
JUNK = st.one_of(st.none(), st.just(""), st.text(alphabet="pi:_-0123456789ab", max_size=12))
STRINGS = st.lists(st.one_of(PARAM, JUNK), min_size=20, max_size=60)

INT64_MAX = 2**63 - 1


def _expected(value, pattern, typ):
    if value is None:
        return None
    m = re.search(pattern, value)
    g = m.group(1) if m else None
    if not g:
        return None
    if typ == "int":
        n = int(g)
        return n if n <= INT64_MAX else None
    return g


@settings(max_examples=6, deadline=None)
@given(STRINGS)
def test_all_parsers_match_python(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    cols = []
    for n, specs in ip.PARAM_SPECS.items():
        cols += [c.alias(f"{n}_{name}") for (name, _, _), c in zip(specs, ip.parsed_columns(F.col("v"), n))]
    got = {r["i"]: r.asDict() for r in df.select("i", *cols).collect()}
    for i, v in enumerate(values):
        for n, specs in ip.PARAM_SPECS.items():
            for name, pattern, typ in specs:
                assert got[i][f"{n}_{name}"] == _expected(v, pattern, typ), (v, n, name)
