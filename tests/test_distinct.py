"""Two-level distinct counts and the branch merge, against brute force."""

from pyspark.sql import functions as F

from clickflow.operators.distinct import DistinctBranch, distinct_counts, merge_on_keys

ROWS = [
    # seg, user, session, flag, amount
    ("a", "u1", "s1", 1, 10), ("a", "u1", "s2", 0, 5), ("a", "u2", "s3", 1, 1),
    ("a", None, "s4", 1, 2), ("b", "u1", "s5", 0, 3), (None, "u3", "s6", 1, 4),
    (None, "u3", "s6", 1, 4), (None, None, None, 0, 7),
]
SCHEMA = "seg string, user string, session string, flag int, amount int"


def _brute(rows, keyf):
    out = {}
    for seg, user, session, flag, amount in rows:
        k = keyf(seg)
        d = out.setdefault(k, {"users": set(), "flag_users": set(), "sessions": set(), "amount": 0})
        if user is not None:
            d["users"].add(user)
            if flag == 1:
                d["flag_users"].add(user)
        if session is not None:
            d["sessions"].add(session)
        d["amount"] += amount
    return {k: (len(v["users"]), len(v["flag_users"]), len(v["sessions"]), v["amount"]) for k, v in out.items()}


def _branches():
    return [
        DistinctBranch("user", {"users": None, "flag_users": F.col("flag") == 1},
                       sums={"amount": F.col("amount")}, sum_types={"amount": "bigint"}),
        DistinctBranch("session", {"sessions": None}),
    ]


def test_grouped_with_null_keys(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {r["seg"]: (r["users"], r["flag_users"], r["sessions"], r["amount"])
           for r in distinct_counts(df, ["seg"], _branches()).collect()}
    assert got == _brute(ROWS, lambda s: s)


def test_global_without_keys(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    r = distinct_counts(df, [], _branches()).collect()
    assert len(r) == 1
    assert (r[0]["users"], r[0]["flag_users"], r[0]["sessions"], r[0]["amount"]) == _brute(ROWS, lambda s: 0)[0]


def test_matches_count_distinct_and_has_no_expand(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    ours = distinct_counts(df, ["seg"], _branches())
    ref = df.groupBy("seg").agg(
        F.count_distinct("user").alias("users"),
        F.count_distinct(F.when(F.col("flag") == 1, F.col("user"))).alias("flag_users"),
        F.count_distinct("session").alias("sessions"),
        F.sum("amount").cast("bigint").alias("amount"))
    assert sorted(ours.select(*ref.columns).collect(), key=str) == sorted(ref.collect(), key=str)
    assert "Expand" not in ours._jdf.queryExecution().executedPlan().toString()


def test_merge_keeps_null_segment_single(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 10), ("x", 20)], "k string, b int")
    got = sorted(merge_on_keys([a, b], ["k"]).collect(), key=str)
    assert [(r["k"], r["a"], r["b"]) for r in got] == sorted([(None, 1, 10), ("x", 2, 20)], key=str)
