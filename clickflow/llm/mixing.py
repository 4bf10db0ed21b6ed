"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should appear ``target / source size`` times on
average. The whole part of that number is taken outright; the fractional
part is rounded dependently. Two documents with fractional copy probabilities
meet, and words of probability are moved from one to the other, at random in
a way that keeps both expectations, until one of them is 0 or 1. Their words
in expectation stay exactly the same, so a source ends up within one document
of its target.

The pairing is a tree of grouped tasks. At the bottom, a source's documents
are dealt by a hash of their content into groups of about ``group_docs``
(a large source has many); each group leaves one document undecided. The
undecided ones are dealt into groups again, until a source has one left,
which is decided by its own probability. All random numbers are hashes of
document, seed and level, so the same rows always give the same mix.

Rows equal in id, source and text are one document with a weight: ``n`` of them
expect ``n`` times the copies, of which the whole part is taken outright, and
share what they get evenly. They are counted where they lie and numbered by
stretches (the equal rows of one partition), so however many there are, no
task holds them all.

Defined cases: a null text has size 0; documents of size 0 are taken as often
as the whole part says and settle their fraction by themselves; a null source
is a source of its own, last in order; repeated rows are a document with a weight; null ids
are ordinary values; other columns are ignored by ``mix_sizes`` and kept by
``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickflow.llm.common import SPACE_WORD, free_name, keep

GROUP_DOCS = 2_000
#: Undecided documents that meet in one group above the first level.
FAN_IN = 500


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, max_copies: float = 2.0,
                   times_col: str | None = None) -> DataFrame:
    """Per source: ``source_size``, ``docs`` (rows of ``sizes``) and ``target`` words.

    A row counts as often as ``times_col`` says, once without it.

    Sources in code point order (null last) weigh ``weights`` in turn and
    share ``share`` times all words; none gets more than ``max_copies`` times
    its own, and what is over goes to the others by weight. That ends where
    every target is the smaller of its limit and one common rate times its
    weight; the rate follows from the sources sorted by limit per weight.
    The windows run over one row per source.
    """
    times = F.col(times_col) if times_col else F.lit(1)
    own = sizes.groupBy("source").agg(F.sum(F.col("size") * times).alias("source_size"), F.count(F.lit(1)).alias("docs"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn + 1).cast("int"))
    everything = Window.partitionBy()
    by_limit = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    return (own.withColumn("weight", weight)
            .withColumn("cap", F.col("source_size") * F.lit(float(max_copies)))
            .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
            .withColumn("capped", F.coalesce(F.sum("cap").over(by_limit), F.lit(0.0)))
            .withColumn("free", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_limit), F.lit(0.0)))
            # the rate if exactly the sources before this one are at their limits; where it exceeds
            # this source's limit per weight, this one is at its limit too
            .withColumn("rate", (F.col("budget") - F.col("capped")) / F.col("free"))
            .withColumn("at_limit", F.col("rate") >= F.col("cap") / F.col("weight"))
            # the first below its limit has the true rate; those after it count too much as capped and get less
            .withColumn("common", F.max(F.when(~F.col("at_limit"), F.col("rate"))).over(everything))
            .select("source", "source_size", "docs",
                    F.when(F.col("at_limit") | F.col("common").isNull(), F.col("cap"))
                    .otherwise(F.least(F.col("cap"), F.col("common") * F.col("weight"))).alias("target")))


def _chances(ties, turn: int, seed: int) -> list[float]:
    """Uniform numbers in [0, 1) from hashes (numpy uint64) by a 64-bit mixing function."""
    import numpy as np

    z = ties + np.uint64((seed * 1_000_003 + turn * 0x9E3779B97F4A7C15) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)).tolist()


def _settle(level: int, seed: int, last: bool):
    """Decide all documents of a group but one (or all, on the last level).

    Large documents go first, so that smaller ones settle them and the one left is small.
    """
    def run(key, rows):
        import numpy as np
        import pandas as pd

        rows = rows.sort_values(["size", "tie", "row"], ascending=[False, True, True], kind="stable")
        n = len(rows)
        p = rows["p"].to_numpy(dtype=np.float64).tolist()
        size = rows["size"].tolist()
        ties = rows["tie"].to_numpy(dtype=np.int64).view(np.uint64)
        chance, alone = _chances(ties, 2 * level, seed), _chances(ties, 2 * level + 1, seed)
        take = [-1] * n
        held = -1
        for i in range(n):
            if p[i] <= 0 or p[i] >= 1 or size[i] == 0:
                take[i] = int(p[i] >= 1 or p[i] > 0 and alone[i] < p[i])
                continue
            if held < 0:
                held = i
                continue
            a, b = held, i
            # words that can move from a to b, and from b to a
            ab = min(p[a] * size[a], (1 - p[b]) * size[b])
            ba = min(p[b] * size[b], (1 - p[a]) * size[a])
            if chance[i] * (ab + ba) < ba:
                moved, giver, taker = ab, a, b
            else:
                moved, giver, taker = ba, b, a
            gives_all = p[giver] * size[giver] <= moved
            fills = (1 - p[taker]) * size[taker] <= moved
            p[giver] = 0.0 if gives_all else p[giver] - moved / size[giver]
            p[taker] = 1.0 if fills else p[taker] + moved / size[taker]
            held = -1
            for k in (a, b):
                if p[k] <= 0 or p[k] >= 1:
                    take[k] = int(p[k] >= 1)
                else:
                    held = k
        if last and held >= 0:
            take[held] = int(alone[held] < p[held])
        return pd.DataFrame({"row": rows["row"].to_numpy(), "source": rows["source"].to_numpy(), "tie": rows["tie"].to_numpy(),
                             "size": rows["size"].to_numpy(), "p": p, "extra": np.asarray(take, dtype=np.int32)})
    return run


_SETTLED = T.StructType([
    T.StructField("row", T.LongType()), T.StructField("source", T.StringType()), T.StructField("tie", T.LongType()),
    T.StructField("size", T.LongType()), T.StructField("p", T.DoubleType()), T.StructField("extra", T.IntegerType())])


def _stretches(rows: DataFrame, same: list[str]) -> DataFrame:
    """``rows`` with the stretch each lies in: its ``first`` row, its ``length``, and the row's ``index`` in it.

    A stretch is the rows equal in ``same`` of one partition of the table in which ``row`` was fixed
    (``monotonically_increasing_id`` has the partition above bit 33).
    """
    stretch = Window.partitionBy(*same, F.shiftright("row", 33))
    return (rows.withColumn("index", F.row_number().over(stretch.orderBy("row")) - 1)
            .withColumn("first", F.min("row").over(stretch)).withColumn("length", F.count(F.lit(1)).over(stretch)))


def _heads(stretches: DataFrame, same: list[str]) -> DataFrame:
    """The first row of each stretch, with the equal rows ``before`` it, their ``total`` and the first of all (``doc``)."""
    alike = Window.partitionBy(*same)
    return (stretches.where(F.col("index") == 0)
            .withColumn("before", F.sum("length").over(alike.orderBy("row")) - F.col("length"))
            .withColumn("total", F.sum("length").over(alike)).withColumn("doc", F.min("row").over(alike)))


def mix_rows(rows: DataFrame, weights=(3, 1, 2), share: float = 1.5, max_copies: float = 2.0, seed: int = 1,
             group_docs: int = GROUP_DOCS, fan_in: int = FAN_IN) -> DataFrame:
    """``rows`` (row, tie, source, size; one per document) with ``source_size``, ``target`` and ``copies``.

    ``row`` tells the rows apart, fixed by ``monotonically_increasing_id``; ``tie`` is a hash of the document.
    """
    same = ["tie", "source", "size"]
    placed = keep(_stretches(rows, same))
    heads = keep(_heads(placed, same))
    docs = heads.where(F.col("row") == F.col("doc")).select("row", *same, "total")
    targets = keep(source_targets(docs, weights, share, max_copies, "total"))
    # one row per source; Spark broadcasts it only below its own size limit
    joined = docs.join(targets, docs["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    average = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    planned = keep(joined.withColumn("expected", average * F.col("total")).withColumn("whole", F.floor("expected"))
                   .withColumn("p", F.col("expected") - F.col("whole")).drop("expected"))

    largest = planned.agg(F.max("docs")).first()[0] or 0
    groups = lambda n: F.ceil(n / F.lit(group_docs)).cast("long")
    open_rows = planned.withColumn("group", F.pmod(F.xxhash64("tie", F.lit(seed)), groups(F.col("docs"))))
    level, left, decided = 0, -(-largest // group_docs), []
    while True:
        last = left <= 1
        settled = keep(open_rows.select("row", "source", "tie", "size", "p", "group")
                       .groupBy("source", "group").applyInPandas(_settle(level, seed, last), _SETTLED))
        decided.append(settled.where("extra >= 0").select("row", "extra"))
        if last:
            break
        level, left = level + 1, -(-left // fan_in)
        open_rows = settled.where("extra < 0").withColumn(
            "group", F.pmod(F.xxhash64("tie", F.lit(seed + level)), F.lit(left)))
    extra = decided[0]
    for more in decided[1:]:
        extra = extra.unionByName(more)
    taken = planned.join(extra, "row", "left").select(
        F.col("row").alias("doc"), "source_size", "target", (F.col("whole") + F.coalesce("extra", F.lit(0))).alias("taken"))
    # equal rows share evenly; the first of them get what is over
    shares = heads.join(taken, "doc").select(
        "first", "source_size", "target", F.expr("taken div total").alias("each"),
        (F.col("taken") % F.col("total") - F.col("before")).alias("over"))
    return placed.join(shares, "first").select(
        *rows.columns, "source_size", "target",
        (F.col("each") + (F.col("index") < F.col("over")).cast("int")).cast("int").alias("copies"))


def word_count(text) -> F.Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(SPACE_WORD))).cast("long")


def _tie(id_col: str, text_col: str, source_col: str) -> F.Column:
    """A hash of the document (nulls told apart from empty strings)."""
    return F.xxhash64(F.col(id_col).cast("string"), F.col(id_col).isNull(), F.col(source_col).cast("string"),
                      F.col(source_col).isNull(), F.col(text_col), F.col(text_col).isNull())


def _numbered(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Per document: a row number fixed by writing it, a hash, source and size."""
    return keep(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
        _tie(id_col, text_col, source_col).alias("tie"), F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size")))


def mix_sizes(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, max_copies: float = 2.0, seed: int = 1,
              id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: id, ``size``, ``source_size``, ``target`` (its source's) and ``copies``."""
    rows = _numbered(docs, id_col, text_col, source_col)
    return mix_rows(rows, weights, share, max_copies, seed).select(
        F.col("id").alias(id_col), "size", "source_size", "target", "copies")


def mixed_documents(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, max_copies: float = 2.0, seed: int = 1,
                    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it was taken, with its own columns.

    Rows are matched by a hash of id, source and text; rows equal in these share their copies evenly.
    """
    rows = _numbered(docs, id_col, text_col, source_col)
    mixed = mix_rows(rows, weights, share, max_copies, seed)
    tie, copies, equal, row, place, take, copy = (
        free_name(docs, x) for x in ("tie", "copies", "equal", "row", "place", "take", "copy"))
    counts = keep(mixed.groupBy(F.col("tie").alias(tie)).agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(equal))
                  .where(F.col(copies) > 0))
    tied = docs.withColumn(tie, _tie(id_col, text_col, source_col))
    single = tied.join(counts.where(F.col(equal) == 1), tie).withColumn(take, F.col(copies).cast("int"))
    several = keep(tied.join(counts.where(F.col(equal) > 1), tie).withColumn(row, F.monotonically_increasing_id()))
    placed = _stretches(several.select(F.col(row).alias("row"), F.col(tie).alias("tie")), ["tie"])
    places = placed.join(_heads(placed, ["tie"]).select("first", "before"), "first").select(
        F.col("row").alias(row), (F.col("before") + F.col("index")).alias(place))
    own = F.floor(F.col(copies) / F.col(equal)) + (F.col(place) < F.col(copies) % F.col(equal)).cast("int")
    shared = several.join(places, row).withColumn(take, own.cast("int"))
    return (single.select(*docs.columns, take).unionByName(shared.select(*docs.columns, take)).where(F.col(take) > 0)
            .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(take)))).select(*docs.columns))
