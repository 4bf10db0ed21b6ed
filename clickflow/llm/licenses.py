"""License scans by diagonal voting.

Every rolling run of ``K`` words of every text is joined, by hash and then by
the words themselves, to the places of the license templates (passages of
license texts and notices, ``license_texts``) that have the same run. A hit votes for a diagonal: its place in the text minus its place in
the template. Votes are counted per text, template and diagonal, diagonals a
few words apart (words were put in or left out) are merged, and a merged span
counts if it covers enough of the template over a fitting length.

The base phrases are templates too. A phrase stands at a place exactly if all
its runs vote for the same diagonal, which then is the place.

Everything is DataFrame functions. The given templates are a fixed table of some
hundred runs, which is what is broadcast; a table of the caller's own is broadcast if Spark finds it small. Texts are told apart by a hash of
their content, so copies add nothing but equal votes.

Defined cases: a null or empty text has no words and score 0; texts shorter
than a run have no hits; repeated rows each get their text's result; other
columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickflow.llm.common import keep
from clickflow.llm.license_texts import PASSAGES

K = 3
#: What stands between words: ASCII but digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed base phrases and their labels.
BASE_PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: The passages of license texts and notices, in normalised words.
TEMPLATES = tuple((" ".join(re.split(SEPARATORS, text.lower())).strip(), label) for text, label in PASSAGES)
#: Diagonals this far apart are one span; least share of a template's runs; length against the template's.
MAX_SHIFT = 3
LEAST_COVER = 0.6
MOST_LENGTH = 1.5


def words(text) -> F.Column:
    """Lower-cased (A-Z) words."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, SEPARATORS), "")


def _content(text) -> F.Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def template_runs(spark: SparkSession, templates=None) -> DataFrame:
    """``template``, ``base``, ``label``, ``runs`` (of the template), ``at``, ``a``, ``b``, ``c``, ``hash``."""
    listed = templates or [(p, x, True) for p, x in BASE_PHRASES] + [(p, x, False) for p, x in TEMPLATES]
    rows = F.array(*(F.struct(F.lit(k).alias("template"), F.lit(base).alias("base"), F.lit(label).alias("label"),
                              F.split(F.lit(text), " ").alias("w")) for k, (text, label, base) in enumerate(listed)))
    return (spark.range(1).select(F.inline(rows))
            .select("template", "base", "label", (F.size("w") - (K - 1)).alias("runs"), F.posexplode(_runs(F.col("w"))).alias("at", "run"))
            .where("run.c is not null").select("template", "base", "label", "runs", "at", "run.*")
            .withColumn("hash", F.xxhash64("a", "b", "c")))


def _runs(w) -> F.Column:
    """All runs of ``K`` consecutive words (the last ones lack words)."""
    return F.arrays_zip(w.alias("a"), F.slice(w, F.lit(2), F.size(w)).alias("b"), F.slice(w, F.lit(3), F.size(w)).alias("c"))


def votes(docs: DataFrame, templates: DataFrame, text_col: str = "text") -> DataFrame:
    """Per text (``content``), template and diagonal: the template places that voted."""
    w = words(F.col(text_col))
    runs = (docs.select(_content(F.col(text_col)).alias("content"), w.alias("w"))
            .where(F.size("w") >= K)
            .select("content", F.posexplode(_runs(F.col("w"))).alias("pos", "run"))
            .where("run.c is not null")
            .select("content", "pos", F.xxhash64("run.a", "run.b", "run.c").alias("hash"), "run"))
    same = ((runs["hash"] == templates["hash"]) & (runs["run.a"] == templates["a"])
            & (runs["run.b"] == templates["b"]) & (runs["run.c"] == templates["c"]))
    hits = runs.join(templates, same)
    return hits.groupBy("content", "template", "base", "label", "runs", (F.col("pos") - F.col("at")).alias("diagonal")) \
        .agg(F.collect_set("at").alias("places"))


def spans(voted: DataFrame, max_shift: int = MAX_SHIFT, least_cover: float = LEAST_COVER,
          most_length: float = MOST_LENGTH) -> DataFrame:
    """Verified spans: ``content``, ``label``, ``base``, ``start``, ``end`` (words), ``cover`` (0 to 1)."""
    exact = voted.where("base and size(places) = runs").select(
        "content", "label", "base", F.col("diagonal").cast("long").alias("start"),
        (F.col("diagonal") + F.col("runs") + K - 1).cast("long").alias("end"), F.lit(1.0).alias("cover"))
    along = Window.partitionBy("content", "template").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > max_shift, F.lit(True))
    merged = (voted.where("not base").withColumn("new", new.cast("int"))
              .withColumn("band", F.sum("new").over(along))
              .groupBy("content", "template", "label", "runs", "band")
              .agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("covered"),
                   F.min(F.col("diagonal") + F.array_min("places")).cast("long").alias("start"),
                   (F.max(F.col("diagonal") + F.array_max("places")) + K).cast("long").alias("end")))
    cover = F.col("covered") / F.col("runs")
    loose = merged.where((cover >= least_cover) & (F.col("end") - F.col("start") <= most_length * (F.col("runs") + K - 1))) \
        .select("content", "label", F.lit(False).alias("base"), "start", "end", cover.alias("cover"))
    return exact.unionByName(loose)


def license_digest(docs: DataFrame, templates: DataFrame | None = None, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``n_words``, base counts and places, labels and the best span's score."""
    templates = F.broadcast(template_runs(docs.sparkSession)) if templates is None else templates
    found = spans(keep(votes(docs, templates, text_col)))
    base = F.when(F.col("base"), F.col("start"))
    per_text = keep(found.groupBy("content").agg(
        F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("cover").alias("score")))
    texts = docs.select(F.col(id_col), _content(F.col(text_col)).alias("content"),
                        F.size(words(F.col(text_col))).cast("long").alias("n_words"))
    return texts.join(per_text, "content", "left").select(
        id_col, "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
