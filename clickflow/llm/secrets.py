"""Secret scans over a ledger of content-addressed blobs.

A document is a path to a blob, and a blob is a text under its SHA-256. The
ledger is a Parquet table with one row per (blob, rule, version) that was
scanned, with the spans found. A scan takes the blobs of all given paths,
drops those that the ledger has under every current rule version, scans each
remaining text once for the rule versions it lacks, appends the result, and
joins the findings back to all paths. Copies and old versions of a file are
thus scanned once in the ledger's life, and a changed rule only by that rule.

Everything is DataFrame functions. A rule's matches are taken with
``regexp_extract_all`` and the text between them with ``split``; running sums
of their lengths give the offsets, in code points.

Defined cases: a null text is the empty blob; repeated rows and paths with
equal texts share a blob and each get its findings; null ids are ordinary
paths; other columns are ignored; an empty table appends nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickflow.llm.common import keep
from clickflow.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    literal: str = ""  # every match contains it: a cheap test before the pattern
    version: int = 1


#: Fixed rules. Runs of one character class are greedy, so their least length
#: can stand in the pattern; ``assign`` must take short values too, since a
#: match uses up its text even where its value is too short.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 1),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 18, literal="AKIA"),
    Rule("hex", r"[0-9a-f]{16,}", 16),
    Rule("pem", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", 1, literal="PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")

_LEDGER = {"blob": "binary", "rule": "string", "version": "int", "spans": "array<struct<start:bigint,end:bigint>>"}


def _blob(text) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _matches(text, rule: Rule) -> F.Column:
    """The rule's raw matches in turn: the text before each, its length, the length that counts."""
    found = text.rlike(rule.pattern)
    if rule.literal:
        found = F.contains(text, F.lit(rule.literal)) & found
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    hits = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.length)
    value = hits if not rule.group else F.transform(
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length)
    return F.when(found, F.slice(F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), value.alias("value")), F.lit(1), F.size(hits)))


def scan_blobs(blobs: DataFrame, rules=RULES) -> DataFrame:
    """Ledger rows for ``blobs`` (blob, text, known: rule versions not to scan for)."""
    scans = []
    for rule in rules:
        due = ~F.array_contains("known", f"{rule.kind}@{rule.version}")
        scans.append(F.when(due, F.struct(F.lit(rule.kind).alias("rule"), F.lit(rule.version).alias("version"),
                                          F.lit(rule.least).alias("least"), _matches(F.col("text"), rule).alias("matches"))))
    scanned = keep(blobs.select("blob", F.explode(F.array_compact(F.array(*scans))).alias("s")).select("blob", "s.*"))
    along = Window.partitionBy("blob", "rule").orderBy("i")
    spans = (scanned.where("matches is not null").select("blob", "rule", "least", F.posexplode("matches").alias("i", "m"))
             .withColumn("end", F.sum(F.col("m.gap") + F.col("m.hit")).over(along).cast("long"))
             .where(F.col("m.value") >= F.col("least"))
             .groupBy("blob", "rule").agg(F.array_sort(F.collect_list(F.struct(
                 (F.col("end") - F.col("m.hit")).alias("start"), F.col("end").alias("end")))).alias("spans")))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return scanned.select("blob", "rule", "version").join(spans, ["blob", "rule"], "left").select(
        "blob", "rule", "version", F.coalesce("spans", none).alias("spans"))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``, empty if there is none yet."""
    if _exists(spark, path):
        return spark.read.schema(", ".join(f"{n} {k}" for n, k in _LEDGER.items())).parquet(path)
    return spark.range(0).select(*(F.lit(None).cast(kind).alias(name) for name, kind in _LEDGER.items()))


def update_ledger(docs: DataFrame, path: str, rules=RULES, text_col: str = "text") -> None:
    """Scan what the ledger at ``path`` lacks for the texts of ``docs``, and append it."""
    spark = docs.sparkSession
    current = [f"{r.kind}@{r.version}" for r in rules]
    known = (read_ledger(spark, path).withColumn("done", F.concat_ws("@", "rule", "version"))
             .where(F.col("done").isin(current)).groupBy("blob").agg(F.collect_set("done").alias("known")))
    texts = docs.select(_blob(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    done = known.where(F.size("known") == len(current)).select("blob")
    due = (texts.join(done, "blob", "left_anti") if _exists(spark, path) else texts) \
        .groupBy("blob").agg(F.any_value("text").alias("text"))
    if _exists(spark, path):
        due = due.join(known, "blob", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    else:
        due = due.withColumn("known", F.array().cast("array<string>"))
    scan_blobs(due, rules).write.mode("append").parquet(path)


def _joined(spans, only=None) -> F.Column:
    """Spans as ``kind:start:end`` by start, then kind in rule order."""
    if only is not None:
        spans = F.filter(spans, lambda s: s["at"] < only)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def findings(docs: DataFrame, path: str, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger's findings under the current rule versions, for every row of ``docs``:
    id, ``blob``, ``found`` (at, kind, start, end in order)."""
    order = {r.kind: i for i, r in enumerate(rules)}
    current = [f"{r.kind}@{r.version}" for r in rules]
    at = F.create_map(*(F.lit(x) for kv in order.items() for x in kv))[F.col("rule")]
    per_blob = (read_ledger(docs.sparkSession, path).where(F.concat_ws("@", "rule", "version").isin(current) & (F.size("spans") > 0))
                .select("blob", F.explode("spans").alias("s"), at.alias("at"), F.col("rule").alias("kind"))
                .groupBy("blob").agg(F.array_sort(F.collect_set(F.struct(
                    F.col("s.start").alias("start"), "at", "kind", F.col("s.end").alias("end")))).alias("found")))
    paths = docs.select(F.col(id_col), _blob(F.col(text_col)).alias("blob"))
    # written first: both sides are then plain, and a blob with very many paths can be split
    return paths.join(keep(per_blob), "blob", "left")


def secret_digest(docs: DataFrame, ledger: str | None = None, rules=RULES, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Scan ``docs`` into the ledger (default: a new one in the shared folder) and report every row's findings."""
    spark = docs.sparkSession
    ledger = ledger or f"{ensure_checkpoint_dir(spark).rstrip('/')}/secret-ledger-{uuid.uuid4().hex}"
    update_ledger(docs, ledger, rules, text_col)
    found = F.coalesce(F.col("found"), F.array().cast("array<struct<start:bigint,at:int,kind:string,end:bigint>>"))
    count = lambda kind: F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
    return findings(docs, ledger, rules, id_col, text_col).select(
        id_col, *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(_joined(found, len(BASE)), 256).alias("base_sha256"), _joined(found).alias("spans"))
