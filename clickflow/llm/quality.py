"""Quality rules with cross-document line frequency.

Each document's lines are normalised (lower case, digits alike, white space
collapsed) and hashed. For every host and line the distinct documents that
have the line are counted, where copies count once: documents with the same
set of line hashes are one document here, also in the host's size, so a page
copied many times does not turn its own lines into boilerplate. Lines above the
host's limit are removed; a document that loses too many of its words is
rejected.

One pass over the texts writes each document's counts and line hashes; all
else works on those. Counting pre-aggregates per task, so a line that a third
of all documents have, or a host with a third of all documents, costs one row
per task and document group.

Defined cases: a null or empty text has no words and fails; a null host is a
host of its own; repeated rows are each judged (and count as one document);
lines without a word are ignored; other columns are ignored by
``quality_rules`` and kept by ``keep_good`` and ``without_frequent_lines``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickflow.llm.common import LOWER_TABLE, free_name, id_type, keep, utf8

SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\t\n\x0b\x0c\r"
#: A line is boilerplate above so many documents of its host, and above this share of them.
LIMIT_DOCS = 20
LIMIT_SHARE = 0.02
#: A document is depleted if less than this share of its words is left.
LEAST_LEFT = 0.2
#: Base rules.
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of words inside repeated windows

_DIGITS = re.compile(rb"[0-9]+")


def line_hash(line: bytes) -> int | None:
    """Signed 64-bit hash of the normalised line; None if it has no word."""
    import xxhash

    words = line.translate(LOWER_TABLE).split()
    if not words:
        return None
    return xxhash.xxh3_64_intdigest(_DIGITS.sub(b"0", b" ".join(words))) - (1 << 63)


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    grams = list(zip(words, words[1:], words[2:]))
    if len(set(grams)) == len(grams):
        return 0
    often = {g for g, n in Counter(grams).items() if n > 1}
    n, covered = 0, 0  # covered: the first place no window has reached
    for i, g in enumerate(grams):
        if g in often:
            n += i + 3 - max(i, covered)
            covered = i + 3
    return n


def describe(text: bytes | None) -> dict:
    """Counts and line hashes of one text; ``family`` is a digest of its set of lines as they are."""
    import xxhash

    text = text or b""
    words = text.split()
    lines: dict[int, int] = {}
    seen: set[bytes] = set()
    dups = 0
    for line in text.split(b"\n"):
        own = line_hash(line)
        if own is None:
            continue
        if line in seen:
            dups += 1
        seen.add(line)
        lines[own] = lines.get(own, 0) + len(line.split())
    return {
        "n_words": len(words), "word_chars": len(text.decode("utf-8", "replace")) - sum(text.count(c) for c in SPACES),
        "n_symbols": sum(text.count(c) for c in SYMBOLS), "n_dup_lines": dups, "n_repeat_words": repeated_words(words),
        "family": xxhash.xxh3_128_digest(b"\n".join(sorted(seen))),
        "lines": [{"line": h, "words": n} for h, n in lines.items()]}


_DESCRIBED = [
    *(T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    T.StructField("family", T.BinaryType()),
    T.StructField("lines", T.ArrayType(T.StructType([T.StructField("line", T.LongType()), T.StructField("words", T.LongType())])))]


def _describer(schema):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = utf8(batch.column(2))
            for at in range(0, len(texts), 256):  # small batches: the lists of lines take memory
                part = texts[at:at + 256]
                found = [describe(t) for t in part]
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(row, row + len(part)), pa.int64()),
                    batch.column(0).slice(at, 256).cast(schema.field("id").type),
                    batch.column(1).slice(at, 256).cast(pa.string()),
                    *(pa.array([f[c.name] for f in found], schema.field(c.name).type) for c in _DESCRIBED)], schema=schema)
                row += len(part)
    return run


def describe_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       host_col: str = "source") -> DataFrame:
    """Per row: ``row``, ``id``, ``host``, counts, ``family``, ``lines``; written once."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", id_type(docs, id_col)),
                           T.StructField("host", T.StringType()), *_DESCRIBED])
    return keep(docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"),
                            F.col(text_col).alias("text"))
                .mapInArrow(_describer(to_arrow_schema(schema)), schema))


def _key(host, line) -> F.Column:
    return F.xxhash64(host, host.isNull(), line)


def frequent_lines(described: DataFrame, limit_docs: int = LIMIT_DOCS, limit_share: float = LIMIT_SHARE) -> DataFrame:
    """``host``, ``line``, ``n_docs`` of the lines above their host's limit, and their join ``key``."""
    entries = described.select("host", "family", F.explode("lines.line").alias("line"))
    counts = entries.distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"))
    hosts = described.select(F.col("host").alias("_host"), "family").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("_docs"))
    limit = F.greatest(F.lit(float(limit_docs)), F.col("_docs") * F.lit(limit_share))
    # only lines above the absolute limit meet their host's size
    return keep(counts.where(F.col("n_docs") > limit_docs)
                .join(keep(hosts), F.col("host").eqNullSafe(F.col("_host")))
                .where(F.col("n_docs") > limit)
                .select("host", "line", "n_docs", _key(F.col("host"), F.col("line")).alias("key")))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                  limit_docs: int = LIMIT_DOCS, limit_share: float = LIMIT_SHARE,
                  least_left: float = LEAST_LEFT) -> DataFrame:
    """Per row of ``docs``: id, counts, ``n_removed_words``, ``base_failed``, ``kept``."""
    return _judged(describe_documents(docs, id_col, text_col, host_col), limit_docs, limit_share, least_left) \
        .withColumnRenamed("id", id_col).drop("row", "host")


def _judged(described: DataFrame, limit_docs: int, limit_share: float, least_left: float) -> DataFrame:
    frequent = frequent_lines(described, limit_docs, limit_share)
    entries = described.select("row", "host", F.explode("lines").alias("l")).select(
        "row", _key(F.col("host"), F.col("l.line")).alias("key"), F.col("l.words").alias("words"))
    removed = entries.join(frequent.select("key"), "key").groupBy("row").agg(F.sum("words").alias("n_removed_words"))
    n = F.col("n_words")
    failed = (n < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * n)
    lost = F.coalesce(F.col("n_removed_words"), F.lit(0))
    return described.drop("lines", "family").join(removed, "row", "left").select(
        "row", "id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        lost.alias("n_removed_words"), failed.alias("base_failed"),
        (~failed & ((n - lost) >= F.lit(least_left) * n)).alias("kept"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """``docs`` without the rejected ones, rows and columns as they are.

    Verdicts depend on host and text only, so they are matched by a hash of both.
    """
    tag, own = _tag(host_col, text_col), free_name(docs, "tag")
    described = describe_documents(docs.withColumn(own, tag), own, text_col, host_col)
    verdicts = _judged(described, limits.get("limit_docs", LIMIT_DOCS), limits.get("limit_share", LIMIT_SHARE),
                       limits.get("least_left", LEAST_LEFT))
    good = keep(verdicts.where("kept").select(F.col("id").alias(own)).distinct())
    return docs.withColumn(own, tag).join(good, own, "left_semi").select(*docs.columns)


def _tag(host_col: str, text_col: str) -> F.Column:
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(host_col).cast("string"), F.lit("\x00")), F.lit("\x01"),
                                  F.coalesce(F.col(text_col), F.lit("")))))


def without_frequent_lines(docs: DataFrame, frequent: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``docs`` with the lines of ``frequent`` (of ``frequent_lines``) taken out of their texts.

    A host's frequent lines meet its documents as one sorted list: they are
    above a share of its documents, so their number is bounded by the lines
    of one document divided by that share.
    """
    host, lines_of = free_name(docs, "host"), free_name(docs, "lines")
    per_host = keep(frequent.groupBy(F.col("host").alias(host)).agg(F.collect_set("line").alias(lines_of)))
    schema = docs.schema

    def strip(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at = schema.names.index(text_col)
        for batch in batches:
            out = []
            for text, lines in zip(utf8(batch.column(at)), batch.column(batch.num_columns - 1).to_pylist()):
                if text and lines:
                    drop = set(lines)
                    text = b"\n".join(x for x in text.split(b"\n") if line_hash(x) not in drop)
                out.append(text)
            columns = [batch.column(i) for i in range(len(schema))]
            columns[at] = pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return (docs.join(per_host, F.col(host_col).cast("string").eqNullSafe(F.col(host)), "left").drop(host)
            .mapInArrow(strip, schema))
