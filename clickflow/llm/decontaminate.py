"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to lower-case words between single spaces. An item's
windows are its runs of ``window`` consecutive words (a shorter item is one
window); the automaton holds every distinct window with a space at both ends,
so a match is a run of whole words. Each document is scanned once; matches
give word positions, which lead back to the original text.

The automaton is built in each task from a broadcast list of windows. That
list is the benchmark's, not the corpus's, and its size is checked, item ids
included. Up to ``max_window_bytes`` one automaton knows the items of every
window, and documents are marked where they are read. Above it the windows are
dealt into lists of that size, which name their items by the digest of the set
only. The lists go to the tasks one after another; each scan keeps findings,
not texts, and the items are joined to the digests in Spark. So neither the
driver nor a task ever holds more than one list, and the results are the same.

Defined cases: a null or empty text has no words; an item without words has
no window; an item whose id is null is ignored; repeated item ids count once;
repeated or null document ids are ordinary rows; other columns are ignored by
``find_contamination`` and kept by ``drop_contaminated``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickflow.llm.common import PLAIN_TABLE, PLAIN_WORD, free_name, keep, utf8

#: Bytes of windows and their items' ids that one automaton takes (some 30 times that in memory).
MAX_WINDOW_BYTES = 8 << 20


def words(text: bytes | None) -> list[bytes]:
    """Normalised words of a UTF-8 text."""
    return text.translate(PLAIN_TABLE).split() if text else []


def _windows(width: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, out = [], []
            for item, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                w = words(text)
                for i in range(max(1, len(w) - width + 1) if w else 0):
                    ids.append(item)
                    out.append(b" ".join(w[i:i + width]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.binary()).cast(pa.string())],
                                             names=["item", "window"])
    return run


def item_windows(items: DataFrame, width: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows with the sorted ids (as strings) of the items that have them."""
    found = (items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"),
                                                            F.col(text_col).alias("text"))
             .mapInArrow(_windows(width), "item string, window string"))
    return found.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _automaton(windows: list[tuple[str, list]]):
    import ahocorasick

    auto = ahocorasick.Automaton()
    for window, names in windows:
        # one character per byte, so that positions are byte positions
        auto.add_word(f" {window} ".encode().decode("latin-1"), (window.count(" ") + 1, tuple(names)))
    auto.make_automaton()
    return auto


def scan_words(auto, text_words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
    """Merged runs of hit words (start, end) and the names that the automaton's windows found carry."""
    import numpy as np

    joined = b" " + b" ".join(text_words) + b" "
    found = [(end, n, names) for end, (n, names) in auto.iter(joined.decode("latin-1"))]
    if not found:
        return [], set()
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
    ends = np.searchsorted(spaces, [end for end, _, _ in found]).tolist()
    return merged([(end - n, end) for end, (_, n, _) in zip(ends, found)]), set().union(*(names for _, _, names in found))


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted runs, those that meet or touch as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as code point offsets in the original text (end exclusive)."""
    at = [m.span() for m in re.finditer(PLAIN_WORD, _lower_ascii(text))]
    return [(at[a][0], at[b - 1][1]) for a, b in runs]


def _lower_ascii(text: str) -> str:
    return text.translate({c: c + 32 for c in range(0x41, 0x5B)})


_RUNS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", _RUNS), T.StructField("spans", _RUNS),
                       T.StructField("items", T.ArrayType(T.StringType()))])


def _structs(runs: list[tuple[int, int]]) -> list[dict]:
    return [{"start": a, "end": b} for a, b in runs]


def _marked(text: bytes | None, text_words: list[bytes], runs: list[tuple[int, int]], names) -> dict:
    return {"n_words": len(text_words), "runs": _structs(runs),
            "spans": _structs(original_spans(text.decode(), runs) if runs else []), "items": sorted(names)}


def _scanner(shared, text_at: int, schema):
    """Every row with its struct of ``_FOUND``; the broadcast windows carry their items."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        auto = None
        for batch in batches:
            if auto is None and batch.num_rows:
                auto = _automaton(shared.value)
            out = []
            for text in utf8(batch.column(text_at)):
                w = words(text)
                out.append(_marked(text, w, *(scan_words(auto, w) if w and len(auto) else ([], set()))))
            found = pa.array(out, schema.field(len(schema) - 1).type)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).cast(schema.field(i).type) for i in range(batch.num_columns)),
                                              found], schema=schema)
    return run


_FINDING = T.StructType([T.StructField("row", T.LongType()), T.StructField("runs", _RUNS),
                         T.StructField("sets", T.ArrayType(T.BinaryType()))])


def _finder(shared, schema):
    """(row, text) to the findings of one list of windows, which carry digests of item sets."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        auto = None
        for batch in batches:
            if auto is None and batch.num_rows:
                auto = _automaton(shared.value)
            out = []
            for row, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                w = words(text)
                runs, sets = scan_words(auto, w) if w and len(auto) else ([], ())
                if runs:
                    out.append({"row": row, "runs": _structs(runs), "sets": sorted(sets)})
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    return run


def _finisher(text_at: int, schema):
    """Rows with the runs and items of all lists (last two columns) to rows with their struct of ``_FOUND``."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        width = len(schema) - 1
        for batch in batches:
            out = []
            for text, runs, names in zip(utf8(batch.column(text_at)), batch.column(width).to_pylist(),
                                         batch.column(width + 1).to_pylist()):
                out.append(_marked(text, words(text), merged([(r["start"], r["end"]) for r in runs or ()]), names or ()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).cast(schema.field(i).type) for i in range(width)),
                                              pa.array(out, schema.field(width).type)], schema=schema)
    return run


def _found_in_one(docs: DataFrame, windows: DataFrame, text_col: str, found_col: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*docs.schema.fields, T.StructField(found_col, _FOUND)])
    shared = docs.sparkSession.sparkContext.broadcast([(r["window"], r["items"]) for r in windows.toLocalIterator()])
    return docs.mapInArrow(_scanner(shared, docs.columns.index(text_col), to_arrow_schema(schema)), schema)


def _found_in_lists(docs: DataFrame, windows: DataFrame, lists: int, text_col: str, found_col: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    sc = docs.sparkSession.sparkContext
    row, runs, names = (free_name(docs, x) for x in ("row", "runs", "names"))
    # a row's number is fixed by writing it; texts are written once, whatever the number of lists
    rows = keep(docs.withColumn(row, F.monotonically_increasing_id()))
    texts = rows.select(F.col(row).alias("row"), F.col(text_col).alias("text"))
    dealt = keep(windows.select("window", "items", F.unhex(F.sha2(F.to_json("items"), 256)).alias("set"),
                                F.pmod(F.xxhash64("window"), F.lit(lists)).alias("list")))
    found = None
    for i in range(lists):
        shared = sc.broadcast([(r["window"], [bytes(r["set"])])
                               for r in dealt.where(F.col("list") == i).select("window", "set").toLocalIterator()])
        one = keep(texts.mapInArrow(_finder(shared, to_arrow_schema(_FINDING)), _FINDING))
        shared.destroy()
        found = one if found is None else found.unionByName(one)
    found = keep(found)
    sets = dealt.select("set", "items").dropDuplicates(["set"]).select("set", F.explode("items").alias("item"))
    items = (found.select("row", F.explode("sets").alias("set")).distinct().join(sets, "set")
             .groupBy("row").agg(F.array_sort(F.collect_set("item")).alias(names)))
    spans = found.groupBy("row").agg(F.flatten(F.collect_list("runs")).alias(runs))
    marks = keep(spans.join(items, "row").withColumnRenamed("row", row))
    schema = T.StructType([*docs.schema.fields, T.StructField(found_col, _FOUND)])
    return (rows.join(marks, row, "left").select(*docs.columns, runs, names)
            .mapInArrow(_finisher(docs.columns.index(text_col), to_arrow_schema(schema)), schema))


def find_contamination(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text",
                       item_id_col: str = "item_id", item_text_col: str = "text", found_col: str = "found",
                       max_window_bytes: int = MAX_WINDOW_BYTES) -> DataFrame:
    """``docs`` with a struct ``found_col``: ``n_words``, ``runs`` (hit words), ``spans`` (their code
    points in the text) and ``items`` (ids, sorted as strings)."""
    windows = keep(item_windows(items, window, item_id_col, item_text_col))
    names = F.aggregate("items", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 64)
    size = F.octet_length("window") + F.lit(64).cast("long")
    own, whole = windows.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(size + names), F.lit(0))).first()
    if whole <= max_window_bytes:
        return _found_in_one(docs, windows, text_col, found_col)
    return _found_in_lists(docs, windows, -(-own // max_window_bytes), text_col, found_col)


def n_hit(found) -> F.Column:
    """Hit words of a ``found`` struct."""
    return F.aggregate(found["runs"], F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])


def items_digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the documents in which a window of an item occurs."""
    found_col = free_name(docs, "found")
    marked = find_contamination(docs, items, window, found_col=found_col)
    return marked.where(F.size(F.col(found_col)["runs"]) == 0).select(*docs.columns)
