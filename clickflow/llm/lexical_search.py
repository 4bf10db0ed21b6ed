"""Ranked lexical search by the Best Position Algorithm over an index in shards.

The index is a Parquet table with one row per shard, a bounded number of
documents of one task: their ids and lengths, and per term the documents that
have it and how often. A shard is a row of about a megabyte, and a row group a few of
them, so that what executors hold of them does not grow with a task's documents.
The index serves any queries, and any number of tables of them.

A search weighs the queries' terms by all shards' document counts and then
goes through the shards in groups of bounded size, each on its own:

1. For each term the impacts (weight times saturated frequency) of its
   documents are sorted into an impact list, the highest first.
2. All lists of a query are read a few positions at a time. Every document met
   is looked up in all the query's lists by direct access, which gives its
   whole score and marks its positions in them as seen.
3. A list's best position is the last one up to which all are seen, be it by
   reading or by direct access. A document not met so far stands after the best position
   in every list that has it, so the sum of the impacts that follow bounds its score.
   The search ends when the bound is strictly below the k-th best score so
   far, which a task carries along from group to group (ties may win by id).

Every task gives its k best documents per query; a ranked window takes the
k best of these. Queries are taken from their table in blocks of bounded size,
one at a time, and each block is one scan of the index.

A term's weight w is floor(1000 ln((2N + 2) / (2 df + 1))); a document with n
of the L terms of all N documents has m = 50 + (50 n N) div L; a term that it
has tf times adds w * ((10**9 tf) div (1000 tf + 20 m)).

Defined cases: a null or empty text has no terms, so such documents are
neither counted nor found, and such queries find nothing; documents whose score is 0 are
not found; repeated documents are documents of their own, each in the result;
every row of the queries is a query, also where rows share an id; equal scores
go by document id, null last; other columns are ignored. An empty table on
either side gives an empty result. One document's or one query's terms are
held in a task, however long its text is.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickflow.llm.common import PLAIN_TABLE, id_type, keep, slices, utf8

TOP = 50
#: A shard ends with the document that brings it to so many documents or postings.
SHARD_DOCS = 8192
SHARD_POSTINGS = 1 << 16
#: Shards in a row group of the index.
GROUP_SHARDS = 8
#: Shards are searched together until they have SHARD_DOCS documents or so many postings of the queries' terms.
SEARCHED_POSTINGS = 1 << 18
#: Bytes of query text in a block (one query at least).
BLOCK_BYTES = 4 << 20
#: Positions read in the first round; later rounds double them.
READ = 64


def terms_of(text: bytes | None) -> list[bytes]:
    """A text's terms: runs of digits, letters (A-Z lower-cased) and non-ASCII characters."""
    return (text or b"").translate(PLAIN_TABLE).split()


class _Shard:
    """A shard being filled."""

    def __init__(self):
        from array import array
        from collections import defaultdict
        from itertools import count

        self.ids, self.lengths, self.each = [], array("q"), array("q")
        self.numbers = defaultdict(count().__next__)  # its own __len__ would be a cycle, and keep full shards for long
        self.term, self.tf = array("i"), array("i")

    def add(self, doc_id, terms: list[bytes]) -> None:
        from collections import Counter

        counts = Counter(terms)
        self.ids.append(doc_id)
        self.lengths.append(len(terms))
        self.each.append(len(counts))
        self.term.extend(map(self.numbers.__getitem__, counts))
        self.tf.extend(counts.values())

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or len(self.term) >= SHARD_POSTINGS

    def record(self, schema):
        """The shard as one row; documents are numbered as they came."""
        import numpy as np
        import pyarrow as pa

        doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.frombuffer(self.each, np.int64))
        term = np.frombuffer(self.term, np.int32)
        by_term = np.argsort(term, kind="stable")
        _, ends, terms = pa.array(list(self.numbers), pa.binary()).buffers()
        ends = np.frombuffer(ends, np.int32)[:len(self.numbers) + 1]
        row = [self.ids, self.lengths.tobytes(), terms.to_pybytes()[:ends[-1]], ends.tobytes(),
               np.bincount(term, minlength=len(self.numbers)).astype(np.int32).tobytes(), doc[by_term].tobytes(),
               np.frombuffer(self.tf, np.int32)[by_term].tobytes(), len(self.ids), sum(self.lengths)]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)


def _terms_in(terms, ends):
    """The terms of a shard as an Arrow array."""
    import pyarrow as pa

    terms, ends = terms.as_py(), ends.as_py()
    return pa.Array.from_buffers(pa.binary(), len(ends) // 4 - 1, [None, pa.py_buffer(ends), pa.py_buffer(terms)])


def _indexer(schema):
    def run(batches: Iterator) -> Iterator:
        shard = _Shard()
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                if terms := terms_of(text):
                    shard.add(doc_id, terms)
                    if shard.full():
                        yield shard.record(schema)
                        shard = _Shard()
        if shard.ids:
            yield shard.record(schema)
    return run


def write_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the index of ``docs`` to ``path`` and read it back.

    Row groups end after a few rows, as a shard is a large one: by size alone
    Parquet would look for their end after a hundred rows only.
    """
    index = build_index(docs, id_col, text_col)
    (index.write.option("parquet.block.size", 16 << 20).option("parquet.block.row.count.limit", GROUP_SHARDS)
     .option("parquet.enable.dictionary", "false").parquet(path))
    return docs.sparkSession.read.schema(index.schema).parquet(path)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of ``docs``: per shard ``ids``, ``lengths``, ``terms``, ``ends``, ``df``, ``doc``, ``tf``, ``n_docs``, ``n_terms``.

    Arrays of whole numbers are packed (little-endian), and so are the terms, one after another, with the places
    where each begins and the last ends in ``ends``; documents without terms are not in it.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([
        T.StructField("ids", T.ArrayType(id_type(docs, id_col))), T.StructField("lengths", T.BinaryType()),
        T.StructField("terms", T.BinaryType()), T.StructField("ends", T.BinaryType()), T.StructField("df", T.BinaryType()),
        T.StructField("doc", T.BinaryType()), T.StructField("tf", T.BinaryType()),
        T.StructField("n_docs", T.LongType()), T.StructField("n_terms", T.LongType())])
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(_indexer(to_arrow_schema(schema)), schema)


def _query_terms(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in slices(batches):
        q, found = [], []
        for number, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
            own = set(terms_of(text))
            q += [number] * len(own)
            found += own
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(found, pa.binary())], names=["q", "term"])


def _term_counts(batches: Iterator) -> Iterator:
    """Each shard's terms and how many of its documents have them."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for terms, ends, df in zip(*batch.columns):
            counts = np.frombuffer(df.as_py(), np.int32).astype(np.int64)
            yield pa.RecordBatch.from_arrays([_terms_in(terms, ends), pa.array(counts)], names=["terms", "df"])


class ImpactList:
    """A term's documents in a group of shards, by impact."""

    def __init__(self, docs, impacts):
        import numpy as np

        some = impacts > 0
        self.by_doc = docs[some]
        order = np.argsort(-impacts[some], kind="stable")
        self.docs = self.by_doc[order]
        self.impacts = np.append(impacts[some][order], 0)  # 0: after the last position
        self.position = np.empty(len(order), np.int64)
        self.position[order] = np.arange(len(order))

    def positions_of(self, docs):
        """Direct access: which of ``docs`` (ascending) the list has, and where."""
        import numpy as np

        if not len(self.by_doc):
            return np.zeros(len(docs), bool), np.empty(0, np.int64)
        at = np.searchsorted(self.by_doc, docs)
        at[at == len(self.by_doc)] = 0
        has = self.by_doc[at] == docs
        return has, self.position[at[has]]


def best_positions(lists: list[ImpactList], n_docs: int, k: int, kth: int = 0):
    """Documents of a group of shards that can be among the ``k`` best: numbers, scores, and how many were looked up.

    ``kth`` is a score that k documents elsewhere reach already (0: none known).
    """
    import numpy as np

    met = np.zeros(n_docs, dtype=bool)
    seen = [np.zeros(len(x.docs) + 1, dtype=bool) for x in lists]
    best = [0] * len(lists)
    docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    looked_up, at, read = 0, 0, max(READ, k)
    while True:
        new = np.unique(np.concatenate([x.docs[at:at + read] for x in lists])) if lists else docs
        new = new[~met[new]]
        met[new] = True
        looked_up += len(new)
        score = np.zeros(len(new), np.int64)
        bound = 0
        for i, x in enumerate(lists):
            has, where = x.positions_of(new)
            score[has] += x.impacts[where]
            seen[i][where] = True
            best[i] += int(seen[i][best[i]:].argmin())  # the last place is never seen
            bound += int(x.impacts[best[i]])
        docs, scores = np.concatenate([docs, new]), np.concatenate([scores, score])
        fit = np.lexsort((docs, -scores))[:k]
        docs, scores = docs[fit], scores[fit]
        least = max(kth, int(scores[-1]) if len(scores) == k else 0)
        if bound < least or bound == 0:
            some = scores >= max(kth, 1)
            return docs[some], scores[some], looked_up
        at += read
        read *= 2


def _rank(x):
    """Order of results (score, id): the best first, equal scores by id, null last."""
    return (-x[0], x[1] is None, 0 if x[1] is None else x[1])


class _Group:
    """Shards to be searched together: their documents, and the impacts of ``wanted`` terms (an Arrow array) in them."""

    def __init__(self, wanted, weights, n: int, length: int):
        self.wanted, self.weights, self.n, self.length = wanted, weights, n, length
        self.ids, self.term, self.doc, self.impact = [], [], [], []
        self.n_docs = self.n_postings = 0

    def add(self, ids, lengths, terms, ends, df, doc, tf) -> None:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        m = 50 + (50 * np.frombuffer(lengths.as_py(), np.int64) * self.n) // self.length
        found = pc.index_in(_terms_in(terms, ends), value_set=self.wanted)
        at = pc.indices_nonzero(found.is_valid()).to_numpy()
        df = np.frombuffer(df.as_py(), np.int32).astype(np.int64)
        begin, count = (np.cumsum(df) - df)[at], df[at]
        some = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
        doc = np.frombuffer(doc.as_py(), np.int32)[some]
        tf = np.frombuffer(tf.as_py(), np.int32)[some].astype(np.int64)
        term = np.repeat(found.drop_null().to_numpy(), count)
        self.ids.append(ids.values.take(pa.array(np.arange(len(m)))))  # a copy: a slice would hold the whole batch
        self.term.append(term)
        self.doc.append(doc + np.int32(self.n_docs))
        self.impact.append(self.weights[term] * ((10 ** 9 * tf) // (1000 * tf + 20 * m[doc])))
        self.n_docs += len(m)
        self.n_postings += len(term)

    def full(self) -> bool:
        return self.n_docs >= SHARD_DOCS or self.n_postings >= SEARCHED_POSTINGS

    def lists(self) -> tuple[list, dict]:
        """Ids, and impact lists by the number of the wanted term; documents are numbered by id, so that numbers settle ties."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        ids = pa.concat_arrays(self.ids)
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order), dtype=np.int32)
        term, doc, impact = np.concatenate(self.term), number[np.concatenate(self.doc)], np.concatenate(self.impact)
        by_term = np.lexsort((doc, term))
        term, doc, impact = term[by_term], doc[by_term], impact[by_term]
        begin = np.flatnonzero(np.diff(term, prepend=-1))
        lists = {int(term[a]): ImpactList(doc[a:b], impact[a:b]) for a, b in zip(begin, np.append(begin[1:], len(term)))}
        return ids.take(pa.array(order)).to_pylist(), lists


def _searcher(weights: dict, queries: list, k: int, n: int, length: int, schema):
    """Per task: the ``k`` best documents of its shards for every query (number, terms)."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        best: dict[int, list] = {q: [] for q, _ in queries}
        wanted = pa.array(list(weights), pa.binary())
        number = {t: i for i, t in enumerate(weights)}
        asked = [(q, [number[t] for t in own]) for q, own in queries]
        new_group = lambda: _Group(wanted, np.array(list(weights.values()), np.int64), n, length)

        def search_group(group: _Group) -> None:
            names, lists = group.lists()
            for q, own in asked:
                so_far = best[q]
                found, scores, _ = best_positions([lists[t] for t in own if t in lists], len(names), k,
                                                  so_far[-1][0] if len(so_far) == k else 0)
                if len(found):
                    new = [(s, names[d]) for d, s in zip(found.tolist(), scores.tolist())]
                    best[q] = sorted(so_far + new, key=_rank)[:k]

        group = new_group()
        for batch in batches:
            for i in range(batch.num_rows):
                group.add(*(batch.column(c)[i] for c in range(7)))
                if group.full():
                    search_group(group)
                    group = new_group()
        if group.ids:
            search_group(group)
        rows = [(q, doc, score) for q, own in best.items() for score, doc in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)], schema=schema)
    return run


def search(index: DataFrame, queries: DataFrame, k: int = TOP, query_id: str = "item_id", query_text: str = "text",
           id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` best documents of ``index`` for every row of ``queries``: query id, ``rank``, document id, ``score``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = index.schema["ids"].dataType.elementType
    asked = keep(queries.select(F.col(query_id).alias("item"), F.col(query_text).alias("text"))
                 .withColumn("q", F.monotonically_increasing_id()))
    own = keep(asked.select("q", "text").mapInArrow(_query_terms, "q long, term binary"))
    n, length = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    # how many documents of all shards have each query term
    wanted = own.select("term").distinct()
    df = (index.select("terms", "ends", "df").mapInArrow(_term_counts, "terms binary, df long")
          .join(wanted, F.col("terms") == F.col("term"), "left_semi").groupBy("terms").agg(F.sum("df").alias("df")))
    weight = F.floor(1000 * F.log((2 * F.lit(n) + 2) / (2 * F.col("df") + 1)))
    weighed = keep(own.join(df.select("terms", weight.alias("w")), F.col("term") == F.col("terms"))
                   .where("w > 0").groupBy("q").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("terms"))
                   .withColumn("bytes", F.aggregate("terms", F.lit(0).cast("long"), lambda s, t: s + F.length(t["term"]) + 64)))
    schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("doc", kind), T.StructField("score", T.LongType())])
    packed = index.select("ids", "lengths", "terms", "ends", "df", "doc", "tf")
    found = index.sparkSession.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
    for block in _blocks(weighed, block_bytes):
        rows = weighed.where(block).select("q", "terms").collect()
        weights = {bytes(t["term"]): t["w"] for r in rows for t in r["terms"]}
        listed = [(r["q"], [bytes(t["term"]) for t in r["terms"]]) for r in rows]
        run = _searcher(weights, listed, k, n, length, to_arrow_schema(schema))
        found = found.union(keep(packed.mapInArrow(run, schema)))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last()))
    ranked = found.withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.join(asked.select("q", "item"), "q").select(
        F.col("item").alias(query_id), "rank", F.col("doc").alias(id_col), "score")


def _blocks(weighed: DataFrame, block_bytes: int) -> list:
    """Conditions that deal the queries by a hash into blocks of about ``block_bytes``."""
    total = weighed.agg(F.sum("bytes")).first()[0]
    if not total:
        return []
    blocks = -(-total // block_bytes)
    return [F.pmod(F.xxhash64("q"), F.lit(blocks)) == b for b in range(blocks)]
