"""Vector codes: product quantisation whose nearest entries are found by Orchard search.

A vector's components become integers, floor(1024 * x), and the vector is cut
into equal consecutive parts. Each part position has a codebook, which starts
as that part of the first vectors by id and is refined for some rounds: every
part goes to its nearest entry (squared Euclidean distance, ties to the lower
index), and an entry becomes the componentwise floor of its parts' mean.

A search keeps, for every entry, the list of all entries by distance from it.
It starts at the entry nearest to all others and reads the list of the entry
it stands on; a nearer entry found there makes it go over to that entry's list.
Entries visited once are not computed again, and a list is read up to twice
the distance of the best entry so far: what lies beyond is farther from the
vector than that entry, by the triangle inequality. Distances are whole
numbers, so the result is exact, ties included. Many vectors take a step at
once, each reading a few entries on in its own list.

Vectors are scanned once per round. A task sends at most one row per entry, a
count and a sum; the driver holds the codebooks only (``ENTRIES`` times the
vector's length numbers, whatever the table's size).

Defined cases: rows whose vector is null or holds a null, NaN or infinite
component are dropped; null ids come last, rows equal in id are ordered by
their vectors; repeated rows count as often as they come; null labels are one
label; vectors of no components get code 0 in every part. Other columns are
ignored. An empty table gives an empty result. Vectors of unequal lengths, or
not divisible into the parts, or with a component of 65,536 or more are errors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickflow.llm.common import id_type, keep, slices

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Components below this keep every sum of squares within 64 bits (vectors of up to 511 components).
LEAST_TOO_LARGE = 65_536
#: Entries of a list that a search reads at a time, and vectors searched at a time.
STEP = 16
VECTORS = 4096


class Codebook:
    """The entries of one part position, and for each of them the list of all by distance."""

    def __init__(self, entries):
        import numpy as np

        self.entries = entries = np.asarray(entries, dtype=np.int64)
        far = np.array([((entries - e) ** 2).sum(axis=1) for e in entries])
        order = np.argsort(far, axis=1, kind="stable")
        self.start = int(far.astype(float).sum(axis=1).argmin())
        # an entry at squared distance f from the one we stand on is beyond twice our own distance d if f > 4 d
        reach = -(-np.take_along_axis(far, order, axis=1) // 4)
        pad = ((0, 0), (0, STEP))
        self.order = np.pad(order, pad)
        self.reach = np.pad(reach, pad, constant_values=np.iinfo(np.int64).max)

    def nearest(self, vectors):
        """Index and squared distance of each vector's nearest entry, and how many entries were computed."""
        import numpy as np

        codes, errors, computed = [], [], 0
        for at in range(0, len(vectors), VECTORS):
            c, e, n = self._nearest(vectors[at:at + VECTORS])
            codes.append(c)
            errors.append(e)
            computed += n
        none = np.empty(0, np.int64)
        return np.concatenate([none, *codes]), np.concatenate([none, *errors]), computed

    def _nearest(self, vectors):
        import numpy as np

        n, k, most = len(vectors), len(self.entries), np.iinfo(np.int64).max
        code = np.full(n, self.start)
        error = ((vectors - self.entries[self.start]) ** 2).sum(axis=1)
        visited = np.zeros((n, k), dtype=bool)
        visited[:, self.start] = True
        place, rows, computed = np.zeros(n, np.int64), np.arange(n), n
        while len(rows):
            here, best = code[rows, None], error[rows]
            ahead = place[rows, None] + np.arange(STEP)
            entry = self.order[here, ahead]
            within = self.reach[here, ahead] <= best[:, None]
            r, c = np.nonzero(within & ~visited[rows[:, None], entry])
            own, e = rows[r], entry[r, c]
            visited[own, e] = True
            computed += len(e)
            found = np.full(entry.shape, most)
            found[r, c] = ((vectors[own] - self.entries[e]) ** 2).sum(axis=1)
            least = found.min(axis=1)
            who = np.where(found == least[:, None], entry, k).min(axis=1)
            better = (least < best) | ((least == best) & (who < code[rows]))
            code[rows] = np.where(better, who, code[rows])
            error[rows] = np.where(better, least, best)
            place[rows] = np.where(better, 0, place[rows] + STEP)
            rows = rows[better | within[:, -1]]
        return code, error, computed


def _matrix(column, size: int):
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)


def _parts(books: list, vectors):
    import numpy as np

    width = vectors.shape[1] // len(books)
    return [np.ascontiguousarray(vectors[:, p * width:(p + 1) * width]) for p in range(len(books))]


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``id``, ``label`` and ``v``, the integer components, of every row with a whole vector."""
    x = F.col(vec_col).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    as_integer = lambda c: F.when(F.abs(c) < LEAST_TOO_LARGE, F.floor(c * SCALE)).otherwise(
        F.raise_error(F.lit(f"vector codes take components below {LEAST_TOO_LARGE}")).cast("long"))
    return vectors.where(x.isNotNull() & ~bad).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"),
                                                      F.transform(x, as_integer).alias("v"))


def _summer(entries: list, size: int):
    """Per task: count and sum of the parts nearest to each entry."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        books = [Codebook(e) for e in entries]
        sums = [np.zeros_like(b.entries) for b in books]
        counts = [np.zeros(len(b.entries), np.int64) for b in books]
        for batch in slices(batches, VECTORS):
            for p, part in enumerate(_parts(books, _matrix(batch.column(0), size))):
                code, _, _ = books[p].nearest(part)
                np.add.at(sums[p], code, part)
                counts[p] += np.bincount(code, minlength=len(counts[p]))
        for p, n in enumerate(counts):
            used = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(used), p), pa.int32()), pa.array(used, pa.int32()), pa.array(n[used], pa.int64()),
                pa.array(list(sums[p][used]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])
    return run


def train(whole: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list:
    """The codebooks of ``whole_vectors``: per part, a list of entries (lists of integers). None without vectors."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits per part: 1 to 256 entries")
    low, high = whole.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if low is None:
        return []
    if low != high or low % parts:
        raise ValueError(f"vectors of one length divisible by {parts} are needed, not of {low} to {high} components")
    width = low // parts
    first = [r["v"] for r in whole.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]
    books = [[v[p * width:(p + 1) * width] for v in first] for p in range(parts)]
    for _ in range(rounds):
        # at most one row per entry comes back
        sums = whole.select("v").mapInArrow(_summer(books, low), "part int, entry int, n long, sums array<long>") \
            .groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)))
        for r in sums.collect():
            books[r["part"]][r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return books


def _coder(entries: list, schema):
    size = sum(len(book[0]) for book in entries)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        books = [Codebook(e) for e in entries]
        for batch in slices(batches, VECTORS):
            found = [b.nearest(part) for b, part in zip(books, _parts(books, _matrix(batch.column(2), size)))]
            codes = np.stack([code for code, _, _ in found], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(schema.field(0).type), batch.column(1).cast(schema.field(1).type),
                pa.array([row.tobytes().hex() for row in codes], pa.string()),
                pa.array(sum(error for _, error, _ in found), pa.int64())], schema=schema)
    return run


def encode(whole: DataFrame, books: list) -> DataFrame:
    """``id``, ``label``, ``code`` and ``error`` of every vector."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField("id", id_type(whole, "id")), T.StructField("label", id_type(whole, "label")),
                           T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not books:
        return whole.limit(0).select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    return whole.select("id", "label", "v").mapInArrow(_coder(books, to_arrow_schema(schema)), schema)


def books_digest(books: list) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                 parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Per row with a whole vector: id, ``code``, ``error``, ``label_error`` (over its label) and ``codebooks_sha256``."""
    whole = whole_vectors(vectors, id_col, vec_col, label_col)
    books = train(whole, parts, entries, rounds)
    coded = keep(encode(whole, books))
    # written, so that Spark sees its size when it chooses the join
    per_label = keep(coded.groupBy(F.col("label").alias("own")).agg(F.sum("error").alias("label_error")))
    return coded.join(per_label, F.col("label").eqNullSafe(F.col("own"))).select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
