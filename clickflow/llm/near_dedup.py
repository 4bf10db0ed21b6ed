"""Near-duplicate documents by HyperMinHash, banding and exact verification.

A document is its set of word shingles, hashed to 64 bits. Its sketch has 256
registers: the top 8 bits of a hash choose the register, and the register
keeps its least remaining value as a floating-point number of two bytes --
leading zeros and ten bits of mantissa. Runs of ``r`` registers are bands;
``r`` is the largest for which two documents at the threshold share no band
with a chance of one in a million. (Empty registers borrow, in a fixed order of
their own, from ones in use, so short documents do not meet by emptiness.)

Documents with equal sets are one class from the start. Classes that share a
band are candidates, and links are found without listing all pairs of a band:

1. In each band, every class is compared with one hub, the class with most
   copies.
2. Components so far divide each band's classes. Pairs inside a component need
   no check; each other pair has a class outside the band's largest component.
   Pairs that share a shingle which at most ``SELDOM`` candidates have are
   listed by that shingle. In all other pairs such shingles are in no
   intersection, which bounds the similarity from counts alone. A second bound
   is exact too: two sets differ by at least as many shingles as their parity
   bits differ (``PARITY_BITS`` bits, each the parity of the shingles hashed to it).
   Only pairs that can still reach the threshold by both are formed and compared;
   pages of one template that share less never are.

Each comparison first estimates the similarity from the registers, corrected
for chance collisions; pairs that stay below the threshold by six standard
errors go no further, all others are verified on their full sets.

Every step is a join or pre-aggregated grouping on class, band or shingle;
intermediate tables are written to the shared folder.

Defined cases: a text without words, or null, has an empty set and links to
nothing; one with fewer words than a shingle has its whole sequence as its only one;
rows equal in id and text are one document; a null id never is a group's
least id (a group without any id has a null component); other columns are
ignored by ``near_duplicates`` and kept by ``without_near_duplicates``, which
tells groups by their label (``component_id`` is an id, which unrelated groups
may share or lack) and keeps one of equal rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickflow.llm.common import LOWER_TABLE, free_name, id_type, keep, utf8
from clickflow.llm.components import component_labels

REGISTERS = 256
MANTISSA_BITS = 10
EMPTY = 0xFFFF
#: Chance that a pair at the threshold shares no band.
MISS = 1e-6
#: Candidates that have a shingle for it to list pairs; others are covered by the bound (a matter of work, not results).
SELDOM = 8
#: Parity bits of a set; the bound holds at any size and excludes most for sets of up to about twice as many shingles.
PARITY_BITS = 1024
SHINGLE_WORDS = 5
LEAST_PERCENT = 80


def band_rows(percent: int) -> int:
    """Registers per band."""
    j = percent / 100
    fits = [r for r in range(1, 33) if (1 - j ** r) ** (REGISTERS // r) <= MISS]
    return max(fits, default=1)


def _mix(z):
    import numpy as np

    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingles(text: bytes | None, k: int):
    """Sorted distinct 64-bit hashes of the text's k-word shingles."""
    import numpy as np
    import xxhash

    words = (text or b"").translate(LOWER_TABLE).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(k, len(words))
    out = _mix(h[:len(h) - width + 1] + np.uint64(width))
    for i in range(1, width):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - width + 1 + i])
    return np.unique(out)


def sketch(hashes):
    """The registers (numpy uint16) of a sorted set."""
    import numpy as np

    out = np.full(REGISTERS, EMPTY, dtype=np.uint16)
    edges = np.searchsorted(hashes, np.arange(REGISTERS, dtype=np.uint64) << np.uint64(56))
    used = edges < np.append(edges[1:], len(hashes))
    least = (hashes[edges[used]] & np.uint64((1 << 56) - 1)) >> np.uint64(3)  # 53 bits: exact as a float
    fraction, exponent = np.frexp(least.astype(np.float64))
    mantissa = np.maximum(fraction * 2 - 1, 0) * (1 << MANTISSA_BITS)
    out[used] = (53 - exponent) * (1 << MANTISSA_BITS) + mantissa.astype(np.int64)
    return out


def parity_bits(hashes):
    """For each of ``PARITY_BITS`` places whether an odd number of hashes falls on it, as 64-bit numbers."""
    import numpy as np

    odd = np.bincount((hashes & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


class _Lenders:
    """For each register, the order in which it asks the others."""

    order = None

    @classmethod
    def get(cls):
        import numpy as np

        if cls.order is None:
            cls.order = np.argsort(_mix(np.arange(REGISTERS * REGISTERS, dtype=np.uint64) + np.uint64(77)).reshape(
                REGISTERS, REGISTERS), axis=1)
        return cls.order


def band_keys(registers, rows: int):
    """One signed 64-bit key per band of a sketch that is not empty."""
    import numpy as np

    used = registers != EMPTY
    if not used.all():
        order = _Lenders.get()
        lender = np.where(used, np.arange(REGISTERS), order[np.arange(REGISTERS), used[order].argmax(axis=1)])
        registers = registers[lender]
    n = REGISTERS // rows
    bands = registers[:n * rows].reshape(n, rows).astype(np.uint64)
    key = _mix(np.arange(n, dtype=np.uint64) + np.uint64(rows << 8))
    for i in range(rows):
        key = _mix(key + bands[:, i])
    return key.view(np.int64)


def estimate(a, b, n_a: int, n_b: int) -> tuple[float, float]:
    """Similarity by registers, less the expected chance collisions, and its standard error."""
    import numpy as np

    used = int(np.count_nonzero((a != EMPTY) | (b != EMPTY)))
    equal = int(np.count_nonzero((a == b) & (a != EMPTY)))
    if not used:
        return 0.0, 1.0
    # chance that two unrelated minima agree in leading zeros and mantissa, at most for equal sizes
    ratio = n_a / n_b
    chance = 0.169919487 * 4 * ratio / (1 + ratio) ** 2 / (1 << MANTISSA_BITS)
    j = max(0.0, (equal - used * chance) / used)
    return j, math.sqrt(0.25 / used)


def linked(a, b, sketch_a, sketch_b, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, by estimate and then by the full sets."""
    import numpy as np

    low, high = sorted((len(a), len(b)))
    if not low or 100 * low < percent * high:
        return False
    j, error = estimate(sketch_a, sketch_b, len(a), len(b))
    if j < percent / 100 - 6 * error:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _profiler(k: int, schema):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in batches:
            n, keys, regs = [], [], []
            for text in utf8(batch.column(1)):
                h = shingles(text, k)
                n.append(len(h))
                keys.append(xxhash.xxh3_128_digest(h.tobytes()))
                regs.append(sketch(h).tobytes())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(schema.field(0).type), batch.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.binary()),
                pa.array(regs, pa.binary())], schema=schema)
    return run


def _bander(rows: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keys = [band_keys(np.frombuffer(r, np.uint16), rows) for r in batch.column(1).to_pylist()]
            each = REGISTERS // rows
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64), pa.int64()),
                pa.array(np.repeat(batch.column(0).to_numpy(), each), pa.int64())], names=["band", "member"])
    return run


def _fetcher(k: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in batches:
            c, n, sets, regs, bits = [], [], [], [], []
            for text, node, key in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                h = shingles(text, k)
                if xxhash.xxh3_128_digest(h.tobytes()) == key:  # another text may have the same id
                    c.append(node)
                    n.append(len(h))
                    sets.append(h.tobytes())
                    regs.append(sketch(h).tobytes())
                    bits.append(parity_bits(h))
            yield pa.RecordBatch.from_arrays([
                pa.array(c, pa.int64()), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(regs, pa.binary()),
                pa.array(bits, pa.list_(pa.int64()))], names=["node", "n", "hashes", "registers", "bits"])
    return run


def _verifier(percent: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            col = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
            out = [(a, b) for a, b, x, y, rx, ry in zip(*(col[c] for c in ("a", "b", "hashes", "hashes_b", "registers", "registers_b")))
                   if linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), np.frombuffer(rx, np.uint16),
                             np.frombuffer(ry, np.uint16), percent)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())],
                                             names=["a", "b"])
    return run


def _hash_rows(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        sets = [np.frombuffer(h, np.int64) for h in batch.column(1).to_pylist()]
        sizes = [len(s) for s in sets]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64), pa.int64()),
            pa.array(np.repeat(batch.column(0).to_numpy(), sizes), pa.int64())], names=["shingle", "node"])


class _Search:
    """The search for links between classes."""

    def __init__(self, sets: DataFrame, percent: int):
        self.sets, self.percent = sets, percent
        self.links: DataFrame | None = None
        self.labels: DataFrame | None = None

    def labelled(self, df: DataFrame, col: str, name: str) -> DataFrame:
        """``df`` with the component label of ``col``, itself if it has no link yet."""
        if self.labels is None:
            return df.withColumn(name, F.col(col))
        labels = self.labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
        return df.join(labels, F.col(col) == F.col("_node"), "left") \
            .withColumn(name, F.coalesce("_label", col)).drop("_node", "_label")

    def compare(self, pairs: DataFrame) -> None:
        """Verify the pairs (a, b) whose components differ, and update components."""
        pairs = pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.labels is not None:
            pairs = self.labelled(self.labelled(pairs, "a", "label_a"), "b", "label_b").where("label_a != label_b").select("a", "b")
        # sizes first: only pairs that can reach the threshold take their sets along
        sizes = self.sets.select("node", "n")
        sized = (pairs.join(sizes.withColumnsRenamed({"node": "a", "n": "n_a"}), "a")
                 .join(sizes.withColumnsRenamed({"node": "b", "n": "n_b"}), "b")
                 .where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.percent).select("a", "b"))
        left = self.sets.select(F.col("node").alias("a"), "hashes", "registers")
        right = self.sets.select(F.col("node").alias("b"), F.col("hashes").alias("hashes_b"), F.col("registers").alias("registers_b"))
        found = keep(keep(sized).join(left, "a").join(right, "b").mapInArrow(_verifier(self.percent), "a long, b long"))
        self.links = found if self.links is None else keep(self.links.union(found))
        self.labels = component_labels(self.links)


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = LEAST_PERCENT,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``tag`` (hash of the text), ``n_shingles``, ``component_id`` (least id of its group)."""
    return _grouped(docs, shingle_words, percent, id_col, text_col).select(
        F.col("id").alias(id_col), "tag", F.col("n").alias("n_shingles"), "component_id")


def _grouped(docs: DataFrame, shingle_words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Per row of ``docs``: ``id``, ``tag``, ``n``, ``component_id`` and ``label``, its group's own number (null without words)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = id_type(docs, id_col)
    schema = T.StructType([T.StructField("id", kind), T.StructField("tag", T.LongType()), T.StructField("n", T.LongType()),
                           T.StructField("set_key", T.BinaryType()), T.StructField("registers", T.BinaryType())])
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    profiles = keep(texts.withColumn("tag", F.xxhash64("text"))
                    .mapInArrow(_profiler(shingle_words, to_arrow_schema(schema)), schema))
    # classes of equal sets, numbered as they are written
    classes = keep(profiles.where("n > 0").groupBy("set_key").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tag")).alias("first"), F.count(F.lit(1)).alias("copies"),
        F.any_value("registers").alias("registers"))
        .withColumn("node", F.monotonically_increasing_id()).withColumn("least_id", F.col("first.id")))
    # a member's number and, above it, how often it is doubled by copies: the largest is the hub
    weighed = classes.select((F.shiftleft(F.floor(F.log2("copies")).cast("long"), 57) + F.col("node")).alias("member"), "registers")
    members = weighed.mapInArrow(_bander(band_rows(percent)), "band long, member long")
    mask = F.lit((1 << 57) - 1)
    bands = members.groupBy("band").agg(F.max("member").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "hub")
    shared = keep(members.join(bands, "band").select(
        "band", F.col("member").bitwiseAND(mask).alias("node"), F.col("hub").bitwiseAND(mask).alias("hub")))

    wanted = shared.select("node").distinct().join(classes.select("node", "first", "set_key"), "node")
    first_text = texts["id"].eqNullSafe(F.col("first.id")) & (F.xxhash64(texts["text"]) == F.col("first.tag"))
    sets = keep(texts.join(wanted, first_text).select("text", "node", "set_key")
                .mapInArrow(_fetcher(shingle_words), "node long, n long, hashes binary, registers binary, bits array<long>")
                .groupBy("node").agg(*(F.any_value(c).alias(c) for c in ("n", "hashes", "registers", "bits"))))
    search = _Search(sets, percent)
    search.compare(shared.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    search.compare(_open_pairs(search, shared, percent))

    groups = search.labelled(classes.select("node", "set_key", "least_id"), "node", "label")
    least = groups.groupBy("label").agg(F.min("least_id").alias("component_id"))
    by_set = keep(groups.join(least, "label").select("set_key", "component_id", "label"))
    own = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return profiles.select("id", "tag", "n", "set_key").join(by_set, "set_key", "left").select(
        "id", "tag", "n", own.alias("component_id"), "label")


def _open_pairs(search: _Search, shared: DataFrame, percent: int) -> DataFrame:
    """Pairs of a band in different components that may still be links."""
    # bands with the same hub are one group: their classes meet once, not once for every band they share
    rows = search.labelled(shared.select(F.col("hub").alias("band"), "node").distinct(), "node", "label")
    parts = keep(rows.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n")))
    # the largest component of a band (by number of classes, then label), packed to aggregate as one number
    mixed = (parts.groupBy("band").agg(F.count(F.lit(1)).alias("parts"), F.max("n").alias("most")).where("parts > 1"))
    main = parts.join(mixed, "band").where("n = most").groupBy("band").agg(F.min("label").alias("main"))
    rows = keep(rows.join(keep(main), "band"))
    involved = search.sets.join(rows.select("node").distinct(), "node", "left_semi").select("node", "n", "hashes", "bits")
    found = involved.select("node", "hashes").mapInArrow(_hash_rows, "shingle long, node long")
    seldom = keep(found.groupBy("shingle").agg(F.count(F.lit(1)).alias("holders"), F.min("node").alias("holder"))
                  .where(F.col("holders") <= SELDOM))
    alone = seldom.where("holders = 1").select(F.col("holder").alias("node"), F.lit(1).alias("alone"))
    held = keep(found.join(seldom.where("holders > 1").select("shingle"), "shingle"))
    counted = alone.union(held.select("node", F.lit(0))).groupBy("node").agg(
        F.count(F.lit(1)).alias("seldom"), F.sum("alone").alias("alone"))
    less = lambda c: (F.col("n") - F.coalesce(c, F.lit(0))).alias
    sizes = keep(involved.select("node", "n").join(counted, "node", "left")
                 .select("node", "n", less("seldom")("common"), less("alone")("whole")))

    def reaches(both, n_a, n_b) -> F.Column:
        """Whether an intersection of at most ``both`` can be enough for sets of these sizes."""
        return 100 * both >= percent * (n_a + n_b - both)

    # pairs with a seldom shingle in common: at most SELDOM for each place of one
    labels = rows.groupBy("node").agg(F.min("label").alias("label"), F.max((F.col("label") != F.col("main")).cast("int")).alias("open"))
    able = keep(labels.join(sizes, "node").where(F.col("whole") * 100 >= F.col("n") * percent))
    one = held.join(able.where("open = 1"), "node").select("shingle", *(F.col(c).alias(f"{c}_a") for c in ("node", "label", "n", "whole")))
    two = held.join(able, "node").select("shingle", *(F.col(c).alias(f"{c}_b") for c in ("node", "label", "n", "whole")))
    explicit = one.join(two, (one["shingle"] == two["shingle"]) & (F.col("label_a") != F.col("label_b"))
                        & reaches(F.least("whole_a", "whole_b"), F.col("n_a"), F.col("n_b"))) \
        .select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    rows = rows.join(sizes, "node").join(involved.select("node", "bits"), "node")

    # with the partner's size that suits it best, of those in the band
    rows = keep(rows)
    ranges = rows.groupBy("band").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    best = F.greatest("low", F.least("high", "common"))
    rows = keep(rows.join(ranges, "band").withColumn("open", (F.col("label") != F.col("main")) & reaches(F.least("common", best), F.col("n"), best)))

    def side(name: str) -> DataFrame:
        return rows.select("band", F.col("node").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("label", "n", "common", "bits", "open")))

    a, b = side("a").where("open_a"), side("b")
    differ = sum((F.bit_count(F.col("bits_a")[i].bitwiseXOR(F.col("bits_b")[i])) for i in range(1, PARITY_BITS // 64)),
                 F.bit_count(F.col("bits_a")[0].bitwiseXOR(F.col("bits_b")[0])))
    possible = ((a["label_a"] != b["label_b"]) & (~b["open_b"] | (a["a"] < b["b"]))
                & reaches(F.least("common_a", "common_b"), F.col("n_a"), F.col("n_b"))
                & ((100 + percent) * differ <= (100 - percent) * (F.col("n_a") + F.col("n_b"))))
    return a.join(b, (a["band"] == b["band"]) & possible).select("a", "b").union(explicit)


def without_near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = LEAST_PERCENT,
                            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group, the one with the least id (and then the least text hash)."""
    found = _grouped(docs, shingle_words, percent, id_col, text_col)
    texts = found.groupBy("label", "id", "tag").agg(F.count(F.lit(1)).alias("rows"))
    # a text without words is a group of its own
    alone = F.col("label").isNull()
    own_id, own_tag = free_name(docs, "own_id"), free_name(docs, "own_tag")
    kept = keep(texts.groupBy("label", F.when(alone, F.col("id")).alias("own_id"), F.when(alone, F.col("tag")).alias("own_tag"))
                .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tag", "rows")).alias("first"))
                .select(F.col("first.id").alias(own_id), F.col("first.tag").alias(own_tag), F.col("first.rows").alias("rows")))
    tag = F.xxhash64(F.col(text_col))
    if kept.where("rows > 1").limit(1).count():  # equal rows become one in every task before they meet
        docs = docs.groupBy(F.col(id_col).alias(own_id), tag.alias(own_tag)).agg(
            F.any_value(F.struct(*docs.columns)).alias("doc")).select("doc.*")
    kept = kept.drop("rows")
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(own_id)) & (tag == F.col(own_tag)), "left_semi").select(*docs.columns)
