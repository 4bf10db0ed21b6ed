"""Line deduplication within an edit distance, by segment partitions.

A line is a duplicate if an earlier line (by document id, then place) is
equal to it or, for lines of ``least_chars`` characters or more, is linked to
it by edits: a chain of lines, each within the permitted edits of the next.
The first line of such a class stays, the others are removed. ``max_edits`` is
one number for all lines or steps of (least length, edits); the shorter line
of a pair decides.

Lines are cut into one segment more than the edits permitted at their length,
at fixed places for it. Two lines within these edits share a segment: the
shorter line's segment equals a substring of the longer one whose start can
differ only by the edits on either side. So every line is indexed by (length, segment number,
segment) and probes, for each length it may be close to, the few substrings
that can match. Keys and probes are hashes of substrings, all taken from running
hashes of many lines at once, and dealt by key in one shuffle of number pairs. Every
task reads its keys in order, indexed lines first, and lets go at once of those
that only one line has or that none is indexed by, which is nearly all. A line is
named in the pairs by 48 bits of its own hash; what is left is joined to
the numbered distinct lines, so two lines of one name are both looked at.

Lines that meet under a key are compared with one hub line of the key first, and
of a line's hubs with the least before the others. Pairs whose lines are then in one component need no check; of the others,
those whose parities of letters and letter pairs differ by more than the edits can
explain are never formed, and any other only once, under the least key it shares. What is left
is verified by a banded bit-parallel automaton, many pairs at a time.

Defined cases: lines without a word are never removed; a null or empty text
has no lines; null ids come first, repeated rows in a fixed order, so only one of
equal rows keeps a line; other columns are ignored by ``repeated_lines`` and
kept by ``without_repeated_lines``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickflow.llm.common import free_name, id_type, keep, release, slices, utf8
from clickflow.llm.components import component_labels

#: Permitted edits from a line length on.
MAX_EDITS = ((20, 1), (40, 2), (80, 3))
#: Shorter lines are only compared for equality.
LEAST_CHARS = 20


Edits = int | tuple[tuple[int, int], ...]


def edits_at(length: int, max_edits: Edits) -> int:
    """Edits permitted between a line of this length and one as long or longer."""
    if isinstance(max_edits, int):
        return max_edits
    return max((edits for least, edits in max_edits if length >= least), default=0)


def most_edits(max_edits: Edits) -> int:
    return max_edits if isinstance(max_edits, int) else max(edits for _, edits in max_edits)


def segment_places(length: int, parts: int) -> list[tuple[int, int]]:
    """Start and length of each segment of a line."""
    size, longer = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        n = size + (i >= parts - longer)
        out.append((at, n))
        at += n
    return out


#: Bits of a key, and of a line's name in the pairs.
KEY_BITS = NAME_BITS = 48
_ODD, _ODD_INVERSE = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)


def _mixed(z):
    import numpy as np

    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


class Keys:
    """Keys and probes of lines: where they start, how long they are and what tells them apart, by line length."""

    def __init__(self, max_edits: Edits):
        self.max_edits = max_edits
        self.places: dict[int, tuple] = {}
        self.powers = self.inverses = None

    def places_of(self, n: int) -> tuple:
        """Starts, sizes, seeds and whether probing, for a line of ``n`` characters."""
        import numpy as np

        if n not in self.places:
            most, found = most_edits(self.max_edits), {}
            for i, (start, size) in enumerate(segment_places(n, edits_at(n, self.max_edits) + 1)):
                found[n, i, start, size] = 0
            for length in range(max(n - most, 1), n + 1):
                more, edits = n - length, edits_at(length, self.max_edits)
                if more > edits:
                    continue
                for i, (start, size) in enumerate(segment_places(length, edits + 1)):
                    left, right = i, edits - i  # edits that can lie on either side
                    low = max(start - left, start + more - right, 0)
                    high = min(start + left, start + more + right, n - size)
                    for at in range(low, high + 1):
                        found.setdefault((length, i, at, size), 1)
            rows = np.array([(at, size, length * (most + 1) + i, probing) for (length, i, at, size), probing in found.items()])
            self.places[n] = tuple(rows.T)
        return self.places[n]

    def of(self, lines: list[str]):
        """Per line its number of keys; all keys in turn (of ``KEY_BITS``), and which of them are probes."""
        import numpy as np

        lengths = np.array([len(x) for x in lines])
        codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        if self.powers is None or len(self.powers) <= len(codes):
            bases = np.full((2, max(len(codes) + 1, 1 << 16)), 1, np.uint64)
            bases[0, 1:], bases[1, 1:] = _ODD, _ODD_INVERSE
            self.powers, self.inverses = np.cumprod(bases, axis=1, dtype=np.uint64)
        # running hashes: a substring's is a difference, moved to the origin
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(codes + np.uint64(1)) * self.powers[:len(codes)])])
        places = [self.places_of(n) for n in lengths.tolist()]
        each = np.array([len(p[0]) for p in places])
        begins = np.repeat(np.cumsum(lengths) - lengths, each)
        start, size, seed, probing = (np.concatenate([p[k] for p in places]) for k in range(4))
        start = start + begins
        own = (running[start + size] - running[start]) * self.inverses[start]
        return each, _mixed(own + seed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - KEY_BITS), probing == 1


def line_keys(line: str, max_edits: Edits) -> tuple[list[int], list[int]]:
    """Keys under which the line is indexed, and further keys that it probes."""
    _, keys, probing = Keys(max_edits).of([line])
    own = set(keys[~probing].tolist())
    return sorted(own), sorted(set(keys[probing].tolist()) - own)


def parities(line: str) -> tuple[int, int]:
    """64 parities of the line's letter pairs, and of its letters, by hash.

    A replaced letter changes at most four and two of them, one put in or taken out three and one.
    """
    import numpy as np

    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    out = []
    for z in (codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:], codes * np.uint64(0x9E3779B97F4A7C15)):
        bits = np.bincount(((z * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(58)).astype(np.int64), minlength=64) & 1
        out.append(int(np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)[0]))
    return out[0], out[1]


def within_edits(left: list[str], right: list[str], max_edits: int) -> list[bool]:
    """For each pair, whether its edit distance is ``max_edits`` at most.

    State d of a pair is a bit mask over the diagonals of the band: which
    prefixes of the left line match what has been read of the right one with
    at most d edits. All pairs of a batch take a step at once.
    """
    import numpy as np

    out = np.zeros(len(left), dtype=bool)
    width, full = 2 * max_edits + 1, (1 << (2 * max_edits + 1)) - 1
    kind = np.min_scalar_type(full << 1)
    order = sorted((k for k in range(len(left)) if abs(len(left[k]) - len(right[k])) <= max_edits), key=lambda k: len(right[k]))
    at = 0
    while at < len(order):
        # a batch: some million characters, and lines of like length
        longest = max(64, 2 * len(right[order[at]]))
        n = 1
        while at + n < len(order) and len(right[order[at + n]]) <= longest and (n + 1) * longest <= 4_000_000:
            n += 1
        batch = order[at:at + n]
        at += n
        columns = max(len(right[k]) for k in batch)
        a = np.zeros((n, columns + width + max_edits), dtype=np.uint32)
        b = np.full((n, columns), 1, dtype=np.uint32)
        for row, k in enumerate(batch):
            x = np.frombuffer(left[k].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            a[row, max_edits:max_edits + len(x)] = x + 2
            y = np.frombuffer(right[k].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            b[row, :len(y)] = y + 2
        ends = np.array([len(right[k]) for k in batch])
        final = np.array([len(left[k]) - len(right[k]) + max_edits for k in batch])
        rows = np.arange(n)
        state = [np.full(n, sum(1 << (max_edits + i) for i in range(d + 1)), dtype=kind) for d in range(max_edits + 1)]
        for j in range(columns + 1):
            done = ends[rows] == j
            if done.any():
                hit = rows[done]
                out[np.asarray(batch)[hit]] = (state[-1][done] >> final[hit].astype(kind)) & 1 == 1
            alive = ~done & (state[-1] != 0) if j % 32 == 0 or done.any() else None
            if alive is not None and not alive.all():
                rows, state = rows[alive], [s[alive] for s in state]
            if not len(rows):
                break
            if j == columns:
                break
            same = np.zeros(len(rows), dtype=kind)
            read = b[rows, j]
            for k in range(width):
                same |= (a[rows, j + k] == read).astype(kind) << kind.type(k)
            new = [state[0] & same]
            for d in range(1, max_edits + 1):
                new.append(((state[d] & same) | state[d - 1] | (state[d - 1] >> kind.type(1)) | (new[d - 1] << kind.type(1)))
                           & kind.type(full))
            state = new
    return out.tolist()


def has_word(line: bytes) -> bool:
    return bool(line) and not line.isspace()


def _line_rows(schema):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            of, places, digests = [], [], []
            for k, text in enumerate(utf8(batch.column(1))):
                before = len(of)
                for place, raw in enumerate(text.split(b"\n")) if text else ():
                    if has_word(raw):
                        of.append(k)
                        places.append(place)
                        digests.append(xxhash.xxh3_128_digest(raw))
                if len(of) == before:  # a document without lines has one row
                    of.append(k)
                    places.append(None)
                    digests.append(None)
            which = pa.array(of, pa.int64())
            columns = [pa.array(np.array(of, np.int64) + row), batch.column(0).take(which), batch.column(2).take(which),
                       pa.array(places, pa.int32()), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)
            row += batch.num_rows
    return run


#: Lines whose keys are made at a time, and line names that a task remembers to pass over repeats.
LINES_AT_ONCE = 2048
REMEMBERED = 1 << 20


def _entries(max_edits: Edits, least_chars: int):
    """``key`` (twice the key, and one if it is probed) and ``name`` of the lines of texts."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        keys, seen, names, lines = Keys(max_edits), set(), [], []

        def made():
            each, key, probing = keys.of(lines)
            name = np.repeat(np.array(names, np.int64), each)
            names.clear()
            lines.clear()
            return pa.RecordBatch.from_arrays([pa.array((key.astype(np.int64) << 1) | probing), pa.array(name)], names=["key", "name"])

        for batch in slices(batches):
            for text in utf8(batch.column(0)):
                for raw in text.split(b"\n") if text else ():
                    if len(raw) < least_chars or not has_word(raw):  # as many bytes as characters, or more
                        continue
                    name = line_name(xxhash.xxh3_128_digest(raw))
                    if name in seen:
                        continue
                    seen.add(name)
                    line = raw.decode("utf-8", "replace")
                    if len(line) >= least_chars:
                        names.append(name)
                        lines.append(line)
                        if len(lines) == LINES_AT_ONCE or len(line) > 100_000:
                            yield made()
                if len(seen) > REMEMBERED:
                    seen.clear()
        if lines:
            yield made()
    return run


def line_name(digest: bytes) -> int:
    return int.from_bytes(digest[:NAME_BITS // 8], "big")


def _shared_keys(batches: Iterator) -> Iterator:
    """Of rows in order of ``key`` (see ``_entries``), those whose key has two rows or more, one of them indexed.

    Indexed rows come first, so a key's first row tells whether it has one.
    Only a key's single row so far is held back from batch to batch. A line that several tasks
    have found is dropped within a batch only, so a few keys of one line may come out too.
    """
    import numpy as np
    import pyarrow as pa

    last_key, keep_last, held = None, False, None
    for batch in batches:
        key, name = (batch.column(i).to_numpy() for i in range(2))
        if not len(key):
            continue
        carried = held is not None
        if carried:
            key, name = np.append(held[0], key), np.append(held[1], name)
        again = np.flatnonzero(key[1:] >> 1 == key[:-1] >> 1)
        if len(again):  # names in order within the keys of several rows, so that repeats are neighbours
            some = np.union1d(again, again + 1)
            order = some[np.lexsort((name[some], key[some]))]
            key, name = key.copy(), name.copy()
            key[some], name[some] = key[order], name[order]
            fresh = np.append(True, (key[1:] != key[:-1]) | (name[1:] != name[:-1]))
            key, name = key[fresh], name[fresh]
        own = key >> 1
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        sizes = np.diff(np.append(starts, len(key)))
        lengths = sizes.copy()
        indexed = key[starts] & 1 == 0
        kept = indexed & (sizes > 1)
        if not carried and last_key is not None and own[0] == last_key:
            kept[0] = indexed[0] = keep_last
            sizes[0] += 1  # its first row is gone already
        last_key = own[-1]
        # a single indexed row may still find company
        held = (key[-1], name[-1]) if indexed[-1] and sizes[-1] == 1 else None
        keep_last = bool(kept[-1])
        some = np.repeat(kept, lengths)
        yield pa.RecordBatch.from_arrays([pa.array(own[some]), pa.array(1 - (key[some] & 1)), pa.array(name[some])],
                                         names=["key", "indexed", "name"])


def _texts_of(batches: Iterator) -> Iterator:
    import pyarrow as pa
    import xxhash

    for batch in batches:
        nodes, lines, pairs, letters, chars = [], [], [], [], []
        for text, wanted in zip(utf8(batch.column(0)), batch.column(1).to_pylist()):
            parts = text.split(b"\n")
            for w in wanted:
                raw = parts[w["place"]] if w["place"] < len(parts) else None
                if raw is not None and xxhash.xxh3_128_digest(raw) == w["line"]:
                    line = raw.decode("utf-8", "replace")
                    nodes.append(w["node"])
                    lines.append(raw)
                    both = parities(line)
                    pairs.append(both[0])
                    letters.append(both[1])
                    chars.append(len(line))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(lines, pa.binary()).cast(pa.string()),
                                          *(pa.array(x, pa.int64()) for x in (pairs, letters, chars))],
                                         names=["node", "text", "pairs", "letters", "chars"])


def _verifier(max_edits: Edits):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
            edits = [edits_at(min(len(p), len(q)), max_edits) for p, q in zip(x, y)]
            ok = [False] * len(x)
            for e in set(edits):
                some = [k for k, own in enumerate(edits) if own == e]
                for k, near in zip(some, within_edits([x[k] for k in some], [y[k] for k in some], e)):
                    ok[k] = near
            yield pa.RecordBatch.from_arrays([pa.array([p for p, o in zip(a, ok) if o], pa.int64()),
                                              pa.array([p for p, o in zip(b, ok) if o], pa.int64())], names=["a", "b"])
    return run


def line_classes(docs: DataFrame, max_edits: Edits = MAX_EDITS, least_chars: int = LEAST_CHARS, id_col: str = "doc_id",
                 text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables: every line (row, id, tag, place, line), and per distinct line its class's first place.

    ``row`` numbers the documents, ``line`` is the line's hash; a document
    without lines has one row with a null place.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([
        T.StructField("row", T.LongType()), T.StructField("id", id_type(docs, id_col)), T.StructField("tag", T.LongType()),
        T.StructField("place", T.IntegerType()), T.StructField("line", T.BinaryType())])
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("tag", F.xxhash64("text"))
    lines = keep(texts.mapInArrow(_line_rows(to_arrow_schema(schema)), schema))
    distinct = keep(lines.where("line is not null").groupBy("line").agg(F.min(F.struct("id", "tag", "place", "row")).alias("first"))
                    .withColumn("node", F.monotonically_increasing_id()))
    links = _links(texts, distinct, max_edits, least_chars)
    labels = component_labels(links)
    classed = distinct.select("line", "first", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    starts = classed.where("label != node").select("label").distinct().join(classed.select("label", "first"), "label") \
        .groupBy("label").agg(F.min("first").alias("class_first"))
    classes = classed.join(starts, "label", "left").select("line", F.coalesce("class_first", "first").alias("first"))
    return lines.select("row", "id", "tag", "place", "line"), keep(classes)


def _links(texts: DataFrame, distinct: DataFrame, max_edits: Edits, least_chars: int) -> DataFrame:
    """Verified links (a, b) that connect all lines of a class."""
    entries = texts.select("text").mapInArrow(_entries(max_edits, least_chars), "key long, name long")
    # one long to sort by is sorted by its digits
    met = keep(entries.repartition(F.shiftright("key", 1)).sortWithinPartitions("key")
               .mapInArrow(_shared_keys, "key long, indexed long, name long"))
    name = F.conv(F.hex(F.substring("line", 1, NAME_BITS // 8)), 16, 10).cast("long")
    named = distinct.select(name.alias("name"), "node")
    shared = keep(met.join(named, "name").groupBy("key", "node").agg(F.max("indexed").alias("indexed")))
    release(met)
    hubs = shared.where("indexed = 1").groupBy("key").agg(F.min("node").alias("hub"))
    shared = shared.join(hubs, "key")

    wanted = shared.select("node").distinct().join(distinct.select("node", "first", "line"), "node")
    per_text = wanted.groupBy(F.col("first.id").alias("_id"), F.col("first.tag").alias("_tag")).agg(
        F.collect_list(F.struct("node", F.col("first.place").alias("place"), "line")).alias("wanted"))
    found = keep(texts.join(per_text, texts["id"].eqNullSafe(F.col("_id")) & (texts["tag"] == F.col("_tag")))
                 .select("text", "wanted").mapInArrow(_texts_of, "node long, text string, pairs long, letters long, chars long")
                 .groupBy("node").agg(F.any_value("text").alias("text"), F.any_value(F.struct(
                     "pairs", "letters", "chars")).alias("sign")))
    edits = F.lit(most_edits(max_edits))
    if not isinstance(max_edits, int):
        edits = F.greatest(F.lit(0), *(F.when(F.col("sign.chars") >= least, e) for least, e in max_edits))
    signs = keep(found.select("node", "sign", edits.alias("edits")))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        one = found.select(F.col("node").alias("a"), F.col("text").alias("x"))
        two = found.select(F.col("node").alias("b"), F.col("text").alias("y"))
        return keep(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(_verifier(max_edits), "a long, b long"))

    # the indexed line of a pair is the shorter one, or as long
    def far(p, q, edits):
        """Whether two lines differ by more than the edits can explain; letters put in or taken out explain less."""
        other = F.abs(p["chars"] - q["chars"])
        return ((F.bit_count(p["pairs"].bitwiseXOR(q["pairs"])) > 4 * edits - other)
                | (F.bit_count(p["letters"].bitwiseXOR(q["letters"])) > 2 * edits - other))

    rows = keep(shared.join(signs, "node"))
    hub_signs = signs.select(F.col("node").alias("hub"), F.col("sign").alias("hub_sign"), F.col("edits").alias("hub_edits"))
    spokes = keep(rows.where("node != hub").select("node", "hub", "sign").distinct().join(hub_signs, "hub")
                  .where(~far(F.col("sign"), F.col("hub_sign"), F.col("hub_edits"))).select(F.col("node").alias("a"), F.col("hub").alias("b")))

    def labelled(df: DataFrame, col: str, name: str, labels: DataFrame) -> DataFrame:
        own = labels.select(F.col("node").alias("own_node"), F.col("label").alias("own_label"))
        return df.join(own, F.col(col) == F.col("own_node"), "left").withColumn(name, F.coalesce("own_label", col)).drop("own_node", "own_label")

    # every line with one hub first: the least of its keys; then with the hubs of other components
    links = verified(spokes.groupBy("a").agg(F.min("b").alias("b")))
    labels = component_labels(links)
    links = keep(links.union(verified(labelled(labelled(spokes, "a", "label_a", labels), "b", "label_b", labels)
                                      .where("label_a != label_b").select("a", "b"))))
    labels = component_labels(links)
    rows = keep(labelled(rows, "node", "label", labels).select("key", "indexed", "node", "sign", "edits", "label"))
    mixed = keep(rows.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 != l1").select("key"))
    rows = keep(rows.join(mixed, "key"))
    # two lines are paired under the least of the keys that they share; a line has some tens of keys
    under = rows.groupBy("node").agg(F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("indexed") == 1, F.col("key"))).alias("own"))
    rows = keep(rows.join(under, "node"))
    left, right = rows.where("indexed = 1").alias("p"), rows.alias("q")
    least = F.least(F.array_min(F.array_intersect("p.own", "q.keys")), F.array_min(F.array_intersect("q.own", "p.keys")))
    near = ((F.col("p.key") == F.col("q.key")) & (F.col("p.label") != F.col("q.label"))
            & ((F.col("q.indexed") == 0) | (F.col("p.node") < F.col("q.node")))
            & ~far(F.col("p.sign"), F.col("q.sign"), F.col("p.edits")) & (F.col("p.key") == least))
    return keep(links.union(verified(left.join(right, near).select(F.col("p.node").alias("a"), F.col("q.node").alias("b")))))


def repeated_lines(docs: DataFrame, max_edits: Edits = MAX_EDITS, least_chars: int = LEAST_CHARS, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``tag`` (hash of the text), ``n_lines`` with a word, ``n_removed``, ``removed`` (places from 0)."""
    lines, classes = line_classes(docs, max_edits, least_chars, id_col, text_col)
    here = F.struct("id", "tag", "place", "row")
    marked = lines.join(classes, "line", "left").withColumn("gone", F.col("place").isNotNull() & ~here.eqNullSafe(F.col("first")))
    return marked.groupBy("row").agg(
        F.min("id").alias(id_col), F.min("tag").alias("tag"), F.count("place").alias("n_lines"),
        F.count(F.when(F.col("gone"), 1)).alias("n_removed"),
        F.array_sort(F.collect_list(F.when(F.col("gone"), F.col("place")))).alias("removed")).drop("row")


def without_repeated_lines(docs: DataFrame, max_edits: Edits = MAX_EDITS, least_chars: int = LEAST_CHARS,
                           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated lines taken out of their texts (null texts stay null).

    Rows equal in id and text are matched in a fixed order.
    """
    from pyspark.sql import Window

    tag, removed, turn, number, few, rest, gone = (
        free_name(docs, x) for x in ("tag", "removed", "turn", "number", "few", "rest", "gone"))
    found = keep(repeated_lines(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), max_edits, least_chars, "id", "text")
                 .where("n_removed > 0").select(F.col("id").alias("own_id"), F.col("tag").alias("own_tag"), "removed"))
    # equal rows beyond the first lose every line, so all but one have the longest list
    lists = keep(found.groupBy("own_id", "own_tag").agg(F.max_by("removed", F.size("removed")).alias(rest),
                                                        F.min_by("removed", F.size("removed")).alias(few), F.count(F.lit(1)).alias(turn)))
    own = docs.withColumn(tag, F.xxhash64(F.col(text_col)))
    joined = own.join(lists.withColumnsRenamed({"own_id": removed, "own_tag": number}),
                      F.col(id_col).eqNullSafe(F.col(removed)) & (F.col(tag) == F.col(number)), "left").drop(removed, number)
    joined = joined.withColumn(number, F.row_number().over(Window.partitionBy(id_col, tag).orderBy(tag)))
    joined = joined.withColumn(gone, F.coalesce(F.when(F.col(number) == 1, F.col(few)).otherwise(F.col(rest)), F.array().cast("array<int>")))
    parts = F.split(F.col(text_col), "\n", -1)
    left = F.filter(F.transform(parts, lambda x, i: F.when(~F.array_contains(F.col(gone), i), x)), lambda x: x.isNotNull())
    return joined.withColumn(text_col, F.when(F.col(text_col).isNull() | (F.size(gone) == 0), F.col(text_col))
                             .otherwise(F.array_join(left, "\n"))).select(*docs.columns)
