"""Token counts without token ids.

Each task cuts its documents into pre-tokens and keeps, per chunk of
documents, the chunk's distinct pre-tokens and the documents' frequencies of
them. The chunks' dictionaries are shuffled by pre-token, pieces are counted
once for every distinct one of the corpus, and the counts go back to the
chunks, where they are joined with the frequencies and summed. A frequent
pre-token costs one row per chunk, however often it occurs.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); a null or
repeated id is an ordinary row (one row out per row in); other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickflow.llm.bpe import NEWLINE, ByteBpe, plain_lines, segments, splits_badly
from clickflow.llm.common import id_type, keep, slices

CHUNK_BYTES = 32 << 20


class _Chunk:
    """Frequencies of pre-tokens (numbered within the chunk) for each of its documents."""

    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe
        self.ids, self.n_bytes, self.specials = [], [], []
        self.sizes, self.gaps, self.freq = array("I"), [], []
        self.number: dict[str, int] = {}
        chunk = self

        class Words(dict):
            """Numbers of a word's pre-tokens; None if the text must be cut differently."""

            def __init__(self, space):
                self.space = space

            def __missing__(self, word):
                self[word] = out = None if splits_badly(word) else chunk._numbers(bpe.word_pretokens(word, self.space))
                return out

        self.first, self.spaced = Words(""), Words(" ")

    def _numbers(self, pretokens: list[str]) -> tuple[int, ...]:
        number = self.number
        return tuple(number.setdefault(p, len(number)) for p in pretokens)

    def _plain(self, part: str) -> dict[int, int] | None:
        lines = plain_lines(part)
        if lines is None:
            return None
        firsts = Counter(words[0] for words in lines)
        others = Counter(w for words in lines for w in words[1:])
        counts: dict[int, int] = {}
        for memory, own in ((self.first, firsts), (self.spaced, others)):
            for word, n in own.items():
                numbers = memory[word]
                if numbers is None:
                    return None
                for k in numbers:
                    counts[k] = counts.get(k, 0) + n
        if len(lines) > 1:
            k, = self._numbers([NEWLINE])
            counts[k] = counts.get(k, 0) + len(lines) - 1
        return counts

    def add(self, doc_id, text: str, n_bytes: int) -> None:
        import numpy as np

        counts: Counter = Counter()
        parts = self.bpe.split_special(text)
        for part in parts[::2]:
            if part:
                own = self._plain(part)
                counts.update(own if own is not None else
                              self._numbers([p for s in segments(part) for p in self.bpe.pretokens(s)]))
        self.ids.append(doc_id)
        self.n_bytes.append(n_bytes)
        self.specials.append(len(parts) // 2)
        self.sizes.append(len(counts))
        pre = np.fromiter(counts.keys(), dtype=np.uint32, count=len(counts))
        order = np.argsort(pre)
        self.gaps.append(np.diff(pre[order], prepend=np.uint32(0)))
        self.freq.append(np.fromiter(counts.values(), dtype=np.uint32, count=len(counts))[order])

    def row(self, chunk: int) -> dict:
        import numpy as np

        return {"chunk": chunk, "ids": self.ids, "n_bytes": self.n_bytes, "specials": self.specials,
                "sizes": _packed(np.asarray(self.sizes)), "gaps": _packed(np.concatenate(self.gaps)),
                "freq": _packed(np.concatenate(self.freq)), "pretokens": list(self.number)}


def _packed(values) -> bytes:
    """Whole numbers, byte plane by byte plane, compressed."""
    import numpy as np
    import pyarrow as pa

    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(b: bytes):
    import numpy as np
    import pyarrow as pa

    n = int.from_bytes(b[:8], "little")
    planes = np.frombuffer(pa.decompress(b[8:], decompressed_size=4 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


def _chunker(path: str, schema, chunk_bytes: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        bpe, size = None, 0
        n = TaskContext.get().partitionId() << 33
        chunk = None
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                bpe = bpe or ByteBpe(path)
                chunk = chunk or _Chunk(bpe)
                text = text or ""
                n_bytes = len(text.encode("utf-8"))
                chunk.add(doc_id, text, n_bytes)
                size += n_bytes + 64
                if size >= chunk_bytes:
                    yield pa.RecordBatch.from_pylist([chunk.row(n)], schema=schema)
                    chunk, n, size = None, n + 1, 0
        if chunk:
            yield pa.RecordBatch.from_pylist([chunk.row(n)], schema=schema)
    return run


def _piece_counter(path: str):
    """Rows sorted by pre-token: pieces are counted once for each run of equal ones."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe, last, n = None, None, 0
        for batch in batches:
            pieces = []
            for pretoken in batch.column(0).to_pylist():
                if pretoken != last:
                    bpe = bpe or ByteBpe(path)
                    last, n = pretoken, bpe.count_pieces(pretoken)
                pieces.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(pieces, pa.int32())],
                                             names=["of_chunk", "pos", "n_pieces"])
    return run


def _sum_chunk(chunk, counts):
    """Both sides of one chunk: documents with their token totals."""
    import numpy as np
    import pyarrow as pa

    pos = counts.column("pos").to_numpy()
    pieces = np.zeros(int(pos.max(initial=-1)) + 1, dtype=np.int64)
    pieces[pos] = counts.column("n_pieces").to_numpy()
    out = []
    for row in chunk.to_pylist():
        sizes = _unpacked(row["sizes"]).astype(np.int64)
        ends = np.cumsum(sizes)
        gaps = np.cumsum(_unpacked(row["gaps"]), dtype=np.int64)
        # numbers run on from one document to the next: take off what the ones before have reached
        base = np.where(ends - sizes > 0, np.append(gaps, 0)[ends - sizes - 1], 0)
        tokens = np.cumsum(np.append(0, pieces[gaps - np.repeat(base, sizes)] * _unpacked(row["freq"])))
        out.append(pa.table({
            "id": pa.array(row["ids"], chunk.schema.field("ids").type.value_type),
            "n_bytes": pa.array(row["n_bytes"], pa.int64()),
            "n_tokens": pa.array(tokens[ends] - tokens[ends - sizes] + np.asarray(row["specials"], dtype=np.int64), pa.int64())}))
    return pa.concat_tables(out)


def token_counts(docs: DataFrame, tokenizer_path: str, max_tokens: int = 1024, id_col: str = "doc_id",
                 text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``.

    ``tokenizer_path`` names a byte-level BPE file that every executor can
    open. Added tokens' strings inside a text count as that token, as the
    library does by default; nothing is added at either end.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = id_type(docs, id_col)
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(kind)),
        T.StructField("n_bytes", T.ArrayType(T.LongType())), T.StructField("specials", T.ArrayType(T.LongType())),
        *(T.StructField(c, T.BinaryType()) for c in ("sizes", "gaps", "freq")),
        T.StructField("pretokens", T.ArrayType(T.StringType()))])
    chunks = keep(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
                  .mapInArrow(_chunker(tokenizer_path, to_arrow_schema(schema), chunk_bytes), schema))
    entries = chunks.select(F.posexplode("pretokens").alias("pos", "pretoken"), "chunk").select("pretoken", "chunk", "pos")
    counts = entries.repartition("pretoken").sortWithinPartitions("pretoken").mapInArrow(
        _piece_counter(tokenizer_path), "of_chunk long, pos int, n_pieces int")
    sums = chunks.drop("pretokens").groupBy("chunk").cogroup(counts.groupBy("of_chunk")).applyInArrow(
        _sum_chunk, T.StructType([T.StructField("id", kind), T.StructField("n_bytes", T.LongType()),
                                  T.StructField("n_tokens", T.LongType())]))
    return sums.select(F.col("id").alias(id_col), "n_bytes", "n_tokens",
                       (F.col("n_tokens") > max_tokens).alias("over_limit"))
