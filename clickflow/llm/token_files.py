"""Token ids as fixed-width bit-packed blocks.

``write_token_blocks`` sorts documents by id (a range shuffle), encodes each
one, appends the end id and packs the ids of consecutive documents into
blocks: every id takes the fewest bits that hold the vocabulary, first id in
the lowest bits. A block is one row of a Parquet table -- committed by
Spark's writer, so a lost task leaves nothing behind -- with

    shard, block      its place: shards in id order, blocks within them
    first             ids of the shard before this block
    n_ids, bits       ids in the block and bits of each
    doc_ids, doc_ends the documents and where each ends, in ids
    payload           the packed ids

A block holds whole documents and closes once it has ``block_ids`` ids, so
it can be read on its own: filter by shard and block, unpack with numpy.
``read_token_blocks`` does that for all blocks; ``shard_starts`` gives each
shard's first position in the whole corpus.

Defined cases: a null text is empty (just the end id); null ids sort first;
rows with equal ids keep one deterministic order (by text) and their own
entries; other columns are ignored; an empty table writes no block.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickflow.llm.bpe import NEWLINE, POINTS, ByteBpe, plain_lines, segments, splits_badly
from clickflow.llm.common import id_type, per_process, slices
from clickflow.session import ensure_checkpoint_dir

BLOCK_IDS = 1 << 18
#: Words a worker process remembers (some 200 bytes each); beyond that it starts afresh.
MEMORY_WORDS = 1_000_000


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``."""
    return max(1, (max(1, vocabulary) - 1).bit_length())


def pack(ids, bits: int) -> bytes:
    """Ids (numpy uint32) in ``bits`` bits each, lowest bit first."""
    import numpy as np

    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    out = []
    step = 1 << 16  # a multiple of 8 ids: every part but the last fills whole bytes
    for at in range(0, len(ids), step):
        part = ids[at:at + step].astype("<u4").view(np.uint8).reshape(-1, 4)
        out.append(np.packbits(np.unpackbits(part, axis=1, bitorder="little")[:, :bits], bitorder="little").tobytes())
    return b"".join(out)


def unpack(payload: bytes, bits: int, n_ids: int, start: int = 0):
    """``n_ids`` ids from place ``start`` on; reads only the bytes that hold them."""
    import numpy as np

    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", n_ids, start * bits // 8).astype(np.uint32)
    out = np.empty(n_ids, dtype=np.uint32)
    step = 1 << 16
    for at in range(0, n_ids, step):
        n = min(step, n_ids - at)
        low = (start + at) * bits
        raw = np.frombuffer(payload, np.uint8, -(-(low + n * bits) // 8) - low // 8, low // 8)
        wide = np.zeros((n, 32), dtype=np.uint8)
        wide[:, :bits] = np.unpackbits(raw, bitorder="little")[low % 8:low % 8 + n * bits].reshape(n, bits)
        out[at:at + n] = np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()
    return out


class _CutDifferently(Exception):
    """A space continues white space before it."""


class _Encoder:
    """Whole texts to little-endian 32-bit ids, remembering words."""

    def __init__(self, path: str):
        bpe = self.bpe = ByteBpe(path)
        self.vocabulary = bpe.tok.get_vocab_size(with_added_tokens=True)

        class Pretokens(dict):
            def __missing__(self, pretoken):
                self[pretoken] = out = array("I", bpe.pretoken_ids(pretoken)).tobytes()
                return out

        pre = self.pre = Pretokens()

        class Words(dict):
            """Ids of a word after ``space``."""

            def __init__(self, space):
                super().__init__()
                self.space = space

            def __missing__(self, word):
                if splits_badly(word):
                    raise _CutDifferently
                if word[-1] in POINTS and word[:-1].isalpha():  # the word itself may be known
                    out = self[word[:-1]] + pre[word[-1]]
                else:
                    out = array("I", [i for p in bpe.word_pretokens(word, self.space) for i in bpe.pretoken_ids(p)]).tobytes()
                self[word] = out
                return out

        self.first, self.spaced = Words(""), Words(" ")

    def _general(self, part: str) -> list[bytes]:
        return [array("I", self.bpe.pretoken_ids(p)).tobytes() for segment in segments(part) for p in self.bpe.pretokens(segment)]

    def _plain(self, part: str) -> list[bytes]:
        lines = plain_lines(part)
        if lines is None:
            return self._general(part)
        out, newline, spaced = [], self.pre[NEWLINE], self.spaced.__getitem__
        try:
            for k, words in enumerate(lines):
                if k:
                    out.append(newline)
                out.append(self.first[words[0]])
                out += map(spaced, words[1:])
        except _CutDifferently:
            return self._general(part)
        return out

    def __call__(self, text: str) -> bytes:
        if len(self.first) + len(self.spaced) > MEMORY_WORDS:
            self.first.clear()
            self.spaced.clear()
        out = []
        for k, part in enumerate(self.bpe.split_special(text)):
            if k % 2:
                out.append(self.bpe.added[part].to_bytes(4, "little"))
            elif part:
                out += self._plain(part)
        return b"".join(out)


def _packer(path: str, end_id: int, block_ids: int, schema):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encoder, end = None, end_id.to_bytes(4, "little")
        block = first = 0
        docs, ends, parts, n = [], [], [], 0

        def row():
            ids = np.frombuffer(b"".join(parts), "<u4")
            bits = bits_for(max(encoder.vocabulary, end_id + 1))
            return pa.RecordBatch.from_pylist([{
                "shard": shard, "block": block, "first": first, "n_ids": n, "bits": bits, "doc_ids": docs,
                "doc_ends": ends, "payload": pack(ids, bits)}], schema=schema)

        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                encoder = encoder or per_process(("encoder", path), lambda: _Encoder(path))
                got = encoder(text or "") + end
                n += len(got) // 4
                docs.append(doc_id)
                ends.append(n)
                parts.append(got)
                if n >= block_ids:
                    yield row()
                    block, first = block + 1, first + n
                    docs, ends, parts, n = [], [], [], 0
        if docs:
            yield row()
    return run


def write_token_blocks(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 0, block_ids: int = BLOCK_IDS,
                       id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` in ascending id order into a table of packed blocks at ``path``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType()),
        T.StructField("first", T.LongType()), T.StructField("n_ids", T.LongType()),
        T.StructField("bits", T.IntegerType()), T.StructField("doc_ids", T.ArrayType(id_type(docs, id_col))),
        T.StructField("doc_ends", T.ArrayType(T.LongType())), T.StructField("payload", T.BinaryType())])
    ordered = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
               .withColumn("tie", F.xxhash64("text"))
               .repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")
               .select("id", "text"))
    (ordered.mapInArrow(_packer(tokenizer_path, end_id, block_ids, to_arrow_schema(schema)), schema)
     .write.option("compression", "zstd").parquet(path))


def shard_starts(blocks: DataFrame) -> DataFrame:
    """``shard``, ``start``: ids of all shards before it (one row per shard: as many as write tasks)."""
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))


def _reader(schema):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for b in batch.to_pylist():
                ids = unpack(b["payload"], b["bits"], b["n_ids"]).astype("<u4")
                ends = np.asarray(b["doc_ends"], dtype=np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                raw = memoryview(ids.tobytes())
                yield pa.RecordBatch.from_arrays([
                    pa.array(b["doc_ids"], schema.field("id").type),
                    pa.array([b["shard"]] * len(ends), pa.int32()),
                    pa.array(b["first"] + starts, pa.int64()), pa.array(ends - starts, pa.int64()),
                    pa.array([zlib.crc32(raw[4 * s:4 * e]) for s, e in zip(starts.tolist(), ends.tolist())], pa.int64()),
                ], schema=schema)
    return run


def read_token_blocks(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document of the blocks: id, ``start``, ``n_tokens``, ``ids_crc32`` (little-endian 32-bit ids)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = blocks.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("id", kind), T.StructField("shard", T.IntegerType()),
                           T.StructField("at", T.LongType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_crc32", T.LongType())])
    docs = blocks.mapInArrow(_reader(to_arrow_schema(schema)), schema)
    # one row per write task: a few bytes each
    return docs.join(F.broadcast(shard_starts(blocks)), "shard").select(
        F.col("id").alias(id_col), (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_blocks_digest(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Write ``docs`` as packed blocks in the shared folder and read them back."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-blocks-{uuid.uuid4().hex}"
    write_token_blocks(docs, tokenizer_path, path, end_id=end_id)
    return read_token_blocks(spark.read.parquet(path))
