"""Token ids in binary files: fixed-width bit packing.

Each id takes the bits that the vocabulary's largest id needs. Documents are dealt by range of doc_id; each task encodes its
own in order and writes shards of whole documents. A shard is one file, laid down by Spark's writer (so a failed
job leaves nothing half written):

    magic, width, ids a block, documents, ids, partition, number in the partition     (HEADER, little-endian)
    int64 doc_id, uint8 whether there is one, uint64 end of each document's ids in the shard
    uint64 byte offset of each block, and of the end
    blocks: 32 ids fill `width` 32-bit words, lowest bits first; the last block is filled up with zeros to 32 ids

A block starts at a whole byte, so any run of ids is unpacked by numpy from the blocks that hold it. Partitions are in the order
of doc_id, and shards within them; a manifest table tells each shard's file and the place of its first id among all.

Defined results: null text is empty and gives the end id alone; rows with one id are documents of their own, in the order of a hash
of their texts; rows without an id come first; an empty table gives no shards and no rows; extra columns aren't kept; a document is never cut,
so a very long text makes a shard of its own, and its ids must fit into memory, as the text itself.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import join_small, text_of, written
from .packing import encoder

MAGIC = b"IDBITS01"
HEADER = struct.Struct("<8sIIQQQQ")
#: Ids of a block (a multiple of 32), of a full shard, and that are packed or unpacked at once.
BLOCK_IDS, SHARD_IDS, SLICE_IDS = 1024, 1 << 24, 1 << 20


def bits_for(vocabulary: int) -> int:
    """Bits that ids below `vocabulary` need."""
    if not 0 < vocabulary <= 1 << 32:
        raise ValueError("ids must fit into 32 bits")
    return max(1, (vocabulary - 1).bit_length())


def vocabulary_of(path: str) -> int:
    """One more than the largest id of a tokenizers file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))])


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """ids, filled up with zeros to a multiple of 32, in `width` bits each."""
    full = np.zeros(-(-len(ids) // 32) * 32, np.uint64)
    full[: len(ids)] = ids
    if width in (8, 16, 32):  # lie as numbers of that size
        return full.astype(f"<u{width // 8}").tobytes()
    lanes = full.reshape(-1, 32)
    words = np.zeros((len(lanes), width + 1), np.uint64)
    for i in range(32):
        word, shift = divmod(i * width, 32)
        v = lanes[:, i] << np.uint64(shift)
        words[:, word] |= v & np.uint64(0xFFFFFFFF)
        if shift + width > 32:
            words[:, word + 1] |= v >> np.uint64(32)
    return words[:, :width].astype("<u4").tobytes()


def unpack_bits(data: bytes | memoryview, width: int) -> np.ndarray:
    """The ids in data, which holds whole groups of 32."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}").astype(np.uint32)
    words = np.frombuffer(data, "<u4").reshape(-1, width).astype(np.uint64)
    out = np.empty((len(words), 32), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i in range(32):
        word, shift = divmod(i * width, 32)
        v = words[:, word] >> np.uint64(shift)
        if shift + width > 32:
            v |= words[:, word + 1] << np.uint64(32 - shift)
        out[:, i] = v & mask
    return out.reshape(-1)


def shard_bytes(docs: list[int | None], lengths: list[int], ids: np.ndarray, width: int, partition: int, number: int) -> bytes:
    """A shard of the documents whose ids, one after the other, are given."""
    n = len(ids)
    sizes = np.full(-(-n // BLOCK_IDS), BLOCK_IDS // 8 * width, np.uint64)
    if n % BLOCK_IDS:
        sizes[-1] = -(-(n % BLOCK_IDS) // 32) * 4 * width
    return b"".join(
        [
            HEADER.pack(MAGIC, width, BLOCK_IDS, len(docs), n, partition, number),
            np.array([d or 0 for d in docs], "<i8").tobytes(),
            np.array([d is not None for d in docs], np.uint8).tobytes(),
            np.cumsum(lengths, dtype="<u8").tobytes(),
            np.concatenate([np.zeros(1, "<u8"), np.cumsum(sizes, dtype="<u8")]).astype("<u8").tobytes(),
            *(pack_bits(ids[at : at + SLICE_IDS], width) for at in range(0, n, SLICE_IDS)),
        ]
    )


class Shard:
    """A shard in a buffer (bytes, or a memory map of the file): its documents, and any run of its ids."""

    def __init__(self, data):
        self.data = memoryview(data)
        if len(self.data) < HEADER.size:
            raise ValueError("cut short")
        magic, self.width, self.block, self.n_docs, self.n_ids, self.partition, self.number = HEADER.unpack_from(self.data)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = HEADER.size
        self.doc_ids, at = np.frombuffer(self.data, "<i8", self.n_docs, at), at + 8 * self.n_docs
        self.has_id, at = np.frombuffer(self.data, np.uint8, self.n_docs, at).astype(bool), at + self.n_docs
        self.ends, at = np.frombuffer(self.data, "<u8", self.n_docs, at).astype(np.int64), at + 8 * self.n_docs
        blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(self.data, "<u8", blocks + 1, at).astype(np.int64)
        self.payload = at + 8 * (blocks + 1)
        if len(self.data) < self.payload + int(self.offsets[-1]):
            raise ValueError("cut short")

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the shard: only the blocks that hold them are unpacked."""
        start, stop = max(0, start), min(stop, self.n_ids)
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        data = self.data[self.payload + int(self.offsets[first]) : self.payload + int(self.offsets[last + 1])]
        return unpack_bits(data, self.width)[start - first * self.block : stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(number, start, ids) of each document, some SLICE_IDS ids unpacked at once."""
        starts = np.concatenate([[0], self.ends[:-1]])
        i = 0
        while i < self.n_docs:
            j = max(i + 1, int(np.searchsorted(self.ends, starts[i] + SLICE_IDS, "right")))
            run = self.ids(int(starts[i]), int(self.ends[j - 1]))
            for k in range(i, j):
                yield k, int(starts[k]), run[starts[k] - starts[i] : self.ends[k] - starts[i]]
            i = j


def write_tokens(
    docs: DataFrame, tokenizer_path: str, path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shard_ids: int = SHARD_IDS
) -> None:
    """Writes the shards of docs below path/shards."""
    width = bits_for(max(vocabulary_of(tokenizer_path), end_id + 1))
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, partition = encoder(tokenizer_path), TaskContext.get().partitionId()
        found, lengths, parts, held, number = [], [], [], 0, 0

        def shard() -> pa.RecordBatch:
            data = shard_bytes(found, lengths, np.frombuffer(b"".join(parts), "<u4"), width, partition, number)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["shard"])

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                part = encode(text.as_py()) + end
                found.append(doc.as_py())
                lengths.append(len(part) // 4)
                parts.append(part)
                held += lengths[-1]
                if held >= shard_ids:
                    yield shard()
                    found, lengths, parts, held, number = [], [], [], 0, number + 1
        if held:
            yield shard()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    # Ties go by a hash of the text; rows alike in both are dealt by their place, which their results don't show.
    keyed = rows.withColumn("__tie", F.xxhash64("text")).withColumn("__row", F.monotonically_increasing_id())
    order = ["doc_id", "__tie", "__row"]
    shards = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, "shard binary")
    # The text writer lays down a row's bytes as they are and ends them with a newline, which the reader leaves out.
    shards.select(F.col("shard").cast("string")).write.option("maxRecordsPerFile", 1).text(f"{path}/shards")


def read_tokens(spark: SparkSession, path: str, *, with_ids: bool = True) -> DataFrame:
    """path, partition, number, doc_id, start_in_shard, n_tokens, ids_crc32 and, if wanted, ids (unsigned little-endian 32-bit) of what write_tokens wrote."""
    names = ["path", "partition", "number", "doc_id", "start_in_shard", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    types = [pa.string(), *[pa.int64()] * 6, *([pa.binary()] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for file, data in zip(batch.column(0), batch.column(1), strict=True):
                shard, rows, held = Shard(data.as_buffer()), [], 0
                for k, start, ids in shard.documents():
                    raw = ids.astype("<u4", copy=False).tobytes()
                    doc = int(shard.doc_ids[k]) if shard.has_id[k] else None
                    row = (file.as_py(), shard.partition, shard.number, doc, start, len(ids), zlib.crc32(raw))
                    rows.append((*row, raw) if with_ids else row)
                    held += len(raw) if with_ids else 64
                    if held > 1 << 24:
                        yield made()
                        rows, held = [], 0
                if rows:
                    yield made()

    schema = "path string, partition long, number long, doc_id long, start_in_shard long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    files = spark.read.format("binaryFile").load(f"{path}/shards").select("path", "content")
    return files.mapInArrow(run, schema)


def manifest(tokens: DataFrame) -> DataFrame:
    """partition, number, path, first (the place of the shard's first id among all), n_ids, n_docs of read_tokens' rows.

    Only one sum for each partition comes to the driver; within a partition its shards are summed up in order.
    """
    shards = written(
        tokens.groupBy("partition", "number").agg(F.min("path").alias("path"), F.sum("n_tokens").alias("n_ids"), F.count("*").alias("n_docs")), "shards"
    )
    starts, total = [], 0
    for r in sorted(shards.groupBy("partition").agg(F.sum("n_ids").alias("n")).collect()):
        starts.append((r["partition"], total))
        total += r["n"]
    before = F.sum("n_ids").over(Window.partitionBy("partition").orderBy("number")) - F.col("n_ids")
    bases = tokens.sparkSession.createDataFrame(starts, "partition long, __base long")  # one row for each partition
    return shards.join(F.broadcast(bases), "partition").withColumn("first", F.col("__base") + before).drop("__base")


def token_starts(tokens: DataFrame) -> DataFrame:
    """read_tokens' rows with start: the ids of all documents before."""
    firsts = manifest(tokens).select("partition", "number", "first")
    return join_small(tokens, firsts, ["partition", "number"], "inner").withColumn("start", F.col("first") + F.col("start_in_shard"))


def round_trip(docs: DataFrame, tokenizer_path: str, path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of documents that are written to path and read back; their manifest is left beside them."""
    if not path:
        raise ValueError("a folder must be named")
    write_tokens(docs, tokenizer_path, path, id_col=id_col, text_col=text_col, end_id=end_id)
    tokens = written(read_tokens(docs.sparkSession, path, with_ids=False), "tokens")
    manifest(tokens).write.mode("overwrite").parquet(f"{path}/manifest")
    firsts = docs.sparkSession.read.parquet(f"{path}/manifest").select("partition", "number", "first")
    return join_small(tokens, firsts, ["partition", "number"], "inner").select(
        "doc_id", (F.col("first") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32"
    )
