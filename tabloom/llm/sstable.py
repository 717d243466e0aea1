"""Token ids as sorted-string-table shards (operator 3).

A shard holds documents in ascending key order. Layout, all little-endian:

    data blocks   entries: shared key bytes, new key bytes, ids (3 x uint32), key suffix, ids as uint16 or uint32
    block index   per block: key length (uint32), first key, offset (uint64), length (uint32)
    Bloom filter  bits of all keys
    footer        index offset, filter offset, filter bits (3 x uint64), hashes, id bytes, blocks (3 x uint32), ids in the shard (uint64), magic (8 bytes)

Keys are 8 bytes, big-endian with the sign bit flipped, so that byte order is number order. Each block starts
with a whole key; later keys share a prefix with the one before. A reader looks a key up through filter,
binary search of the index, and one block.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch, ship, table, text_of
from .tokens import encoder, vocabulary

MAGIC = b"SSTTOK01"
FOOTER = struct.Struct("<QQQIIIQ8s")
ENTRY = struct.Struct("<III")
#: A shard is closed at so many bytes, so that a reader that takes it whole stays small.
SHARD_BYTES = 16 << 20
BLOCK_BYTES = 64 << 10


def key_bytes(doc_id: int) -> bytes:
    return struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def key_number(key: bytes) -> int:
    return struct.unpack(">Q", key)[0] - (1 << 63)


def _probes(key: bytes, bits: int, hashes: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(hashes)]


class ShardWriter:
    """Entries are added in key order; bytes() closes the shard."""

    def __init__(self, id_bytes: int = 2):
        self.id_bytes, self.parts, self.at, self.keys, self.index = id_bytes, [], 0, [], []
        self.block_start, self.last, self.ids = None, b"", 0

    def add(self, doc_id: int, ids: bytes) -> None:
        """ids: packed uint32."""
        import numpy as np

        key = key_bytes(doc_id)
        if self.block_start is None or self.at - self.block_start >= BLOCK_BYTES:
            if self.block_start is not None:
                self.index[-1][2] = self.at - self.block_start
            self.block_start, self.last = self.at, b""
            self.index.append([key, self.at, 0])
        shared = next((i for i, (x, y) in enumerate(zip(key, self.last, strict=False)) if x != y), min(len(key), len(self.last)))
        n = len(ids) // 4
        body = ids
        if self.id_bytes == 2:
            wide = np.frombuffer(ids, "<u4")
            if n and wide.max() > 0xFFFF:
                raise ValueError(f"id {wide.max()} of document {doc_id} does not fit 2 bytes")
            body = wide.astype("<u2").tobytes()
        for x in (ENTRY.pack(shared, len(key) - shared, n), key[shared:], body):
            self.parts.append(x)
            self.at += len(x)
        self.last, self.ids = key, self.ids + n
        self.keys.append(key)

    def bytes(self) -> bytes:
        if self.index:
            self.index[-1][2] = self.at - self.block_start
        index = b"".join(struct.pack("<I", len(k)) + k + struct.pack("<QI", at, n) for k, at, n in self.index)
        bits, hashes = max(64, 10 * len(self.keys)), 7
        bloom = bytearray((bits + 7) // 8)
        for key in self.keys:
            for p in _probes(key, bits, hashes):
                bloom[p >> 3] |= 1 << (p & 7)
        foot = FOOTER.pack(self.at, self.at + len(index), bits, hashes, self.id_bytes, len(self.index), self.ids, MAGIC)
        return b"".join([*self.parts, index, bytes(bloom), foot])


class ShardReader:
    def __init__(self, data: bytes):
        self.data = memoryview(data)
        self.index_at, self.bloom_at, self.bits, self.hashes, self.id_bytes, blocks, self.ids, magic = FOOTER.unpack(self.data[-FOOTER.size :])
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.keys, self.blocks, at = [], [], self.index_at
        for _ in range(blocks):
            (n,) = struct.unpack_from("<I", self.data, at)
            self.keys.append(bytes(self.data[at + 4 : at + 4 + n]))
            self.blocks.append(struct.unpack_from("<QI", self.data, at + 4 + n))
            at += 16 + n

    def _block(self, i: int) -> Iterator[tuple[bytes, memoryview]]:
        at, size = self.blocks[i]
        end, last = at + size, b""
        while at < end:
            shared, new, n = ENTRY.unpack_from(self.data, at)
            at += ENTRY.size
            last = last[:shared] + bytes(self.data[at : at + new])
            at += new
            yield last, self.data[at : at + n * self.id_bytes]
            at += n * self.id_bytes

    def _ids(self, raw: memoryview):
        import numpy as np

        return np.frombuffer(raw, "<u2" if self.id_bytes == 2 else "<u4").astype("<u4")

    def items(self) -> Iterator[tuple[int, object]]:
        for i in range(len(self.blocks)):
            for key, raw in self._block(i):
                yield key_number(key), self._ids(raw)

    def get(self, doc_id: int) -> list:
        """The ids of every document with this key (none, one, or several if keys repeat)."""
        key = key_bytes(doc_id)
        bloom = self.data[self.bloom_at :]
        if not all(bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits, self.hashes)):
            return []
        found, i = [], max(0, bisect_right(self.keys, key) - 1)
        while i > 0 and self.keys[i] == key:
            i -= 1
        for j in range(i, len(self.blocks)):
            if self.keys[j] > key:
                break
            found += [self._ids(raw) for k, raw in self._block(j) if k == key]
        return found


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None, doc_id: str = "doc_id", text: str = "text", id_bytes: int | None = None, splits: int | None = None) -> DataFrame:
    """Writes docs under path and returns (shard, first, docs, ids), a row per shard; shard names sort as keys do.

    Null text is empty (only the end id remains). Rows without a key are refused, repeated keys keep all
    their rows. A task writes its range of keys in order, through a temporary name, so a rerun after a
    lost executor replaces whole files and never leaves half of one. id_bytes: 2 or 4, by default as many as the file's
    largest id or end_id needs; ids that do not fit are refused. Empty docs give no shards.
    """
    spark = docs.sparkSession
    ship(spark)
    id_bytes = id_bytes or (2 if max(encoder(tokenizer_path).largest_id, end_id or 0) <= 0xFFFF else 4)
    # Part of the key itself, so that it is never left out of the plan.
    key = F.coalesce(F.col(doc_id).cast("long"), F.raise_error(F.lit(f"{doc_id} is null")).cast("long"))
    rows = docs.select(key.alias("doc_id"), text_of(text).alias("text"))
    n = splits or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    tail = b"" if end_id is None else struct.pack("<I", end_id)

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        enc, shard, made, first = encoder(tokenizer_path), ShardWriter(id_bytes), [], None

        def close():
            nonlocal shard, first
            if shard.keys:
                name = f"{context.partitionId():06d}-{len(made):05d}.sst"
                part = f"{root}/_{name}.{context.taskAttemptId()}"
                with store.open_output_stream(part) as f:
                    f.write(shard.bytes())
                store.move(part, f"{root}/{name}")
                made.append((name, first, len(shard.keys), shard.ids))
            shard, first = ShardWriter(id_bytes), None

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for key, ids in zip(part.column("doc_id").to_pylist(), enc.encode(part.column("text").to_pylist()), strict=True):
                    first = key if first is None else first
                    shard.add(key, ids + tail)
                    if shard.at >= SHARD_BYTES:
                        close()
        close()
        if made:
            names, firsts, counts, ids = zip(*made, strict=True)
            yield pa.RecordBatch.from_pydict({"shard": list(names), "first": list(firsts), "docs": list(counts), "ids": list(ids)}, schema=pa.schema([("shard", pa.string()), ("first", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())]))

    listing = ranged.mapInArrow(write, "shard string, first long, docs long, ids long")
    listing.write.parquet(f"{path}-shards")
    return spark.read.schema("shard string, first long, docs long, ids long").parquet(f"{path}-shards")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(shard, position, doc_id, ids binary) of every document in the files; ids as packed uint32."""
    schema = T.StructType().add("path", "string").add("modificationTime", "timestamp").add("length", "long").add("content", "binary")
    files = spark.read.format("binaryFile").schema(schema).option("pathGlobFilter", "*.sst").load(path).select("path", "content")

    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                keys, ids, size, at = [], [], 0, 0
                for key, x in ShardReader(data).items():
                    keys.append(key)
                    ids.append(x.tobytes())
                    size += len(ids[-1])
                    if size > 4 << 20:
                        yield _rows(pa, name, at, keys, ids)
                        at, keys, ids, size = at + len(keys), [], [], 0
                if keys:
                    yield _rows(pa, name, at, keys, ids)

    return files.mapInArrow(parse, "shard string, position long, doc_id long, ids binary")


def _rows(pa, name: str, at: int, keys: list, ids: list):
    shard = name.rpartition("/")[2]
    return pa.RecordBatch.from_arrays([pa.array([shard] * len(keys)), pa.array(range(at, at + len(keys)), pa.int64()), pa.array(keys, pa.int64()), pa.array(ids, pa.binary())], names=["shard", "position", "doc_id", "ids"])


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts come from the shards' own totals (a row per shard) plus a running sum inside each shard."""
    path = scratch(spark, "sst")
    shards = write_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), path, vocabulary("word_bpe_49k.json"), 2)
    from pyspark.sql import Window

    # One row per shard of SHARD_BYTES: the sum over them is a window over a table that is smaller than the data by the shard size.
    before = shards.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("before"))
    read = read_shards(spark, path).select("shard", "position", "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    inside = Window.partitionBy("shard").orderBy("position")
    placed = read.withColumn("inside", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    return placed.join(before, "shard").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
