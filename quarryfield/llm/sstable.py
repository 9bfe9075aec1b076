"""Operator 6: token ids as sorted-string-table shards.

Documents are ordered by identifier (range partitioning, then a sort in each partition) and
each partition writes one shard: blocks of entries with prefix-compressed keys, a sparse
index of the blocks' first keys, a Bloom filter of all keys and a fixed-size footer.  A
reader finds a key by the filter, a binary search in the index and one block.

Layout, all integers little-endian; varint: 7 bits a byte, low bits first::

    block   entries, then crc32 of the entries (u32)
    entry   varint shared key bytes, varint further key bytes, varint ids, key bytes, ids
    index   for each block: varint key bytes, key, u64 position, u32 bytes
    filter  u32 hashes, then the bits
    footer  u64 index position, u32 index bytes, u64 filter position, u32 filter bytes,
            u64 documents, u64 ids, u8 bytes of an id (2 or 4), 7 bytes of magic

Keys sort as their bytes: one byte 0 for null, else 1 and then the integer, big-endian with
its sign bit flipped, or the UTF-8 bytes of a string.

A shard is written under a name of its own attempt, and the manifest names the file of the
attempt that Spark committed; a lost executor's half-written file is never read.

Shards are as many as the input's estimated size asks for, and at least the session's shuffle
partitions.

Cases: a null text is empty; null ids come first; repeated ids keep their own entries (a
lookup gives all of them), in order of a hash of the text and over several shards if they
are many; an empty table gives no shards; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, text_or_empty, work_dir
from .encoders import encoder, slices, tokenizer_path

MAGIC = b"QFSST\x00\x01"
FOOTER = struct.Struct("<QIQIQQB7s")
BLOCK_BYTES = 64 << 10
BITS_A_KEY, HASHES = 10, 7
#: Input of a shard, by the planner's estimate, and most shards of one call (a larger table has larger shards).
SHARD_BYTES, MOST_SHARDS = 512 << 20, 1 << 20


def to_key(value) -> bytes:
    if value is None:
        return b"\0"
    return b"\1" + (struct.pack(">Q", value + (1 << 63)) if isinstance(value, int) else value.encode())


def from_key(key: bytes, text: bool):
    if key == b"\0":
        return None
    return key[1:].decode() if text else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def _bits(keys: list[bytes], n_bits: int) -> np.ndarray:
    h = np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64)
    a, b = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    return (a[:, None] + np.arange(HASHES, dtype=np.uint64)[None, :] * b[:, None]) % np.uint64(n_bits)


class ShardWriter:
    """Entries must come in key order; memory: one block, the index, 8 bytes a key and the filter's bits."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.block, self.first, self.last = bytearray(), None, b""
        self.index, self.hashes = [], array("Q")
        self.documents = self.tokens = 0
        self.low = self.high = None

    def add(self, key: bytes, ids: bytes) -> None:
        if self.first is None:
            self.first, shared = key, 0
        else:
            shared, most = 0, min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        n = len(ids) // 4
        stored = ids if self.width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(n) + key[shared:] + stored
        self.last, self.high = key, key
        self.low = key if self.low is None else self.low
        self.hashes.append(xxhash.xxh64_intdigest(key))
        self.documents += 1
        self.tokens += n
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _flush(self) -> None:
        if self.block:
            data = bytes(self.block)
            self.index.append((self.first, self.at, len(data) + 4))
            self._write(data + struct.pack("<I", zlib.crc32(data)))
            self.block, self.first = bytearray(), None

    def finish(self) -> None:
        self._flush()
        index_at = self.at
        self._write(b"".join(_varint(len(k)) + k + struct.pack("<QI", p, n) for k, p, n in self.index))
        filter_at = self.at
        n_bits = max(64, -(-len(self.hashes) * BITS_A_KEY // 8) * 8)
        bits = np.zeros(n_bits // 8, dtype=np.uint8)
        for start in range(0, len(self.hashes), 1 << 16):
            h = np.array(self.hashes[start : start + (1 << 16)], dtype=np.uint64)
            a, b = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
            for i in range(HASHES):
                at = (a + np.uint64(i) * b) % np.uint64(n_bits)
                np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        self._write(struct.pack("<I", HASHES) + bits.tobytes())
        self._write(FOOTER.pack(index_at, filter_at - index_at, filter_at, self.at - filter_at, self.documents, self.tokens, self.width, MAGIC))


class ShardReader:
    """Reads one shard through any random-access file."""

    def __init__(self, file):
        self.file, size = file, file.size()
        index_at, index_n, self._filter_at, self._filter_n, self.documents, self.tokens, self.width, magic = FOOTER.unpack(self._bytes(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        self.keys, self.spans = [], []
        data, at = self._bytes(index_at, index_n), 0
        while at < len(data):
            n, at = _read_varint(data, at)
            self.keys.append(data[at : at + n])
            self.spans.append(struct.unpack_from("<QI", data, at + n))
            at += n + 12

    def _bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        raw = self._bytes(*self.spans[i])
        data, (check,) = raw[:-4], struct.unpack("<I", raw[-4:])
        if zlib.crc32(data) != check:
            raise ValueError(f"block {i} is damaged")
        at, key = 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            more, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + more]
            at += more
            ids = data[at : at + n * self.width]
            at += n * self.width
            yield key, ids if self.width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.spans)):
            yield from self._block(i)

    def may_hold(self, key: bytes) -> bool:
        raw = self._bytes(self._filter_at, self._filter_n)
        bits = np.unpackbits(np.frombuffer(raw[4:], np.uint8), bitorder="little")
        return bool(bits[_bits([key], len(bits))].all())

    def lookup(self, key: bytes) -> list[bytes]:
        """The ids of every entry with that key."""
        if not self.may_hold(key):
            return []
        i, found = max(0, bisect_right(self.keys, key) - 1), []
        while i > 0 and self.keys[i] == key:  # repeated keys may begin in an earlier block
            i -= 1
        for j in range(i, len(self.keys)):
            if self.keys[j] > key:
                break
            found += [ids for k, ids in self._block(j) if k == key]
        return found


def _filesystem(uri: str):
    """Any store that Arrow knows: file, hdfs, s3, gs."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


_MANIFEST = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("file", T.StringType()), T.StructField("low", T.BinaryType()), T.StructField("high", T.BinaryType()), T.StructField("documents", T.LongType()), T.StructField("tokens", T.LongType()), T.StructField("bytes", T.LongType())])


def _writer(folder: str, tokenizer: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        width = 2 if max(e.tokenizer.get_vocab_size(), end_id or 0) < 1 << 16 else 4
        end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
        store, path = _filesystem(folder)
        shard, name, writer, out = TaskContext.get().partitionId(), "", None, None
        for batch in batches:
            for ids, texts in slices(batch):
                if writer is None:
                    name = f"shard-{shard:06d}-{uuid.uuid4().hex}.sst"
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(f"{path}/{name}")
                    writer = ShardWriter(out, width)
                for doc, tokens in zip(ids, e.batch(texts)):
                    writer.add(to_key(doc), tokens + end)
        if writer is not None:
            writer.finish()
            out.close()
            row = (shard, f"{folder}/{name}", writer.low, writer.high, writer.documents, writer.tokens, writer.at)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))], names=_MANIFEST.names)

    return run


def write_shards(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int | None = 2, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards and give the manifest: shard, file, low, high (keys), documents, tokens, bytes."""
    folder = folder or f"{work_dir(docs.sparkSession, 'sstable')}/tokens"
    source = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    if isinstance(source.schema["doc_id"].dataType, T.IntegralType):
        source = source.withColumn("doc_id", F.col("doc_id").cast("long"))
    else:
        source = source.withColumn("doc_id", F.col("doc_id").cast("string"))
    # Rows that repeat an id may part within it, by a hash of the text, so no shard must hold them all.
    order = ["doc_id", F.xxhash64("text")]
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    shards = shards or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_SHARDS, -(-size // SHARD_BYTES)))
    ordered = source.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    tokenizer = tokenizer or tokenizer_path("word_bpe_49k.json")
    return materialise(ordered.mapInArrow(_writer(folder, tokenizer, end_id), _MANIFEST), f"{folder}/manifest")


def read_shards(manifest: DataFrame, text_ids: bool = False) -> DataFrame:
    """One row for each document, from the files: doc_id, start (ids of all documents before it), ids."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file, not for each document
    files = manifest.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))
    files = files.repartition(max(1, manifest.count()), "file")
    schema = T.StructType([T.StructField("doc_id", T.StringType() if text_ids else T.LongType()), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, path = _filesystem(uri)
                with store.open_input_file(path) as file:
                    out: list[tuple] = []
                    held = 0
                    for key, ids in ShardReader(file):
                        out.append((from_key(key, text_ids), start, ids))
                        start += len(ids) // 4
                        held += len(ids)
                        if held >= 1 << 22:
                            yield _rows(out)
                            out, held = [], 0
                    if out:
                        yield _rows(out)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string() if text_ids else pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=schema.names)

    return files.mapInArrow(run, schema)


def lookup(spark: SparkSession, manifest: DataFrame, value) -> list[bytes]:
    """Ids of all documents with that identifier: shards by key range, then filter, index and one block each."""
    key = to_key(value)
    near = manifest.where((F.col("low") <= F.lit(key)) & (F.col("high") >= F.lit(key))).orderBy("shard").select("file")
    found = []
    for row in near.collect():  # one shard, or the few that repeated ids span
        store, path = _filesystem(row["file"])
        with store.open_input_file(path) as file:
            found += ShardReader(file).lookup(key)
    return found
