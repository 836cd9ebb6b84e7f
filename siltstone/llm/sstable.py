"""Token ids as sorted-string-table shards.

A shard holds documents in ascending key order::

    block*  index  filter  footer

* block: zstd of entries and a trailer. An entry is varint(shared) varint(rest) varint(value length), the rest of
  the key and the value; ``shared`` counts the leading bytes taken over from the entry before, and is 0 at every
  16th entry. The trailer lists where those entries begin (u32 each) and how many they are (u32), so that a lookup
  can bisect within the block.
* index (zstd): for each block its last key, place, length and number of entries; lookups bisect it.
* filter: a Bloom filter of 10 bits and 7 probes a key.
* footer (56 bytes): places and lengths of index and filter, number of entries and ids, crc32 of both, magic.

Keys are bytes that sort as the column does: null first, longs by value, texts by code point. A key may repeat;
a lookup returns all its values. A value is a width byte (2 or 4) and the ids as little-endian integers of it.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ENCODE_BYTES, Scratch, filesystem, sized, table, utf8
from .encoding import encoder

MAGIC = b"SSTSHRD1"
FOOTER = struct.Struct("<QQQQQQ8s")
RESTART = 16


def key_bytes(value) -> bytes:
    if value is None:
        return b"\0"
    if isinstance(value, int):
        return b"\1" + struct.pack(">Q", (value + (1 << 63)) & ((1 << 64) - 1))
    return b"\2" + str(value).encode()


def key_value(key: bytes):
    if key[:1] == b"\0":
        return None
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[:1] == b"\1" else key[1:].decode()


def pack_ids(ids: np.ndarray) -> bytes:
    """16 bits each where all fit."""
    return b"\2" + ids.astype("<u2").tobytes() if not ids.size or ids.max() < 65536 else b"\4" + ids.astype("<u4").tobytes()


def unpack_ids(value: bytes) -> bytes:
    return value[1:] if value[0] == 4 else np.frombuffer(value, "<u2", offset=1).astype("<u4").tobytes()


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key)
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + i * b) % bits for i in range(7)]


class ShardWriter:
    """Appends entries in key order to an open binary file; holds one block, the index and 8 bytes a key."""

    def __init__(self, out, block_bytes: int = 1 << 16):
        self.out, self.block_bytes, self.at = out, block_bytes, 0
        self.block, self.restarts, self.in_block, self.last = bytearray(), [], 0, b""
        self.index, self.keys, self.entries, self.n_ids = [], [], 0, 0
        self.first, self.zip = None, zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, value: bytes, n_ids: int) -> None:
        if key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.in_block % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.first = key if self.first is None else self.first
        self.last, self.in_block, self.entries, self.n_ids = key, self.in_block + 1, self.entries + 1, self.n_ids + n_ids
        self.keys.append(xxhash.xxh64_intdigest(key))
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.in_block:
            data = self.zip.compress(bytes(self.block) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts)))
            self.out.write(data)
            self.index.append((self.last, self.at, len(data), self.in_block))
            self.at += len(data)
            self.block, self.restarts, self.in_block = bytearray(), [], 0

    def close(self) -> int:
        """Write what follows the blocks; the shard's length."""
        self._flush()
        index = self.zip.compress(b"".join(_varint(len(k)) + k + _varint(a) + _varint(n) + _varint(c) for k, a, n, c in self.index))
        bits = max(64, 10 * len(self.keys) + 7 & ~7)
        h = np.array(self.keys, np.uint64)
        field = np.zeros(bits, np.uint8)
        for i in range(7):
            field[((h & np.uint64(0xFFFFFFFF)) + np.uint64(i) * (h >> np.uint64(32) | np.uint64(1))) % np.uint64(bits)] = 1
        bloom = np.packbits(field, bitorder="little").tobytes()
        crc = zlib.crc32(bloom, zlib.crc32(index))
        self.out.write(index + bloom + FOOTER.pack(self.at, len(index), len(bloom), self.entries, self.n_ids, crc, MAGIC))
        return self.at + len(index) + len(bloom) + FOOTER.size


class Shard:
    """Reads a shard through read(place, length), a block at a time."""

    def __init__(self, read, length: int):
        self.read = read
        at, n_index, n_bloom, self.entries, self.n_ids, crc, magic = FOOTER.unpack(read(length - FOOTER.size, FOOTER.size))
        packed, self.bloom = read(at, n_index), read(at + n_index, n_bloom)
        if magic != MAGIC or zlib.crc32(self.bloom, zlib.crc32(packed)) != crc:
            raise ValueError("not a whole shard")
        data, p, self.index = zstandard.decompress(packed), 0, []
        while p < len(data):
            n, p = _read_varint(data, p)
            key, p = data[p : p + n], p + n
            a, p = _read_varint(data, p)
            size, p = _read_varint(data, p)
            count, p = _read_varint(data, p)
            self.index.append((key, a, size, count))
        self.lasts = [e[0] for e in self.index]

    def _block(self, i: int) -> tuple[bytes, list[int], int]:
        data = zstandard.decompress(self.read(self.index[i][1], self.index[i][2]))
        n = struct.unpack_from("<I", data, len(data) - 4)[0]
        end = len(data) - 4 * (n + 1)
        return data, list(struct.unpack_from(f"<{n}I", data, end)), end

    @staticmethod
    def _walk(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + size]
            at += size

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.index)):
            data, _, end = self._block(i)
            yield from self._walk(data, 0, end)

    def maybe(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, 8 * len(self.bloom)))

    def get(self, key: bytes) -> list[bytes]:
        """All values of a key: filter, then bisection over blocks and over restarts."""
        out: list[bytes] = []
        if not self.maybe(key):
            return out
        i = bisect_left(self.lasts, key)
        while i < len(self.index):
            data, restarts, end = self._block(i)
            lo = bisect_left(restarts, True, key=lambda at: next(self._walk(data, at, end))[0] >= key)
            for k, v in self._walk(data, restarts[max(0, lo - 1)], end):
                if k > key:
                    return out
                if k == key:
                    out.append(v)
            i += 1
        return out


MANIFEST = "path string, part int, seq int, bytes long, n_docs long, n_ids long, first_key binary, last_key binary"


class TokenStore:
    """Shards of one run in the shared folder and the manifest that lists them."""

    def __init__(self, scratch: Scratch, manifest: DataFrame, key_type: str):
        self.scratch, self.manifest, self.key_type = scratch, manifest, key_type

    def documents(self, task_bytes: int = 8 << 20) -> DataFrame:
        """(key, start, n_tokens, ids) of every entry, read back from the shards; start counts the ids before it.
        ids are little-endian unsigned 32-bit integers. A task reads about ``task_bytes`` of shards, or one shard."""
        order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
        shards = self.manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))

        def read(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    fs, path = filesystem(row["path"])
                    at = row["base"]
                    with fs.open_input_file(path) as f:
                        held, size = [], 0
                        for key, value in Shard(lambda p, n, f=f: f.read_at(n, p), row["bytes"]).scan():
                            ids = unpack_ids(value)
                            if held and size + len(ids) > 4 * ENCODE_BYTES:
                                yield _rows(held)
                                held, size = [], 0
                            held.append((key_value(key), at, len(ids) // 4, ids))
                            at, size = at + len(ids) // 4, size + len(ids)
                        if held:
                            yield _rows(held)

        kind = pa.string() if self.key_type == "string" else pa.int64()

        def _rows(held):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (kind, pa.int64(), pa.int64(), pa.binary()), strict=True)], ["key", "start", "n_tokens", "ids"])

        # a shard is a row of a few bytes here and up to tens of MB there: tasks by bytes, and shards dealt in turn
        n, size = self.manifest.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
        tasks = min(n, max(self.scratch.spark.sparkContext.defaultParallelism, -(-size // task_bytes)))
        spread = shards.select("path", "bytes", "base").repartition(max(1, tasks))
        return spread.mapInArrow(read, f"key {self.key_type}, start long, n_tokens long, ids binary")

    def lookup(self, keys: DataFrame, slots: int = 16) -> DataFrame:
        """(key, ids) for each row of the one-column ``keys`` and each document of that key.

        A key's shards are found by bisection of the manifest's ascending last keys, which tasks read from the shared
        folder; then each shard's keys are looked up in it, in ``slots`` tasks a shard at most.
        """
        key_type, manifest = self.key_type, self.scratch.path("manifest")

        def place(frames):
            import pandas as pd

            fs, top = filesystem(manifest)
            listed = pads.dataset(top, filesystem=fs, format="parquet", exclude_invalid_files=False).to_table(columns=["path", "part", "seq", "bytes", "first_key", "last_key"]).sort_by([("part", "ascending"), ("seq", "ascending")]).to_pydict()
            for pdf in frames:
                out = []
                for value in pdf["key"]:
                    k = key_bytes(None if pd.isna(value) else int(value) if key_type == "long" else value)
                    i = bisect_left(listed["last_key"], k)
                    while i < len(listed["path"]) and listed["first_key"][i] <= k:
                        out.append((k, listed["path"][i], listed["bytes"][i]))
                        i += 1
                yield pd.DataFrame(out, columns=["k", "path", "bytes"])

        def find(pdf):
            import pandas as pd

            fs, path = filesystem(pdf["path"].iloc[0])
            with fs.open_input_file(path) as f:
                shard = Shard(lambda p, n: f.read_at(n, p), int(pdf["bytes"].iloc[0]))
                found = [(key_value(bytes(k)), unpack_ids(v)) for k in pdf["k"] for v in shard.get(bytes(k))]
            return pd.DataFrame({"key": pd.Series([k for k, _ in found], dtype="Int64" if key_type == "long" else object), "ids": [v for _, v in found]})

        hits = keys.select(F.col(keys.columns[0]).cast(key_type).alias("key")).mapInPandas(place, "k binary, path string, bytes long")
        return hits.groupBy("path", F.pmod(F.xxhash64("k"), F.lit(slots)).alias("slot")).applyInPandas(find, f"key {key_type}, ids binary")


def write_tokens(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", shard_bytes: int = 64 << 20) -> TokenStore:
    """Encode every whole text, append ``end_id`` and write shards of about ``shard_bytes`` in ascending key order.

    Rows with a null key come first; rows that share a key are ordered by a hash of their text, and split over
    tasks if they are many. A null text is empty and has the end id only. Empty input gives no shard.
    Files are written under another name and moved; a task that runs again writes the same bytes to the same name.
    """
    scratch = Scratch(spark, "sstable")
    root = scratch.path("shards")
    kind = dict(docs.dtypes)[key]
    key_type = "long" if kind in ("tinyint", "smallint", "int", "bigint") else "string"
    rows = docs.select(F.col(key).cast(key_type).alias("k"), utf8(text).alias("t")).withColumn("h", F.xxhash64("t"))
    ordered = rows.repartitionByRange(F.col("k").asc_nulls_first(), "h").sortWithinPartitions(F.col("k").asc_nulls_first(), "h", "t")

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        fs, top = filesystem(root)
        fs.create_dir(top, recursive=True)
        tokens, seq, out, writer, done = encoder(tokenizer), 0, None, None, []

        def close():
            out_bytes = writer.close()
            out.close()
            name = f"{part:06d}-{seq:05d}.sst"
            fs.move(f"{top}/.{name}.{attempt}", f"{top}/{name}")
            done.append((f"{root}/{name}", part, seq, out_bytes, writer.entries, writer.n_ids, writer.first, writer.last))

        for some in sized(batches, 1, ENCODE_BYTES):
            ids, ends = tokens.encode(some.column(1), end_id)
            ends = ends.tolist()
            for k, a, b in zip(some.column(0).to_pylist(), ends[:-1], ends[1:], strict=True):
                if writer is None:
                    out = fs.open_output_stream(f"{top}/.{part:06d}-{seq:05d}.sst.{attempt}")
                    writer = ShardWriter(out)
                writer.add(key_bytes(k), pack_ids(ids[a:b]), b - a)
                if writer.at >= shard_bytes:
                    close()
                    seq, writer = seq + 1, None
        if writer is not None:
            close()
        if done:
            types = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], [x.split()[0] for x in MANIFEST.split(", ")])

    # one file: a row of a shard is some hundred bytes, and a Parquet file takes starts of chmod on a local file system
    manifest = scratch.table(ordered.select("k", "t").mapInArrow(write, MANIFEST).repartition(1), "manifest")
    return TokenStore(scratch, manifest, key_type)


def op1_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document's ids, read back from the shards."""
    import public_tokenizers

    store = write_tokens(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    read = store.documents()
    return read.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
