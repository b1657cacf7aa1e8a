"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of their keys. Layout, all integers little-endian:

    blocks   each the zstd bytes of its entries: varint shared prefix with the key before, varint length of the rest
             of the key, varint number of tokens, the rest of the key, the ids (unsigned 32-bit)
    index    for each block: u32 length of its first key, that key, u64 place, u32 bytes stored, u32 bytes unpacked
    bloom    bits over all keys
    footer   u64 place of the index, u32 blocks, u64 place of the bloom bits, u32 bloom bytes, u32 hashes, u64 entries,
             u64 tokens, 8 bytes magic

A lookup tests the Bloom filter, finds the block by binary search in the sparse index, and reads that block alone.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, pa_schema, small_batches, stage, table, tokenizer_path
from .wordpiece import encoder

MAGIC = b"KWSST001"
FOOTER = struct.Struct("<QIQIIQQ8s")
BLOCK_BYTES = 1 << 18
BLOOM_BITS, BLOOM_HASHES = 10, 7
END_ID = 2


def key_of(doc_id: int | None) -> bytes:
    """Bytes in the order of the numbers, null first."""
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


def bloom_places(key: bytes, bits: int, hashes: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.adler32(key) | 1
    a, b = zlib.crc32(struct.pack("<I", a)), zlib.crc32(struct.pack("<I", b)) | 1
    return [(a + i * b) % bits for i in range(hashes)]


class Writer:
    """Writes entries, given in ascending order of keys, to an open file."""

    def __init__(self, file, codec: str = "zstd"):
        self.file, self.codec, self.at = file, pa.Codec(codec), 0
        self.index, self.keys, self.tokens = [], [], 0
        self._new_block()

    def _new_block(self):
        self.block, self.first, self.last = bytearray(), None, b""

    def add(self, key: bytes, ids: bytes) -> None:
        if self.first is None:
            self.first = key
        shared = 0
        while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
            shared += 1
        n = len(ids) // 4
        self.block += varint(shared) + varint(len(key) - shared) + varint(n) + key[shared:] + ids
        self.last, self.tokens = key, self.tokens + n
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.first is not None:
            packed = self.codec.compress(bytes(self.block), asbytes=True)
            self.file.write(packed)
            self.index.append(struct.pack("<I", len(self.first)) + self.first + struct.pack("<QII", self.at, len(packed), len(self.block)))
            self.at += len(packed)
        self._new_block()

    def close(self) -> None:
        self._flush()
        size = max(64, BLOOM_BITS * len(self.keys))
        bits = bytearray((size + 7) // 8)
        for key in self.keys:
            for p in bloom_places(key, 8 * len(bits), BLOOM_HASHES):
                bits[p >> 3] |= 1 << (p & 7)
        index = b"".join(self.index)
        self.file.write(index + bytes(bits) + FOOTER.pack(self.at, len(self.index), self.at + len(index), len(bits), BLOOM_HASHES, len(self.keys), self.tokens, MAGIC))


class Reader:
    """Reads a shard by its places: footer, index and Bloom bits are held, blocks are read one at a time."""

    def __init__(self, file, codec: str = "zstd"):
        self.file, self.codec = file, pa.Codec(codec)
        size = file.size()
        at, blocks, bloom_at, bloom_bytes, self.hashes, self.entries, self.tokens, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        self.bloom = self._read(bloom_at, bloom_bytes)
        index, p, self.first, self.places = self._read(at, bloom_at - at), 0, [], []
        for _ in range(blocks):
            (n,) = struct.unpack_from("<I", index, p)
            self.first.append(index[p + 4 : p + 4 + n])
            self.places.append(struct.unpack_from("<QII", index, p + 4 + n))
            p += 20 + n

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        at, stored, unpacked = self.places[k]
        data, p, key = self.codec.decompress(self._read(at, stored), unpacked, asbytes=True), 0, b""
        while p < len(data):
            shared, p = read_varint(data, p)
            rest, p = read_varint(data, p)
            n, p = read_varint(data, p)
            key = key[:shared] + data[p : p + rest]
            p += rest
            yield key, data[p : p + 4 * n]
            p += 4 * n

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.places)):
            yield from self.block(k)

    def get(self, key: bytes) -> list[bytes]:
        """The ids of all entries with this key, which may repeat and run over blocks."""
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in bloom_places(key, 8 * len(self.bloom), self.hashes)):
            return []
        found = []
        for k in range(max(0, bisect.bisect_left(self.first, key) - 1), bisect.bisect_right(self.first, key)):
            found += [ids for own, ids in self.block(k) if own == key]
        return found


def filesystem(uri: str):
    """pyarrow's file system of a folder in the shared store, and the path there."""
    from pyarrow.fs import FileSystem

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return FileSystem.from_uri(uri)


def write_shards(docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """docs (doc_id, text, ...) to shards in folder; returns one row per shard: shard, path, docs, tokens.

    Ranges of doc_id are dealt to tasks, each writes one shard under a name of its own and moves it to its place when it is
    whole, so a repeated task leaves the same file. A null text is an empty one, its only token the end id; a null doc_id
    comes first; rows with an equal doc_id are ordered by text. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    end = struct.pack("<I", END_ID)
    ddl = "shard int, path string, docs long, tokens long"
    out = pa_schema(docs.sparkSession, ddl)

    def write(batches):
        part, encode, writer = TaskContext.get().partitionId(), encoder(tokenizer).encode, None
        fs, root = filesystem(folder)
        path, own = f"{root}/shard-{part:06d}.sst", f"{root}/.shard-{part:06d}-{TaskContext.get().taskAttemptId()}"
        for batch in batches:
            if batch.num_rows and writer is None:
                fs.create_dir(root, recursive=True)
                file = fs.open_output_stream(own)
                writer = Writer(file)
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                writer.add(key_of(doc), ids + end)
        if writer is not None:
            writer.close()
            file.close()
            fs.move(own, path)
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((part, path.removeprefix(root + "/"), len(writer.keys), writer.tokens), out, strict=True)], schema=out)

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id")
    return stage(ordered.sortWithinPartitions("doc_id", "text").mapInArrow(write, ddl), "sstable-manifest")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """The digest of every document in the shards: doc_id, start, n_tokens, ids_crc32; start counts over all shards."""
    # one row for each shard, so this window stays small: a shard holds a whole partition
    placed = manifest.withColumn("base", F.sum("tokens").over(Window.orderBy("shard")) - F.col("tokens")).select("shard", "path", "base")
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long"
    out = pa_schema(manifest.sparkSession, ddl)

    def read(batches):
        fs, root = filesystem(folder)
        for batch in batches:
            for path, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{path}") as file:
                    reader = Reader(file)
                    for k in range(len(reader.places)):
                        rows = []
                        for key, ids in reader.block(k):
                            rows.append((id_of(key), at, len(ids) // 4, zlib.crc32(ids)))
                            at += len(ids) // 4
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    # a row stands for a whole shard, so the number of tasks is given: by size alone these rows would all go to one
    places = stage(placed, "sstable-places")
    return places.repartition(max(1, places.count()), "shard").mapInArrow(read, ddl)


def lookup(spark: SparkSession, folder: str, manifest: DataFrame, doc_ids: list[int]) -> DataFrame:
    """The ids of a few documents: every shard's Bloom filter and index are asked, and only hit blocks are read."""
    keys, ddl = [(i, key_of(i)) for i in doc_ids], "doc_id long, ids binary"
    out = pa_schema(spark, ddl)

    def ask(batches):
        fs, root = filesystem(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_file(f"{root}/{path}") as file:
                    reader = Reader(file)
                    hits = [(i, ids) for i, key in keys for ids in reader.get(key)]
                yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in hits], f.type) for k, f in enumerate(out)], schema=out)

    return manifest.select("path").mapInArrow(ask, ddl)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "shards")
    manifest = write_shards(table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"))
    return read_shards(manifest, folder)
