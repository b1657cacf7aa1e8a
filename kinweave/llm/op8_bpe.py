"""Byte-level BPE with a hierarchical-bitmap rank queue.

A pre-token is a linked list of parts. Each adjacent pair whose bytes are in the vocabulary waits in the bucket of its
rank, which holds list positions. A bitmap over all ranks, in two levels of words, marks buckets that are not empty; the
next rank is found by find-first-set from the top level down. A bucket entry whose pair has changed meanwhile is stale
and skipped. The cost of a merge does not depend on the length of the pre-token, which suits very long ones.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import held, map_batches, table, tokenizer_path

#: Pre-tokens in one generation of the cache; it holds two. Longer ones, which may be whole texts, are not held.
CACHE, HELD_CHARS = 500_000, 64
#: Bits of a rank that a level of the bitmap resolves; two levels hold 2^18 ranks.
LEVEL = 9
LOW = (1 << LEVEL) - 1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token; the lowest rank first and, within a rank, the lowest position.

    A part is named by where it begins; the queue is held in locals, as most pre-tokens are short.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, find = len(piece), ranks.get
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # end: 0 where no part begins any more
    top, words, buckets = 0, {}, {}
    fresh = [(i, i + 2) for i in range(n - 1)]
    while True:
        for i, k in fresh:
            rank = find(piece[i:k])
            if rank is None:
                continue
            bucket = buckets.get(rank)
            if bucket:
                heappush(bucket, i)
                continue
            buckets[rank] = [i]
            high = rank >> LEVEL
            words[high] = words.get(high, 0) | 1 << (rank & LOW)
            top |= 1 << high
        if not top:
            break
        high = (top & -top).bit_length() - 1
        word = words[high]
        rank = high << LEVEL | (word & -word).bit_length() - 1
        bucket, fresh = buckets[rank], ()
        i = heappop(bucket)
        if not bucket:
            words[high] = word = word & word - 1
            if not word:
                top &= top - 1
        j = end[i]
        if not j or j >= n or find(piece[i : end[j]]) != rank:
            continue  # stale
        end[i], end[j] = end[j], 0
        k = end[i]
        h = before[i]
        if k < n:
            before[k] = i
            fresh = ((i, end[k]), (h, k)) if h >= 0 else ((i, end[k]),)
        elif h >= 0:
            fresh = ((h, k),)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


class Cache(dict):
    """Ids of pre-tokens. When a generation is full it becomes the old one, from which pre-tokens still in use come back."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.old = ranks, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = array("I", merge(piece.encode(), self.ranks)).tobytes()
        if len(piece) <= HELD_CHARS:
            self[piece] = ids
        return ids

    def turn(self) -> None:
        if len(self) > CACHE:
            self.old = dict(self)
            self.clear()


class Codec:
    """Encodes and decodes texts by a rank file; ids of pre-tokens are cached, up to a bound."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = load_ranks(path)
        if max(self.ranks.values()) >= 1 << 2 * LEVEL:
            raise ValueError("more ranks than the bitmap holds")
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.split, self.cache = regex.compile(pattern).findall, Cache(self.ranks)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes."""
        if not text:
            return b""
        self.cache.turn()
        return b"".join(map(self.cache.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids)))


def codec(path: str, pattern: str) -> Codec:
    return held(("codec", path, pattern), lambda: Codec(path, pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) to doc_id, n_tokens, ids_sha256, decoded_sha256, and ids (binary) if asked for.

    A null text is an empty one, without tokens. Special tokens in a text are ordinary text. One row for every input row,
    repeated ones too; other columns are not read. An empty table gives no rows. Nothing is shuffled.
    """

    def each(batch: pa.RecordBatch) -> dict:
        own = codec(path, pattern)
        ids = [own.encode(t) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids], "decoded_sha256": [hashlib.sha256(own.decode(x)).hexdigest() for x in ids]} | ({"ids": ids} if with_ids else {})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), each, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
