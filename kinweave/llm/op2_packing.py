"""Packing by power-of-two decomposition.

A document of n tokens is cut into whole sequences of the longest length and, for the rest, one piece for each set bit of
its length. Every piece is a sequence of its own, so no sequence crosses documents and none needs padding; sequences of
an equal length form a bucket, and batches are drawn from one bucket at a time.
"""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import pa_schema, small_batches, table, tokenizer_path
from .wordpiece import encoder

END_ID = 2
#: Bits of a sequence_id for the task and for the piece within it; the bits above hold the power of two.
TASK_BITS, SLOT_BITS = 24, 33


def pieces_of(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: longest first, then the set bits of the rest, high to low."""
    out, at = [], 0
    while at < n:
        size = min(longest, 1 << ((n - at).bit_length() - 1))
        out.append((at, size))
        at += size
    return out


def pack(docs: DataFrame, tokenizer: str, longest: int = 4096, with_ids: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) to one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    and ids (little-endian unsigned 32-bit) if asked for.

    longest is a power of two. A null text is an empty one: its only token is the end id. Repeated rows are packed
    each for itself. Other columns are not read. An empty table gives no rows. sequence_id is unique and orders sequences by bucket,
    shortest first: it holds the power of two, the task and the place among the task's pieces of that length. So nothing is shuffled
    or counted first, and a task that runs again gives the same ids.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    spark = docs.sparkSession
    small_batches(spark)
    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    out = pa_schema(spark, ddl)
    end = struct.pack("<I", END_ID)

    def cut(batches):
        task, slots, encode = TaskContext.get().partitionId() << SLOT_BITS, [0] * 64, encoder(tokenizer).encode
        for batch in batches:
            rows = {f.name: [] for f in out}
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                for start, size in pieces_of(len(ids) // 4, longest):
                    own, bucket = ids[4 * start : 4 * (start + size)], size.bit_length() - 1
                    values = (doc, start, size, zlib.crc32(own), len(ids) // 4, bucket << TASK_BITS + SLOT_BITS | task | slots[bucket], 0, own)
                    for column, v in zip(rows.values(), values, strict=False):
                        column.append(v)
                    slots[bucket] += 1
            yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in out], schema=out)

    return docs.select("doc_id", "text").mapInArrow(cut, ddl)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
