"""Operator 1: token ids in directly addressable codes.

An id is cut into chunks of 8 bits, lowest first. Level j holds the j-th chunk of every id that has one, and a
bitmap that says which of them go on in the next level; a directory of ranks (ones before each block of 512
bits) leads from a place in level j to the place in level j + 1. Any id is read in as many steps as it has
levels, without decoding others.

The file format is Parquet, one row for each segment of about 2**18 ids: shard, segment, first (ids of the
shard before it), documents with their sizes, and the levels, bitmaps and directories as binary columns,
stored uncompressed. Spark's committer writes it, so lost tasks leave nothing behind and any file system
that Spark knows will do.

Defined results: a null or empty text is a document of the end id alone; a null doc_id sorts first; rows that
share a doc_id stand next to each other, ordered by a hash of the text; an empty table gives no files' rows and no
result; further columns of the input are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir, table
from .tokens import encoder, pieces_of, word_vocabulary

BLOCK = 512
FORMAT = "shard int, segment int, first long, n_tokens long, doc_ids array<bigint>, sizes array<bigint>, levels array<binary>, bitmaps array<binary>, ranks array<binary>"
_SCHEMA = pa.schema(
    [("shard", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))]
    + [(x, pa.list_(pa.binary())) for x in ("levels", "bitmaps", "ranks")]
)


def encode(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Levels, bitmaps and rank directories of 32-bit ids."""
    levels, bitmaps, ranks = [], [], []
    rest = np.asarray(ids, np.uint32)
    while True:
        levels.append(rest.astype(np.uint8).tobytes())
        rest = rest >> np.uint32(8)
        more = rest > 0
        packed = np.packbits(more, bitorder="little")
        bitmaps.append(packed.tobytes())
        ones = np.bitwise_count(np.pad(packed, (0, -len(packed) % (BLOCK // 8))).reshape(-1, BLOCK // 8)).sum(1, dtype=np.uint32)
        ranks.append((np.cumsum(ones, dtype=np.uint32) - ones).tobytes())
        rest = rest[more]
        if not len(rest):
            return levels, bitmaps, ranks


class Codes:
    """Random access to encoded ids."""

    def __init__(self, levels: list[bytes], bitmaps: list[bytes], ranks: list[bytes]):
        self.levels = [np.frombuffer(x, np.uint8) for x in levels]
        self.bitmaps = [np.frombuffer(x, np.uint8) for x in bitmaps]
        self.ranks = [np.frombuffer(x, np.uint32) for x in ranks]

    def __len__(self) -> int:
        return len(self.levels[0])

    def _rank(self, level: int, i: int) -> int:
        """Ones of a level's bitmap before place i: the directory's entry and part of one block."""
        block = i // BLOCK
        if block >= len(self.ranks[level]):
            block = len(self.ranks[level]) - 1
        if block < 0:
            return 0
        part = self.bitmaps[level][block * BLOCK // 8 : i // 8]
        left = int(self.bitmaps[level][i // 8]) & ((1 << i % 8) - 1) if i % 8 else 0
        return int(self.ranks[level][block]) + int(np.bitwise_count(part).sum()) + left.bit_count()

    def __getitem__(self, i: int) -> int:
        value, level = 0, 0
        while True:
            value |= int(self.levels[level][i]) << 8 * level
            if not self.bitmaps[level][i // 8] >> i % 8 & 1:
                return value
            i, level = self._rank(level, i), level + 1

    def extract(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop (exclusive)."""
        out = np.zeros(max(0, stop - start), np.uint32)
        where = slice(None)
        for level in range(len(self.levels)):
            if stop <= start:
                break
            part = self.levels[level][start:stop].astype(np.uint32)
            out[where] |= part << np.uint32(8 * level)
            bits = np.unpackbits(self.bitmaps[level][start // 8 : (stop + 7) // 8], bitorder="little")[start % 8 :][: stop - start]
            on = np.flatnonzero(bits)
            where = on if isinstance(where, slice) else where[on]
            start = self._rank(level, start)
            stop = start + len(on)
        return out


def _segments(path: str, end_id: int, target: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encode_texts = TaskContext.get().partitionId(), encoder(path)
        segment, first, docs, sizes, held, n = 0, 0, [], [], [], 0

        def out():
            levels, bitmaps, ranks = encode(np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((shard, segment, first, n, docs, sizes, levels, bitmaps, ranks), _SCHEMA, strict=True)], schema=_SCHEMA)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, some in pieces_of(texts):
                for doc, tokens in zip(ids[at:], encode_texts(some), strict=False):
                    docs.append(doc)
                    sizes.append(len(tokens) + 1)
                    held.append(np.append(tokens, np.uint32(end_id)))
                    n += len(tokens) + 1
                    if n >= target:
                        yield out()
                        segment, first, docs, sizes, held, n = segment + 1, first + n, [], [], [], 0
        if docs:
            yield out()

    return run


def write_ids(documents: DataFrame, folder: str, vocabulary: str, end_id: int = 1, target: int = 1 << 18) -> None:
    """Encode documents (doc_id, text) and write the format above, shards and segments in ascending doc_id order."""
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The hash splits a doc_id that very many rows share.
    order = [F.asc_nulls_first("doc_id"), "hash", "text"]
    ordered = documents.select("doc_id", "text", F.xxhash64("text").alias("hash")).repartitionByRange(n, *order[:2]).sortWithinPartitions(*order).select("doc_id", "text")
    ordered.mapInArrow(_segments(vocabulary, end_id, target), FORMAT).write.option("compression", "uncompressed").parquet(folder)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
            ids = Codes(row["levels"], row["bitmaps"], row["ranks"]).extract(0, row["n_tokens"])
            stop = np.cumsum(row["sizes"])
            start = stop - row["sizes"]
            crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(start, stop, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array([row["shard"]] * len(crc), pa.int32()), pa.array(start + row["first"], pa.int64()), pa.array(row["sizes"], pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "shard", "inner", "n_tokens", "ids_crc32"],
            )


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files. Only one count per shard is put in order."""
    files = spark.read.schema(FORMAT).parquet(folder)
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    found = files.mapInArrow(_documents, "doc_id long, shard int, inner long, n_tokens long, ids_crc32 long")
    return found.join(before, "shard").select("doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/codes-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), folder, word_vocabulary())
    return read_documents(spark, folder)
