"""Token-id files: a concatenated id array with Elias-Fano document boundaries.

A store is a Parquet folder of blocks, so that Spark's commit protocol and
any Hadoop store work; each block's ``payload`` is one binary in this format
(integers little-endian):

    magic "TWTB", u8 id width (2 or 4), u32 documents d, u64 ids n,
    u32 null doc_ids, i64 first doc_id, then three length-prefixed (u32)
    sections: Elias-Fano of the d+1 boundaries, Elias-Fano of the doc_ids
    less the first one, and the n ids.

Elias-Fano section: u32 count, u8 low bits l, u32 bytes of the low part, the
low parts, u32 bytes of the high part, the unary high part, and for select
the u32 bit position of every 64th set bit.  That is about 2 + log2(n / d)
bits a boundary, and offsets come from select, not from 64-bit tables.

Shards are ranges of doc_id, in order; a block belongs to one shard and
records the ids before it there.  Rows: null text counts as empty (its ids
are the end id alone); null doc_ids come first; rows that repeat a doc_id
follow each other in the order of a hash of their texts; an empty table gives an empty
store; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import Scratch, only, small_batches

BLOCK = "shard int, block int, before long, n_docs int, n_ids long, payload binary"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"
EVERY = 64
ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)
PLACE = np.array([([b for b in range(8) if i >> b & 1] + [0] * 8)[:8] for i in range(256)], np.int64)  # of the k-th set bit of a byte


class EliasFano:
    """A non-decreasing sequence of integers from 0 on."""

    def __init__(self, count: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.count, self.low_bits, self.low, self.high, self.samples = count, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.packbits(((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        at = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        unary[at] = 1
        return cls(n, bits, low, np.packbits(unary, bitorder="little"), at[::EVERY].astype(np.uint32))

    def select(self, i: np.ndarray) -> np.ndarray:
        """The i-th values: each from the nearest sample on, byte by byte, all of them in step."""
        i = np.asarray(i, np.int64)
        at = self.samples[i // EVERY].astype(np.int64)
        byte, left = at >> 3, i % EVERY
        left = left + ONES[self.high[byte] & ((1 << (at & 7)) - 1).astype(np.uint8)]  # the set bits before the sample in its byte
        open_ = np.arange(len(i))
        while len(open_ := open_[left[open_] >= ONES[self.high[byte[open_]]]]):
            left[open_] -= ONES[self.high[byte[open_]]]
            byte[open_] += 1
        high = (byte << 3) + PLACE[self.high[byte], left] - i
        low = np.zeros(len(i), np.int64)
        for b in range(self.low_bits):
            p = i * self.low_bits + b
            low |= (self.low[p >> 3].astype(np.int64) >> (p & 7) & 1) << b
        return high << self.low_bits | low

    def dumps(self) -> bytes:
        low, high = self.low.tobytes(), self.high.tobytes()
        return struct.pack("<IBI", self.count, self.low_bits, len(low)) + low + struct.pack("<I", len(high)) + high + self.samples.astype("<u4").tobytes()

    @classmethod
    def loads(cls, data: bytes) -> EliasFano:
        count, bits, n = struct.unpack_from("<IBI", data)
        low = np.frombuffer(data, np.uint8, n, 9)
        (m,) = struct.unpack_from("<I", data, 9 + n)
        high = np.frombuffer(data, np.uint8, m, 13 + n)
        return cls(count, bits, low, high, np.frombuffer(data, "<u4", -1, 13 + n + m))


def dump_block(doc_ids: list, ids: list[bytes], width: int) -> bytes:
    """A block's payload; ids: each document's as little-endian u32 bytes."""
    nulls = sum(x is None for x in doc_ids)
    known = np.array([x for x in doc_ids if x is not None], np.int64)
    first = int(known[0]) if len(known) else 0
    bounds = np.concatenate([[0], np.cumsum([len(b) // 4 for b in ids])])
    flat = np.frombuffer(b"".join(ids), "<u4")
    parts = [EliasFano.of(bounds).dumps(), EliasFano.of((known - first).astype(np.uint64)).dumps(), flat.astype(f"<u{width}").tobytes()]
    head = b"TWTB" + struct.pack("<BIQIq", width, len(ids), len(flat), nulls, first)
    return head + b"".join(struct.pack("<I", len(p)) + p for p in parts)


class Block:
    """A payload read back."""

    def __init__(self, data: bytes):
        if data[:4] != b"TWTB":
            raise ValueError("not a token block")
        width, self.n_docs, self.n_ids, nulls, first = struct.unpack_from("<BIQIq", data, 4)
        at, parts = 4 + struct.calcsize("<BIQIq"), []
        for _ in range(3):
            (n,) = struct.unpack_from("<I", data, at)
            parts.append(data[at + 4 : at + 4 + n])
            at += 4 + n
        self.bounds = EliasFano.loads(parts[0])
        self.nulls, self.first, self.names = nulls, first, EliasFano.loads(parts[1])
        self.ids = np.frombuffer(parts[2], f"<u{width}")

    def documents(self, step: int = 1 << 14):
        """(doc_ids, offsets) of some documents at a time, with one more offset, by select."""
        for a in range(0, self.n_docs, step):
            b = min(a + step, self.n_docs)
            known = np.arange(max(a - self.nulls, 0), max(b - self.nulls, 0))
            names = self.names.select(known) + self.first if len(known) else known
            yield [None] * (b - a - len(known)) + names.tolist(), self.bounds.select(np.arange(a, b + 1))

    def document(self, i: int) -> np.ndarray:
        a, b = self.bounds.select(np.array([i, i + 1])).tolist()
        return self.ids[a:b]


def _writer(path: str, end_id: int, block_ids: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        names, held, size = [], [], 0

        def flush():
            nonlocal block, before, names, held, size
            enc = tokens.encoder(path)
            width = 2 if max(enc.library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
            row = [[shard], [block], [before], [len(held)], [size], [dump_block(names, held, width)]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types)], [c.split()[0] for c in BLOCK.split(", ")])
            block, before = block + 1, before + size
            names, held, size = [], [], 0
            return out

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for first, part in tokens.in_parts(texts):
                for i, enc in enumerate(tokens.encoder(path).encode(part), first):
                    names.append(ids[i])
                    held.append(enc + end)
                    size += len(held[-1]) // 4
                    if size >= block_ids:
                        yield flush()
        if held:
            yield flush()

    return run


def write(docs: DataFrame, path: str, *, tokenizer: str | None = None, end_id: int = 0, shards: int | None = None, block_ids: int = 1 << 20) -> None:
    """Write a store of all documents in ascending doc_id order.

    The texts are dealt out by ranges of doc_id, then encoded, so that
    sampling the ranges does not encode anything.  Rows that repeat a doc_id,
    or have none, are told apart by a hash of their text, so that many of them
    take several ranges.  shards: how many ranges; unset, one for each 200,000
    documents and the session's shuffle partitions at least.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    rows = only(docs, "doc_id", "text").withColumn("h", F.xxhash64("text"))
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // 200_000))
    dealt = rows.repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    dealt.mapInArrow(_writer(tokenizer or tokens.default_path(), end_id, block_ids), BLOCK).write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a store (see RESULT), from the files alone."""
    blocks = spark.read.schema(BLOCK).parquet(path)
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()  # a row per shard
    base, total = {}, 0
    for r in sizes:
        base[r["shard"]], total = total, total + r["n"]

    def run(batches):
        for batch in batches:
            for shard, before, payload in zip(*(batch.column(k).to_pylist() for k in range(3))):
                b = Block(payload)
                for names, bounds in b.documents():
                    crc = [zlib.crc32(b.ids[x:y].astype("<u4").tobytes()) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names, pa.int64()), pa.array(bounds[:-1] + before + base[shard]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return blocks.select("shard", "before", "payload").mapInArrow(run, RESULT)


def store_and_index(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Write a store to the shared folder and read its documents back."""
    scratch = Scratch(docs.sparkSession, "tokenbin")
    write(docs, scratch.path("store"), tokenizer=tokenizer, end_id=end_id)
    return read(docs.sparkSession, scratch.path("store"))
