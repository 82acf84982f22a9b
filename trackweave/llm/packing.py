"""Best-fit packing of documents into sequences: minimum bin slack.

The plan depends only on how many pieces there are of each length, at most
``capacity`` counts.  For each bin a bitset subset-sum dynamic programme over
the available lengths finds the fullest feasible combination; it is then
removed, as many times over as the counts allow, so the number of programmes
grows with the number of lengths and not with the corpus.  Pieces take their
places by their rank among the pieces of their length: ranks are counted
within tasks, and only the counts of each task and length meet.

Rows: null text counts as empty; a document without ids still has its end
id.  Repeated rows and repeated doc_id values are packed row by row; a null
doc_id is carried through.  An empty table gives no rows.  Other columns are
ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import Scratch, only, small_batches, trimmed

PART = 2_000_000  # characters that are encoded at once
MEMO = 1_000_000  # chunks whose ids a worker keeps
LEAN = 4  # part of both that is left where packing follows stages that left an executor little memory
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long"
RESULT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def fullest(counts: np.ndarray, capacity: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to capacity.

    Holds length -> how many.  The largest available length always takes part,
    so that long pieces are placed while short ones remain to fill up.  Bit s
    of reach says that sum s can be made; kept copies lead back.
    """
    lengths = np.nonzero(counts)[0][::-1]
    lead = int(lengths[0])
    room = capacity - lead
    mask = (1 << (room + 1)) - 1
    reach, trail = 1, []
    for length in map(int, lengths):
        spare = int(counts[length]) - (length == lead)
        most = min(spare, room // length)
        if not most:
            continue
        trail.append((length, reach, most))
        left, part = most, 1  # binary splitting of the multiplicity
        while left:
            take = min(part, left)
            reach |= (reach << (take * length)) & mask
            left, part = left - take, part * 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    used = {lead: 1}
    for length, before, most in reversed(trail):
        k = 0
        while not before >> total & 1:
            total, k = total - length, k + 1
            assert k <= most
        if k:
            used[length] = used.get(length, 0) + k
    return used


def plan(counts: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """Which ranks of each length go where; rows sorted by (length, rank).

    Row: ranks from ``rank`` on of ``length`` fill ``each`` places in every
    sequence from ``sequence`` on, the first at ``place``.
    """
    counts = counts.astype(np.int64).copy()
    given = np.zeros_like(counts)
    rows, sequence = [], 0
    while counts.any():
        used = fullest(counts, capacity)
        times = min(int(counts[n]) // k for n, k in used.items())
        place = 0
        for n, k in used.items():
            rows.append((n, int(given[n]), k, sequence, place))
            given[n] += k * times
            counts[n] -= k * times
            place += n * k
        sequence += times
    rows.sort()
    cols = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "each", "sequence", "place"), cols))


def _cutter(path: str, capacity: int, end_id: int, share: int):
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in trimmed(batches):
            ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for first, part in tokens.in_parts(texts, PART // share):
                out: list[tuple] = []
                for i, enc in enumerate(tokens.encoder(path, MEMO // share).encode(part), first):
                    data = enc + end
                    n = len(data) // 4
                    head = n % capacity or capacity
                    at, piece = 0, 0
                    while at < n:
                        size = head if piece == 0 else capacity
                        out.append((ids[i], piece, at, size, zlib.crc32(data[4 * at : 4 * (at + size)]), task, int(seen[size])))
                        seen[size] += 1
                        at, piece = at + size, piece + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int32()] + [pa.int64()] * 5)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"],
                )

    return cut


def _placer(table: dict[str, np.ndarray], capacity: int):
    key = table["length"] << 44 | table["rank"]  # ranks of a length stay far below 2^44

    def place(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            length, rank = pdf["length"].to_numpy(), pdf.pop("before").to_numpy() + pdf.pop("nth").to_numpy()
            row = np.searchsorted(key, length << 44 | rank, side="right") - 1
            nth = rank - table["rank"][row]
            pdf["sequence_id"] = table["sequence"][row] + nth // table["each"][row]
            pdf["offset"] = table["place"][row] + nth % table["each"][row] * length
            yield pdf

    return place


def pack(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = 1024, end_id: int = 2, lean: bool = False) -> DataFrame:
    """One row per piece, with its sequence and its place there (see RESULT).

    lean: workers take less memory and more time; the rows are the same.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "packing")
    cut = only(docs, "doc_id", "text").mapInArrow(_cutter(tokenizer or tokens.default_path(), capacity, end_id, LEAN if lean else 1), PIECES)
    pieces = scratch.keep(cut, "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    by_task = scratch.keep(by_task, "counts")
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # capacity rows at most
        counts[r["length"]] = r["n"]
    w = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("task", "length", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    before = scratch.keep(before, "before")
    joined = pieces.join(before, ["task", "length"])
    joined = joined.select("doc_id", "piece", "start", "length", "ids_crc32", "nth", "before")
    return joined.mapInPandas(_placer(plan(counts, capacity), capacity), RESULT)
