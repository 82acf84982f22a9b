"""What the training-data operators share: scratch tables and connected components.

Scratch tables are Parquet below ``spark.checkpoint.dir``, which driver and
executors share; they cut lineage, so a lost executor costs only its own
tasks.  A scratch table lives until its ``Scratch`` drops it or the session
ends.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LEFT: list = []
_OWN: list[str] = []
SLOTS = 1 << 27  # bits of a membership bitmap at most: 16 MB


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Unset, a local session, whose driver is its only machine, gets a folder of
    its own; on a cluster that folder would be out of reach, so it is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix=f"trackweave-{os.getpid()}-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return _OWN[0]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def _at_exit() -> None:
    for spark, path in _LEFT:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone already; the folder is scratch
            return


atexit.register(_at_exit)


_KEPT: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What a Python worker keeps from task to task for one operator.

    Spark uses a worker again for other operators' tasks; a cache goes when
    such a task begins, so that their memory does not add up.
    """
    if owner not in _KEPT:
        _KEPT.clear()
        _KEPT[owner] = {}
        trim()
    return _KEPT[owner]


def trim() -> None:
    """Gives back what the allocators of a Python worker hold of freed memory.

    A worker outlives its tasks and would keep it beside the next one's peak.
    """
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if give_back:
        give_back(0)


def trimmed(batches):
    """The batches of a task; memory is trimmed when they end."""
    yield from batches
    trim()


class Scratch:
    """Named Parquet tables of one operator call."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
        _LEFT.append((spark, self.root))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return the written table."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, self.path(name))


def release(spark: SparkSession) -> None:
    """Lets Spark free the broadcasts and shuffle files of plans whose results are written.

    It does so when the driver no longer holds the plans, which it only finds
    out by collecting garbage; until then executors keep them.
    """
    gc.collect()
    spark._jvm.System.gc()


BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": f"{16 << 20}b"}


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1000 rows and some 16 MB: whole texts go to Python in bounded pieces.

    A query reads the setting when it runs, which is after its plan was
    returned, so it stays set; a stricter one is left alone.
    """
    for key, most in BATCH.items():
        now = spark.conf.get(key, most).rstrip("b")
        if not now.isdigit() or not 0 < int(now) < int(most.rstrip("b")):
            spark.conf.set(key, most)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns by exact name and first place, whatever else clashes with them."""
    at = [df.columns.index(n) for n in names]
    if len({c.lower() for c in df.columns}) == len(df.columns):
        return df.select(*[F.col(f"`{n}`") for n in names])
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_{i}").alias(n) for i, n in zip(at, names)])


def plain(df: DataFrame) -> DataFrame:
    """df with the column names _0, _1 and so on: whatever names its user chose, ours cannot clash with them."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def hits(rows: DataFrame, key: Column, ids: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """rows with a boolean ``hit``: false only if the hash ``key`` is none of the longs in ``ids`` (h).

    Rows that miss need no shuffle to be told from those of ids.  The bitmap
    has 32 bits for each id and SLOTS at most; a fuller one only lets more
    rows pass.  A null key is no hit.
    """
    slots = 1 << min(max(32 * ids.count(), 1 << 15).bit_length(), SLOTS.bit_length() - 1)
    slot = F.pmod(ids["h"], F.lit(slots))
    bits = ids.select((F.floor(slot / 32768)).alias("slice"), (slot % 32768).alias("at"))
    bits = scratch.keep(bits.groupBy("slice").agg(F.bitmap_construct_agg("at").alias("bits")), name)  # 4096 rows of 4 kB at most
    asked = rows.withColumn("slot", F.pmod(key, F.lit(slots)))
    met = asked.join(F.broadcast(bits), F.floor(F.col("slot") / 32768) == F.col("slice"), "left")
    byte = F.conv(F.hex(F.expr("substring(bits, int((slot % 32768) div 8) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.expr("shiftright(byte, int(slot % 8)) & 1 = 1"), F.lit(False))
    return met.withColumn("byte", byte).withColumn("hit", hit).select(*rows.columns, "hit")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs, all columns and whatever their names, less the rows whose doc_id is in gone.

    Rows without doc_id stay; repeated ones go together.  Only rows that may
    be gone are shuffled.
    """
    scratch = Scratch(docs.sparkSession, "without")
    ids = scratch.keep(gone.select(F.col("doc_id").alias("gone")).where("gone IS NOT NULL").distinct(), "gone")
    own = F.col(f"_{docs.columns.index('doc_id')}")
    asked = hits(plain(docs), F.when(own.isNotNull(), F.xxhash64(own.cast("long"))), ids.select(F.xxhash64(F.col("gone").cast("long")).alias("h")), scratch, "bits")
    left = asked.where("hit").join(ids, own == F.col("gone"), "left_anti")
    return asked.where("NOT hit").union(left).drop("hit").toDF(*docs.columns)


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each index reaches by links (a, b), given those it reached before."""
    root = root.copy()
    while True:  # hook the larger root to the smaller one, then jump pointers
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        if (low == high).all():
            return root
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _contract(batches):
    """Links of one partition as a star forest (node, smallest node reached)."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    pdf = pd.concat(parts)
    nodes, flat = np.unique(np.concatenate([pdf["u"].to_numpy(), pdf["v"].to_numpy()]), return_inverse=True)
    half = len(pdf)
    root = joined(np.arange(len(nodes)), flat[:half], flat[half:])
    moved = root != np.arange(len(nodes))
    yield pd.DataFrame({"u": nodes[moved], "v": nodes[root[moved]]})


def components(links: DataFrame, scratch: Scratch, most: int = 60) -> DataFrame:
    """Connected components of links (u, v) of longs: rows (node, root).

    root is the smallest node reachable; nodes without links are absent.  Each
    partition first contracts its own links to a star forest, then large-star
    and small-star steps alternate until nothing changes.  Minima are
    aggregated before they are joined, and both sides of each join are plain
    exchanges over written tables, so that skewed nodes are split.
    """
    schema = "u long, v long"
    edges = scratch.keep(
        links.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").mapInPandas(_contract, schema), "star-0"
    )
    last = None
    for step in range(1, most + 1):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = small.select("e.u", "e.v").where("u <> v").distinct()
        edges = scratch.keep(small, f"star-{step}")
        now = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        scratch.drop(f"star-{step - 1}")
        if tuple(now) == last:
            break
        last = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {most} steps")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
