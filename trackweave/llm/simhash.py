"""SimHash near-duplicates through Golay-code fuzzy hashing.

Fingerprints are 64 bits; equal ones are one class from the start.  They are
cut into segments of 23, 23 and 18 bits.  Two fingerprints that differ in at
most two bits agree in one segment at least, and each other segment is within
two bits, so its words share a codeword near both.  Keys are therefore an
exact segment with a codeword of a second one; a key that several fingerprints
share is made longer by the codewords of the third one, so that all 64 bits
take part.  What meets in a whole key is verified bit by bit, and the key
gives a spanning forest of its links, not the list of them: few fingerprints
are compared pair by pair, more of them through the words one bit away, which
any two within two bits share.  Either way the components are those of all
links, and the rows stay in proportion to the fingerprints.

Rows: null text counts as empty, which has fingerprint zero.  Repeated rows
stay, as do several rows without doc_id.  A null doc_id never becomes a component_id while another id is in the
component.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golay
from .common import Scratch, components, only, small_batches, without

FLIPS = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the shingles of a text's words, A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    begins = ends - size
    width = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(begins[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    hashes = np.array([digest(joined[a:b], seed) for a, b in spans], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16 if len(part) < 1 << 16 else None)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int, seed: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t or b"", shingle, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return run


def _segments(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = fps.view(np.uint64)
    return tuple(((v >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in ((0, 23), (23, 23), (46, 18)))


# of each family: the exact segment, the one with a codeword in the key, the one that makes the key longer
FAMILIES = ((0, 1, 2), (1, 0, 2), (2, 0, 1))


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, index of the fingerprint) of all fingerprints."""
    cut = _segments(fps)
    out, row = [], []
    for family, (exact, second, _) in enumerate(FAMILIES):
        near = golay.keys(cut[second])
        at = np.nonzero(near >= 0)
        out.append((family << 40 | cut[exact][:, None] << 12 | near)[at])
        row.append(at[0])
    return np.concatenate(out), np.concatenate(row)


def longer_keys(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys with a codeword of the third segment, index of the row)."""
    cut, family = _segments(fps), keys >> 40
    third = np.choose(family, [cut[f[2]] for f in FAMILIES])
    near = golay.keys(third)
    at = np.nonzero(near >= 0)
    return (keys[:, None] << 12 | near)[at], at[0]


def _emit_keys(batches):
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        key, row = fuzzy_keys(fps)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row])], ["key", "fp"])


def _emit_longer(batches):
    for batch in batches:
        keys, fps = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        for a in range(0, len(keys), 1 << 16):
            key, row = longer_keys(keys[a : a + (1 << 16)], fps[a : a + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[a : a + (1 << 16)][row])], ["key", "fp"])


def near_pairs(m: np.ndarray, most: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Indices of links among distinct fingerprints that span the components of all of them.

    Beyond two bits the nearest come first, and of more than 64 fingerprints only those within two bits are told.
    """
    if len(m) <= 64:
        x, y = np.triu_indices(len(m), 1)
    else:  # any two within two bits share a word one bit away; there all meet the smallest
        words = (m[:, None] ^ FLIPS).ravel()
        order = np.argsort(words, kind="stable")
        first = np.concatenate([[True], words[order][1:] != words[order][:-1]])
        who = order // 65
        x = who[np.flatnonzero(first)][np.cumsum(first) - 1]
        x, y = x[~first], who[~first]
    apart = np.bitwise_count(m[x] ^ m[y])
    ok = np.flatnonzero(apart <= most)
    if most > 2:
        ok = ok[np.argsort(apart[ok], kind="stable")]
    return x[ok], y[ok]


def spanning(m: np.ndarray, most: int = 2) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints."""
    up = list(range(len(m)))
    out = []
    for a, b in zip(*(z.tolist() for z in near_pairs(m, most))):
        ra, rb = a, b
        while up[ra] != ra:
            up[ra] = ra = up[up[ra]]
        while up[rb] != rb:
            up[rb] = rb = up[up[rb]]
        if ra != rb:
            up[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def _verify(batches, most: int = 2):
    """Links of each key; rows come sorted by key, and a key may reach over batches."""

    def of(keys: np.ndarray, fps: np.ndarray):
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.append(edge, len(keys)))
        at = edge[size == 2]  # most keys
        ok = np.bitwise_count(fps[at] ^ fps[at + 1]) <= most
        us, vs = [fps[at[ok]]], [fps[at[ok] + 1]]
        for a, n in zip(edge[size > 2].tolist(), size[size > 2].tolist()):
            if links := spanning(fps[a : a + n], most):
                x, y = np.array(links).T
                us.append(fps[a + x])
                vs.append(fps[a + y])
        u, v = (np.concatenate(z).view(np.int64) for z in (us, vs))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    held = None
    for batch in batches:
        new = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        held = new if held is None else tuple(np.concatenate(z) for z in zip(held, new))
        if len(held[0]) and held[0][0] != held[0][-1]:
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last key is not complete yet
            yield of(held[0][:cut], held[1][:cut])
            held = held[0][cut:], held[1][cut:]
    if held is not None and len(held[0]):
        yield of(*held)


def links(classes: DataFrame, scratch: Scratch, most: int = 2) -> DataFrame:
    """Links (u, v) between distinct fingerprints fp at two or fewer bits.

    They span every component of the full link graph; each is verified.  With
    a larger ``most`` they also take in what meets in a whole key and differs
    in so many bits, which is part of all such pairs only.
    """
    keyed = scratch.keep(classes.select("fp").mapInArrow(_emit_keys, "key long, fp long"), "keys")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    longer = keyed.join(shared, "key").select("key", "fp").mapInArrow(_emit_longer, "key long, fp long")
    longer = scratch.keep(longer, "longer")
    shared = longer.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    met = longer.join(shared, "key").select("key", "fp")
    return met.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(partial(_verify, most=most), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, *, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint hex, component_id) of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "simhash")
    prints = scratch.keep(only(docs, "doc_id", "text").mapInArrow(_fingerprints(shingle, seed), "doc_id long, fp long"), "prints")
    classes = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = components(links(classes, scratch), scratch)
    rooted = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = scratch.keep(rooted, "rooted")
    lowest = scratch.keep(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "lowest")
    named = scratch.keep(rooted.join(lowest, "root").select("fp", "component_id"), "named")
    scratch.drop("keys", "longer")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, *, shingle: int = 3, seed: int = 42) -> DataFrame:
    """docs with one document of each component, the smallest doc_id; all columns.

    Rows that share a doc_id go together, and only if none of them stays.
    """
    found = near_duplicates(docs, shingle=shingle, seed=seed)
    return without(docs, found.groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("gone")).where("gone"))
