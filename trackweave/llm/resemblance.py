"""Near copies by SimHash, and by the exact similarity of their word shingles.

Two documents link if the sets of their five-word shingles have a Jaccard
similarity of at least 4/5; that is decided on the whole sets, by 64-bit
hashes of the shingles.

First come SimHash fingerprints of those sets.  Equal ones meet, and others by
the Golay keys of ``simhash``; what meets in a whole key gives a forest of the
nearest, each decided on the sets.  At this similarity fingerprints differ in
ten bits of 64 on average, where keys that miss nothing do not select, so
this finds a part of the links.  The rest is found in an exact way, and goes
on from the components that fingerprints have joined.

Similar sets differ in a ninth of their sizes at most.
So all shingles are dealt to some more slots than that, by hash; sets that may
link have the same shingles in one slot at least, whatever the rest is, and
meet by a key of the slot and all that lies in it.  The number of slots goes
by a class of sizes; a set takes part in its own class and in the next one, as
its partner can be in either.  An empty slot tells nothing and has no key,
except for sets with so many of them that only empty ones may be left equal.
A passage that very many texts share is a part of many slots but hardly ever
all that lies in one, so that those texts do not meet.

Pairs that meet are first held against parity sketches, a bit or two for each
shingle: sets differ in at least as many shingles as their sketches differ in
bits, so no link is lost there.  Only what passes is decided on the sets, and
only their texts are read again.

Connected components are what matters, so where many meet in one key, members
are first checked against some leaders, and what links becomes one component.
Then members of different components are compared by their sketches, all that
meet in a key, in blocks of bounded size.  A block names no pairs, which are
many times more than its members and come again in each key they share, but a
forest of those that pass.  Its trees, over all keys, are clumps, outside of
which nothing is left to link.  All of a clump meets with its sets, again in
blocks; there each pair of different components that passes is decided until
they are joined, and a forest of what is joined is told.

Rows: texts without words are equal to each other; a text of fewer words than
a shingle is one shingle.  Repeated rows are copies.  A row without doc_id is
never the one that stays unless its component has no other.  An empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import Scratch, components, hits, joined, only, release, small_batches, trimmed, without, worker_cache

WHOLE = 4  # so many pairs for each row are checked at once
FEW = 8  # members of a key that are paired off at once
BLOCK = 4096  # members of a block; blocks of a crowded key or clump are compared pair by pair
BYTES = 1 << 24  # of the sets of a clump's block
RADIUS = 18  # bits in which fingerprints that meet by Golay keys may differ: ten on average at similarity 0.8, hardly more
NOBODY = -(1 << 63)  # stands for a null doc_id


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text, A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    w = np.fromiter(map(digest, words), np.uint64, len(words))
    k = min(width, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for j in range(k):
        h = (h ^ w[j : j + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of at least 4/5, in integers."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 9 * both >= 4 * (len(a) + len(b))


def _sets(batch):
    return [shingles(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]


def _name(h: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes())).view(np.int64))


def sketch(h: np.ndarray) -> bytes:
    """Parities of the number of shingles in each of some n to 2 n slots, 256 at least."""
    slots = 1 << max(8, (len(h) - 1).bit_length())
    return np.packbits(np.bincount((h >> np.uint64(20)).astype(np.int64) & (slots - 1), minlength=slots) & 1, bitorder="little").tobytes()


def may_be_similar(a: bytes, b: bytes, n: int) -> bool:
    """False only if sets of n shingles together with these sketches are not similar."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)  # slots go by the low bits
    return 9 * int(np.bitwise_count(x ^ y).sum()) <= n


def fingerprint(h: np.ndarray) -> int:
    """SimHash of a set of shingle hashes: a bit is 1 if set in over half of them."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def _prints(batches):
    worker_cache("shingles")
    for batch in trimmed(batches):
        sets = _sets(batch)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(map(_name, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(map(sketch, sets), pa.binary()), pa.array(map(fingerprint, sets), pa.int64())],
            ["doc_id", "cls", "size", "sketch", "fp"],
        )


def _bounds() -> list[int]:
    """First size of each class: sizes that similarity 4/5 allows lie in one class or in two that follow each other."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 5 // 4 + 1)
    return out


BOUNDS = _bounds()


def slots_of(family: int) -> tuple[int, int]:
    """(slots, shingles in which two sets may differ) for sets of the classes ``family`` and the one before."""
    differ = 2 * (BOUNDS[family + 1] - 1) // 9
    return differ + 3 + differ // 8, differ


def keys_of(h: np.ndarray) -> np.ndarray:
    """Keys by which a set of shingle hashes meets all that may be similar."""
    if not len(h):
        return np.zeros(1, np.uint64)
    own, out = bisect_right(BOUNDS, len(h)) - 1, []
    mixed = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    for family in (own, own + 1):
        slots, differ = slots_of(family)
        at = ((h >> np.uint64(11)) % np.uint64(slots)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(at[order]) > 0]))
        used, content = at[order[first]], np.add.reduceat(mixed[order], first)
        if len(used) <= differ:  # the slots that are sure to be equal may all be empty
            filled = np.zeros(slots, np.uint64)
            filled[used] = content
            used, content = np.arange(slots), filled
        key = (content ^ (content >> np.uint64(29))) + used.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((family + 1) * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1)
        out.append((key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9))
    return np.concatenate(out)


def _keyed(batches):
    """(key, cls, size) of the sets; a task tells each of them once."""
    seen: set[int] = set()
    for batch in trimmed(batches):
        new = {}
        for h in _sets(batch):
            if (name := _name(h)) not in seen and name not in new:
                new[name] = h
        seen.update(new)
        if new:
            keys = [keys_of(h) for h in new.values()]
            n = [len(k) for k in keys]
            cls, size = np.repeat(np.fromiter(new, np.int64, len(new)), n), np.repeat([len(h) for h in new.values()], n)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(cls), pa.array(size)], ["key", "cls", "size"])


def _groups(few: int):
    def of(key, cls, size):
        """(key, u, v, size): pairs of keys with few members (key null), and the members u of the others."""
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])])
        key, cls, size = key[fresh], cls[fresh], size[fresh]
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff(np.append(edge, len(key)))
        pairs = [np.zeros((0, 2), np.int64)]
        for k in range(2, few + 1):
            x, y = np.triu_indices(k, 1)
            at = edge[n == k]
            x, y = (at[:, None] + x).ravel(), (at[:, None] + y).ravel()
            ok = 5 * np.minimum(size[x], size[y]) >= 4 * np.maximum(size[x], size[y])
            pairs.append(np.sort(np.stack([cls[x[ok]], cls[y[ok]]], 1), axis=1))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        many = np.flatnonzero(np.repeat(n > few, n))
        blank = np.zeros(len(pairs), np.int64)
        columns = [np.concatenate(z) for z in ((blank, key[many]), (pairs[:, 0], cls[many]), (pairs[:, 1], 0 * many), (blank, size[many]))]
        paired = np.concatenate([np.ones(len(pairs), bool), np.zeros(len(many), bool)])
        return pa.RecordBatch.from_arrays([pa.array(paired), *map(pa.array, columns)], ["paired", "key", "u", "v", "size"])

    def run(batches):
        held = None
        for batch in trimmed(batches):
            new = tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            held = new if held is None else tuple(np.concatenate(z) for z in zip(held, new))
            if len(held[0]) and held[0][0] != held[0][-1]:  # the last key may go on
                cut = int(np.searchsorted(held[0], held[0][-1]))
                yield of(*(z[:cut] for z in held))
                held = tuple(z[cut:] for z in held)
        if held is not None and len(held[0]):
            yield of(*held)

    return run


def _named_sets(batches):
    for batch in trimmed(batches):
        sets = _sets(batch)
        yield pa.RecordBatch.from_arrays([pa.array(map(_name, sets), pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())], ["cls", "hashes"])


def _verify(batches):
    for batch in trimmed(batches):
        a, b = (batch.column(k).to_pylist() for k in (2, 3))
        ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b)]
        yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def _sketched(batches):
    for batch in trimmed(batches):
        a, b, n = (batch.column(k).to_pylist() for k in (2, 3, 4))
        yield batch.select([0, 1]).filter(pa.array(list(map(may_be_similar, a, b, n)), pa.bool_()))


def _close(a: str, b: str):
    """Sizes that similarity 4/5 allows."""
    return (5 * F.least(a, b)) >= (4 * F.greatest(a, b))


def _ends(pairs: DataFrame, values: DataFrame, names: str) -> DataFrame:
    """pairs (u, v) with the columns of values (cls, ...), named ``names`` and numbered by end."""
    for k, end in enumerate(("u", "v")):
        pairs = pairs.join(values.select(F.col("cls").alias(end), *[F.col(c).alias(f"{c}{k}") for c in names.split()]), end)
    return pairs


def _sets_of(needed: DataFrame, classes: DataFrame, texts: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(cls, hashes) of the classes needed (cls); only their texts are read again."""
    needed = scratch.keep(needed.join(classes.select("cls", F.coalesce("least", F.lit(NOBODY)).alias("id")), "cls"), f"needed-{name}")
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(NOBODY))
    rows = hits(texts, F.xxhash64(own), needed.select(F.xxhash64("id").alias("h")), scratch, f"bits-{name}").where("hit").select("doc_id", "text")
    sets = rows.mapInArrow(_named_sets, "cls long, hashes binary").join(needed.select("cls"), "cls", "left_semi")
    return scratch.keep(sets.groupBy("cls").agg(F.any_value("hashes").alias("hashes")), f"sets-{name}")


def _decided(met: DataFrame, classes: DataFrame, texts: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Those of the pairs met (u, v) that are similar, by their sketches and then by their sets."""
    told = _ends(met, classes, "sketch size").select("u", "v", "sketch0", "sketch1", (F.col("size0") + F.col("size1")).alias("n"))
    passed = scratch.keep(told.mapInArrow(_sketched, "u long, v long"), f"passed-{name}")
    sets = _sets_of(passed.select(F.col("u").alias("cls")).union(passed.select("v")).distinct(), classes, texts, scratch, name)
    return scratch.keep(_ends(passed, sets, "hashes").select("u", "v", "hashes0", "hashes1").mapInArrow(_verify, "u long, v long"), f"links-{name}")


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of one width, the smallest one; slots go by the low bits."""
    width = min(map(len, sketches))
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, width), axis=0) for x in sketches])


def _crossing(size: np.ndarray, root: np.ndarray, bits: np.ndarray, one: np.ndarray, two: np.ndarray):
    """Part by part, (p, q, bits apart) of members of one and of two whose roots differ and whose sketches may be similar."""
    for a in range(0, len(one), 256):
        i, part = one[a : a + 256], [np.zeros((3, 0), np.int64)]
        ok = (root[i][:, None] != root[two]) & (5 * np.minimum(size[i][:, None], size[two]) >= 4 * np.maximum(size[i][:, None], size[two]))
        x, y = np.nonzero(ok & (i[:, None] < two) if one is two else ok)
        for at in range(0, len(x), 1 << 16):
            p, q = i[x[at : at + (1 << 16)]], two[y[at : at + (1 << 16)]]
            apart = np.bitwise_count(bits[p] ^ bits[q]).sum(1, dtype=np.int64)
            near = 9 * apart <= size[p] + size[q]
            part.append(np.stack([p[near], q[near], apart[near]]))
        yield np.concatenate(part, axis=1)


def _block_pairs(batches, of):
    """A star forest (u, v) of what of(rows) joins in each group and pair of blocks (first three columns), by which rows come sorted."""

    def out(found):
        nodes, flat = np.unique(np.concatenate(found), return_inverse=True)
        root = joined(np.arange(len(nodes)), *flat.reshape(-1, 2).T)
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["u", "v"])

    rows, found, size = [], [], 0
    for batch in trimmed(batches):
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and r[:3] != rows[0][:3]:
                found.append(of(rows))
                rows, size = [], size + len(found[-1])
                if size > 1 << 18:
                    yield out(found)
                    found, size = [], 0
            rows.append(r)
    if rows:
        found.append(of(rows))
    if found:
        yield out(found)


def _ends_of(block: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Members of the two blocks; the same array if they are one."""
    one = np.flatnonzero(block == low)
    return one, one if low == high else np.flatnonzero(block == high)


def _clump_blocks(batches):
    """A forest (u, v) of the pairs of a key that have different roots and may be similar by their sketches."""

    def of(rows: list[tuple]) -> np.ndarray:
        block, cls, size, root = np.array([r[3:7] for r in rows], np.int64).T
        reached, bits = np.arange(len(rows)), folded([r[7] for r in rows])
        for p, q, _ in _crossing(size, root, bits, *_ends_of(block, *rows[0][1:3])):
            reached = joined(reached, p, q)
        moved = np.flatnonzero(reached != np.arange(len(rows)))
        return np.stack([cls[moved], cls[reached[moved]]], 1)

    return _block_pairs(batches, of)


def _link_blocks(batches):
    """A forest (u, v) of what the similar pairs of a clump join; all pairs of different roots are decided that may be
    similar and that no link found before joins, the nearest first."""

    def of(rows: list[tuple]) -> np.ndarray:
        block, cls, root = np.array([r[3:6] for r in rows], np.int64).T
        sets = [np.frombuffer(r[6], np.uint64) for r in rows]
        up = np.unique(root, return_inverse=True)[1].tolist()  # a root for each member, and from there on
        size, own = np.array(list(map(len, sets)), np.int64), list(up)
        up, found = list(range(max(up) + 1)), [np.zeros((0, 2), np.int64)]

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for part in _crossing(size, root, folded(list(map(sketch, sets))), *_ends_of(block, *rows[0][1:3])):
            for p, q in part[:2, np.argsort(part[2], kind="stable")].T.tolist():
                a, b = top(own[p]), top(own[q])
                if a != b and similar(sets[p], sets[q]):
                    up[max(a, b)] = min(a, b)
                    found.append(cls[[[p, q]]])
        return np.concatenate(found)

    return _block_pairs(batches, of)


def _in_blocks(members: DataFrame, group: str, *columns: str) -> DataFrame:
    """Members of groups of so many blocks, dealt by (group, low, high), in order of cls: each pair of blocks meets once."""
    here = members.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    here = here.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    here = here.select(group, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", *columns)
    return here.repartition(group, "low", "high").sortWithinPartitions(group, "low", "high", "cls")


def _between(members: DataFrame, spread: DataFrame, classes: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """A forest (u, v) of what is similar of members that meet in a key and have different roots.

    Clumps are joined by pairs that may be similar, whatever their key, so
    that each class comes with its set once and not key by key.
    """
    blocks = F.expr(f"int(ceil(n / {BLOCK}))").alias("blocks")
    here = members.join(spread.select("key", blocks), "key").join(classes.select("cls", "sketch"), "cls")
    near = _in_blocks(here, "key", "cls", "size", "root", "sketch").mapInArrow(_clump_blocks, "u long, v long").distinct()
    clumps = components(scratch.keep(near, "near"), scratch).select(F.col("node").alias("cls"), F.col("root").alias("clump"))
    clumps = scratch.keep(clumps.union(clumps.select(F.col("clump").alias("cls"), "clump")).distinct(), "clumps")
    sets = _sets_of(clumps.select("cls"), classes, texts, scratch, "clumps")
    roots = scratch.keep(members.select("cls", "root").distinct(), "roots")
    here = clumps.join(roots, "cls").join(sets, "cls")
    blocks = F.expr(f"int(greatest(ceil(count(*) / {BLOCK}), ceil(sum(length(hashes)) / {BYTES})))").alias("blocks")
    here = here.join(here.groupBy("clump").agg(blocks), "clump")
    return scratch.keep(_in_blocks(here, "clump", "cls", "root", "hashes").mapInArrow(_link_blocks, "u long, v long"), "links-blocks")


def _by_fingerprint(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (u, v) of classes that SimHash brings together: equal fingerprints, and those that Golay keys link."""
    first = scratch.keep(classes.groupBy("fp").agg(F.min("cls").alias("first")), "prints-first")
    found = scratch.keep(simhash.links(first, scratch, RADIUS), "prints-links")
    scratch.drop("keys", "longer")
    for end in "uv":
        found = found.join(first.select(F.col("fp").alias(end), F.col("first").alias(f"{end}1")), end)
    same = classes.join(first, "fp").select(F.col("first").alias("u"), F.col("cls").alias("v")).where("u < v")
    return found.select(F.least("u1", "v1").alias("u"), F.greatest("u1", "v1").alias("v")).union(same).distinct()


def _forest(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Links (u, v) from every class to the root of its component; they span what the links so far do."""
    return scratch.keep(components(links, scratch).toDF("u", "v"), f"forest-{name}")


def _rooted(bare: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(forest of the links, members with their root, keys with several roots, pairs of different roots in them)."""
    forest = _forest(links, scratch, name)
    members = bare.join(forest.toDF("cls", "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    members = scratch.keep(members, f"members-{name}")
    spread = members.groupBy("key", "root").agg(F.count("*").alias("m")).groupBy("key").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("m")).alias("s"))
    spread = scratch.keep(spread.select("key", "n", F.expr("(n * n - s) div 2").alias("cross")).where("cross > 0"), f"open-{name}")
    return forest, members, spread, spread.agg(F.sum("cross")).first()[0] or 0


def _linked(met: DataFrame, classes: DataFrame, texts: DataFrame, rows: int, scratch: Scratch) -> DataFrame:
    """Links (u, v) that span every component, by verified ones; met: what _groups gives."""
    links = _decided(_by_fingerprint(classes, scratch), classes, texts, scratch, "prints")
    roots = _forest(links, scratch, "prints")
    pairs = met.where("paired").select("u", "v").distinct()
    for end in "uv":  # what fingerprints have joined already need not be decided
        pairs = pairs.join(roots.select(F.col("u").alias(end), F.col("v").alias(f"{end}1")), end, "left")
    pairs = pairs.where(F.coalesce("u1", "u") != F.coalesce("v1", "v")).select("u", "v")
    links = roots.union(_decided(scratch.keep(pairs, "pairs"), classes, texts, scratch, "few"))
    release(texts.sparkSession)
    bare = met.where("NOT paired").select("key", F.col("u").alias("cls"), "size")
    forest, members, spread, cross = _rooted(bare, links, scratch, "few")
    if cross > WHOLE * rows:  # each against up to 4 leaders
        here = members.join(spread.select("key"), "key")
        turn = F.xxhash64("cls", F.pmod("key", F.lit(4)))
        other = here.groupBy("key").agg(F.min(F.struct(turn.alias("turn"), "cls", "size", "root")).alias("x"))
        other = other.select("key", *[F.col(f"x.{c}").alias(f"_{c}") for c in ("cls", "size", "root")])
        near = here.join(other, "key").where((F.col("root") != F.col("_root")) & _close("size", "_size"))
        near = near.select(F.least("cls", "_cls").alias("u"), F.greatest("cls", "_cls").alias("v")).distinct()
        links = forest.union(_decided(scratch.keep(near, "met-leaders"), classes, texts, scratch, "leaders"))
        release(texts.sparkSession)
        forest, members, spread, cross = _rooted(bare, links, scratch, "leaders")
    if cross:
        links = forest.union(_between(members, spread, classes, texts, scratch))
        release(texts.sparkSession)
    return links


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) of every document."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "resemblance")
    texts = only(docs, "doc_id", "text")
    prints = scratch.keep(texts.mapInArrow(_prints, "doc_id long, cls long, size long, sketch binary, fp long"), "prints")
    grouped = prints.groupBy("cls").agg(F.min("doc_id").alias("least"), *[F.any_value(c).alias(c) for c in ("size", "sketch", "fp")])
    classes = scratch.keep(grouped, "classes")
    dealt = texts.mapInArrow(_keyed, "key long, cls long, size long").repartition("key").sortWithinPartitions("key", "cls")
    met = scratch.keep(dealt.mapInArrow(_groups(FEW), "paired boolean, key long, u long, v long, size long"), "met")
    found = components(_linked(met, classes, texts, classes.count(), scratch), scratch)
    rooted = classes.select("cls", "least").join(found.withColumnRenamed("node", "cls"), "cls", "left")
    rooted = scratch.keep(rooted.select("cls", "least", F.coalesce("root", "cls").alias("root")), "rooted")
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.keep(rooted.join(lowest, "root").select("cls", "component_id"), "named")
    out = scratch.keep(prints.select("doc_id", "cls").join(named, "cls").select("doc_id", "component_id"), "out")
    scratch.drop("prints", "classes", "met")
    return out


def representatives(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, the smallest doc_id; all columns.

    Rows that share a doc_id go together, and only if none of them stays.
    """
    found = near_copies(docs)
    return without(docs, found.groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("gone")).where("gone"))
