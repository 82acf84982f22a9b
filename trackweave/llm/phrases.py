"""Substring deduplication by repeated-phrase automata.

A window is ``window`` consecutive words.  It is recurring if it starts in
documents with different ids, and the smallest of them owns it.  Steps:

1. One pass hashes words and picks anchors: of the 16-word phrases in each
   window the one with the smallest hash.  What anchor a window gets depends
   on its words alone, so a recurring window has a recurring anchor, and a
   document without recurring anchors holds no recurring window.
2. Documents with equal words are one document from here on: all words of a
   copy go if there are enough for a window.
3. Windows around recurring anchors are counted by 128-bit hashes.  That tells
   which recur, who owns them and where the owner has them; runs of them make
   a document's claims on passages of other documents.
4. The claimed passages are cut out of their owners' texts, in phrases of one
   to two windows.  Aho-Corasick automata of bounded size are compiled from
   them, shard by shard, and the documents of the shard stream by.  What goes
   is what an automaton finds, character by character, where the phrase's
   owner is a smaller document; a hash alone removes nothing.

Rows: null text has no words.  A null doc_id counts as larger than any other
and is never smaller than another null.  Rows that repeat doc_id and text
fare alike; with one doc_id and different texts neither is the smaller one.
An empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hits, only, plain, release, small_batches, trim, trimmed, worker_cache
from .grams import texts_as_bytes

ANCHOR = 16  # words of an anchor phrase
SHARD = 400_000  # characters of phrases in an automaton
LAST = (1 << 63) - 1  # stands for a null doc_id
PRINTS = "doc_id long, id long, raw string, n_words long, sha string, key long, anchors array<long>, places array<int>"
REMOVED = "id long, key long, n_removed long, kept_sha256 string, kept string"

_SEED = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo 2 ** 64 for i < n."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = 1 << max(18, n.bit_length())
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            step = np.full(size, b, np.uint64)
            step[0] = 1
            made.append(np.multiply.accumulate(step))
        if size > 1 << 19:  # longer texts are few
            return made[0], made[1]
        _POWERS[base] = made[0], made[1]
    return _POWERS[base]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def word_hashes(text: bytes, block: int = 1 << 18) -> np.ndarray:
    """A hash of each word of a text whose words are joined by one space."""
    out, at = [], 0
    while at < len(text):
        end = len(text)
        if end - at > block and (cut := text.rfind(b" ", at, at + block)) > at:
            end = cut
        elif end - at > block and (cut := text.find(b" ", at + block)) > 0:
            end = cut
        data = np.frombuffer(text, np.uint8, end - at, at)
        up, down = _powers(_BASES[0], len(data) + 1)
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_SEED[data] * up[: len(data)], out=run[1:])
        gaps = np.flatnonzero(data == 32)
        starts, ends = np.concatenate([[0], gaps + 1]), np.append(gaps, len(data))
        out.append(_mix((run[ends] - run[starts]) * down[starts]))
        at = end + 1
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def rolling(words: np.ndarray, width: int, lane: int = 1) -> np.ndarray:
    """A hash of each run of width words."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    up, down = _powers(_BASES[lane], len(words) + 1)
    run = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=run[1:])
    return _mix((run[width:] - run[:-width]) * down[: len(words) - width + 1])


def _slide(values: np.ndarray, width: int, of) -> np.ndarray:
    """of = np.minimum or np.maximum over each run of width values."""
    have = 1
    while have * 2 <= width:
        values, have = of(values[:-have], values[have:]), have * 2
    return of(values[: len(values) - (width - have)], values[width - have :]) if width > have else values


def anchors(words: np.ndarray, owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the anchors; owner tells the document of each word."""
    n = len(words)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    size = min(ANCHOR, window)
    grams = rolling(words, size) | np.uint64(1)
    reach = window - size + 1
    low = _slide(grams, reach, np.minimum)  # one for each window
    low[owner[: n - window + 1] != owner[window - 1 :]] = 0
    edge = np.zeros(reach - 1, np.uint64)
    high = _slide(np.concatenate([edge, low, edge]), reach, np.maximum)  # over the windows that hold a phrase
    at = np.flatnonzero(high == grams)
    return at, grams[at]


def _joined(text: bytes) -> bytes:
    return b" ".join(text.split())


def _grouped(texts: list[bytes], size: int = 1 << 18):
    """Runs [first, last) of texts of about size bytes."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield first, i
            first, total = i, 0
        total += len(t)
    if first < len(texts):
        yield first, len(texts)


def _prints(window: int):
    def run(batches):
        worker_cache("phrases")
        for batch in trimmed(batches):
            ids, raw = batch.column(0), texts_as_bytes(batch.column(1))
            texts = [_joined(t) for t in raw]
            counts = np.array([t.count(b" ") + 1 if t else 0 for t in texts], np.int64)
            digests = [hashlib.sha256(t).digest() for t in texts]
            places, hashes, sizes = [], [], []
            for a, b in _grouped(texts):
                n = counts[a:b]
                words = word_hashes(b" ".join(t for t in texts[a:b] if t))
                owner = np.repeat(np.arange(b - a), n)
                at, h = anchors(words, owner, window)
                begin = np.cumsum(n) - n
                places.append((at - begin[owner[at]]) if len(at) else at)
                hashes.append(h)
                sizes.append(np.bincount(owner[at], minlength=b - a) if len(at) else np.zeros(b - a, np.int64))
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else [0], pa.int32())
            flat = lambda x, t: pa.array(np.concatenate(x).astype(t) if x else np.zeros(0, t))
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    ids.fill_null(LAST),
                    pa.array([hashlib.sha256(t).hexdigest() for t in raw], pa.string()),
                    pa.array(counts),
                    pa.array([d.hex() for d in digests], pa.string()),
                    pa.array([int.from_bytes(d[:8], "little", signed=True) for d in digests], pa.int64()),
                    pa.ListArray.from_arrays(offsets, flat(hashes, np.uint64).view(pa.int64())),
                    pa.ListArray.from_arrays(offsets, flat(places, np.int32)),
                ],
                [c.split()[0] for c in PRINTS.split(", ")],
            )

    return run


def _keyed(batches):
    """(id, key, words): the joined words of each text and the start of their digest."""
    for batch in trimmed(batches):
        texts = [_joined(t) for t in texts_as_bytes(batch.column(1))]
        keys = [int.from_bytes(hashlib.sha256(t).digest()[:8], "little", signed=True) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["id", "key", "words"])


def _windows(window: int):
    size = min(ANCHOR, window)

    def run(batches):
        """(h1, h2, id, place) of windows around anchors; place holds a part of the key above 32 bits, see _part."""
        for batch in trimmed(batches):
            ids, keys, places = (batch.column(k).to_pylist() for k in (0, 1, 3))
            for i, text in enumerate(texts_as_bytes(batch.column(2))):
                words = word_hashes(text)
                n = len(words) - window + 1
                if n < 1:
                    continue
                p = np.array(places[i], np.int64)
                mark = np.zeros(n + 1, np.int64)
                np.add.at(mark, np.clip(p + size - window, 0, n), 1)
                np.add.at(mark, np.clip(p + 1, 0, n), -1)
                at = np.flatnonzero(np.cumsum(mark[:-1]))
                lanes = [rolling(words, window, lane)[at].view(np.int64) for lane in (1, 2)]
                place = at | (keys[i] & 0x7FFFFFFF) << 32
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*lanes, np.full(len(at), ids[i], np.int64), place)], ["h1", "h2", "id", "place"])

    return run


def passages(at: np.ndarray, owner: np.ndarray, source: np.ndarray, window: int):
    """(owner, first word, end word) in the owners of phrases of one to two windows.

    Window ``at`` of a document is window ``source`` of its owner; the phrases
    cover each run of windows that follow each other in both.
    """
    order = np.argsort(at)
    at, owner, source = at[order], owner[order], source[order]
    breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(source) != 1) | (owner[1:] != owner[:-1])) + 1
    for run in np.split(np.arange(len(at)), breaks):
        begin, end = int(source[run[0]]), int(source[run[-1]]) + window
        pieces = (end - begin) // window
        for k in range(pieces):
            yield int(owner[run[0]]), begin + k * window, end if k == pieces - 1 else begin + (k + 1) * window


def _claims(window: int):
    def run(batches):
        """(id, part, owner, begin, end) from the recurring windows of a document; begin holds the owner's part above 32 bits."""
        for batch in batches:
            out = [
                (i, part, *phrase)
                for i, part, found in zip(*(batch.column(k).to_pylist() for k in range(3)))
                for phrase in set(passages(*np.array([(f["place"] & 0xFFFFFFFF, f["owner"], f["source"]) for f in found], np.int64).T, window))
            ]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["id", "part", "owner", "begin", "end"])

    return run


def _cut(batches):
    """(owner, begin, end, phrase) from the joined words of the owners."""
    for batch in trimmed(batches):
        out = []
        for i, text, spans in zip(*(batch.column(k).to_pylist() for k in range(3))):
            words = text.split(" ")
            out += [(i, s["begin"], s["end"], " ".join(words[s["begin"] & 0xFFFFFFFF : s["end"] & 0xFFFFFFFF])) for s in spans]
        if out:
            columns = [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 3 + [pa.string()])]
            yield pa.RecordBatch.from_arrays(columns, ["owner", "begin", "end", "phrase"])


def _automata(phrases: dict[str, int]):
    import ahocorasick

    made, size = ahocorasick.Automaton(), 0
    for text, owner in phrases.items():
        made.add_word(text, (owner, len(text)))
        size += len(text)
        if size >= SHARD:
            made.make_automaton()
            yield made
            made, size = ahocorasick.Automaton(), 0
    if len(made):
        made.make_automaton()
        yield made


def _locate(window: int):
    def shard(rows):
        phrases: dict[str, int] = {}
        for _, _, _, _, _, found in rows:
            for f in found:
                key = f" {f['phrase']} "
                phrases[key] = min(f["owner"], phrases.get(key, LAST))
        covered = [np.zeros(len(words) + 1, np.int64) for _, _, _, words, _, _ in rows]
        for automaton in _automata(phrases):
            for (doc, _, text, _, starts, _), cover in zip(rows, covered):
                for end, (owner, size) in automaton.iter(text):
                    if owner < doc:
                        cover[np.searchsorted(starts, end - size + 2)] += 1
                        cover[np.searchsorted(starts, end)] -= 1
        out = []
        for (doc, key, _, words, _, _), cover in zip(rows, covered):
            gone = np.cumsum(cover[:-1]) > 0
            kept = " ".join(w for w, g in zip(words, gone.tolist()) if not g)
            out.append((doc, key, int(gone.sum()), hashlib.sha256(kept.encode("utf-8")).hexdigest(), kept))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [c.split()[0] for c in REMOVED.split(", ")])

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for doc, key, text, found in zip(*(batch.column(k).to_pylist() for k in range(4))):
                words = text.split(" ")
                starts = np.cumsum([1] + [len(w) + 1 for w in words[:-1]])
                rows.append((doc, key, f" {text} ", words, starts, found))
                size += len(text)
                if size >= SHARD:
                    yield shard(rows)
                    rows, size = [], 0
        if rows:
            yield shard(rows)
        rows.clear()
        trim()

    return run


def _part(key):
    """31 bits of a key, which tell documents with one id apart; documents that share them too only share their phrases."""
    return key.bitwiseAND(F.lit(0x7FFFFFFF))


def analyse(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(one row per document with its class, rows REMOVED of documents that lose words)."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "phrases")
    docs = only(docs, "doc_id", "text")
    prints = scratch.keep(docs.mapInArrow(_prints(window), PRINTS), "prints")
    heads = prints.groupBy("sha").agg(F.min(F.struct("id", "key", "anchors", "places")).alias("h")).select("sha", "h.*")
    heads = scratch.keep(heads, "heads")
    classes = heads.select("sha", F.col("id").alias("least"))
    picked = heads.select("id", "key", F.explode(F.arrays_zip("anchors", "places")).alias("a")).select("id", "key", "a.anchors", "a.places")
    repeated = picked.groupBy("anchors").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("anchors")
    repeated = scratch.keep(repeated, "repeated")
    wanted = picked.join(repeated, "anchors").groupBy("id", "key").agg(F.collect_list("places").alias("places"))
    wanted = scratch.keep(wanted, "wanted")
    named = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "text").where("text IS NOT NULL")
    named = hits(named, F.xxhash64("id"), wanted.select(F.xxhash64("id").alias("h")), scratch, "bits").where("hit")
    held = named.select("id", "text").mapInArrow(_keyed, "id long, key long, words string").join(wanted, ["id", "key"])
    held = scratch.keep(held.dropDuplicates(["id", "key"]), "held")
    windows = held.select("id", "key", "words", "places").mapInArrow(_windows(window), "h1 long, h2 long, id long, place long")
    owners = windows.groupBy("h1", "h2").agg(F.min("id").alias("owner"), F.max("id").alias("hi"), F.min_by("place", "id").alias("source"))
    owners = scratch.keep(owners.where("owner < hi").drop("hi"), "owners")
    spans = windows.join(owners, ["h1", "h2"]).where("owner < id")
    spans = spans.groupBy("id", F.shiftright("place", 32).alias("part")).agg(F.collect_list(F.struct("place", "owner", "source")).alias("found"))
    claims = scratch.keep(spans.mapInArrow(_claims(window), "id long, part long, owner long, begin long, end long"), "claims")
    scratch.drop("repeated", "wanted", "owners")
    release(spark)
    texts = held.withColumn("part", _part(F.col("key"))).select("id", "key", "part", "words")
    asked = claims.select("owner", "begin", "end").distinct().groupBy("owner", F.shiftright("begin", 32).alias("part")).agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    cut = texts.join(asked.withColumnRenamed("owner", "id"), ["id", "part"]).select("id", "words", "spans")
    phrases = scratch.keep(cut.mapInArrow(_cut, "owner long, begin long, end long, phrase string"), "phrases")
    found = claims.join(phrases, ["owner", "begin", "end"]).groupBy("id", "part").agg(F.collect_set(F.struct("owner", "phrase")).alias("found"))
    removed = texts.join(found, ["id", "part"]).select("id", "key", "words", "found").mapInArrow(_locate(window), REMOVED)
    removed = scratch.keep(removed, "removed")
    scratch.drop("held", "claims", "phrases")
    classed = prints.select("doc_id", "id", "raw", "n_words", "sha", "key").join(classes, "sha")
    return classed.withColumn("copy", F.expr(f"id > least AND n_words >= {window}")), removed


def dedup(docs: DataFrame, *, window: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    classed, removed = analyse(docs, window)
    both = classed.join(removed.drop("kept"), ["id", "key"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return both.select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(F.col("copy"), none).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def cleaned(docs: DataFrame, *, window: int = 50) -> DataFrame:
    """docs with the recurring passages cut out of ``text``, all columns and rows.

    A text that loses nothing stays as it is; of another one the kept words
    stay, joined by one space, and ``n_chars``, where there is one, is theirs.
    Columns may have any names.  Only rows that may change are shuffled.
    """
    scratch = Scratch(docs.sparkSession, "phrases-cut")
    classed, removed = analyse(docs, window)
    new = classed.select("id", "key", "raw", "copy").join(removed.select("id", "key", "kept"), ["id", "key"], "left").where("copy OR kept IS NOT NULL")
    new = new.select("id", "raw", F.when(~F.col("copy"), F.col("kept")).alias("kept")).dropDuplicates(["id", "raw"])
    new = scratch.keep(new, "new")
    at = {c: f"_{docs.columns.index(c)}" for c in ("doc_id", "text", "n_chars") if c in docs.columns}
    own = F.coalesce(F.col(at["doc_id"]), F.lit(LAST))
    asked = hits(plain(docs), F.xxhash64(own), new.select(F.xxhash64("id").alias("h")), scratch, "bits")
    joined = asked.where("hit").join(new, (own == F.col("id")) & (F.sha2(at["text"], 256) == F.col("raw")), "left")
    changed, kept = F.col("id").isNotNull(), F.coalesce("kept", F.lit(""))
    out = {at["text"]: F.when(changed, kept).otherwise(F.col(at["text"]))}
    if "n_chars" in at:
        n = at["n_chars"]
        out[n] = F.when(changed, F.length(kept)).otherwise(F.col(n)).cast(docs.schema[docs.columns.index("n_chars")].dataType)
    left = joined.withColumns(out).select(asked.columns)
    return asked.where("NOT hit").union(left).drop("hit").toDF(*docs.columns)
