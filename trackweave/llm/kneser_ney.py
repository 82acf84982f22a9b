"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

Symbols are bytes, with capitals folded to one class and digits to another;
each of the 256 values has its own counts.  n-gram counts of trusted texts,
their continuation counts, context totals and discounts are tables, sharded by
n-gram and context, that grow with the trusted text; none is collected.

Documents are scored by joins with these tables.  A first pass gathers some
megabytes of texts to a chunk, compressed, with the n-grams that occur in it,
each once.  The n-grams of all chunks together are joined with the counts of
each order, lowest first, which gives the nats of each; these go back to the
chunks that asked, where each document's nats are added up over its whole
text.  So rows are counted in different n-grams of a chunk, not in bytes.

One half of all trusted documents, by hash of doc_id, trains; the other gives
the threshold of each language: a high quantile, so that nearly all clean text
stays.  Short texts scatter more, so what is compared is the excess over the
language's mean in units that suit the length.  Quantiles are taken of all
held-out documents, with the excess in steps of 1 / STEPS.  So few documents
that none is expected beyond the quantile do not show it; theirs is the one of
an exponential tail through their median and nine tenths, if that is higher.

Rows: null or empty text has perplexity null and is rejected only if
``keep_empty`` is false.  Repeated rows are scored alike, null ids are carried
through.  A language with fewer than ``least`` held-out documents, or null,
takes the threshold over all languages.  Without trusted text nothing is
rejected.  An empty table gives no rows; other columns are ignored.  A text
must fit one row (2 GB).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hits, only, small_batches, trimmed, without, worker_cache
from .grams import blocks, segment_sums, texts_as_bytes

ORDER = 4
STEPS = 10_000
CHUNK = 16 << 20  # bytes of text in a chunk
CHUNKS = "chunk long, doc_ids array<long>, langs array<string>, sizes array<long>, texts binary, codes array<long>"
SCORES = "doc_id long, lang string, n_symbols long, nll double"


def folded() -> np.ndarray:
    """Byte -> symbol: capitals as A, digits as 0."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] = 65
    table[48:58] = 48
    return table


_FOLD = folded()


def grams(data: np.ndarray) -> np.ndarray:
    """The code of the n-gram that ends at each byte, one byte a symbol; the first ones are short."""
    s = _FOLD[data].astype(np.uint32)
    code = s.copy()
    for back in range(1, ORDER):
        code[back:] |= s[:-back] << np.uint32(8 * back)
    return code


def _inside(data, starts, ends):
    mark = np.zeros(len(data) + 1, np.int8)
    mark[starts] += 1
    mark[ends] -= 1
    return grams(data)[np.cumsum(mark[:-1]) > 0]


def _count(batches):
    worker_cache("quality")
    held = None
    for batch in trimmed(batches):
        for data, starts, ends, _ in blocks(texts_as_bytes(batch.column(1)), ORDER - 1):
            codes, n = np.unique(_inside(data, starts, ends), return_counts=True)
            frame = pd.Series(n, index=codes)
            held = frame if held is None else held.add(frame, fill_value=0)
    if held is not None and len(held):
        yield pa.RecordBatch.from_arrays([pa.array(held.index.to_numpy(np.int64)), pa.array(held.to_numpy(np.int64))], ["code", "n"])


def train(texts: DataFrame, scratch: Scratch) -> list[tuple[DataFrame, DataFrame]]:
    """Of each order from 1 on: discounted shares (code, seen) and context weights (context, gamma); none without text."""
    counts = scratch.keep(texts.mapInArrow(_count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), f"grams-{ORDER}")
    levels = [counts]
    for m in range(ORDER - 1, 0, -1):  # below the highest order: in how many contexts, not how often
        counts = levels[-1].groupBy((F.col("code") % 256**m).alias("code")).agg(F.count("*").alias("n"))
        levels.append(scratch.keep(counts, f"grams-{m}"))
    if counts.isEmpty():
        return []
    return [_weights(level, scratch, m) for m, level in enumerate(reversed(levels), 1)]


def _weights(counts: DataFrame, scratch: Scratch, m: int) -> tuple[DataFrame, DataFrame]:
    how = {r["k"]: r["n"] for r in counts.where("n <= 4").groupBy(F.col("n").alias("k")).agg(F.count("*").alias("n")).collect()}
    n1, n2, n3, n4 = (how.get(k, 0) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    clip = lambda d, top: min(max(d, 0.05), top)
    d1 = clip(1 - 2 * y * n2 / n1 if n1 else 0.5, 0.95)
    d2 = clip(2 - 3 * y * n3 / n2 if n2 else 1.0, 1.95)
    d3 = clip(3 - 4 * y * n4 / n3 if n3 else 1.5, 2.95)
    off = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
    found = counts.withColumn("context", F.shiftright("code", 8))
    totals = found.groupBy("context").agg(F.sum("n").alias("total"), F.sum(off).alias("taken"))
    totals = scratch.keep(totals, f"totals-{m}")
    seen = found.join(totals, "context").select("code", ((F.col("n") - off) / F.col("total")).alias("seen"))
    return scratch.keep(seen, f"seen-{m}"), totals.select("context", (F.col("taken") / F.col("total")).alias("gamma"))


def nats(codes: DataFrame, model: list[tuple[DataFrame, DataFrame]], scratch: Scratch) -> DataFrame:
    """(code, nats) of distinct n-grams (code) of the highest order, by joins with the counts of each order."""
    below = None
    for m, (seen, weights) in enumerate(model, 1):
        asked = codes.select((F.col("code") % 256**m).alias("code")).distinct() if m < ORDER else codes
        met = asked.withColumn("context", F.shiftright("code", 8)).join(seen, "code", "left").join(weights, "context", "left")
        if below is None:
            lower = F.lit(1 / 256)
        else:
            met = met.withColumn("rest", F.col("code") % 256 ** (m - 1)).join(below.select(F.col("code").alias("rest"), F.col("p").alias("lower")), "rest")
            lower = F.col("lower")
        p = F.coalesce("seen", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * lower
        below = scratch.keep(met.select("code", p.alias("p")), f"p-{m}")
    return below.select("code", (-F.log("p")).cast("float").alias("nats"))


def _gather(batches):
    """Chunks of texts with the n-grams in them."""
    worker_cache("quality")
    task, number, codec = TaskContext.get().partitionId(), 0, pa.Codec("zstd", compression_level=9)
    ids, langs, texts, size = [], [], [], 0

    def out():
        found = [np.unique(_inside(data, starts, ends)) for data, starts, ends, _ in blocks(texts, ORDER - 1)]
        codes = np.unique(np.concatenate(found)).astype(np.int64) if found else np.zeros(0, np.int64)
        row = [task << 32 | number], [ids], [langs], [[len(t) for t in texts]], [codec.compress(b"".join(texts), asbytes=True)], [codes]
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types)], [c.split()[0] for c in CHUNKS.split(", ")])

    for batch in trimmed(batches):
        for i, t, lang in zip(batch.column(0).to_pylist(), texts_as_bytes(batch.column(1)), batch.column(2).to_pylist()):
            if texts and size + len(t) > CHUNK:
                yield out()
                ids, langs, texts, size, number = [], [], [], 0, number + 1
            ids.append(i)
            langs.append(lang)
            texts.append(t)
            size += len(t)
    if texts:
        yield out()


def _pack(batches, rows: int = 1 << 19):
    """(chunk, packed): the answers to a chunk among so many rows, as a few large values and not as many small ones."""

    def out():
        chunk, code, worth = (np.concatenate(z) for z in zip(*held))
        order = np.argsort(chunk, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], np.diff(chunk[order]) != 0]))
        parts = np.split(order, edges[1:])
        packed = [code[at].astype("<u4").tobytes() + worth[at].astype("<f4").tobytes() for at in parts]
        return pa.RecordBatch.from_arrays([pa.array(chunk[order[edges]]), pa.array(packed, pa.binary())], ["chunk", "packed"])

    held, size = [], 0
    for batch in trimmed(batches):
        if batch.num_rows:
            held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)))
            size += batch.num_rows
        if size >= rows:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _score(batches):
    codec = pa.Codec("zstd")
    for batch in trimmed(batches):
        for row in range(batch.num_rows):
            ids, langs, sizes, packed, answers = (batch.column(k)[row] for k in range(5))
            sizes = sizes.values.to_numpy()
            data = codec.decompress(packed.as_py(), int(sizes.sum()), asbytes=True) if sizes.sum() else b""
            ends_at = np.cumsum(sizes)
            texts = [data[b - n : b] for b, n in zip(ends_at.tolist(), sizes.tolist())]
            total = np.zeros(len(texts))
            if answers.is_valid:
                parts = answers.as_py()
                code = np.concatenate([np.frombuffer(x, "<u4", len(x) // 8) for x in parts])
                worth = np.concatenate([np.frombuffer(x, "<f4", len(x) // 8, len(x) // 2) for x in parts])
                order = np.argsort(code)
                code, worth = code[order], worth[order].astype(np.float64)
                for piece, starts, ends, owners in blocks(texts, ORDER - 1):
                    at = np.minimum(np.searchsorted(code, grams(piece)), len(code) - 1)
                    np.add.at(total, owners, segment_sums(worth[at], starts, ends))
            mean = pa.array(total / np.maximum(sizes, 1), mask=sizes == 0)
            yield pa.RecordBatch.from_arrays([ids.values, langs.values, pa.array(sizes), mean], ["doc_id", "lang", "n_symbols", "nll"])


def score(docs: DataFrame, model: list[tuple[DataFrame, DataFrame]], scratch: Scratch) -> DataFrame:
    """(doc_id, lang, n_symbols, nll): mean nats a symbol of every whole text."""
    rows = only(docs, "doc_id", "text", "lang").select(F.col("doc_id").cast("long"), "text", "lang")
    chunks = scratch.keep(rows.mapInArrow(_gather, CHUNKS), "chunks")
    asked = chunks.select("chunk", F.explode("codes").alias("code"))
    known = nats(scratch.keep(asked.select("code").distinct(), "asked"), model, scratch)
    answers = asked.join(known, "code").select("chunk", "code", "nats").mapInArrow(_pack, "chunk long, packed binary")
    answers = answers.groupBy("chunk").agg(F.collect_list("packed").alias("answers"))
    both = chunks.select("chunk", "doc_ids", "langs", "sizes", "texts").join(answers, "chunk", "left")
    return both.select("doc_ids", "langs", "sizes", "texts", "answers").mapInArrow(_score, SCORES)


def excess(nll: Column, n: Column, mean: Column) -> Column:
    """How far nats a symbol lie above a language's mean, in units that suit the length."""
    return (nll - mean) / (0.03 + 1.0 / F.sqrt(F.greatest(n, F.lit(1))))


def _limits(held: DataFrame, quantile: float) -> DataFrame:
    """(lang, n, mean, limit) of each language in (lang, n_symbols, nll)."""
    means = held.groupBy("lang").agg(F.count("*").alias("n"), (F.sum(F.col("nll") * F.col("n_symbols")) / F.sum("n_symbols")).alias("mean"))
    over = held.join(means, "lang")
    over = over.withColumn("step", F.round(excess(F.col("nll"), F.col("n_symbols"), F.col("mean")) * STEPS))
    steps = over.groupBy("lang", "n", "mean", "step").agg(F.count("*").alias("times"))
    at = lambda q: F.percentile("step", F.lit(q), F.col("times")) / STEPS
    told = steps.groupBy("lang", "n", "mean").agg(at(quantile).alias("top"), at(0.9).alias("high"), at(0.5).alias("middle"))
    tail = F.col("high") + (F.col("high") - F.col("middle")) * (np.log(0.1 / (1 - quantile)) / np.log(5.0))
    unseen = F.col("n") * (1 - quantile) < 0.999
    return told.select("lang", "n", "mean", F.when(unseen, F.greatest("top", tail)).otherwise(F.col("top")).alias("limit"))


def classify(docs: DataFrame, labels: DataFrame, *, quantile: float = 0.999, least: int = 100, keep_empty: bool = True) -> DataFrame:
    """(doc_id, lang, n_symbols, perplexity, excess, threshold, kept) of every document.

    labels: doc_id, quality, toxic; trusted is quality 1 and not toxic.
    quantile: the share of a language's trusted text below its threshold.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "quality")
    trusted = only(labels, "doc_id", "quality", "toxic").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    trusted = trusted.where("doc_id IS NOT NULL AND q = 1 AND coalesce(t, 0) = 0").select(F.col("doc_id").cast("long").alias("doc_id"))
    trusted = scratch.keep(trusted.withColumn("h", F.xxhash64("doc_id")), "ids")
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    half = trusted.where("h % 2 = 0")
    likely = hits(rows, F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")), half.select("h"), scratch, "bits").where("hit")
    model = train(likely.select("doc_id", "text").join(half, "doc_id", "left_semi"), scratch)
    if not model:
        return only(docs, "doc_id", "lang", "text").selectExpr(
            "doc_id", "lang", "octet_length(coalesce(text, '')) + 0L AS n_symbols", "double(null) AS perplexity", "double(null) AS excess",
            "double(null) AS threshold", "true AS kept")
    scored = scratch.keep(score(docs, model, scratch), "scored")
    scratch.drop("chunks", "asked")
    held = scored.where("n_symbols > 0").join(trusted.where("h % 2 <> 0").select("doc_id"), "doc_id", "left_semi").select("lang", "n_symbols", "nll")
    held = scratch.keep(held, "held")
    pooled = _limits(held.withColumn("lang", F.lit("")), quantile).first() or {"mean": 0.0, "limit": float("inf")}
    own = _limits(held.where("lang IS NOT NULL"), quantile).where(F.col("n") >= least).select("lang", "mean", "limit")
    scored = scored.join(scratch.keep(own, "limits"), "lang", "left")
    mean, limit = (F.coalesce(c, F.lit(float(pooled[c]))) for c in ("mean", "limit"))
    scored = scored.withColumns({"excess": excess(F.col("nll"), F.col("n_symbols"), mean), "threshold": limit, "perplexity": F.exp("nll")})
    kept = F.when(F.col("n_symbols") == 0, F.lit(keep_empty)).otherwise(F.col("excess") <= F.col("threshold"))
    return scored.select("doc_id", "lang", "n_symbols", "perplexity", "excess", "threshold", kept.alias("kept"))


def keepers(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """docs without the rejected rows, all columns, whatever their names.

    Rows that share a doc_id go together, and only if all are rejected; rows
    without doc_id stay.  An empty table stays empty.
    """
    return without(docs, classify(docs, labels, **how).groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where("NOT kept"))
