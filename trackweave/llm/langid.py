"""Language identification by error-correcting output codes.

Each language has a codeword.  For each bit a binary n-gram classifier, the
log-odds of byte trigrams between the languages with and without the bit,
gives a margin: the mean log-odds over the whole text.  Decoding adds up a
logistic loss of every bit, weighted by how well the bit told the training
documents apart, and takes the codeword with the smallest loss.  A small lead
over the second one flags the text as ambiguous.

Trigrams are taken over letters: ASCII letters without case, every byte from
0x80 on, and one symbol for all between.  Training counts cover every
training document; they are summed per language and trigram bucket, so the
model has languages x BUCKETS numbers.

Rows: null text, or text without letters, is ``und`` with score 0.  Repeated
rows are predicted alike; a null doc_id is not held out.  Without training
documents every text is ``und``.  An empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, small_batches
from .grams import blocks, segment_sums, texts_as_bytes

BUCKETS = 1 << 16
RESULT = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"


def letters() -> np.ndarray:
    """Byte -> letter: 0 for what is none."""
    table = np.zeros(256, np.uint32)
    table[65:91] = table[97:123] = np.arange(1, 27)
    table[128:] = np.arange(27, 155)
    return table


_LETTER = letters()


def buckets(data: np.ndarray) -> np.ndarray:
    """The bucket of the trigram that ends at each byte; 0 for one without letters."""
    s = _LETTER[data]
    code = s.copy()
    code[1:] += s[:-1] * np.uint32(155)
    code[2:] += s[:-2] * np.uint32(155 * 155)
    mixed = (code * np.uint32(2654435769)) >> np.uint32(16)
    return np.where(code == 0, np.uint32(0), np.maximum(mixed, 1))


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n distinct codewords of 0 and 1: all splits for few languages, else the widest of random ones."""
    if n <= 7:
        rows = [c for k in range(1, n) for c in combinations(range(n), k) if 0 not in c]
        out = np.zeros((n, max(len(rows), 1)), np.int8)
        for j, members in enumerate(rows):
            out[list(members), j] = 1
        return out
    rng, best, width = np.random.default_rng(seed), None, int(np.ceil(15 * np.log2(n)))
    for _ in range(50):
        code = rng.integers(0, 2, (n, width), dtype=np.int8)
        code = code[:, (code.min(0) == 0) & (code.max(0) == 1)]
        apart = (code[:, None] != code[None]).sum(2)[np.triu_indices(n, 1)].min()
        if best is None or apart > best[0]:
            best = apart, code
    return best[1]


def _count(batches):
    """(lang, bucket, n, docs): trigram counts of one partition; docs stands at bucket 0."""
    held: dict[str, np.ndarray] = {}

    def out():
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])

    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        for data, starts, ends, owners in blocks(texts_as_bytes(batch.column(1)), 2):
            code = buckets(data)
            for lang in set(langs[owners]):
                if len(held) >= 400 and lang not in held:
                    yield from out()
                    held.clear()
                mine = np.flatnonzero(langs[owners] == lang)
                picked = np.concatenate([code[starts[i] : ends[i]] for i in mine])
                n = np.bincount(picked, minlength=BUCKETS)
                n[0] = 0
                held[lang] = held[lang] + n if lang in held else n
    yield from out()


def train(training: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray] | None:
    """(languages, codewords, weights BUCKETS x bits, bit weights) from (lang, text)."""
    found = training.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    if not langs:
        return None
    row = found["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()
    counts = np.zeros((len(langs), BUCKETS))
    counts[row, found["bucket"].to_numpy()] = found["n"].to_numpy()
    code = codewords(len(langs))
    seen = counts.sum(0) > 0
    p = (counts + 0.5 * seen) / (counts + 0.5 * seen).sum(1, keepdims=True)
    w = np.zeros((BUCKETS, code.shape[1]), np.float32)
    power = np.zeros(code.shape[1])
    for j in range(code.shape[1]):
        if code[:, j].any():
            yes, no = p[code[:, j] == 1].mean(0), p[code[:, j] == 0].mean(0)
            w[seen, j] = np.clip(np.log(yes[seen] / no[seen]), -6, 6)
            power[j] = ((yes - no) * w[:, j]).sum() / 2  # mean margin of the bit on its own languages
    return langs, code, w, power / max(power.sum(), 1e-9)


def decode(sums: np.ndarray, n: np.ndarray, model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language index, score, lead) from summed log-odds of n trigrams."""
    _, code, _, power = model
    evidence = sums / np.sqrt(np.maximum(n, 1))[:, None]  # neighbours are not independent, so less than the full sum
    signs = 2.0 * code - 1
    loss = np.stack([(np.logaddexp(0, -evidence * s) * power).sum(1) for s in signs], 1)
    like = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
    like /= like.sum(1, keepdims=True)
    best = like.argmax(1)
    order = np.sort(like, 1)
    lead = order[:, -1] - (order[:, -2] if order.shape[1] > 1 else 0)
    return best, order[:, -1], lead


def _has_letters(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def identify(docs: DataFrame, *, lead: float = 0.2) -> DataFrame:
    """Predictions for every document; a third by crc32(doc_id) is held out of training."""
    spark = docs.sparkSession
    small_batches(spark)
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    rows = only(docs, "doc_id", "text", "lang").withColumn("held_out", fold)
    return predict(rows, train(rows.where("NOT held_out AND lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")), lead=lead)


def predict(rows: DataFrame, model, *, lead: float = 0.2) -> DataFrame:
    """Predictions for (doc_id, text, held_out) by a trained model."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = texts_as_bytes(batch.column(1))
            bits = 1 if model is None else model[2].shape[1]
            sums, n = np.zeros((len(texts), bits)), np.zeros(len(texts), np.int64)
            if model is not None:
                for data, starts, ends, owners in blocks(texts, 2):
                    code = buckets(data)
                    np.add.at(n, owners, segment_sums((code > 0).astype(np.int64), starts, ends))
                    for j in range(bits):
                        np.add.at(sums[:, j], owners, segment_sums(model[2][:, j][code], starts, ends).astype(float))
                best, score, ahead = decode(sums, n, model)
            out = [(None, 0.0, False)] * len(texts)
            for i, t in enumerate(texts):
                if model is None or not (n[i] and _has_letters(t)):
                    out[i] = ("und", 0.0, False)
                else:
                    out[i] = (model[0][best[i]], float(min(max(score[i], 0.0), 1.0)), bool(ahead[i] < lead))
            names, scores, flags = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(flags, pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
            )

    return rows.select("doc_id", "text", "held_out").mapInArrow(run, RESULT)
