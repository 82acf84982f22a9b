"""Substring dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from trackweave.llm import phrases

from .fixtures import documents, empty


def brute(rows, window):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, phrases.LAST), phrases.LAST if i is None else i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < (phrases.LAST if i is None else i):
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def passages(seed=4):
    rng = random.Random(seed)
    vocab = ["été", "the", "of", "x", "日本", "a", "bb", "nineteen", "!!", "<", " y"] + [f"w{i}" for i in range(40)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    shared = [say(n) for n in (50, 51, 80, 130, 49, 200)]
    rows = []
    for i in range(90):
        w = say(rng.randint(0, 90))
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, max(0, len(s) - 50))
            at = rng.randint(0, len(w))
            w[at:at] = s[a : a + rng.randint(45, 220)]
        rows.append((i * 3 % 91, rng.choice([" ", "  ", "\n"]).join(w), "en"))
    rows += [(200, rows[4][1], "en"), (1, rows[7][1], None), (300, "rep " * 170, "en"), (301, "rep " * 120, "en"), (None, rows[9][1], "en"), (None, rows[9][1], "en")]
    rows += [(400, rows[11][1], "en"), (400, rows[12][1], "en")]
    return rows


@pytest.mark.parametrize("window", [50, 12])
def test_against_brute_force(spark, window):
    docs = documents(spark, passages())
    want = brute(docs.select("doc_id", "text").collect(), window)
    got = phrases.dedup(docs, window=window).collect()
    key = lambda r: str(tuple(r))
    assert sorted((tuple(r) for r in got), key=key) == sorted((w[:4] for w in want), key=key)
    assert sum(w[2] for w in want) > 500


def test_cleaned(spark):
    docs = documents(spark, passages(6))
    got = phrases.cleaned(docs)
    assert got.columns == docs.columns
    texts = docs.select("doc_id", "text").collect()
    want = sorted(((w[0], r["text"] if not w[2] else w[4]) for w, r in zip(brute(texts, 50), texts)), key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == want


def test_empty(spark):
    assert phrases.dedup(empty(spark)).count() == 0


def test_word_hashes_cut_anywhere():
    text = " ".join(["word", "été", "x" * 70] * 40).encode()
    assert (phrases.word_hashes(text) == phrases.word_hashes(text, 64)).all()
    assert len(set(phrases.word_hashes(b"a b ab ba a b").tolist())) == 4
    a = phrases.word_hashes(b"p q r s p q r")
    assert (np.flatnonzero(phrases.rolling(a, 3) == phrases.rolling(a, 3)[0]) == [0, 4]).all()
