"""Packing, BPE automaton and token store against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from trackweave.llm import bpe, packing, tokenbin, tokens

from .fixtures import documents, empty


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.default_path())


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4")


def test_encoder_equals_library(library):
    texts = ["", " a  b ", "x<|endoftext|><|endoftext|> y", "it's we'll\n\n  z", "é" * 50, "ab" * 3000, "\x00\x00q", "𝔘 ١٢٣ ⅷ ²"]
    assert [np.frombuffer(b, "<u4").tolist() for b in tokens.encoder(tokens.default_path()).encode(texts)] == [ids_of(library, t).tolist() for t in texts]


def test_white_space_everywhere(library):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "bc", " ", " ", "\n", "\t", "'s", ",", "\u00a0", "\x1c", "7", "<|endoftext|>"]) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    for encode in (tokens.LibraryEncoder(tokens.default_path(), 300).encode, bpe.codec(tokens.default_path()).encode):
        for i in range(0, len(texts), 100):
            got = encode(texts[i : i + 100])
            assert [np.frombuffer(b, "<u4").tolist() for b in got] == [ids_of(library, t).tolist() for t in texts[i : i + 100]]


def brute_bpe(word, merges):
    parts = [bytes([b]) for b in word]
    rank = {m: i for i, m in enumerate(merges)}
    while True:
        best = min(((rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank), default=None)
        if best is None:
            return parts
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_automaton_against_merging():
    rng = random.Random(3)
    for _ in range(60):
        vocab, merges = [bytes([c]) for c in b"abc"], []
        for _ in range(rng.randint(0, 14)):
            pair = (rng.choice(vocab), rng.choice(vocab))
            if pair[0] + pair[1] not in vocab:
                merges.append(pair)
                vocab.append(pair[0] + pair[1])
        auto = bpe.Automaton({v: i for i, v in enumerate(vocab)}, merges)
        for _ in range(60):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 18)))
            assert [vocab[i] for i in auto.encode(word)] == brute_bpe(word, merges), (word, merges)


def test_one_lookup_a_byte():
    """On a compiled table a word costs one lookup for each byte and compiles nothing; a small table gives the same ids."""
    auto = bpe.codec(tokens.default_path()).automaton
    words = [b" unbelievable", b"aaaaaaaaaaaa", b" thththe", "größenwahn".encode(), b"x"]
    first = [auto.encode(w) for w in words]

    class Counted(dict):
        asked = 0

        def get(self, key):
            Counted.asked += 1
            return dict.get(self, key)

    kept, compile_ = auto.table, auto._compile
    auto.table, auto._compile = Counted(kept), None
    try:
        assert [auto.encode(w) for w in words] == first and Counted.asked == sum(map(len, words))
    finally:
        auto.table, auto._compile = kept, compile_
    limit, auto.limit = auto.limit, 3
    assert [auto.encode(w) for w in words] == first
    auto.limit = limit


def test_codecs_without_ids(spark, library):
    docs = documents(spark, [(None, "no id", "en"), (None, None, "en")])
    assert bpe.round_trip(docs).where("doc_id IS NULL").count() == 2
    assert packing.pack(docs).where("doc_id IS NULL").count() == 2


def test_round_trip_equals_library(spark, library):
    docs = documents(spark)
    got = bpe.round_trip(docs).collect()
    assert len(got) == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got:
        ids = ids_of(library, texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids.tolist(), skip_special_tokens=False).encode()).hexdigest()
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs)).collect()}
    assert all(back[i] == (t or "") for i, t in texts.items())
    assert bpe.round_trip(empty(spark)).count() == 0


def check_packing(docs, library, capacity):
    got = packing.pack(docs, capacity=capacity).toPandas()
    texts = docs.select("doc_id", "text").toPandas()
    held = {}
    for doc_id, text in zip(texts.doc_id, texts.text):
        held.setdefault(doc_id, []).append(np.append(ids_of(library, text), np.uint32(2)).astype("<u4"))
    for doc_id, rows in got.groupby("doc_id"):
        ids = held[doc_id][0]
        assert rows.length.sum() == len(ids) * len(held[doc_id])
        for r in rows.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
            assert r.length == capacity or r.piece == 0
    assert set(got.doc_id) == set(held)
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert rows.length.sum() <= capacity
        assert rows.offset.tolist() == [0, *rows.length.cumsum().tolist()[:-1]]
    return got


@pytest.mark.parametrize("capacity", [64, 1024])
def test_packing(spark, library, capacity):
    got = check_packing(documents(spark), library, capacity)
    assert got.sequence_id.nunique() <= -(-got.length.sum() // capacity) * 1.08 + 1
    assert packing.pack(empty(spark)).count() == 0


def test_fullest_is_fullest():
    rng = np.random.default_rng(1)
    for _ in range(200):
        counts = np.zeros(31, np.int64)
        for n in rng.integers(1, 31, rng.integers(1, 7)):
            counts[n] += rng.integers(1, 4)
        lead = int(np.nonzero(counts)[0][-1])
        sums = {lead}
        for n in np.nonzero(counts)[0]:
            spare = int(counts[n]) - (n == lead)
            sums = {s + k * int(n) for s in sums for k in range(spare + 1) if s + k * n <= 30}
        used = packing.fullest(counts, 30)
        assert all(counts[n] >= k for n, k in used.items())
        assert sum(n * k for n, k in used.items()) == max(sums)


def test_elias_fano():
    rng = np.random.default_rng(2)
    for n, top in [(1, 0), (5, 3), (300, 10**9), (1000, 50), (2, 10**12)]:
        v = np.sort(rng.integers(0, top + 1, n))
        ef = tokenbin.EliasFano.loads(tokenbin.EliasFano.of(v).dumps())
        assert ef.select(np.arange(n)).tolist() == v.tolist()
        some = rng.integers(0, n, 5)
        assert ef.select(some).tolist() == v[some].tolist()


def test_store(spark, library):
    docs = documents(spark, [(None, "no id", "en")])
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    got = sorted(tokenbin.store_and_index(docs).collect(), key=lambda r: r["start"])
    at = 0
    for r, (doc_id, text) in zip(got, rows, strict=True):
        ids = np.append(ids_of(library, text), np.uint32(0)).astype("<u4")
        assert tuple(r) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert tokenbin.store_and_index(empty(spark)).count() == 0


def test_block_documents(library):
    ids = [ids_of(library, t).tobytes() for t in ("a b", "", "c" * 50)]
    block = tokenbin.Block(tokenbin.dump_block([None, 7, 9], ids, 2))
    assert [x for names, _ in block.documents(2) for x in names] == [None, 7, 9]
    assert np.concatenate([np.diff(at) for _, at in block.documents(2)]).tolist() == [len(b) // 4 for b in ids]
    assert [block.document(i).astype("<u4").tobytes() for i in range(3)] == ids


def test_lean_packing_is_the_same(spark):
    """Smaller parts and memo, as the pipeline takes them, give the same pieces."""
    docs = documents(spark)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(str, packing.pack(docs, lean=True).select(columns).collect())) == sorted(map(str, packing.pack(docs).select(columns).collect()))
