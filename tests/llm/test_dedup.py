"""Exact, SimHash and chat against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from trackweave.llm import chat, exact, golay, simhash
from trackweave.llm.common import Scratch, components

from .fixtures import documents, empty


def smallest_reachable(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(300)] + [(1000 + rng.randrange(200), 1000 + rng.randrange(200)) for _ in range(150)] + [(5, 5)]
    links += [(2000, 2000 + i) for i in range(1, 400)]
    want = smallest_reachable({x for p in links for x in p}, links)
    df = spark.createDataFrame(links, "u long, v long").repartition(7)
    got = {r["node"]: r["root"] for r in components(df, Scratch(spark, "t")).collect()}
    assert all(got.get(n, n) == r for n, r in want.items())


def test_golay_keys_meet():
    """All pairs of 23-bit words within two bits share a key; by linearity one word for each syndrome is enough."""
    near = golay.keys(np.arange(1 << 11))
    assert (near[:, 0] >= 0).all()
    flips = [0] + [1 << i for i in range(23)] + [1 << i | 1 << j for i in range(23) for j in range(i)]
    words = np.arange(1 << 11)  # the low bits are a word of each syndrome
    assert len(set(golay.syndromes(words).tolist())) == 1 << 11
    for f in flips:
        other = golay.keys(words ^ f)
        meets = (near[:, :, None] == other[:, None, :]) & (near[:, :, None] >= 0)
        assert meets.any(axis=(1, 2)).all()


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def test_simhash(spark):
    docs = documents(spark)
    got = simhash.near_duplicates(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    fp = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = smallest_reachable(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])
    assert len(got) == docs.count()
    for r in got:
        assert (r["fingerprint"], r["component_id"]) == (f"{fp[r['doc_id']]:016x}", want[r["doc_id"]])
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_simhash_links_lose_nothing(spark):
    """Dense and sparse clouds of fingerprints: components as by all pairs."""
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(200)} | {0, 1, (1 << 64) - 1}
    for _ in range(6):
        centre = rng.getrandbits(64)
        fps |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(150)}
    chain = rng.getrandbits(64)
    for i in range(0, 60, 2):
        chain ^= 3 << i
        fps.add(chain)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    want = smallest_reachable(signed, [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2])
    scratch = Scratch(spark, "t")
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), scratch)
    rows = links.collect()
    assert all(((r["u"] ^ r["v"]) & (1 << 64) - 1).bit_count() <= 2 for r in rows)
    assert smallest_reachable(signed, [tuple(r) for r in rows]) == want


def test_simhash_keys_are_exact_at_any_crowding():
    """Whole keys of all pairs within two bits meet, and a crowded key gives the components of all pairs."""
    rng = random.Random(12)
    a = np.array([rng.getrandbits(64) for _ in range(300)], np.uint64)
    b = np.array([int(x) ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 2))) for x in a], np.uint64)

    def whole(x):
        key, row = simhash.fuzzy_keys(x.view(np.int64))
        long, at = simhash.longer_keys(key, x.view(np.int64)[row])
        out = defaultdict(set)
        for i, k in zip(row[at].tolist(), long.tolist()):
            out[i].add(k)
        return out

    one, two = whole(a), whole(b)
    assert all(one[i] & two[i] for i in range(300))
    crowd = np.unique(np.array([sum(1 << i for i in rng.sample(range(24), rng.randint(0, 6))) for _ in range(400)], np.uint64))
    pairs = [(i, j) for i in range(len(crowd)) for j in range(i) if int(crowd[i] ^ crowd[j]).bit_count() <= 2]
    assert smallest_reachable(range(len(crowd)), simhash.spanning(crowd)) == smallest_reachable(range(len(crowd)), pairs) and len(crowd) > 64


def test_simhash_without_ids(spark):
    got = simhash.near_duplicates(documents(spark, [(None, "a b c d", "en"), (None, "a b c d", "en"), (None, "q r s", "en")])).where("doc_id IS NULL").collect()
    assert len(got) == 3


def brute_exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    return sorted((i, min(g), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)


def test_exact(spark):
    docs = documents(spark)
    want = brute_exact(docs.select("doc_id", "text").collect())
    for digest in (None, lambda c: F.substring(F.md5(c), 1, 1)):  # the weak one collides all the time
        got = exact.dedup(docs.repartition(6), digest=digest, files_per_batch=2).collect()
        assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
        assert sum(r["kept"] for r in got) == len({w[3] for w in want})
        assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got if r["doc_id"] != 50)
    assert exact.dedup(empty(spark)).count() == 0


def test_exact_reads_files_in_place(spark, tmp_path):
    docs = documents(spark, [(None, "no id", "en"), (None, "no id", "en")])
    docs.repartition(3).write.parquet(str(tmp_path / "d"))
    read = spark.read.parquet(str(tmp_path / "d"))
    got = exact.dedup(read).collect()
    assert len(got) == docs.count()
    none = [r for r in got if r["doc_id"] is None]
    assert [r["group_size"] for r in none] == [2, 2] and sum(r["kept"] for r in none) == 1


def test_stays_keeps_rows(spark, tmp_path):
    plain = documents(spark).where("doc_id < 50")
    for docs in (plain, documents(spark, [(70, "once", "en"), (70, "once ", "en"), (70, "once", "en"), (71, "once", "en"), (71, "other", "en")])):
        docs.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "d"))
        docs = spark.read.parquet(str(tmp_path / "d"))
        kept = exact.stays(docs)
        assert kept.columns == docs.columns
        want = {(w[1], w[3]) for w in brute_exact(docs.select("doc_id", "text").collect())}
        got = [(r["doc_id"], r["s"]) for r in kept.select("doc_id", F.sha2(exact.normalised(F.col("text")), 256).alias("s")).collect()]
        assert sorted(got) == sorted(want)


def test_chat(spark):
    a, b, c = ("user", "hi"), ("assistant", "yo <|im_end|>"), ("user", None)
    convs = {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, b, c], 5: [b], 6: [b, a], 7: [c, c, c], 8: [c, c], None: [a, a]}
    rows = [(i, t, role, text, "extra", "k") for i, turns in convs.items() for t, (role, text) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, prefix string, k string")
    got = {r["conv_id"]: r for r in chat.render(df).collect()}
    assert set(got) == {3, 6, 7, None}
    assert got[3]["rendered"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo < |im_end|><|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert got[7]["n_turns"] == 3
    assert chat.render(df.limit(0)).count() == 0
