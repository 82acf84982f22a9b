"""Near copies of the pipeline's stage: every pair of similarity 0.8 or more, against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from trackweave.llm import common, resemblance, simhash

from .fixtures import documents, empty
from .test_dedup import smallest_reachable


def brute_set(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_roots(texts):
    sets = {i: brute_set(t) for i, t in texts.items()}
    same = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    return smallest_reachable(sets, [(a, b) for a, b in combinations(sorted(sets), 2) if same(sets[a], sets[b])])


def planted():
    """Copies with one to four words changed, at similarities on both sides of 0.8; and a chain."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for k in range(30):
        base = [word() for _ in range(rng.randint(20, 120))]
        rows.append((1000 + 10 * k, " ".join(base), "en"))
        for c in range(1, 5):
            copy = list(base)
            for at in rng.sample(range(len(base)), c):
                copy[at] = word()
            rows.append((1000 + 10 * k + c, " ".join(copy), "en"))
    chain = [word() for _ in range(100)]
    for k in range(20):
        rows.append((2000 + k, " ".join(chain[4 * k :] + [word() for _ in range(4 * k)]), "en"))
    return rows


def test_stage_leaves_no_near_copies(spark):
    docs = documents(spark, planted()).dropDuplicates(["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    kept = stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == set(brute_roots(texts).values())
    assert resemblance.near_copies(empty(spark)).count() == 0


def test_similar_sets_share_a_key():
    """Sets of every size with as many differences as similarity 4/5 allows, and the sketch lets them pass."""
    rng = np.random.default_rng(3)
    for n in [1, 2, 4, 5, 6, 9, 13, 14, 18, 40, 41, 100, 350, 2000, *rng.integers(1, 60, 60).tolist()]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            lose = int(rng.integers(0, len(a) // 9 + 1)) if rng.random() < 0.5 else len(a) // 5
            kept = rng.permutation(a)[lose:]
            room = (5 * len(kept)) // 4 - len(a)  # of new ones, so that kept / all >= 4/5
            b = np.unique(np.concatenate([kept, rng.integers(0, 1 << 63, max(0, int(rng.integers(0, max(room, 0) + 1)))).astype(np.uint64)]))
            if len(b) and resemblance.similar(a, b):
                assert set(resemblance.keys_of(a).tolist()) & set(resemblance.keys_of(b).tolist()), (len(a), len(b))
                assert resemblance.may_be_similar(resemblance.sketch(a), resemblance.sketch(b), len(a) + len(b))
    x, y = (np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64)) for _ in range(2))
    assert not resemblance.may_be_similar(resemblance.sketch(x), resemblance.sketch(y), 600)


@pytest.mark.parametrize("whole, few, block", [(0, 8, 4096), (0, 2, 3), (100, 2, 4096), (1000, 2, 4)])
def test_leaders_lose_nothing(spark, monkeypatch, whole, few, block):
    """The same components by leaders first, by blocks of any size, and with any bound of a few."""
    monkeypatch.setattr(resemblance, "WHOLE", whole)
    monkeypatch.setattr(resemblance, "BLOCK", block)
    monkeypatch.setattr(resemblance, "FEW", few)
    docs = documents(spark, planted()).dropDuplicates(["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["component_id"] for r in resemblance.near_copies(docs).collect()}
    assert got == brute_roots(texts)


def test_stage_goes_by_fingerprints(spark, monkeypatch):
    """SimHash and its Golay keys bring near copies together in the stage; fingerprints are those of the shingle sets."""
    met, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a, **k: met.append(links(*a, **k)) or met[-1])
    base = [f"w{k}" for k in range(400)]
    rows = [(5000 + k, " ".join(base[:-1] + [f"end{k}"]), "en") for k in range(6)] + [(6000 + k, " ".join(f"{k}v{j}" for j in range(50)), "en") for k in range(20)]
    docs = documents(spark, rows).where("doc_id >= 5000")
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert got == {5000, *range(6000, 6020)} and len(met) == 1
    h = resemblance.shingles(rows[0][1].encode())
    assert resemblance.fingerprint(h) & (1 << 64) - 1 == sum((2 * sum(int(x) >> b & 1 for x in h) > len(h)) << b for b in range(64))


def test_group_that_nearly_links_makes_no_pairs(spark, monkeypatch):
    """50 texts that meet in crowded keys, pass their sketches and are not similar: no table names their 1225 pairs.

    But for those of keys with few members and of leaders: these are bounded by the members of keys.
    """
    rng = random.Random(5)
    base, rows = [f"b{k}" for k in range(2000)], []
    for i in range(50):
        copy = list(base)
        for at in rng.sample(range(2000), 28):
            copy[at] = f"d{i}w{at}"
        rows.append((5000 + i, " ".join(copy), "en"))
    sets = [resemblance.shingles(t.encode()) for _, t, _ in rows]
    prints = list(map(resemblance.sketch, sets))
    some = list(combinations(range(50), 2))
    passing = sum(resemblance.may_be_similar(prints[a], prints[b], len(sets[a]) + len(sets[b])) for a, b in some)
    assert passing > 1000 and not any(resemblance.similar(sets[a], sets[b]) for a, b in some)
    made, keep = {}, common.Scratch.keep

    def counted(self, df, name):
        out = keep(self, df, name)
        if out.columns == ["u", "v"]:
            made[name] = out.count()
        return out

    monkeypatch.setattr(common.Scratch, "keep", counted)
    got = {r["doc_id"]: r["component_id"] for r in resemblance.near_copies(documents(spark, rows).where("doc_id >= 5000")).collect()}
    bounded = ("pairs", "passed-few", "met-leaders", "passed-leaders")
    assert got == {i: i for i in range(5000, 5050)} and max(n for k, n in made.items() if k not in bounded) <= 10 * 50, made


def test_blocks_give_forests():
    """A key's block and a clump's block tell a forest, of all that may be similar and of all that is."""
    import pyarrow as pa

    sets = [resemblance.shingles(t.encode()) for _, t, _ in planted() if _ == "en"]
    of = lambda extra, columns: pa.table([[0] * len(sets)] * 4 + [list(range(len(sets)))] + extra, ["key", "low", "high", "block", "cls", *columns])
    pairs = list(combinations(range(len(sets)), 2))
    may = [(a, b) for a, b in pairs if resemblance.may_be_similar(resemblance.sketch(sets[a]), resemblance.sketch(sets[b]), len(sets[a]) + len(sets[b]))]
    may = [(a, b) for a, b in may if 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b]))]
    own = list(range(len(sets)))
    near = of([list(map(len, sets)), own, list(map(resemblance.sketch, sets))], ["size", "root", "sketch"]).to_batches()
    clump = of([own, [h.tobytes() for h in sets]], ["root", "hashes"]).to_batches()
    for batches, step, wanted in ((near, resemblance._clump_blocks, may), (clump, resemblance._link_blocks, [p for p in pairs if resemblance.similar(sets[p[0]], sets[p[1]])])):
        got = [(r["u"], r["v"]) for b in step(iter(batches)) for r in b.to_pylist()]
        roots = smallest_reachable(own, wanted)
        assert smallest_reachable(own, got) == roots and len(got) == len(own) - len(set(roots.values()))
