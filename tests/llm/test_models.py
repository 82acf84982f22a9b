"""Quality, language and embeddings: accuracy on held-out rows, recall against brute force."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.llm import embed, grams, kneser_ney, langid

from .fixtures import documents, empty

SYLLABLES = {"en": ["the", "ing", "er", "th", "and", "st"], "fr": ["é", "eau", "la", "ou", "è", "que"], "de": ["sch", "ung", "ü", "ein", "ß", "der"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


def corpus(spark, n=600):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        text, good = prose(rng, lang, rng.randint(15, 80)), rng.random() < 0.8
        if not good:
            text = rng.choice([text.upper().replace(" ", "!! "), " | ".join(text.split()) + " | %%% $$$", text.replace(" ", "### ")])
        rows.append((i, text, lang))
        if i % 2:
            labels.append((i, int(good), 0))
    return rows, labels


def test_blocks_cover_every_byte():
    texts = [b"", b"abc", b"d" * 25, b"", b"ef"]
    for block in (1, 4, 7, 100):
        back = [b""] * len(texts)
        for data, starts, ends, owners in grams.blocks(texts, 2, block):
            sums = grams.segment_sums(data.astype(np.int64), starts, ends)
            for a, b, o, s in zip(starts, ends, owners, sums):
                want = (b"\n\n" + texts[o])[len(back[o]) : len(back[o]) + 2]
                assert bytes(data[a - 2 : a]) == want and s == sum(data[a:b].tolist())
                back[o] += bytes(data[a:b])
        assert back == texts


def brute_kneser_ney(texts, order, size):
    """Interpolated modified Kneser-Ney by dictionaries; texts are lists of symbols."""
    from collections import Counter, defaultdict

    counts = Counter()
    for t in texts:
        padded = [t[0]] * (order - 1) + t[1:]
        for i in range(order - 1, len(padded)):
            counts[tuple(padded[i - order + 1 : i + 1])] += 1
    levels = {order: counts}
    for m in range(order - 1, 0, -1):
        levels[m] = Counter(g[1:] for g in levels[m + 1])
    steps = {}
    for m, c in levels.items():
        how = Counter(c.values())
        n1, n2, n3, n4 = (how.get(k, 0) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
        d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        d = [min(max(x, 0.05), top) for x, top in zip(d, (0.95, 1.95, 2.95))]
        total, taken = defaultdict(int), defaultdict(float)
        for g, n in c.items():
            total[g[:-1]] += n
            taken[g[:-1]] += d[min(n, 3) - 1]
        steps[m] = c, d, total, taken

    def p(gram):
        if not gram:
            return 1 / size
        c, d, total, taken = steps[len(gram)]
        below = p(gram[1:])
        if gram[:-1] not in total:
            return below
        n = c.get(gram, 0)
        return (n - d[min(n, 3) - 1] if n else 0) / total[gram[:-1]] + taken[gram[:-1]] / total[gram[:-1]] * below

    return p


def folded_symbols(text):
    """A line feed, which pads a text, and its bytes with capitals and digits folded."""
    fold = lambda b: 65 if 65 <= b < 91 else 48 if 48 <= b < 58 else b
    return [10] + [fold(b) for b in text.encode()]


def test_perplexity_and_decisions_against_brute_force(spark, monkeypatch):
    """Perplexity, threshold and decision of every document, by dictionaries and numpy; chunks of a few texts."""
    monkeypatch.setattr(kneser_ney, "CHUNK", 2000)
    rng = random.Random(7)
    rows = [(i, prose(rng, lang, rng.randint(3, 25)), lang) for i in range(120) for lang in [rng.choice(["en", "fr"])]]
    rows += [(200, "Zz9 " * 40, "en"), (201, "日本語 \x01", None), (202, "", "en"), (203, None, "fr"), (204, "the ether", "de"), (None, "the", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0), int(i % 7 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    trusted = {i for i in range(120) if i % 5 and i % 7}
    half = {r["id"]: r["h"] % 2 == 0 for r in spark.range(120).select("id", (F.xxhash64("id") % 2).alias("h")).collect()}
    p = brute_kneser_ney([folded_symbols(t) for i, t, _ in rows if i in trusted and half[i]], kneser_ney.ORDER, 256)
    n_before = kneser_ney.ORDER - 1
    nll = {}
    for i, t, _ in rows:
        if t:
            s = [10] * n_before + folded_symbols(t)[1:]
            nll[i] = np.mean([-np.log(p(tuple(s[k - n_before : k + 1]))) for k in range(n_before, len(s))])
    size = {i: len((t or "").encode()) for i, t, _ in rows}
    groups = {lang: [i for i, _, own in rows if i in trusted and not half[i] and lang in ("", own)] for lang in ("", "en", "fr")}
    limit = {}
    for lang, held in groups.items():
        mean = sum(nll[i] * size[i] for i in held) / sum(size[i] for i in held)
        over = [(nll[i] - mean) / (0.03 + size[i] ** -0.5) for i in held]
        limit[lang] = mean, np.quantile(over, 0.9)
    got = {r["doc_id"]: r for r in kneser_ney.classify(docs, labels, quantile=0.9, least=10).collect()}
    assert len(got) == len(rows)
    rejected = 0
    for i, t, lang in rows:
        if not t:
            assert got[i]["perplexity"] is None and got[i]["kept"]
            continue
        mean, top = limit.get(lang, limit[""])
        over = (nll[i] - mean) / (0.03 + size[i] ** -0.5)
        assert got[i]["perplexity"] == pytest.approx(np.exp(nll[i]), rel=1e-5)
        assert got[i]["excess"] == pytest.approx(over, abs=1e-4) and got[i]["threshold"] == pytest.approx(top, abs=2e-4)
        assert abs(over - top) < 1e-3 or got[i]["kept"] == (over < top)
        rejected += not got[i]["kept"]
    assert rejected >= 5 and not got[200]["kept"]


def test_quality(spark):
    rows, labels = corpus(spark)
    docs = documents(spark, [(1000 + i, t, lang) for i, t, lang in rows])
    marks = spark.createDataFrame([(1000 + i, q, t) for i, q, t in labels] + [(1000, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in kneser_ney.classify(docs, marks).collect()}
    bad = {1000 + i for i, t, _ in rows if "!!" in t or "$$$" in t or "###" in t}
    kept = {i for i, r in got.items() if i >= 1000 and r["kept"]}
    assert len(kept & bad) <= 0.05 * len(bad)
    assert len(kept - bad) >= 0.99 * (len(rows) - len(bad))
    assert got[40]["kept"] and got[40]["perplexity"] is None and len(got) == docs.select("doc_id").distinct().count()
    assert kneser_ney.classify(empty(spark), marks).count() == 0
    assert all(r["kept"] for r in kneser_ney.classify(docs, marks.limit(0)).collect())
    assert kneser_ney.keepers(docs, marks).columns == docs.columns


def test_langid(spark):
    rows, _ = corpus(spark)
    docs = documents(spark, [(1000 + i, t, lang if i % 50 else None) for i, t, lang in rows] + [(None, "the thing", "en"), (5000, "١٢٣ — 42 …", "fr")])
    got = langid.identify(docs)
    by = {r["doc_id"]: r for r in got.collect()}
    held = [(by[1000 + i]["lang_pred"], lang) for i, _, lang in rows if by[1000 + i]["held_out"]]
    assert len(held) > 100 and sum(a == b for a, b in held) >= 0.98 * len(held)
    assert all(r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for i, r in by.items())
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (40, 41, 42, 5000))
    assert all(0 <= r["score"] <= 1 for r in by.values()) and got.count() == docs.count()
    assert langid.identify(empty(spark)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_codewords():
    for n in (1, 2, 4, 7, 8, 40):
        code = langid.codewords(n)
        assert len({tuple(r) for r in code.tolist()}) == n
        if n > 2:
            assert (code[:, None] != code[None]).sum(2)[np.triu_indices(n, 1)].min() >= 3 - (n == 3)


def vectors(spark, n=1500):
    rng = np.random.default_rng(3)
    rows = []
    base = rng.normal(size=(n, 16))
    for i in range(n):
        v = base[i] if i % 3 else base[i // 9] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.35])
        rows.append((i, v.astype("float32").tolist(), int(i % 7 % 3)))
    near = base[0] + rng.normal(size=(250, 16)) * 0.1
    rows += [(10_000 + i, v.astype("float32").tolist(), 0) for i, v in enumerate(near)]
    rows += [(20_000 + i, rows[5][1], 1) for i in range(40)] + [(5, rows[5][1], 1)]
    odd = [None, [], [0.0] * 16, [None] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15]
    rows += [(30_000 + i, v, 1) for i, v in enumerate(odd)] + [(30_100, rows[3][1], None), (30_101, rows[3][1], None), (30_102, [1.0, 2.0], 1), (30_103, [2.0, 4.0], 1)]
    return rows, spark.createDataFrame([(*r, "cls", 1) for r in rows], "vec_id long, embedding array<float>, label int, shard string, n int")


def test_embeddings(spark):
    rows, df = vectors(spark)
    got = embed.near_duplicates(df, cell_rows=300, shard_rows=150).collect()
    assert len(got) == len(rows)
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links, degree = [], [0] * len(good)
    for size in {len(v) for _, v, _ in good}:
        at = [k for k, g in enumerate(good) if len(g[1]) == size]
        x = np.stack([good[k][1] / np.linalg.norm(good[k][1]) for k in at])
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.93, 1))):
            a, b = at[a], at[b]
            if good[a][2] == good[b][2]:
                links.append((good[a][0], good[b][0]))
                degree[a] += 1
                degree[b] += 1
    found = sum(r["n_links"] for r in got) / 2
    assert 0.97 * len(links) <= found <= len(links)
    want = {}
    for (i, _, _), d in zip(good, degree):
        want.setdefault(i, []).append(d)
    assert all(r["n_links"] <= max(want.get(r["vec_id"], [0])) for r in got)
    from .test_dedup import smallest_reachable

    comp = smallest_reachable([r[0] for r in rows], links)
    assert sum(r["component_id"] == comp[r["vec_id"]] for r in got) >= 0.97 * len(got)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert embed.near_duplicates(df.limit(0)).count() == 0


def test_search_widens_over_dense_groups():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(200, 12)), rng.normal(size=12) + 0.05 * rng.normal(size=(300, 12))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = [np.array(a, np.int64) for a in embed.build(x, degree=8, pool=24)]
    q, f = embed.search(x, graph, int((x @ x.mean(0)).argmax()), x, 0.93, 16)
    true = set(zip(*map(list, np.nonzero(x @ x.T >= 0.93))))
    assert len(true & set(zip(q.tolist(), f.tolist()))) >= 0.97 * len(true)
