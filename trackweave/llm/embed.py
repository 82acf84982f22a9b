"""Embedding near-duplicates by a robust-pruned flat graph.

Vectors are compared only within a label.  Equal vectors are one class from
the start, told apart by all their components, and count as often as they
occur.  A label with more classes than a cell holds is cut around pivots, in
as many rounds as it takes; members join every pivot within a margin of their
nearest one.  Pivots and margin are fitted to a sample of the cell, one group
for each cell: the margin is the smallest at which the sample's own links stay
together.  Where none does, or the cell is so dense that its members are
neighbours anyway, the cell is cut into blocks, and every block is compared
with every other one, which is exact at any size.

In a cell, flat graphs are built by robust pruning on overlapping cluster
shards, and the adjacency lists of all shards are united.  Every class
searches the united graph from the medoids of the shards, greedily, and widens
its search as long as the frontier is within reach of the threshold; what it
finds is verified in double precision.  The cell audits itself: a sample of
its members is compared with all of them, and a cell whose recall is below the
target is compared whole.

No list of pairs leaves a cell.  A pair counts in the first of the cells that
both ends share, so each class gets a number of links, besides the smallest
class that its links reach in the cell; rows stay in proportion to the classes.
A last audit compares a stated sample of classes with all rows; labels that
fall short are compared again, block by block.

Rows: vectors that are null, empty, zero, or hold null or non-finite
components, and vectors without label, link with nothing and are their own
component.  So do vectors of unequal length among each other.  Repeated
vec_id values keep a row each; they count as separate vectors.  An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, only

POINTS = "cell string, cls long, n long, embedding array<double>"
PIVOTS = "cell string, fan int, margin double, centres binary"
TALLY = "cls long, links long, root long"
NUMBERS = 1 << 20  # components of the vectors in a block, and in a group that is dealt out
WIDEST = 12  # pivots that a member joins at most
MARGINS = (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.45, 2.0)


def unit(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def robust_prune(sims: np.ndarray, order: np.ndarray, among: np.ndarray, alpha: float, degree: int) -> list[int]:
    """Neighbours from ``order`` (nearest first) that no chosen one makes needless.

    A candidate goes if a chosen neighbour is nearer to it, by the factor
    alpha in distance, than the point itself; among[i, j] are similarities.
    """
    chosen: list[int] = []
    alive = np.ones(len(order), bool)
    far = 1.0 - sims
    for i, p in enumerate(order):
        if not alive[i]:
            continue
        chosen.append(int(p))
        if len(chosen) == degree:
            break
        alive &= alpha * (1.0 - among[i]) > far
    return chosen


def build(x: np.ndarray, degree: int = 10, pool: int = 24, alpha: float = 1.2) -> list[list[int]]:
    """Adjacency lists of unit vectors, with reverse edges pruned to twice the degree."""
    n = len(x)
    out: list[list[int]] = [[] for _ in range(n)]
    pool = min(pool, n - 1)
    if pool < 1:
        return out
    for a in range(0, n, 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), a + np.arange(len(s))] = -np.inf
        best = np.argpartition(-s, pool - 1, axis=1)[:, :pool]
        for i, row in enumerate(best):
            row = row[np.argsort(-s[i, row], kind="stable")]
            out[a + i] = robust_prune(s[i, row], row, x[row] @ x[row].T, alpha, degree)
    back: list[list[int]] = [[] for _ in range(n)]
    for i, near in enumerate(out):
        for j in near:
            back[j].append(i)
    for i in range(n):
        more = [j for j in back[i] if j not in out[i]]
        if len(more) > degree:
            more = np.array(more)
            s = x[more] @ x[i]
            order = np.argsort(-s, kind="stable")
            among = x[more[order]] @ x[more[order]].T
            more = robust_prune(s[order], more[order], among, alpha, degree)
        out[i] += list(more)
    into = np.bincount(np.concatenate([np.asarray(o, np.int64) for o in out]), minlength=n)
    for i in np.flatnonzero(into < 2):  # hubs dropped it: its neighbours with the fewest edges lead to it
        for j in sorted(out[i], key=lambda j: len(out[j]))[:2]:
            if i not in out[j]:
                out[j].append(int(i))
    return out


def search(x: np.ndarray, graph: list[np.ndarray], starts, queries: np.ndarray, reach: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, found) pairs with similarity of at least ``reach``.

    All queries walk together, from all of ``starts``.  Each expands its best
    open node ``beam`` times, and whatever lies within a widened range of the
    threshold at any time, so that a dense neighbourhood is followed to its end.
    """
    n, q = len(x), len(queries)
    width = max(map(len, graph), default=0)
    table = np.full((n, max(width, 1)), -1, np.int64)
    for i, near in enumerate(graph):
        table[i, : len(near)] = near
    small, asked = x.astype(np.float32), queries.astype(np.float32)
    sims = np.full((q, n), -2.0, np.float32)  # -2: not seen
    opened = np.full((q, n), -2.0, np.float32)  # similarity of open nodes, -2 once expanded
    starts = np.atleast_1d(starts)
    sims[:, starts] = opened[:, starts] = asked @ small[starts].T
    wide = reach - 0.5 * (1 - reach) - 1e-6
    steps = 0
    while True:
        who, at = np.nonzero(opened >= wide)  # everything in the widened range at once
        if steps < beam:  # and the best open node of the others
            best = opened.argmax(1)
            alone = opened[np.arange(q), best]
            rest = np.flatnonzero((alone > -2) & (alone < wide))
            who, at = np.concatenate([who, rest]), np.concatenate([at, best[rest]])
        steps += 1
        if not len(who):
            break
        opened[who, at] = -2
        for i in range(0, len(who), 8192):
            near = table[at[i : i + 8192]]
            rows, cols = np.nonzero(near >= 0)
            pair = who[i : i + 8192][rows] * n + near[rows, cols]
            pair = np.unique(pair[sims.ravel()[pair] == -2])
            a, c = pair // n, pair % n
            sims[a, c] = opened[a, c] = np.einsum("ij,ij->i", asked[a], small[c])
    return np.nonzero(sims >= reach - 1e-4)


def centres_of(x: np.ndarray, fan: int) -> np.ndarray:
    """Pivots of unit vectors: members far from each other, then a few rounds of spherical k-means."""
    picked, near = [0], x @ x[0]
    while len(picked) < min(fan, len(x)):
        picked.append(int(near.argmin()))
        near = np.maximum(near, x @ x[picked[-1]])
    centres = x[picked]
    for _ in range(8):
        side = (x @ centres.T).argmax(1)
        for k in range(len(centres)):
            if (side == k).any():
                c = x[side == k].sum(0)
                centres[k] = c / max(np.sqrt(c @ c), 1e-12)
    return centres


def joined(x: np.ndarray, centres: np.ndarray, margin: float) -> np.ndarray:
    """members x pivots: whether a member joins a pivot."""
    s = x @ centres.T
    most = np.sort(s, axis=1)[:, ::-1][:, min(WIDEST, s.shape[1]) - 1]
    return s >= np.maximum(s.max(1) - margin, most)[:, None]


class Roots:
    """Smallest reachable index under links that come in array by array."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:  # jump pointers
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up


class Tally:
    """Links of a cell's members, counted where this cell is the first that both ends share."""

    def __init__(self, pdf: pd.DataFrame):
        self.cell, self.weight = pdf["cell"].iloc[0], pdf["n"].to_numpy()
        self.links, self.roots = np.zeros(len(pdf), np.int64), Roots(len(pdf))
        homes = [sorted(h) for h in pdf["homes"]]
        self.many = np.array([len(h) > 1 for h in homes])
        self.first = np.array([h[0] == self.cell for h in homes])
        names = {c: k for k, c in enumerate(sorted({c for h in homes for c in h}))}
        self.me, width = names[self.cell], max(map(len, homes))
        self.homes = np.full((len(pdf), width), len(names))  # in ascending order
        for i, h in enumerate(homes):
            self.homes[i, : len(h)] = [names[c] for c in h]

    def owned(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        both = np.flatnonzero(self.many[a] & self.many[b])
        for i in range(0, len(both), 1 << 16):
            at = both[i : i + (1 << 16)]
            one, two = self.homes[a[at]], self.homes[b[at]]
            shared = (one[:, :, None] == two[:, None, :]).any(2)
            out[at] = one[np.arange(len(at)), shared.argmax(1)] == self.me
        return out

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Verified links, each once."""
        self.roots.link(a, b)
        mine = self.owned(a, b)
        np.add.at(self.links, a[mine], self.weight[b[mine]])
        np.add.at(self.links, b[mine], self.weight[a[mine]])

    def rows(self, ids: np.ndarray) -> pd.DataFrame:
        out = pd.DataFrame({"cls": ids, "links": self.links, "root": ids[self.roots.root]})
        return out[(out["links"] > 0) | (out["root"] != out["cls"])]


def compare(x: np.ndarray, tally: Tally, reach: float, one: np.ndarray, two: np.ndarray | None = None) -> None:
    """All links between two sets of members (indices), or inside one."""
    y = x[one if two is None else two]
    for at in range(0, len(one), 512):
        i, j = np.nonzero(x[one[at : at + 512]] @ y.T >= reach)
        if two is None:
            i, j = i[at + i < j], j[at + i < j]
        tally.add(one[at + i], (one if two is None else two)[j])


def graph_of(x: np.ndarray, shard_rows: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(united adjacency lists, medoids) of graphs built on overlapping cluster shards, and the medoids of finer clusters."""
    n, united = len(x), [set() for _ in range(len(x))]
    some = x[np.random.default_rng(n).permutation(n)[:2000]]
    near = np.argsort(-(x @ centres_of(some, -(-2 * n // shard_rows)).T), axis=1)[:, :3]
    medoids = (x @ centres_of(some, -(-n // 48)).T).argmax(0).tolist()
    for k in range(near.max() + 1):
        members = np.flatnonzero((near == k).any(1))
        if len(members):
            y = x[members]
            medoids.append(int(members[(y @ y.mean(0)).argmax()]))
            for i, own in zip(members.tolist(), build(y)):
                united[i].update(members[own].tolist())
    return [np.fromiter(sorted(u), np.int64, len(u)) for u in united], np.unique(medoids)


def _link_cell(reach: float, shard_rows: int, beam: int, target: float, audited: int = 64, block: int = 256):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cls", ignore_index=True)
        x, ids, n = unit(pdf["embedding"]), pdf["cls"].to_numpy(), len(pdf)
        asked = np.random.default_rng(n).permutation(n)[:audited]
        true = x[asked] @ x.T >= reach
        true[np.arange(len(asked)), asked] = False
        pairs = None
        if true.mean() <= 0.1:  # else members are neighbours, and walking a graph costs more than comparing
            graph, medoids = graph_of(x, shard_rows)
            found = []
            for a in range(0, n, block):
                q, f = search(x, graph, medoids, x[a : a + block], reach, beam)
                q, f = (q + a)[q + a != f], f[q + a != f]
                ok = np.einsum("ij,ij->i", x[q], x[f]) >= reach  # double precision
                found.append(np.minimum(q[ok], f[ok]) * n + np.maximum(q[ok], f[ok]))
            pairs = np.unique(np.concatenate(found))
            i, j = np.nonzero(true)
            codes = np.minimum(asked[i], j) * n + np.maximum(asked[i], j)
            if len(codes) and np.isin(codes, pairs).mean() < target:
                pairs = None
        tally = Tally(pdf)
        if pairs is None:
            compare(x, tally, reach, np.arange(n))
        for at in range(0, 0 if pairs is None else len(pairs), 1 << 20):
            tally.add(pairs[at : at + (1 << 20)] // n, pairs[at : at + (1 << 20)] % n)
        return tally.rows(ids)

    return run


def _inside_block(reach: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """The members of a block with their links inside it and the smallest class that these reach."""
        pdf = pdf.sort_values("cls", ignore_index=True)
        tally = Tally(pdf)
        compare(unit(pdf["embedding"]), tally, reach, np.arange(len(pdf)))
        return pdf.assign(links=tally.links, root=pdf["cls"].to_numpy()[tally.roots.root])

    return run


def core(x: np.ndarray, tally: Tally, reach: float) -> np.ndarray:
    """Members so near to the middle that any two of them link, by the angles; of those that count here first."""
    middle = x.mean(0)
    length = np.sqrt(middle @ middle)
    if length < 1e-9:
        return np.zeros(len(x), bool)
    return tally.first & (x @ (middle / length) >= np.sqrt((1 + reach) / 2) + 1e-9)


def _across_blocks(reach: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links between two blocks: their number for each member, and one of each two roots that they connect."""
        x, tally = unit(pdf["embedding"]), Tally(pdf)
        low = pdf["block"].to_numpy() == pdf["block"].min()
        tight = core(x, tally, reach)
        a, b, c, d = (np.flatnonzero(m) for m in (low & tight, low & ~tight, ~low & tight, ~low & ~tight))
        if len(a) and len(c):  # every a links with every c
            tally.links[a] += tally.weight[c].sum()
            tally.links[c] += tally.weight[a].sum()
            tally.roots.link(np.concatenate([a, c]), np.full(len(a) + len(c), a[0]))
        compare(x, tally, reach, b, np.concatenate([c, d]))
        compare(x, tally, reach, d, a)
        own = pdf["root"].to_numpy()
        known, at = np.unique(own, return_inverse=True)
        met = pd.DataFrame({"cls": own, "root": known[at[tally.roots.root]]}).drop_duplicates()
        met = met[met["cls"] != met["root"]].assign(links=0)
        counts = pd.DataFrame({"cls": pdf["cls"], "links": tally.links})
        counts = counts[counts["links"] > 0]
        return pd.concat([counts.assign(root=counts["cls"]), met])[["cls", "links", "root"]]

    return run


def blockwise(points: DataFrame, reach: float, scratch: Scratch, name: str) -> DataFrame:
    """TALLY of cells by comparing all blocks of a cell with each other; points: POINTS and homes."""
    sizes = points.groupBy("cell").agg(F.count("*").alias("total"), F.max(F.size("embedding")).alias("dim"))
    sizes = sizes.select("cell", F.expr(f"ceil(total / greatest(1024, {NUMBERS} div dim))").cast("int").alias("blocks"))
    cut = points.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("cls", F.lit("block")), F.col("blocks")).cast("int"))
    schema = f"{POINTS}, homes array<string>, blocks int, block int, links long, root long"
    inside = scratch.keep(cut.groupBy("cell", "block").applyInPandas(_inside_block(reach), schema), f"{name}-inside")
    other = inside.where("blocks > 1").withColumn("other", F.explode(F.expr("filter(sequence(0, blocks - 1), k -> k <> block)")))
    other = other.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    across = other.groupBy("cell", "low", "high").applyInPandas(_across_blocks(reach), TALLY)
    return inside.select("cls", "links", "root").where("links > 0 OR root <> cls").union(across)


def _fit(reach: float, rows: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Pivots of a cell from a sample of it; none where blocks are to be compared."""
        x, name, total = unit(pdf["embedding"]), pdf["cell"].iloc[0], int(pdf["total"].iloc[0])
        a, b = np.nonzero(np.triu(x @ x.T >= reach, 1))
        out = 0, 0.0, b""
        if len(a) <= 0.1 * len(x) * (len(x) - 1) / 2:
            centres = centres_of(x, min(max(8, -(-8 * total // rows)), 64))
            for margin in MARGINS if len(a) >= 20 else (0.15,):
                member = joined(x, centres, margin)
                if member.mean(0).max() > 0.7:
                    break
                if len(a) < 20 or (member[a] & member[b]).any(1).mean() >= 0.98:
                    out = len(centres), margin, centres.tobytes()
                    break
        return pd.DataFrame([(name, *out)], columns=["cell", "fan", "margin", "centres"])

    return run


def _deal(pdf: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    columns = ["cell", "cls", "n", "embedding"]
    if not len(pdf) or not len(pivots):
        return pdf[columns]
    p, name = pivots.iloc[0], pdf["cell"].iloc[0]
    if not p["fan"]:
        return pdf[columns].assign(cell="a" + name[1:])
    centres = np.frombuffer(p["centres"]).reshape(p["fan"], -1)
    who, k = np.nonzero(joined(unit(pdf["embedding"]), centres, p["margin"]))
    return pdf.iloc[who][columns].assign(cell=[f"{name}/{c}" for c in k.tolist()])


def cells(points: DataFrame, reach: float, scratch: Scratch, rows: int, sample: int = 2000, most: int = 8) -> DataFrame:
    """POINTS in overlapping cells of at most ``rows`` classes, whose names begin with b, and cells for blocks, with a."""
    for level in range(most + 1):
        sizes = points.where("cell LIKE 'b%'").groupBy("cell").agg(F.count("*").alias("total"), F.max(F.size("embedding")).alias("dim"))
        large = scratch.keep(sizes.where(F.col("total") > rows), f"large-{level}")
        if large.isEmpty():
            return points
        here = points.join(large, "cell").withColumn("parts", F.expr(f"ceil(total / greatest(1024, {NUMBERS} div dim))").cast("int"))
        if level < most:
            some = here.where(F.pmod(F.xxhash64("cls", F.lit(level)), F.col("total")) < sample)
            pivots = scratch.keep(some.select("cell", "total", "embedding").groupBy("cell").applyInPandas(_fit(reach, rows), PIVOTS), f"pivots-{level}")
        else:
            pivots = large.selectExpr("cell", "0 AS fan", "0D AS margin", "binary('') AS centres")
        parts = large.select("cell", F.expr(f"ceil(total / greatest(1024, {NUMBERS} div dim))").cast("int").alias("parts"))
        pivots = pivots.join(parts, "cell").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).drop("parts")
        here = here.withColumn("part", F.pmod(F.xxhash64("cls", F.lit("deal")), F.col("parts")).cast("int"))
        here = here.select("cell", "part", "cls", "n", "embedding")
        dealt = here.groupBy("cell", "part").cogroup(pivots.groupBy("cell", "part")).applyInPandas(_deal, POINTS)
        rest = points.join(large.select("cell"), "cell", "left_anti").select("cell", "cls", "n", "embedding")
        points = scratch.keep(rest.union(dealt), f"points-{level}")
        if level:
            scratch.drop(f"points-{level - 1}")
    return points


def usable(vectors: DataFrame) -> DataFrame:
    e = F.col("embedding")
    fine = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.where(e.isNotNull() & F.col("label").isNotNull() & fine & F.exists(e, lambda c: c != 0))


def audit(classes: DataFrame, counts: DataFrame, reach: float, queries: int) -> dict:
    """label -> (links found, true links) of a hash sample of classes, compared with all rows."""
    some = classes.orderBy(F.xxhash64("cls", F.lit("audit"))).limit(queries).select("cls", "label", "embedding").toPandas()
    if not len(some):
        return {}
    asked = {}
    for (label, size), part in some.groupby(["label", some["embedding"].map(len)]):
        asked[label, size] = part["cls"].to_numpy(), unit(part["embedding"])
    shared = classes.sparkSession.sparkContext.broadcast(asked)

    def brute(batches):
        for pdf in batches:
            out = [pd.DataFrame({"cls": [], "true": []})]
            for key, mine in pdf.groupby(["label", pdf["embedding"].map(len)]) if len(pdf) else ():
                if key in shared.value:
                    ids, y = shared.value[key]
                    met = (y @ unit(mine["embedding"]).T >= reach) & (ids[:, None] != mine["cls"].to_numpy()[None])
                    out.append(pd.DataFrame({"cls": ids, "true": met @ mine["n"].to_numpy()}))
            yield pd.concat(out).astype("int64")

    true = classes.select("cls", "label", "n", "embedding").mapInPandas(brute, "cls long, true long").groupBy("cls").agg(F.sum("true").alias("true"))
    named = true.join(classes.select("cls", "label"), "cls").join(counts, "cls", "left")
    rows = named.groupBy("label").agg(F.sum(F.coalesce("links", F.lit(0))).alias("found"), F.sum("true").alias("true")).collect()  # labels of the sample
    return {r["label"]: (r["found"], r["true"]) for r in rows}


def share(found: dict) -> float:
    got, true = (sum(v[k] for v in found.values()) for k in (0, 1))
    return got / true if true else 1.0


def link(classes: DataFrame, scratch: Scratch, reach: float, cell_rows: int, shard_rows: int, beam: int, target: float, audited: int) -> tuple[DataFrame, DataFrame, float]:
    """((cls, links), spanning links (u, v), audited recall) of classes (cls, label, embedding, n)."""
    name = F.concat(F.lit("b|"), F.col("label").cast("string"), F.lit(":"), F.size("embedding").cast("string"))
    whole = classes.select(name.alias("cell"), "cls", "n", "embedding")
    points = cells(whole, reach, scratch, cell_rows)
    homes = scratch.keep(points.groupBy("cls").agg(F.collect_set("cell").alias("homes")), "homes")  # WIDEST a round at most
    points = points.join(homes, "cls").select("cell", "cls", "n", "embedding", "homes")
    walked = points.where("cell LIKE 'b%'").groupBy("cell").applyInPandas(_link_cell(reach, shard_rows, beam, target), TALLY)
    met = scratch.keep(walked.union(blockwise(points.where("cell LIKE 'a%'"), reach, scratch, "dense")), "met")
    counts = scratch.keep(met.groupBy("cls").agg(F.sum("links").alias("links")), "counts")
    found = audit(classes, counts, reach, audited)
    if share(found) < target:  # labels that fall short: every block with every block
        short = F.col("label").isin([k for k, (got, true) in found.items() if got < target * true])
        again = whole.join(classes.where(short).select("cls"), "cls", "left_semi").withColumn("homes", F.array("cell"))
        more = scratch.keep(blockwise(again.select("cell", "cls", "n", "embedding", "homes"), reach, scratch, "short"), "met-again")
        rest = met.join(classes.where(~short).select("cls"), "cls", "left_semi")
        met = scratch.keep(rest.union(more), "met-all")
        counts = scratch.keep(met.groupBy("cls").agg(F.sum("links").alias("links")), "counts-all")
        found = audit(classes, counts, reach, audited)
    return counts, met.select(F.col("cls").alias("u"), F.col("root").alias("v")).where("u <> v"), share(found)


def near_duplicates(vectors: DataFrame, *, reach: float = 0.93, cell_rows: int = 6000, shard_rows: int = 300, beam: int = 8,
                    target: float = 0.97, audited: int = 512) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall_audit) of every vector."""
    scratch = Scratch(vectors.sparkSession, "embed")
    rows = only(vectors, "vec_id", "embedding", "label").withColumn("embedding", F.expr("transform(embedding, x -> double(x) + 0.0D)"))
    grouped = usable(rows).groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = scratch.keep(grouped.withColumn("cls", F.monotonically_increasing_id()), "classes")
    counts, links, recall = link(classes, scratch, reach, cell_rows, shard_rows, beam, target, audited)
    rooted = components(links, scratch).withColumnRenamed("node", "cls")
    named = classes.select("cls", "least", "n").join(rooted, "cls", "left").join(counts, "cls", "left")
    named = scratch.keep(named.select("cls", "least", "n", F.coalesce("links", F.lit(0).cast("long")).alias("links"), F.coalesce("root", "cls").alias("root")), "named")
    lowest = scratch.keep(named.groupBy("root").agg(F.min("least").alias("component_id")), "lowest")
    final = scratch.keep(named.join(lowest, "root").select("cls", (F.col("links") + F.col("n") - 1).alias("links"), "component_id"), "final")
    key = classes.select(F.xxhash64("label", "embedding").alias("k"), F.col("label").alias("l"), F.col("embedding").alias("e"), "cls")
    keyed = rows.withColumn("h", F.xxhash64("label", "embedding"))
    same = (F.col("h") == F.col("k")) & (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e"))
    mapped = scratch.keep(keyed.join(key, same, "left").select("vec_id", "cls"), "mapped")
    out = mapped.join(final, "cls", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
        F.lit(float(recall)).alias("recall_audit"),
    )
