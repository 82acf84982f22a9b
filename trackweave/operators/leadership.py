"""Directional correlation with delays, the leadership digraph and its consistency."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import graphs
from ..schema import MEMBER, PERIOD, TICK, along, coords

PAIR = [*PERIOD, "a", "b"]


def unit(x: Column, y: Column) -> tuple[Column, Column]:
    """A vector as length one; null for the zero vector."""
    n = F.sqrt(x * x + y * y)
    n = F.when(n > 0, n)
    return x / n, y / n


def headings(df: DataFrame, kind: str = "utm") -> DataFrame:
    """Position and unit heading (hx, hy) of each member."""
    x, y = coords(kind)
    w = along()
    hx, hy = unit(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w))
    return df.select(*MEMBER, "t", F.col(x).alias("x"), F.col(y).alias("y"), hx.alias("hx"), hy.alias("hy"))


def group_heading(df: DataFrame, kind: str = "utm") -> DataFrame:
    """Unit heading (fx, fy) of the members' mean position."""
    x, y = coords(kind)
    c = df.groupBy(*TICK).agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"))
    w = along(*PERIOD)
    fx, fy = unit(F.col("cx") - F.lag("cx").over(w), F.col("cy") - F.lag("cy").over(w))
    return c.select(*TICK, fx.alias("fx"), fy.alias("fy"))


def delays(df: DataFrame, kind: str = "utm", threshold: float = 10.0, window: int = 9) -> DataFrame:
    """(squad, period, a, b, t, delay, dot) for each pair a < b and window start t.

    A window counts if the pair is within ``threshold`` along the group's
    heading at all of its samples.  a's heading in the middle is compared with
    b's at every offset; delay is the first offset with the largest dot
    product, positive if b follows a.
    """
    half = window // 2
    h = headings(df, kind)
    a = h.select(*PERIOD, "t", F.col("member_id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("hx").alias("ahx"), F.col("hy").alias("ahy"))
    b = h.select(*PERIOD, "t", F.col("member_id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("hx").alias("bhx"), F.col("hy").alias("bhy"))
    both = a.join(b, TICK).where("a < b").join(group_heading(df, kind), TICK)
    along_group = (F.col("ax") - F.col("bx")) * F.col("fx") + (F.col("ay") - F.col("by")) * F.col("fy")
    near = F.coalesce(F.abs(along_group) <= threshold, F.lit(False))
    w = Window.partitionBy(*PAIR).orderBy("t")
    frame = w.rowsBetween(0, window - 1)
    held = both.withColumn("near", near)
    best = []
    for k in range(-half, window - half):
        lead = lambda c, k=k: F.lead(c, half + k).over(w)
        dot = F.lead("ahx", half).over(w) * lead("bhx") + F.lead("ahy", half).over(w) * lead("bhy")
        best.append(F.struct(dot.alias("dot"), F.lit(-k).alias("k")))
    full = (F.count("*").over(frame) == window) & F.bool_and("near").over(frame)
    found = held.select(*PAIR, "t", F.count("*").over(frame).alias("_n"), full.alias("_full"), F.array(*best).alias("_all"))
    found = found.where(F.col("_n") == window)
    top = F.array_max(F.filter("_all", lambda s: s["dot"].isNotNull()))
    found = found.withColumn("_top", F.when(F.col("_full"), top))
    return found.select(*PAIR, "t", (-F.col("_top.k")).alias("delay"), F.col("_top.dot").alias("dot"))


def edges(delayed: DataFrame, level: float = 0.99) -> DataFrame:
    """(squad, period, src, dst, weight): leader to follower, by the mean delay of highly correlated windows."""
    mean = F.avg(F.when(F.col("dot") > level, F.col("delay")))
    e = delayed.groupBy(*PAIR).agg(mean.alias("m")).where("m <> 0")
    ahead = F.col("m") > 0
    return e.select(*PERIOD, F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("dst"), F.abs("m").alias("weight"))


def delay_samples(delayed: DataFrame, level: float = 0.99) -> DataFrame:
    """(squad, period, member_id, delay): each highly correlated delay for a, and negated for b."""
    high = delayed.where(F.col("dot") > level)
    a = high.select(*PERIOD, F.col("a").alias("member_id"), "delay")
    return a.unionByName(high.select(*PERIOD, F.col("b").alias("member_id"), (-F.col("delay")).alias("delay")))


def leadership(delayed: DataFrame, level: float = 0.99) -> DataFrame:
    """Pooled mean delay of each member over all periods."""
    return delay_samples(delayed, level).groupBy("squad_id", "member_id").agg(F.avg("delay").alias("leadership"))


def correlated_share(delayed: DataFrame, mode: str = "clean", window: int = 6, level: float = 0.99) -> DataFrame:
    """(squad, period, a, b, entry, hcs): highly correlated share of a pair's time in proximity.

    The rolling mean of the best dot products is taken.  A pair never in
    proximity is null.  reference: a pair with share 0 has two entries, 0 and
    its share, which is null if no full rolling window exists.
    """
    w = Window.partitionBy(*PAIR).orderBy("t").rowsBetween(-(window - 1), 0)
    rolled = delayed.withColumn("r", F.when(F.count("dot").over(w) == window, F.avg("dot").over(w)))
    g = rolled.groupBy(*PAIR).agg(F.count("dot").alias("any"), F.count("r").alias("prox"), F.count_if(F.col("r") > level).alias("high"))
    share = F.when(F.col("prox") > 0, F.col("high") / F.nullif("prox", F.lit(0)))
    if mode == "clean":
        return g.select(*PAIR, F.lit(0).alias("entry"), F.when(F.col("any") > 0, share).alias("hcs"))
    none = F.array(F.struct(F.lit(0).alias("entry"), F.lit(None).cast("double").alias("hcs")))
    one = F.array(F.struct(F.lit(0).alias("entry"), share.alias("hcs")))
    two = F.array(F.struct(F.lit(0).alias("entry"), F.lit(0.0).alias("hcs")), F.struct(F.lit(1).alias("entry"), share.alias("hcs")))
    rows = F.when(F.col("any") == 0, none).when((F.col("high") == 0) | (F.col("prox") == 0), two).otherwise(one)
    return g.select(*PAIR, F.explode(rows).alias("e")).select(*PAIR, "e.entry", "e.hcs")


def member_share(shares: DataFrame) -> DataFrame:
    """HCS of each member: mean over its pairs per entry, then over entries and periods."""
    both = shares.select(*PERIOD, F.col("a").alias("member_id"), "entry", "hcs").unionByName(shares.select(*PERIOD, F.col("b").alias("member_id"), "entry", "hcs"))
    rows = both.groupBy(*MEMBER, "entry").agg(F.avg("hcs").alias("hcs"))
    return rows.groupBy("squad_id", "member_id").agg(F.avg("hcs").alias("hcs"))


def hierarchy_quality(graph: DataFrame, delayed: DataFrame) -> DataFrame:
    """Share of edges that run from the larger to the smaller mean delay, of those with unequal ones."""
    mean = delay_samples(delayed).groupBy(*MEMBER).agg(F.avg("delay").alias("d"))
    src = mean.select(*PERIOD, F.col("member_id").alias("src"), F.col("d").alias("ds"))
    dst = mean.select(*PERIOD, F.col("member_id").alias("dst"), F.col("d").alias("dd"))
    e = graph.join(src, [*PERIOD, "src"]).join(dst, [*PERIOD, "dst"])
    return e.groupBy(*PERIOD).agg((F.count_if(F.col("ds") > F.col("dd")) / F.nullif(F.count_if(F.col("ds") != F.col("dd")), F.lit(0))).alias("quality"))


def _per_period(graph: DataFrame, fn, column: str) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in graph.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        value = fn(list(zip(pdf["src"].tolist(), pdf["dst"].tolist())))
        return pd.DataFrame({"squad_id": [pdf.squad_id.iloc[0]], "period_id": [pdf.period_id.iloc[0]], column: [value]})

    return graph.groupBy(*PERIOD).applyInPandas(run, f"squad_id {types['squad_id']}, period_id {types['period_id']}, {column} long")


def simple_cycles(graph: DataFrame) -> DataFrame:
    """Number of simple cycles of each period's digraph."""
    return _per_period(graph, graphs.simple_cycles, "cycles")


def period_minutes(df: DataFrame) -> DataFrame:
    return df.groupBy(*PERIOD).agg(F.floor((F.max("t") + 1) / 60).cast("int").alias("minutes"))


def edit_distances(graph: DataFrame, nodes: DataFrame, periods: DataFrame) -> DataFrame:
    """(squad, p1, p2, edits, ratio): unlabelled edit distance of each pair of periods' digraphs.

    nodes: (squad_id, member_id); periods: (squad_id, period_id).  ratio is to
    the mean number of edges, null without edges.  A squad has few members;
    the search over their matchings is branch and bound.
    """
    squad = graph.schema["squad_id"].dataType.simpleString()
    period = graph.schema["period_id"].dataType.simpleString()
    size = nodes.groupBy("squad_id").agg(F.countDistinct("member_id").alias("n"))
    lists = graph.groupBy(*PERIOD).agg(F.collect_list(F.array(F.col("src").cast("string"), F.col("dst").cast("string"))).alias("e"))
    full = periods.join(lists, PERIOD, "left").join(size, "squad_id")
    one = full.select("squad_id", F.col("period_id").alias("p1"), F.col("e").alias("e1"), "n")
    two = full.select("squad_id", F.col("period_id").alias("p2"), F.col("e").alias("e2"))
    pairs = one.join(two, "squad_id").where("p1 < p2")

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                e1, e2 = ([tuple(x) for x in (e if e is not None else [])] for e in (r.e1, r.e2))
                d = graphs.edit_distance(e1, e2, int(r.n))
                mean = (len(e1) + len(e2)) / 2
                rows.append((r.squad_id, r.p1, r.p2, d, d / mean if mean else None))
            yield pd.DataFrame(rows, columns=["squad_id", "p1", "p2", "edits", "ratio"])

    return pairs.mapInPandas(run, f"squad_id {squad}, p1 {period}, p2 {period}, edits long, ratio double")


def adjacency_change(graph: DataFrame, nodes: DataFrame, periods: DataFrame) -> DataFrame:
    """(squad, p1, p2, member_id, change): root mean square change of a member's signed edge weights."""
    signed = graph.select(*PERIOD, "src", "dst", "weight").unionByName(
        graph.select(*PERIOD, F.col("dst").alias("src"), F.col("src").alias("dst"), (-F.col("weight")).alias("weight"))
    )
    a = periods.withColumnRenamed("period_id", "p1").join(periods.withColumnRenamed("period_id", "p2"), "squad_id").where("p1 < p2")
    grid = a.join(nodes.select("squad_id", F.col("member_id").alias("dst")), "squad_id").join(nodes.select("squad_id", F.col("member_id").alias("src")), "squad_id")
    for p in ("1", "2"):
        grid = grid.join(signed.select("squad_id", F.col("period_id").alias(f"p{p}"), "src", "dst", F.col("weight").alias(f"w{p}")), ["squad_id", f"p{p}", "src", "dst"], "left")
    d = F.coalesce("w1", F.lit(0.0)) - F.coalesce("w2", F.lit(0.0))
    return grid.groupBy("squad_id", "p1", "p2", F.col("dst").alias("member_id")).agg(F.sqrt(F.avg(d * d)).alias("change"))


def lagged_ties(delayed: DataFrame) -> DataFrame:
    """How many windows of each pair have each delay."""
    return delayed.where("delay IS NOT NULL").groupBy(*PAIR, "delay").agg(F.count("*").alias("n"))


def order_by_leadership(scores: DataFrame) -> DataFrame:
    w = Window.partitionBy("squad_id").orderBy(F.desc("leadership"), "member_id")
    return scores.withColumn("rank", F.row_number().over(w))


