"""Chat formatting with cumulative-snapshot collapse.

Chat logs often hold a conversation many times, a snapshot after each turn.
Every turn has a digest of role and text; a rolling digest over them stands
for each prefix of a conversation.  A conversation whose whole digest is a
proper prefix of a longer one is a snapshot and goes; of equal conversations
the one with the smallest conv_id stays.  What is left is rendered with one
marked block per turn.

Only DataFrame operations and Spark's own functions run here.  Digests travel
in the first two steps; the texts are shuffled once, for rendering.

Rows: null role or text counts as empty; turns are ordered by turn (null
first), then by their digest; repeated rows are turns of their own; rows
without conv_id are one conversation, as in GROUP BY.  An empty table gives
no rows; other columns are ignored.  A rendered conversation is one row and
must fit one (2 GB).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, only

# The marks around a turn; such marks inside a text are broken up.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def turns(conversations: DataFrame) -> DataFrame:
    rows = only(conversations, "conv_id", "turn", "role", "text")
    rows = rows.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    return rows.withColumn("digest", F.md5(F.concat(F.md5("role"), F.md5("text"))))


def prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, k, last, prefix): prefix stands for the first k turns.

    The rolling digest is a running sum, in four lanes of 32 bits, of hashes
    of each turn's digest and place; a place makes them depend on the order.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "digest")
    placed = turns(conversations).select("conv_id", "turn", "digest").withColumn("k", F.row_number().over(order))
    lanes = []
    for h in (F.xxhash64("k", "digest"), F.xxhash64("digest", "k", F.lit("second"))):
        lanes += [h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)]
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    rolled = F.md5(F.concat_ws(",", *[F.sum(x).over(running).cast("string") for x in lanes]))
    return placed.select("conv_id", "k", F.lead("k").over(order).isNull().alias("last"), rolled.alias("prefix"))


def maximal(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id of the conversations that are a prefix of no other."""
    rolled = scratch.keep(prefixes(conversations), "prefixes")
    first = scratch.keep(rolled.where("last").groupBy("k", "prefix").agg(F.min("conv_id").alias("conv_id")), "first")
    proper = scratch.keep(rolled.where("NOT last").select("k", "prefix").distinct(), "proper")
    return first.join(proper, ["k", "prefix"], "left_anti").select("conv_id")


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered) of the maximal conversations."""
    scratch = Scratch(conversations.sparkSession, "chat")
    kept = scratch.keep(maximal(conversations, scratch), "kept")
    rows = turns(conversations).alias("t")
    rows = rows.join(kept.alias("k"), F.col("t.conv_id").eqNullSafe(F.col("k.conv_id")), "left_semi")
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    block = F.concat(F.lit(OPEN), safe(F.col("role")), F.lit("\n"), safe(F.col("text")), F.lit(CLOSE + "\n"))
    held = F.array_sort(F.collect_list(F.struct("turn", "digest", block.alias("block"))))
    out = rows.groupBy("conv_id").agg(held.alias("held"))
    return out.select("conv_id", F.size("held").cast("long").alias("n_turns"), F.array_join(F.transform("held", lambda t: t["block"]), "").alias("rendered"))
