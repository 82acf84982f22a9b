"""Sources of tracks: CSV folders, the events adapter, simulated walkers; and model tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import FIXES

# The texts that stand for a missing value in a CSV cell.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def load_tracks(spark: SparkSession, folder: str, header: list[str] | None = None) -> DataFrame:
    """Every file of a folder as fixes; squad_id is the file name up to its first dot.

    Files have a header line with time and Member_ID, and coordinates as
    latitude, longitude, UTM_x, UTM_y; other columns are kept as text.  Rows
    with any missing value go.  header: the columns, where files disagree
    with the first one.
    """
    raw = spark.read.option("header", True)
    if header:
        raw = raw.schema(T.StructType([T.StructField(c, T.StringType()) for c in header]))
    raw = raw.csv(folder)
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))  # names come percent-encoded
    squad = F.split(name, r"\.")[0]
    raw = raw.select(squad.alias("squad_id"), *[F.when(~F.col(f"`{c}`").isin(MISSING), F.col(f"`{c}`")).alias(c) for c in raw.columns]).na.drop("any")
    given = {c.lower(): c for c in raw.columns}
    out = [F.col("squad_id"), F.col(f"`{given['member_id']}`").alias("member_id"), F.to_timestamp(F.col(f"`{given['time']}`")).alias("ts")]
    for f in FIXES.fields[3:]:
        c = F.col(f"`{given[f.name]}`").cast("double") if f.name in given else F.lit(None).cast("double")
        out.append(c.alias(f.name))
    known = {"squad_id", "member_id", "time", *(f.name for f in FIXES.fields)}
    return raw.select(*out, *[F.col(f"`{c}`") for low, c in given.items() if low not in known])


def load_matrix(spark: SparkSession, path: str, key: str = "squad") -> DataFrame:
    """A feature matrix whose first column, often without a name, is the key."""
    raw = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return raw.withColumnRenamed(raw.columns[0], key)


def load_labels(spark: SparkSession, path: str, key: str = "squad") -> DataFrame:
    """(key, score): the labels of a two-column file."""
    raw = load_matrix(spark, path, key)
    return raw.select(key, F.col(f"`{raw.columns[1]}`").cast("double").alias("score"))


def tracks_from_events(events: DataFrame) -> DataFrame:
    """Sparse hourly tracks of 3 squads of 5 members: (squad_id, member_id, tick, utm_x, utm_y).

    Sums are taken over integers and divided once, so that other engines get
    the same doubles.
    """
    user = F.col("user_id")
    tick = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) * 24 + F.hour("ts")
    g = events.groupBy((user % 3).cast("int").alias("squad_id"), (F.floor(user / 3) % 5).cast("int").alias("member_id"), tick.alias("tick")).agg(
        F.sum(F.round(F.col("value") * 100).cast("long")).cast("double").alias("c"),
        F.sum(F.get_json_object("props", "$.k").cast("long")).cast("double").alias("k"),
        F.count("*").cast("double").alias("n"),
    )
    x = F.col("tick").cast("double") + (F.col("c") / F.col("n") - F.lit(5000.0)) / F.lit(1000.0)
    return g.select("squad_id", "member_id", "tick", x.alias("utm_x"), (F.col("k") / F.col("n") / F.lit(10.0)).alias("utm_y"))


def walkers(spark: SparkSession, samples: int = 101, seed: int = 7, noise: float = 0.05) -> DataFrame:
    """Three members walking north who take the same turn one after another.

    Member 2 turns first, then 1, then 0, each some samples later; so 2 leads.
    """
    member = F.expr("explode(sequence(0, 2))").alias("member")
    base = spark.range(samples).select(F.col("id").cast("int").alias("t"), member)
    phase = F.greatest(F.col("t") - 30 + (F.col("member") - 1) * 3, F.lit(0)) / 6.0
    jitter = lambda s: (F.rand(seed + s) - 0.5) * noise
    return base.select(
        F.lit("sim").alias("squad_id"),
        F.lit(0).alias("period_id"),
        F.concat(F.lit("Member: "), "member").alias("member_id"),
        "t",
        (F.col("member") * 2 + 4 * F.sin(phase) + jitter(1)).alias("utm_x"),
        (F.col("t") * 1.4 + jitter(2)).alias("utm_y"),
    )
