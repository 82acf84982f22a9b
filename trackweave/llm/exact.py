"""Exact deduplication by a stream with disk-backed keyed state.

A batch pass writes (digest, doc_id, locator) of each document.  A Structured
Streaming query reads that log and keeps, per digest, how many documents came
and the smallest (doc_id, locator) so far, in a RocksDB state store without
watermark or expiry; so a later log can go on from the same checkpoint.  A
locator says where the text is: file and row there.  On a hit, a document
whose digest is another one's, both texts are fetched through their locators
and compared in full; documents that only share the digest form groups of
their own by their bytes.

Only DataFrame operations and Spark's own functions run here.

Rows: null text counts as empty; texts are compared after each run of the six
ASCII space characters became one space.  Repeated rows are copies like any
other.  A null doc_id sorts first and so is the one that stays; keep_id is
then null and ``kept`` is true for one row only, as the locator tells rows
with equal doc_id apart.  An empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import Scratch, hits, only, plain, without

SPACES = "[\\x20\\x09-\\x0D]+"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def located(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, text, file, row): docs as read from files, else written first."""
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    if "_metadata" not in {c.lower() for c in docs.columns}:
        try:
            return docs.select(F.col("doc_id"), F.col("text"), *where)
        except AnalysisException:
            pass
    return scratch.keep(only(docs, "doc_id", "text"), "texts").select("doc_id", "text", *where)


def _stream(spark: SparkSession, log: str, schema, scratch: Scratch, files: int) -> DataFrame:
    """The state after the whole log: (digest, n, first) with first the copy that stays."""
    conf = {
        "spark.sql.streaming.stateStore.providerClass": ROCKS,
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
        "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",  # each partition takes an eighth at once
        "spark.sql.streaming.stateStore.maintenanceInterval": "5s",  # stores of a finished query are closed then
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition takes 4 MB at once
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(log)
        state = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "file", "row")).alias("first"))
        out = scratch.path("updates")

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        query = (
            state.writeStream.outputMode("update").option("checkpointLocation", scratch.path("stream"))
            .trigger(availableNow=True).foreachBatch(keep).start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    shape = state.schema
    seen = spark.read.schema(shape).option("recursiveFileLookup", "true").parquet(out)
    # every batch tells the digests that it changed; counts only rise and the first only falls
    return scratch.keep(seen.groupBy("digest").agg(F.max("n").alias("n"), F.min("first").alias("first")), "state")


def dedup(docs: DataFrame, *, digest=None, files_per_batch: int = 4096) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every document.

    digest: a function of the normalised text column, SHA-256 unless given;
    a weaker one costs more comparisons and gives the same groups.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    source = located(docs, scratch)
    norm = normalised(F.col("text"))
    log = source.select("doc_id", "file", "row", norm.alias("norm")).withColumn("text_sha256", F.sha2("norm", 256))
    log = log.select("doc_id", "file", "row", "text_sha256", (digest(F.col("norm")) if digest else F.col("text_sha256")).alias("digest"))
    log = scratch.keep(log, "log")
    if log.isEmpty():
        return log.selectExpr("doc_id", "doc_id AS keep_id", "1L AS group_size", "true AS kept", "text_sha256")
    state = _stream(spark, scratch.path("log"), log.schema, scratch, files_per_batch)
    own = log.join(state, "digest")
    own = scratch.keep(own, "own")
    single = own.where("n = 1").selectExpr("doc_id", "doc_id AS keep_id", "1L AS group_size", "true AS kept", "text_sha256")
    multi = own.where("n > 1").select("doc_id", "file", "row", "text_sha256", "digest", "first")
    # only texts of hits are fetched and shuffled
    place = F.xxhash64("file", "row")
    fetched = hits(source.select("file", "row", "text"), place, multi.select(place.alias("h")), scratch, "places").where("hit")
    texts = multi.join(fetched.select("file", "row", norm.alias("norm")), ["file", "row"])
    texts = scratch.keep(texts, "multi")
    scratch.drop("log", "state", "updates")
    # full bytes against those of the copy that stays
    firsts = texts.where("file = first.file AND row = first.row").select(F.col("digest"), F.col("norm").alias("held"))
    firsts = scratch.keep(firsts, "firsts")
    checked = texts.join(firsts, "digest").select("doc_id", "file", "row", "text_sha256", "digest", (F.col("norm") == F.col("held")).alias("same"), "norm")
    checked = scratch.keep(checked.withColumn("rest", F.when(~F.col("same"), F.col("norm"))).drop("norm", "same"), "checked")
    groups = checked.groupBy("digest", "rest").agg(F.count("*").alias("group_size"), F.min(F.struct("doc_id", "file", "row")).alias("first"))
    groups = scratch.keep(groups, "groups")
    both = checked.alias("c").join(groups.alias("g"), (F.col("c.digest") == F.col("g.digest")) & F.col("c.rest").eqNullSafe(F.col("g.rest")))
    copies = both.selectExpr(
        "c.doc_id", "g.first.doc_id AS keep_id", "g.group_size", "c.file = g.first.file AND c.row = g.first.row AS kept", "c.text_sha256"
    )
    scratch.drop("multi", "firsts")
    return single.union(copies)


def stays(docs: DataFrame) -> DataFrame:
    """docs without the copies: one row of each group of equal texts, all columns.

    Where doc_id values repeat or are null, rows are told apart by their text
    too.  Columns may have any names.  An empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "exact-stays")
    found = scratch.keep(dedup(docs).select("doc_id", "kept", "text_sha256"), "verdicts")
    if found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return without(docs, found.where("NOT kept"))
    own, text = (F.col(f"_{docs.columns.index(c)}") for c in ("doc_id", "text"))
    marked = plain(docs).withColumns({"own": own, "sha": F.sha2(normalised(text), 256)})
    gone = found.groupBy("doc_id", "text_sha256").agg(F.bool_or("kept").alias("kept")).where("NOT kept")
    same = F.col("own").eqNullSafe(F.col("doc_id")) & (F.col("sha") == F.col("text_sha256"))
    return marked.join(gone, same, "left_anti").dropDuplicates(["own", "sha"]).drop("own", "sha").toDF(*docs.columns)
