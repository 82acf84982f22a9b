"""Quality: what the model gathers covers every trusted document."""

import random

from pyspark.sql import functions as F

from trackweave.llm import kneser_ney


def test_trusted_text_has_no_limit(spark):
    """A language whose documents come last by hash order, behind 20,000 others, has its own counts and threshold."""
    rng = random.Random(4)
    ids = [r["id"] for r in spark.range(20_600).orderBy(F.xxhash64("id")).collect()]
    plain = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))
    rows = [(i, plain("etaoinshr", 12), "en") if k < 20_100 else (i, plain("qxzwvkjyu", 12), "xx") for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = kneser_ney.classify(docs, docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")))
    share = {r["lang"]: r["share"] for r in got.groupBy("lang").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    limits = {r["lang"]: r["n"] for r in got.groupBy("lang").agg(F.countDistinct("threshold").alias("n")).collect()}
    assert share["xx"] >= 0.99 and share["en"] >= 0.99 and limits == {"en": 1, "xx": 1}
