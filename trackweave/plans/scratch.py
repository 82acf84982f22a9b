"""Tables that cut a long plan: Parquet below spark.checkpoint.dir, which all executors share.

They go when the session ends.  Without that setting a local session, whose
driver is its only machine, takes a temporary folder; a cluster is refused.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    def __init__(self, spark: SparkSession, what: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="trackweave-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
        self.spark, self.root = spark, f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
        atexit.register(self.delete)

    def delete(self) -> None:
        try:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
        except Exception:  # the JVM may be gone already; the folder is scratch
            return

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return the written table."""
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def gather(self, tables, name: str, at_once: int = 4) -> DataFrame:
        """All rows of tables of one schema, a few of them written at a time."""
        first, jobs = None, []
        with ThreadPoolExecutor(at_once) as pool:
            for i, df in enumerate(tables):
                first = first or df.schema
                jobs.append(pool.submit(df.write.mode("overwrite").parquet, f"{self.root}/{name}/k={i}"))
            for job in jobs:
                job.result()
        return self.spark.read.schema(first).option("recursiveFileLookup", "true").parquet(f"{self.root}/{name}")
