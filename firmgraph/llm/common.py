"""What the operators share: tables in the shared folder, word splitting, sources."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of letters and digits of the lower-cased text, wherever words are compared.
WORD = r"[\p{L}\p{N}]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode, where it is unset, a new temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        place = sc.getConf().get("spark.checkpoint.dir")
        if place is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            place = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(place)
    return sc.getCheckpointDir()


class Workspace:
    """Intermediate tables of one call, written to the shared folder: they cut the lineage and outlive executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
        """Write a table; the shuffle files that made it go at once, not when the driver happens to collect its garbage.

        batch: rows of an Arrow batch meanwhile, for rows that are large.
        """
        path, meant = f"{self.path}/{name}", {CLEANUP: "true"} | ({BATCH: str(batch)} if batch else {})
        kept = {k: self.spark.conf.get(k, d) for k, d in ((CLEANUP, "false"), (BATCH, "10000")) if k in meant}
        for k, v in meant.items():
            self.spark.conf.set(k, v)
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            for k, v in kept.items():
                self.spark.conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove a table that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    """The words of a text, null as empty."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def word_hashes(text: Column) -> Column:
    """A 64-bit hash for each word, in order."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """A saved table with a broadcast hint if its rows take at most `limit` bytes; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df
