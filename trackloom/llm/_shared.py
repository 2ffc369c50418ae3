"""Tables that cut lineage, and bounded samples of labelled rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Scratch:
    """Intermediate tables in the shared folder that ``spark.checkpoint.dir`` names.

    Only a local session, as in tests, may leave the setting out: it then uses a folder of this machine.  The tables go
    when the application ends; :meth:`drop` removes one earlier.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            top = f"file://{tempfile.gettempdir()}/trackloom-scratch"
        self.path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._path(self.path))

    def save(self, df: DataFrame, name: str) -> DataFrame:
        where = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self._path(f"{self.path}/{name}"), True)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, seed: int, where: str = "true") -> DataFrame:
    """At most ``rows`` labelled documents as (doc_id, text, label), chosen by a hash of the id.

    The chosen ids are bounded by ``rows`` and broadcast, so that other texts are never shuffled.  Of rows with one id,
    the one with the least text hash is taken, so that the bound holds for rows too.  A document with contradicting
    labels gets the largest; null ids and labels are skipped.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .where(where)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
        .limit(rows)
    )
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label"))
