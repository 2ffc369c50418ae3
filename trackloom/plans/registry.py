"""Registration of queries over the driver's tables, each with DuckDB SQL for the same rows, and views that they share.

Roles: ``events`` is a set of tracks (user_id, ordered by ts and event_id) with a signal (value) and a label
(event_type); ``lineitem`` is a dense index series (l_orderkey, l_linenumber); ``embeddings`` stand for poses.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.timeseries import Track
from trackloom.sources.export import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

EVENTS = Track(("user_id",), ("ts", "event_id"))
LINES = Track(("l_orderkey",), ("l_linenumber",))
BY_EVENT = "PARTITION BY user_id ORDER BY ts, event_id"


@dataclass(frozen=True)
class Tables:
    """Reads the tables of a folder by name, as tables or as streams."""

    spark: SparkSession
    folder: str

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        """The table as it would come in files."""
        return self.spark.readStream.schema(self(name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(self.folder)

    def drained(self, df: DataFrame, mode: str) -> DataFrame:
        """All that a stream gives for the files that are there, as a table."""
        out = shared_folder(self.spark, "stream")

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{out}/rows")

        df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
        return self.spark.read.schema(df.schema).parquet(f"{out}/rows")


def query(sql: str | None = None):
    """Registers a function of (table reader) under its name, with its SQL."""

    def add(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(c, n: int = 6):
    """A double rounded as SQL does it: scaled, rounded half away from zero and scaled back, so that zero keeps its sign.

    Spark's own rounding goes by a double's shortest decimal, which is another number next to a tie, and has one zero.
    """
    x = c * F.lit(10.0**n)
    whole = F.rint(x)
    return F.when(F.abs(x - whole) == 0.5, x + F.signum(x) * 0.5).otherwise(whole) / F.lit(10.0**n)


def frames(t) -> DataFrame:
    """Events with an integer frame for each row of a track, and a signal with gaps (values under 20 are missing)."""
    e = t("events").withColumn("frame", F.row_number().over(EVENTS.window()))
    return e.withColumn("gappy", F.when(F.col("value") >= 20, F.col("value")))


FRAMES = f"f AS (SELECT *, row_number() OVER ({BY_EVENT}) AS frame, CASE WHEN value >= 20 THEN value END AS gappy FROM events)"
