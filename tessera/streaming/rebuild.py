"""Following what changes: new snapshot files start a build, readers take up a new version, vectors follow new texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tessera.plans import serving
from tessera.sources import storage


def on_new_snapshot(spark: SparkSession, folder: str, schema, checkpoint: str, act: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Calls act(rows of the new files, generation) once for the files that arrived since the last call."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(act).start()


def follow_snapshots(spark: SparkSession, folder: str, schema, checkpoint: str, root: str) -> StreamingQuery:
    """Builds the serving tables anew from the whole folder whenever it has new files, and makes them current when they are whole. A
    build that fails leaves the version before it current, and the files are taken up again."""

    def rebuild(_: DataFrame, generation: int) -> None:
        serving.build(spark.read.schema(schema).parquet(folder), root)

    return on_new_snapshot(spark, folder, schema, checkpoint, rebuild)


class Reader:
    """The current version of a root's tables; ``fresh`` looks at the pointer and opens a new version, if there is one. Plans made
    before go on reading the version they were made for, which the clean-up after the next build leaves."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.generation, self.tables = spark, root, 0, {}

    def fresh(self) -> dict[str, DataFrame]:
        found = storage.current(self.spark, self.root)
        if found and found[1] != self.generation:
            folder, self.generation = found
            self.tables = serving.tables(self.spark, folder)
        return self.tables


def follow_texts(spark: SparkSession, folder: str, schema, checkpoint: str, target: str, encode) -> StreamingQuery:
    """Appends the vectors (id, e) of new texts (id, text) as they arrive. The checkpoint remembers which files were read, and a batch
    that was cut off is written again under its own folder, so that none is there twice."""

    def add(rows: DataFrame, batch: int) -> None:
        rows.select("id", encode(F.col("text")).alias("e")).write.mode("overwrite").parquet(f"{target}/batch={batch}")

    return on_new_snapshot(spark, folder, schema, checkpoint, add)


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and tumbling window, with a watermark. An extension, without a counterpart in the reference."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
