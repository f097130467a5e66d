"""Components that grow as links arrive: the carried state of the round loop on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from retromill.operators.graph import components

STATE = "node string, component string"


def state_path(folder: str, batch: int) -> str:
    return f"{folder}/batch-{batch:09d}"


def read_state(spark: SparkSession, folder: str, batch: int) -> DataFrame:
    """The components after ``batch``; before the first there are none."""
    return spark.createDataFrame([], STATE) if batch < 0 else spark.read.schema(STATE).parquet(state_path(folder, batch))


def grow_components(links: DataFrame, a: str, b: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Keep the components of all links seen so far. ``links`` is a stream with columns ``a`` and ``b``;
    each micro-batch joins its links with the star-shaped state of the batch before, whose edges from
    every node to its component stand for all earlier links, and writes the state after it into
    ``folder``. A batch that runs again after a failure reads the same state and writes the same
    place, so nothing counts twice. Nulls and links of a node with itself connect nothing."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = read_state(spark, folder, number - 1).where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        new = batch.select(F.col(a).alias("a"), F.col(b).alias("b"))
        components(old.unionByName(new), "a", "b").write.mode("overwrite").parquet(state_path(folder, number))

    return links.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
