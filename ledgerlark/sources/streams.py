"""Streams: files as a source, and draining what is there into a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_dir


def file_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file or folder, which is given as a pattern since a stream takes no single file otherwise."""
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream gives for all files there are now: the last batch of mode complete, all batches of append."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"
    seen: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        seen.append(f"{base}/out/{number}")
        batch.write.mode("overwrite").parquet(seen[-1])

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    paths = seen[-1:] if mode == "complete" else seen
    return spark.read.schema(stream.schema).parquet(*paths) if paths else spark.createDataFrame([], stream.schema)


def drained_in_parts(rows: DataFrame, arrival: str, parts: int, build, merge=None) -> tuple[DataFrame, int]:
    """What ``build(stream)`` gives in append mode if rows arrive in parts (arrival: 0 to parts - 1), as a job that runs after each arrival over one checkpoint; and
    how many rows the watermark dropped, as the queries' progress has it (an aggregate counts them after it has combined what it can in each task).

    The watermark moves between parts, so windows close, state goes and rows behind it are late. merge(batch, number), if given, takes each batch instead of the result.
    """
    spark = rows.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"
    rows.write.partitionBy(arrival).parquet(f"{base}/all")
    schema = rows.drop(arrival).schema
    seen: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        if merge is not None:
            merge(batch, number)
        else:
            seen.append(f"{base}/out/{number}")
            batch.write.mode("overwrite").parquet(seen[-1])

    late = 0
    rows.drop(arrival).limit(0).write.parquet(f"{base}/in")  # the source's folder is there from the start
    out = build(spark.readStream.schema(schema).parquet(f"{base}/in"))
    for k in range(parts):
        spark.read.schema(rows.schema).parquet(f"{base}/all").filter(F.col(arrival) == k).drop(arrival).write.mode("append").parquet(f"{base}/in")
        query = out.writeStream.outputMode("append").option("checkpointLocation", f"{base}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
        query.awaitTermination()
        late += sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    return (spark.read.schema(out.schema).parquet(*seen) if seen else spark.createDataFrame([], out.schema)), late


class Latest:
    """A table in the shared folder that batches are merged into: the newest version of each key's row.

    A batch is merged once, whatever the number of tries: its version is named by its number, and made of the one before.
    """

    def __init__(self, spark: SparkSession, reduce):
        self.path, self.reduce, self.versions = f"{shared_dir(spark)}/latest-{uuid.uuid4().hex[:12]}", reduce, {}

    def __call__(self, batch: DataFrame, number: int) -> None:
        before = [n for n in self.versions if n < number]
        rows = batch if not before else batch.unionByName(batch.sparkSession.read.schema(batch.schema).parquet(self.versions[max(before)]))
        self.reduce(rows).write.mode("overwrite").parquet(f"{self.path}/{number}")
        self.versions[number] = f"{self.path}/{number}"

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.versions[max(self.versions)])
