"""What the training-data operators share: tables, the shared folder, ranks and lookups that survive hot keys."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key that holds more than one row in HOT_SHARE is hot; there can be no more than HOT_SHARE such keys.
HOT_SHARE = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, as in tests, a new local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR") or "/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: computed once, and safe from lost executors."""
    path = fresh_path(df.sparkSession, name)
    if getattr(_recording, "paths", None) is not None:
        _recording.paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: The tables that a thread stores while it is inside recorded().
_recording = threading.local()


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the tables that stored() makes inside, as a list that discarded() takes when nothing reads them any longer."""
    before, _recording.paths = getattr(_recording, "paths", None), []
    try:
        yield _recording.paths
    finally:
        _recording.paths = before


def discarded(spark: SparkSession, paths: list[str]) -> None:
    """Removes stored tables from the shared folder, and empties the list."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


def text_key(column: str = "text"):
    """Equal for equal texts (128 bits); null for null."""
    return F.md5(F.col(column).cast("binary"))


def hot_lookup(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """left with the columns of right (one row per key; null where there is none).

    ``weight`` is the number of left's rows with the key. Keys with over total / HOT_SHARE rows are at most
    HOT_SHARE, so that part of right is broadcast; the other keys are joined by a shuffle, without large groups.
    """
    bound = max(1, total // HOT_SHARE)
    names = [c for c in right.columns if c not in (key, weight)]
    packed = right.select(key, weight, F.struct(*names).alias("_found"))
    hot = packed.filter(F.col(weight) > bound).select(key, F.col("_found").alias("_hot"))
    cold = packed.filter(F.col(weight) <= bound).select(key, "_found")
    tried = left.join(F.broadcast(hot), key, "left")
    done = tried.filter(F.col("_hot").isNotNull()).withColumnRenamed("_hot", "_found")
    rest = tried.filter(F.col("_hot").isNull()).drop("_hot").join(cold, key, "left")
    both = done.select(*left.columns, "_found").unionByName(rest.select(*left.columns, "_found"))
    return both.select(*left.columns, *[F.col("_found")[c].alias(c) for c in names])


def ranked(df: DataFrame, keys: list[str], by: list[str], out: str, buckets: int = 64) -> DataFrame:
    """df with a gapless number ``out`` from 0 within each value of ``keys``, without one task per key.

    Rows are numbered within (keys, bucket of a hash of ``by``); the buckets' counts, at most ``buckets`` for each
    value of keys, give each bucket's base. Only for keys with a fixed number of values. df must give the same rows
    each time it is run.
    """
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*keys, "_bucket").orderBy(*by)
    numbered = dealt.withColumn("_at", F.row_number().over(within) - 1)
    return numbered.join(F.broadcast(bases), [*keys, "_bucket"]).withColumn(out, F.col("_base") + F.col("_at")).drop("_bucket", "_at", "_base")
