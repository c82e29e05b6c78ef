"""Tables in the folder that driver and executors share, spark.checkpoint.dir: computed once, and safe from lost executors."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of the input's files for each partition of a shuffle, and for each bucket of a table that is stored by key.
INPUT_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_BUCKETS = "spark.ledgerlark.buckets"
#: What tables are stored by where it is their first column: a statement's rows lie together.
KEYS = ("statement_id", "l_orderkey")
#: While a table is written: its shuffle files go when it is there, not when the driver's memory is next cleaned, and tables in buckets of one key are joined by more keys as they lie.
_WHILE_WRITTEN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.requireAllClusterKeysForCoPartition": "false"}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, as in tests on one machine, a new local folder. On a cluster it must be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR") or "/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def sized(spark: SparkSession, paths: list[str]) -> None:
    """Gives the session's shuffles and its tables by key partitions by the size of these inputs, so that a task's sort or aggregate doesn't grow with them.

    Adaptive execution puts small ones together again, up to its advisory size. spark.sql.shuffle.partitions stays as it is and is the least number.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    size = sum(f.getFileSystem(conf).getContentSummary(f).getLength() for f in files)
    spark.conf.set(_PARTITIONS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // INPUT_BYTES)))
    spark.conf.set(_BUCKETS, max(spark.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES)))


def buckets(spark: SparkSession) -> int:
    """The buckets of tables that are stored by key, by the inputs that sized() had last."""
    return int(spark.conf.get(_BUCKETS, str(spark.sparkContext.defaultParallelism)))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again; in buckets of its first column, if that is one of KEYS, so that joins and aggregates by it, and by it and others, need no shuffle."""
    spark, label = df.sparkSession, f"lib-{name}-{uuid.uuid4().hex[:12]}"
    path, key = f"{shared_dir(spark)}/{label}", df.columns[0]
    before = {k: spark.conf.get(k, None) for k in _WHILE_WRITTEN}
    try:
        for k, v in _WHILE_WRITTEN.items():
            spark.conf.set(k, v)
        if key not in KEYS:
            df.write.option("compression", "zstd").parquet(path)
            return spark.read.schema(df.schema).parquet(path)
        df.repartition(buckets(spark), key).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets(spark), key).saveAsTable(_table(label))
        return spark.table(_table(label))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _table(label: str) -> str:
    return label.replace("-", "_")


def discarded(*tables: DataFrame) -> None:
    """Removes tables that stored() made, when nothing reads them any longer."""
    for table in tables:
        spark = table.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {os.path.dirname(f) for f in table.inputFiles()}:
            spark.sql(f"DROP TABLE IF EXISTS {_table(os.path.basename(folder))}")
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
