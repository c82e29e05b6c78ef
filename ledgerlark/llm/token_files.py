"""Token ids as Parquet list columns that allow selective reads.

Format: one Parquet file for each range of doc_ids, part numbers ascending with them, rows in ascending doc_id order. Columns:
doc_id and n_tokens in delta encoding, ids (list of int) in dictionary encoding; row groups and pages of a set size, each page
with its bounds in the page index. A reader that wants lengths or a few documents reads those columns and pages only.

Defined results: a null text counts as empty, so its document has the end id only; rows with equal or null doc_ids keep
a row each, in the order of their texts' hashes, nulls first; an empty table gives no rows; columns other than doc_id and text are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import fresh_path, read_table
from ._tokens import encoder

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
AT_ONCE = 512
#: Bytes of text in a file, about.
FILE_BYTES = 64 << 20


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens, ids of each document's whole text, with the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path, True)
        for batch in batches:
            for i in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(i, AT_ONCE)
                found, begins = own.encode(some.column(1))
                counts = np.diff(begins) + 1
                ids = np.insert(found.astype(np.int32), begins[1:], end_id)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(counts), lists], ["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int) -> None:
    rows = docs.select("doc_id", "text")
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // FILE_BYTES)
    # Rows with one doc_id are told apart by their texts, so that many of them needn't be in one file.
    order = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    options = {
        "compression": "zstd",
        "parquet.writer.version": "v2",
        "parquet.block.size": ROW_GROUP_BYTES,
        "parquet.page.size": PAGE_BYTES,
        "parquet.enable.dictionary": "true",
        "parquet.enable.dictionary#doc_id": "false",
        "parquet.enable.dictionary#n_tokens": "false",
    }
    encoded(ordered, tokenizer_path, end_id).write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens, ids, file number and row: the file order is (file, row)."""
    rows = spark.read.schema("doc_id long, n_tokens long, ids array<int>").parquet(path)
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    return rows.select("doc_id", "n_tokens", "ids", part.alias("file"), F.col("_metadata.row_index").alias("row"))


def starts(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """rows with ``start``, the ids in all rows before: a sum within each file on top of the files' own sums.

    lengths has file and n_tokens of all rows; a sum for each file, as many as tasks wrote them, is all that meets in one task.
    """
    files = lengths.groupBy("file").agg(F.sum("n_tokens").alias("_sum"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("file", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("_at", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return summed.join(F.broadcast(bases), "file").withColumn("start", F.col("_base") + F.col("_at")).drop("_base", "_at")


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, file, row; n_tokens and the checksum are of the ids that were read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            values = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64()), batch.column(2), batch.column(3)], ["doc_id", "n_tokens", "ids_crc32", "file", "row"])

    return rows.select("doc_id", "ids", "file", "row").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, file long, row long")


def op9_token_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh_path(spark, "tokens")
    write_tokens(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    rows = read_tokens(spark, path)
    return starts(checksums(rows), rows.select("file", "n_tokens")).select("doc_id", "start", "n_tokens", "ids_crc32")
