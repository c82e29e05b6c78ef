"""Harmonic packing: lengths fall into reciprocal-capacity classes, each class's sequences hold a fixed count of pieces.

A piece of length n is of class k = capacity // n, and k pieces of that class always fit one sequence; so every worker
fills its own sequences of each class, as it encodes, without a word to the others. What a sequence of class k
wastes is least where n is close to capacity / k, so documents are cut there: into pieces of capacity, capacity / 2,
capacity / 4, ... down to SMALLEST, and one rest below SMALLEST. Classes of rests waste less than SMALLEST tokens in a
sequence, the others none. The pieces that a worker has left, fewer than k of each class k, are shuffled and fill sequences by
class again; what is then left of each class, fewer pieces than the capacity bounds, is packed together.

Sequences of ids, padded with the end id, are written to the shared folder; what the query gives is derived from them.

Defined results: a null text counts as empty and has the end id only; rows with equal or null doc_ids are packed one by one; an
empty table gives no pieces; columns other than doc_id and text are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._common import ranked, read_table, stored
from ._tokens import encoder

CAPACITY = 1024
SMALLEST = 32
AT_ONCE = 512


def cuts(n: int, capacity: int = CAPACITY, smallest: int = SMALLEST) -> list[int]:
    """The lengths of the pieces of n tokens."""
    out = [capacity] * (n // capacity)
    rest, size = n % capacity, capacity // 2
    while size >= smallest:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return out + [rest] * (rest > 0)


PIECE = "struct<doc_id: long, start: long, length: long, doc_tokens: long>"
_PIECES = pa.list_(pa.struct([(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens")]))
#: Sequences that a worker collects before it hands them on.
HANDED = 256


class _Rows:
    """Rows (sequence_id, ids, pieces) on their way out of a worker."""

    def __init__(self, capacity: int, end_id: int):
        self.capacity, self.end_id = capacity, end_id
        self.numbers, self.ids, self.sizes, self.owners, self.counts = [], [], [], [], []

    def add(self, number: int | None, parts: list[tuple], pad: bool) -> None:
        size = sum(len(p[0]) for p in parts)
        self.ids += [p[0] for p in parts]
        if pad and size < self.capacity:
            self.ids.append(np.full(self.capacity - size, self.end_id, np.uint32))
            size = self.capacity
        self.numbers.append(number), self.sizes.append(size), self.counts.append(len(parts))
        self.owners += [(p[1], p[2], len(p[0]), p[3]) for p in parts]

    def batch(self) -> pa.RecordBatch:
        def offsets(counts: list[int]) -> pa.Array:
            return pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())

        ids = pa.ListArray.from_arrays(offsets(self.sizes), pa.array(np.concatenate(self.ids).astype(np.int32)))
        fields = [pa.array(c, pa.int64()) for c in zip(*self.owners, strict=True)]
        owners = pa.ListArray.from_arrays(offsets(self.counts), pa.StructArray.from_arrays(fields, [f.name for f in _PIECES.value_type]))
        out = pa.RecordBatch.from_arrays([pa.array(self.numbers, pa.int64()), ids, owners], ["sequence_id", "ids", "pieces"])
        self.__init__(self.capacity, self.end_id)
        return out


def filled(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id, ids and pieces: each worker's full sequences, and with a null sequence_id each piece that it has left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(tokenizer_path, False), np.array([end_id], np.uint32)
        number = TaskContext.get().partitionId() << 32
        waiting: dict[int, list[tuple]] = {}
        rows = _Rows(capacity, end_id)
        for batch in batches:
            for i in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(i, AT_ONCE)
                found, begins = own.encode(some.column(1))
                for doc_id, a, b in zip(some.column(0).to_pylist(), begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                    ids, at = np.concatenate([found[a:b], end]), 0
                    for n in cuts(len(ids), capacity):
                        k = capacity // n
                        group = waiting.setdefault(k, [])
                        group.append((ids[at : at + n], doc_id, at, len(ids)))
                        at += n
                        if len(group) == k:
                            rows.add(number, group, True)
                            number += 1
                            del waiting[k]
                    if len(rows.numbers) >= HANDED:
                        yield rows.batch()
        for group in waiting.values():
            for piece in group:
                rows.add(None, [piece], False)
        if rows.numbers:
            yield rows.batch()

    return docs.select("doc_id", "text").mapInArrow(run, f"sequence_id long, ids array<int>, pieces array<{PIECE}>")


def _best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece: longest first, each into the fullest sequence that has room."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        room = next((r for r in range(n, capacity + 1) if by_room[r]), capacity)
        if by_room[room]:
            s = by_room[room].pop()
        else:
            s, made = made, made + 1
        sequence[i], offset[i] = s, capacity - room
        by_room[room - n].append(s)
    return sequence, offset


def harmonic_pack(rows: DataFrame, length: str, by: list[str], capacity: int = CAPACITY) -> DataFrame:
    """rows with sequence_id and offset; lengths are from 1 to capacity, ``by`` orders the rows of a class.

    A class of k has fewer than k pieces beyond its full sequences. Those of all classes, a number that the capacity bounds,
    share the last sequences.
    """
    classed = stored(rows.withColumn("_class", F.floor(F.lit(capacity) / F.col(length)).cast("int")), "pieces")
    numbered = ranked(classed, ["_class"], by, "_turn").withColumn("_bin", F.expr("_turn div _class"))
    # At most `capacity` classes, so their counts meet in one task.
    counts = classed.groupBy("_class").agg(F.count(F.lit(1)).alias("_n")).withColumn("_bins", F.expr("_n div _class"))
    before = Window.orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_class", "_bins", F.coalesce(F.sum("_bins").over(before), F.lit(0)).alias("_first"))
    placed = numbered.join(F.broadcast(bases), "_class")
    full = placed.filter("_bin < _bins").withColumn("sequence_id", F.col("_first") + F.col("_bin"))
    within = Window.partitionBy("sequence_id").orderBy("_turn").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("offset", F.coalesce(F.sum(length).over(within), F.lit(0)).cast("long"))
    names = [*rows.columns, "sequence_id", "offset"]
    taken = counts.agg(F.coalesce(F.sum("_bins"), F.lit(0)).cast("long").alias("_taken"))
    schema = StructType([*rows.schema.fields, *StructType.fromDDL("sequence_id long, offset long").fields])

    def share(group: pa.Table) -> pa.Table:
        sequence, offset = _best_fit(group.column(length).to_numpy(), capacity)
        return group.select(columns).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    columns = rows.columns
    rest = placed.filter("_bin >= _bins").select(*rows.columns, F.lit(0).alias("_one")).groupBy("_one").applyInArrow(share, schema)
    rest = rest.join(F.broadcast(taken)).withColumn("sequence_id", F.col("sequence_id") + F.col("_taken"))
    return full.select(*names).unionByName(rest.select(*names))


def sequences(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id, ids (capacity of them, end_id where no piece is) and pieces (doc_id, start, length, doc_tokens) in their order; stored."""
    by_worker = stored(filled(docs, tokenizer_path, end_id, capacity), "sequences")
    left = by_worker.filter("sequence_id IS NULL").select("ids", F.inline("pieces"))
    # Repeated rows with one id differ in nothing but their ids' order here.
    placed = harmonic_pack(left.withColumn("_hash", F.xxhash64("ids")), "length", ["doc_id", "start", "_hash"], capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "doc_tokens", "ids")))
    whole = placed.groupBy("sequence_id").agg(parts.alias("parts"))
    ids = F.flatten(F.col("parts")["ids"])
    padded = F.concat(ids, F.array_repeat(F.lit(end_id), F.lit(capacity) - F.size(ids)))
    rest = whole.select("sequence_id", padded.alias("ids"), F.transform("parts", lambda p: p.dropFields("offset", "ids")).alias("pieces"))
    rest = stored(rest, "sequences-left")
    # Each worker has numbered its own from 0; the workers' counts, one row for each task, make the numbers gapless.
    full = by_worker.filter("sequence_id IS NOT NULL").withColumn("_worker", F.shiftright("sequence_id", 32))
    counts = full.groupBy("_worker").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_worker").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_worker", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    full = full.join(F.broadcast(bases), "_worker").withColumn("sequence_id", F.col("_base") + F.expr("sequence_id & 4294967295L"))
    above = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_above"))
    rest = rest.join(F.broadcast(above)).withColumn("sequence_id", F.col("sequence_id") + F.col("_above"))
    return full.select("sequence_id", "ids", "pieces").unionByName(rest.select("sequence_id", "ids", "pieces"))


def packed(docs: DataFrame, tokenizer_path: str, end_id: int = 0, keep_ids: bool = False, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece, read back from the stored sequences: ids_crc32 and offset are of the ids that lie there."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(i, AT_ONCE)
                ids = some.column(1).flatten().to_numpy()
                first = some.column(1).offsets.to_numpy() - some.column(1).offsets[0].as_py()
                counts = np.diff(some.column(2).offsets.to_numpy())
                doc_id, start, length, doc_tokens = some.column(2).flatten().flatten()
                sizes = length.to_numpy()
                before = np.cumsum(sizes) - sizes
                opens = np.cumsum(counts) - counts
                offset = before - np.repeat(before[opens], counts)
                at = offset + np.repeat(first[:-1], counts)
                crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(at.tolist(), sizes.tolist(), strict=True)]
                columns = [doc_id, start, length, pa.array(crc, pa.int64()), doc_tokens, pa.array(np.repeat(some.column(0).to_numpy(), counts)), pa.array(offset)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if keep_ids:
                    # The pieces' ids, without padding, lie one after another.
                    unpadded = np.concatenate([ids[a : a + n] for a, n in zip(at.tolist(), sizes.tolist(), strict=True)])
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(unpadded)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return sequences(docs, tokenizer_path, end_id, capacity).select("sequence_id", "ids", "pieces").mapInArrow(run, schema)


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
