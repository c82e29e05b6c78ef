"""Periodic runs of words: recursive frequency splitting, then a scan over lags.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and at least max(24, 3 q) words that no neighbouring word
extends keeping period q.

1. **Splitting.** A run's word is at least three times in it, so a word that a segment has fewer than three times is in none of the segment's runs: it splits
   the segment. What is left is counted again, until no word splits and all segments have 24 words or more. All segments of a
   slice of documents are split in one sweep; only segments that changed are counted again.
2. **Lags.** The words of all surviving segments stand in one sequence, long segments first, with a word of its own after each. A run with period q has 2 q
   matches of words q apart (24 - q, if that is more) in a row, so one block of a grid of half that width is whole among them. For each lag, blocks are compared by prefix
   hashes, which costs words / q, and only a block that agrees is extended, word by word. Lags ascend, so a block
   inside a run that is known already has that run's period, or a multiple, and is passed over: m words take about m log m steps, also where all are equal.

Documents are independent of each other: Spark deals them out and nothing is shuffled.

Defined results: a null or blank text has no words and no runs; words are separated by space and the characters 09 to 0D alone; a null doc_id counts as any other row and isn't
rewritten by the query; repeated rows get equal results; an empty table gives no rows; a document of any length is looked at as a whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ._common import read_table

#: Words that a run has at least, and times that it holds its period.
LEAST_WORDS, LEAST_TIMES = 24, 3
#: Bytes of text of the documents that are searched together.
SLICE_BYTES = 2_000_000
_BASE = 0x9E3779B97F4A7C15 | 1


def split_segments(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the segments that are left of those given, when every word that its segment has fewer than three times has split it."""
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        keep = ends - starts >= LEAST_WORDS
        starts, ends = starts[keep], ends[keep]
        if not len(starts):
            break
        sizes = ends - starts
        owner = np.repeat(np.arange(len(starts)), sizes)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
        _, inverse, times = np.unique((owner << 32) | ids[at], return_inverse=True, return_counts=True)
        rare = times[inverse] < LEAST_TIMES
        touched = np.zeros(len(starts), bool)
        touched[owner[rare]] = True
        done.append((starts[~touched], ends[~touched]))
        if not touched.any():
            break
        inside = ~rare & touched[owner]
        # A stretch starts after a rare word or where a segment does, and ends likewise.
        previous = np.concatenate([[False], inside[:-1] & (owner[1:] == owner[:-1])])
        following = np.concatenate([inside[1:] & (owner[1:] == owner[:-1]), [False]])
        starts, ends = at[inside & ~previous], at[inside & ~following] + 1
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in done]), np.concatenate([b for _, b in done])


def _same_words(w: np.ndarray, i: int, lag: int, step: int) -> int:
    """How many words from i on, forwards (1) or backwards (-1), equal those lag words further on; looks at doubling stretches."""
    total, width = 0, 32
    while True:
        a, b = (i + total, i + total + width) if step > 0 else (i - total - width + 1, i - total + 1)
        a, b = max(a, 0), min(b, len(w) - lag)
        if a >= b:
            return total
        differ = np.flatnonzero(w[a:b] != w[a + lag : b + lag])
        if len(differ):
            return total + int(differ[0] if step > 0 else b - a - 1 - differ[-1])
        total += b - a
        width *= 2


def scan_lags(segments: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each segment."""
    order = sorted(range(len(segments)), key=lambda i: -len(segments[i]))
    out: list[list[tuple[int, int, int]]] = [[] for _ in segments]
    if not order:
        return out
    sizes = np.array([len(segments[i]) for i in order], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    w = np.concatenate([np.append(segments[i], -1 - k) for k, i in enumerate(order)]).astype(np.int64)
    powers = np.ones(len(w) + 1, np.uint64)
    powers[1:] = np.multiply.accumulate(np.full(len(w), _BASE, np.uint64))
    mixed = (w.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(mixed * powers[:-1], dtype=np.uint64)])
    known = np.zeros(len(w), np.int64)  # the furthest end of a run that is known and holds the word
    for lag in range(1, int(sizes[0]) // LEAST_TIMES + 1):
        least = max(LEAST_WORDS, LEAST_TIMES * lag)
        n = int(np.searchsorted(-sizes, -least, side="right"))
        limit = int(starts[n - 1] + sizes[n - 1])
        width = (least - lag + 1) // 2  # of 2 width - 1 matches in a row a block of the grid is whole
        grid = np.arange(0, limit - width - lag + 1, width)
        own = (prefix[grid + width] - prefix[grid]) * powers[lag]
        grid = grid[own == prefix[grid + lag + width] - prefix[grid + lag]]
        passed = 0
        for i in grid[known[grid] < grid + lag + width].tolist():
            if i < passed or known[i] >= i + lag + width:
                continue
            forwards = _same_words(w, i, lag, 1)
            if forwards < width:
                continue  # the hashes agreed, the words don't
            start = i - (_same_words(w, i - 1, lag, -1) if i else 0)
            end = i + forwards + lag
            passed = end - lag
            if end - start < least:
                continue
            known[start:end] = np.maximum(known[start:end], end)
            k = int(np.searchsorted(starts, start, side="right")) - 1
            out[order[k]].append((int(start - starts[k]), int(end - start), lag))
    return out


def runs_of(documents: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period), by start, then period, of each document, an array of word numbers below 2^32."""
    sizes = np.array([len(d) for d in documents], np.int64)
    firsts = np.cumsum(sizes) - sizes
    ids = np.concatenate([np.zeros(0, np.int64), *documents])
    starts, ends = split_segments(ids, firsts, firsts + sizes)
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    owners = np.searchsorted(firsts, starts, side="right") - 1
    for a, owner, found in zip(starts.tolist(), owners.tolist(), scan_lags([ids[a:b] for a, b in zip(starts, ends, strict=True)]), strict=True):
        out[owner] += [(a - int(firsts[owner]) + start, length, period) for start, length, period in found]
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each of n words stays: those that a run has after its first period go."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change)[:n] == 0


def numbered(words: list[bytes], numbers: dict[bytes, int]) -> np.ndarray:
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def _slices(texts: list[str | None]) -> Iterator[list[int]]:
    some, size = [], 0
    for i, t in enumerate(texts):
        some.append(i)
        size += len(t or "")
        if size > SLICE_BYTES:
            yield some
            some, size = [], 0
    if some:
        yield some


def _over_documents(docs: DataFrame, id_column: str, fields: str, of: Callable) -> DataFrame:
    """id_column and fields: what ``of(words, runs)`` gives for each document; with_copies comes first, if it rewrites the words."""
    schema = StructType([docs.select(id_column).schema[0], *StructType.fromDDL(fields).fields])
    rewrite, describe = of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for some in _slices(texts):
                numbers: dict[bytes, int] = {}
                words = [(texts[i] or "").encode("utf-8", "surrogatepass").split() for i in some]
                sources = [rewrite(ids[i], len(w)) for i, w in zip(some, words, strict=True)]
                words = [w if s is None else [w[j] for j in s.tolist()] for w, s in zip(words, sources, strict=True)]
                found = runs_of([numbered(w, numbers) for w in words])
                rows = [describe(w, r) for w, r in zip(words, found, strict=True)]
                columns = [pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), list(arrow)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)).cast(arrow.field(0).type), *columns], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return docs.select(id_column, "text").mapInArrow(run, schema)


def periodic_runs(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """id_column, runs (array of start, length, period, by start, then period) and collapsed, the text of the words that stay, joined by single spaces."""

    def describe(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
        keep = kept_words(len(words), runs)
        text = b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k).decode("utf-8", "surrogatepass")
        return [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], text

    return _over_documents(docs, id_column, "runs array<struct<start: long, length: long, period: long>>, collapsed string", (lambda doc_id, n: None, describe))


def rewritten(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place of a document that the contract of op12 rewrites; None for the others."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def digests(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """The columns of op12 but doc_id: exponents are compared exactly, as products of integers."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:  # ties: runs come by start, then period
            best = r
    text = b" ".join(words)
    if runs:
        keep = kept_words(len(words), runs)
        text = b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k)
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *four, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest())


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return _over_documents(read_table(spark, sf_dir, "documents"), "doc_id", fields, (rewritten, digests))
