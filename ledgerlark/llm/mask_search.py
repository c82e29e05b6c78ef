"""Ranked lexical search: each item's documents are grouped by the mask of its terms that they hold, masks are evaluated by descending maximum score.

1. Items are dealt into blocks by a hash, so that a block's terms are about BLOCK_TERMS: what a block makes every worker hold is bounded, and the
   documents are read once for each block.
2. One pass over the texts keeps of each document its number of terms and the block's terms in it with their occurrences, as Parquet in the shared folder. N, L and the
   terms' document frequencies are sums over that.
3. A task takes its documents in slices. For an item, the bitmaps of its terms over the slice (a row of bits each) give every document a mask, and
   documents with one mask are a group. A mask's maximum score is the sum, over its terms, of the weight and the
   greatest share any document of the slice has of that term. Groups are scored by descending maximum until it is below the item's 20th score so far in this
   task; a group whose maximum equals that score is still looked at, as a smaller doc_id wins ties. Scores found carry over to
   the next slice, so later slices score few groups.
4. Each task gives at most 20 rows an item. They are ranked within PARTS parts of them first, so that no task gets the rows of all tasks.

Defined results: an item or document without terms has no rows; a null text has none; items are distinct pairs of item_id and text: equal rows are one item, rows with
one item_id and different texts are items each, ranked by themselves; each row of documents is a document, also of repeated ones; of equal scores null doc_ids come last;
a null item_id is an item; an empty table gives no rows; other columns aren't looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import read_table, stored

TOP = 20
#: Terms of the items of a block, about.
BLOCK_TERMS = 250_000
#: Documents and postings whose masks are made together.
SLICE_ROWS, SLICE_POSTINGS = 4096, 1_000_000
#: Documents times terms of an item that are looked at together.
MASK_CELLS = 4_000_000
#: Parts in which the tasks' rows of an item are ranked before they are ranked together.
PARTS = 32
_LOW = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOW).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _postings(docs: DataFrame, shared) -> DataFrame:
    """doc_id, n, terms (numbers in the block's vocabulary) and tfs of the documents with a term; those that hold none of the block's have empty lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value[0]
        for batch in batches:
            ids, ns, places, found, tfs = batch.column(0), [], [], [], []
            for i, text in enumerate(batch.column(1)):
                words = terms(text.as_py())
                if words:
                    times = Counter(words)
                    held = times.keys() & number.keys()
                    places.append(i), ns.append(len(words))
                    found.append([number[w] for w in held]), tfs.append([times[w] for w in held])
            columns = [ids.take(pa.array(places, pa.int64())), pa.array(ns, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tfs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tfs array<long>")


def mask_groups(places: np.ndarray, docs: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents that hold a term, the distinct masks (a row of n_terms booleans each), and which mask each of the documents has.

    places and docs: a posting for each term (by its place in the item) that a document holds.
    """
    held, row = np.unique(docs, return_inverse=True)
    bits = np.zeros((n_terms, len(held)), bool)
    bits[places, row] = True
    packed = np.ascontiguousarray(np.packbits(bits, axis=0).T)
    _, first, group = np.unique(packed.view(np.dtype((np.void, packed.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return held, bits[:, first].T, group


class Best:
    """The best documents of each item in a task so far."""

    def __init__(self, n_items: int):
        self.scores = [np.zeros(0, np.int64)] * n_items
        self.ids = [np.zeros(0, np.int64)] * n_items

    def bar(self, item: int) -> int:
        """What a document's score must reach to come in; 1 as long as there are fewer than TOP."""
        return int(self.scores[item][-1]) if len(self.scores[item]) == TOP else 1

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[item], scores]), np.concatenate([self.ids[item], ids])
        order = np.lexsort((ids, -scores))[:TOP]
        self.scores[item], self.ids[item] = scores[order], ids[order]


def search_slice(best: Best, items: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, norms: np.ndarray, ids: np.ndarray, starts: np.ndarray, at: np.ndarray, tfs: np.ndarray) -> None:
    """Puts a slice's documents into ``best``.

    items: their terms and how often they have them; norms: each document's m; the postings of term t are at[starts[t] : starts[t + 1]] (places in ids), with their tfs.
    """
    shares = (1_000_000_000 * tfs) // (1000 * tfs + 12 * norms[at])
    sizes = np.diff(starts)
    most = np.zeros(len(sizes), np.int64)
    some = np.flatnonzero(sizes)
    if len(some):
        most[some] = np.maximum.reduceat(shares, starts[some])
    for item, (own, repeats) in enumerate(items):
        if not sizes[own].any():
            continue
        factors = weights[own] * repeats
        if int((factors * most[own]).sum()) < best.bar(item):
            continue
        postings = np.concatenate([np.arange(starts[t], starts[t + 1]) for t in own])
        places = np.repeat(np.arange(len(own)), sizes[own])
        width = max(1, MASK_CELLS // len(own))
        for low in range(0, len(ids), width):  # once, but for items of very many terms
            some = slice(None) if width >= len(ids) else (at[postings] >= low) & (at[postings] < low + width)
            if len(postings[some]):
                _search_masks(best, item, factors, most[own], places[some], at[postings[some]], shares[postings[some]], ids)


def _search_masks(best: Best, item: int, factors: np.ndarray, most: np.ndarray, places: np.ndarray, docs: np.ndarray, shares: np.ndarray, ids: np.ndarray) -> None:
    """Puts the documents of an item's postings (place of the term, document, share) into ``best``."""
    held, masks, group = mask_groups(places, docs, len(factors))
    highest = masks @ (factors * most)
    order = np.argsort(-highest, kind="stable")
    members = np.argsort(group, kind="stable")
    ends = np.cumsum(np.bincount(group, minlength=len(masks)))
    begins = np.concatenate([[0], ends[:-1]])
    table = None
    bar, done, step = best.bar(item), 0, TOP
    while done < len(order) and highest[order[done]] >= bar:
        chosen = order[done : done + step]
        chosen = chosen[highest[chosen] >= bar]
        done, step = done + step, step * 2
        rows = np.concatenate([members[begins[g] : ends[g]] for g in chosen])
        if table is None:
            table = np.zeros((len(held), len(factors)), np.int64)
            table[np.searchsorted(held, docs), places] = shares
        scores = table[rows] @ factors
        good = scores >= bar
        if good.any():
            best.add(item, scores[good], ids[held[rows[good]]])
            bar = best.bar(item)


def _searched(postings: DataFrame, shared, statistics: tuple[int, int], weights: np.ndarray) -> DataFrame:
    """item (its number in the block), doc_id and score: at most TOP rows of each item from each task."""
    n_docs, n_terms = statistics
    null = np.iinfo(np.int64).max  # stands for a null doc_id, which comes last among equal scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, items = shared.value
        best = Best(len(items))
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            cuts, load = [0], 0
            for i, s in enumerate(sizes.tolist()):
                load += s
                if load > SLICE_POSTINGS or i + 1 - cuts[-1] >= SLICE_ROWS:
                    cuts.append(i + 1)
                    load = 0
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                n = part.column(1).to_numpy()
                term, tf = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()
                ids = part.column(0).fill_null(null).to_numpy(zero_copy_only=False)
                order = np.argsort(term, kind="stable")
                starts = np.searchsorted(term[order], np.arange(len(number) + 1))
                at = np.repeat(np.arange(b - a), sizes[a:b])[order]
                search_slice(best, items, weights, 75 + (25 * n * n_docs) // n_terms, ids, starts, at, tf[order])
        item = np.repeat(np.arange(len(items)), [len(s) for s in best.scores])
        ids = np.concatenate([np.zeros(0, np.int64), *best.ids])
        columns = [pa.array(item, pa.int32()), pa.array(ids, pa.int64(), mask=ids == null), pa.array(np.concatenate([np.zeros(0, np.int64), *best.scores]), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    return postings.mapInArrow(run, "item int, doc_id long, score long").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))


def _search_block(docs: DataFrame, items: list[tuple], item_type: str) -> DataFrame:
    """The best documents of a block's items (item_id, text)."""
    spark = docs.sparkSession
    counted = [(item_id, Counter(terms(text))) for item_id, text in items]
    number: dict[bytes, int] = {}
    held = [(np.array([number.setdefault(w, len(number)) for w in c], np.int64), np.array(list(c.values()), np.int64)) for _, c in counted]
    shared = spark.sparkContext.broadcast((number, held))
    postings = stored(_postings(docs.withColumn("doc_id", F.col("doc_id").cast("long")), shared), "search-postings")
    n_docs, n_terms = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = np.zeros(len(number), np.int64)
    for t, df in postings.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1))).collect():  # a block's terms at most
        frequency[t] = df
    weights = np.array([weight(n_docs, int(df)) for df in frequency], np.int64)
    found = _searched(postings, shared, (n_docs, max(n_terms, 1)), weights)
    by = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    first = found.withColumn("r", F.row_number().over(Window.partitionBy("item", "part").orderBy(*by))).filter(F.col("r") <= TOP)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by))).filter(F.col("rank") <= TOP)
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(items)], f"item int, item_id {item_type}")
    return last.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def ranked_documents(docs: DataFrame, items: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank (int, from 1), doc_id and score of the TOP documents (doc_id, text) with the highest scores above 0, for each item (item_id, text)."""
    kind = items.schema["item_id"].dataType.simpleString()
    distinct = items.filter("text IS NOT NULL").select("item_id", "text").distinct()
    size = F.octet_length("text") / 4 + 1  # no more terms than that, about
    n_blocks = max(1, math.ceil((distinct.agg(F.sum(size)).first()[0] or 0) / block_terms))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    out = None
    for b in range(n_blocks):
        found = _search_block(docs, [tuple(r) for r in distinct.filter(block == b).collect()], kind)
        found = stored(found, "search-found") if n_blocks > 1 else found
        out = found if out is None else out.unionByName(found)
    return out


def op11_mask_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT k, doc_id, len(ts)::BIGINT AS n, unnest(ts) AS term FROM d),
s AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM (SELECT len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0)),
p AS (SELECT k, doc_id, n, term, count(*)::BIGINT AS tf FROM t GROUP BY ALL),
f AS (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term),
i AS (SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT item_id, text, term, count(*)::BIGINT AS times FROM i GROUP BY ALL),
w AS (SELECT item_id, text, term, times, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM q JOIN f USING (term), s),
x AS (SELECT item_id, text, k, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))))::BIGINT AS score FROM w JOIN p USING (term), s GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 20
"""
