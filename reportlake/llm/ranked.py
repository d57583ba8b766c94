"""Ranked lexical search, term at a time with a limited number of accumulators.

Documents are cut into shards, each with a small inverted index of the terms that are asked for. An item's terms are
processed rarest first. As long as a document without accumulator could still reach the k-th best partial score,
new accumulators are made; from then on the postings of all further terms only update the survivors, exactly.
Shards return their k best per item, a task carries the k-th best score from shard to shard, and Spark
merges what the tasks return. Items are a stated query set: they are broadcast in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import keyed
from .textnum import ASCII_LOWER, Words, chunks

K = 10
#: Items, and bytes of their texts, that are searched at a time.
BLOCK_ITEMS = 2048
BLOCK_BYTES = 4 << 20
#: Bytes of text of a shard; a longer text is a shard of its own.
SHARD_BYTES = 8 << 20
#: Parts of the results that are merged on their own first.
PARTS = 32
#: A term is a run of digits, letters and bytes above 0x7F; all else is a blank here.
_byte = np.arange(256)
IN_TERM = (_byte >= 0x80) | ((_byte >= 48) & (_byte <= 57)) | ((_byte >= 65) & (_byte <= 90)) | ((_byte >= 97) & (_byte <= 122))
FOLD = np.where(IN_TERM, ASCII_LOWER, 32).astype(np.uint8)


def _terms(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Terms of several texts, A-Z lower-cased."""
    return Words(FOLD[data], offsets)


class Vocabulary:
    """The distinct terms of a block of items, by 64-bit hash and length."""

    def __init__(self, items: list[str]):
        raw = [t.encode() for t in items]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
        w = _terms(np.frombuffer(b"".join(raw), np.uint8), offsets)
        self.hash, first, number = np.unique(w.hash, return_index=True, return_inverse=True)
        self.length = (w.end - w.start)[first]
        #: Distinct terms of each item.
        self.items = [np.unique(number[a:b]) for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]

    def __len__(self) -> int:
        return len(self.hash)

    def find(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``w`` of terms that are in the vocabulary, and the terms' numbers."""
        if not len(self.hash) or not len(w.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hash, w.hash), len(self.hash) - 1)
        hit = np.flatnonzero((self.hash[at] == w.hash) & (self.length[at] == w.end - w.start))
        return hit, at[hit]


def _postings(vocabulary: Vocabulary, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, document, occurrences), by term and document."""
    hit, term = vocabulary.find(w)
    key, tf = np.unique(term * np.int64(len(w.counts)) + w.text[hit], return_counts=True)
    return key // max(1, len(w.counts)), key % max(1, len(w.counts)), tf


def _statistics(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each term; number -1: documents with terms, -2: all their terms."""
    vocabulary = shared.value
    df, documents, total = np.zeros(len(vocabulary), np.int64), 0, 0
    for _, data, offsets in chunks(batches, limit=SHARD_BYTES):
        w = _terms(data, offsets)
        df += np.bincount(_postings(vocabulary, w)[0], minlength=len(df))
        documents += int((w.counts > 0).sum())
        total += int(w.counts.sum())
    held = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([held, [-1, -2]])), pa.array(np.concatenate([df[held], [documents, total]]))], names=["term", "n"])


def kth_largest(values: np.ndarray, k: int) -> int:
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else 0


def search_shard(terms: list[int], start: np.ndarray, docs: np.ndarray, adds: np.ndarray, best: np.ndarray, n_docs: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, exact scores, accumulators) that may be among the k best of one item in this shard.

    ``terms``: numbers, rarest first; postings of term t: ``start[t]`` to ``start[t + 1]`` of ``docs`` and ``adds``;
    ``best``: the largest addition of each term here. ``floor``: a score that k documents are known to reach.
    A document whose score equals the k-th is kept, as ties are told apart by doc_id.
    """
    rest = np.cumsum(best[terms][::-1])[::-1].tolist() + [0]
    if rest[0] < max(floor, 1):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    score, alive, creating = np.zeros(n_docs, np.int64), np.zeros(n_docs, bool), True
    for i, t in enumerate(terms):
        where, add = docs[start[t] : start[t + 1]], adds[start[t] : start[t + 1]]
        if creating:
            score[where] += add
            alive[where] = True
            # without accumulator a document gets ``rest`` at most
            if rest[i + 1] < floor or (rest[i + 1] < score.max() and rest[i + 1] < kth_largest(score, k)):
                creating = False
        else:
            kept = alive[where]
            score[where[kept]] += add[kept]
    found = np.flatnonzero(alive & (score >= max(floor, 1)))
    return found, score[found], int(alive.sum())


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _search(shared, documents: int, total: int, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The k best (item number, doc_id, score) of each item in this task."""
    vocabulary, weight, queries = shared.value
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]
    for rows, data, offsets in chunks(batches, limit=SHARD_BYTES):
        w = _terms(data, offsets)
        term, doc, tf = _postings(vocabulary, w)
        if not len(term):
            continue
        ids = np.asarray(rows.column(rows.schema.get_field_index("doc_id")))
        m = 10 + (90 * w.counts.astype(np.int64) * documents) // max(1, total)
        adds = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        start = np.searchsorted(term, np.arange(len(vocabulary) + 1))
        best = np.zeros(len(vocabulary), np.int64)
        here = np.unique(term)
        best[here] = np.maximum.reduceat(adds, start[here])
        for q, terms in enumerate(queries):
            own = terms[best[terms] > 0]
            if not len(own):
                continue
            old_ids, old = held[q]
            found, score, _ = search_shard(own.tolist(), start, doc, adds, best, len(w.counts), k, int(old[-1]) if len(old) == k else 0)
            if len(found):
                new_ids, new = np.concatenate([old_ids, ids[found]]), np.concatenate([old, score])
                keep = _top(new_ids, new, k)
                held[q] = new_ids[keep], new[keep]
    for q, (ids, score) in enumerate(held):
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q)), pa.array(ids), pa.array(score)], names=["query", "doc_id", "score"])


def _blocks(items: DataFrame) -> Iterator[list[Row]]:
    block, size = [], 0
    for r in items.toLocalIterator():
        block.append(r)
        size += len(r.text)
        if len(block) == BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _block_search(docs: DataFrame, block: list[Row], k: int) -> DataFrame:
    """Results of one block of items; the broadcasts are bounded by the block."""
    spark = docs.sparkSession
    vocabulary = Vocabulary([r.text for r in block])
    counts = docs.select("text").mapInArrow(partial(_statistics, spark.sparkContext.broadcast(vocabulary)), "term long, n long")
    found = {r.term: r.n for r in counts.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    documents, total = found.pop(-1, 0), found.pop(-2, 0)
    df = np.zeros(len(vocabulary), np.int64)
    df[list(found)] = list(found.values())
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    # rarest first; terms that no document holds are in no posting
    queries = [t[np.lexsort((t, df[t]))] for t in vocabulary.items]
    shared = spark.sparkContext.broadcast((vocabulary, weight, queries))
    near = docs.select("doc_id", "text").mapInArrow(partial(_search, shared, documents, total, k), "query long, doc_id long, score long")
    order = [F.desc("score"), F.asc("doc_id")]
    for part in (["query", "part"], ["query"]):
        near = near.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(block)], "query long, item_id long")
    return near.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score (long) of the k best documents of each item with a score above 0.

    ``docs``: doc_id, text; ``items``: item_id, text; other columns are ignored. Rows without key are left out of counts and results; a null or empty text has no terms.
    Repeated rows of ``docs`` are documents of their own, and repeated rows of ``items`` are items of their own, with ranks of their own.
    Equal scores are ranked by ascending doc_id. An empty table gives no rows. Terms are compared by a 64-bit hash and their length.
    """
    docs = keyed(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = keyed(items, "item_id").filter("text <> ''").select(F.col("item_id").cast("long").alias("item_id"), "text")
    none = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, [_block_search(docs, b, k) for b in _blocks(items)] or [none])
