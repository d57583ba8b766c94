"""Benchmark decontamination by greedy string tiling.

Runs of words shared with benchmark items are found through hashed seeds; for
each pair of document and item with enough seeds, the longest non-overlapping common runs are marked again and again
by running Karp-Rabin, and the share of the item that is covered decides. Tiles may stand in any order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import keyed, stage
from .textnum import Words, chunks, prefix, signed, spans

MIN_RUN = 5
COVERAGE = 0.6
#: The seed filter has a fixed size: 2^18 longs of 64 bits.
SLOTS = 1 << 18
#: Seeds of items, some 60 bytes each, that are broadcast; above that both sides are shuffled, documents dealt over ``SALTS``.
BROADCAST_ROWS = 200_000
SALTS = 16


def tiles(a: np.ndarray, b: np.ndarray, min_run: int = MIN_RUN) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of the greedy tiling of two word sequences given as hashes.

    Longest matches are marked first; among equal ones the first in ``b``, then in ``a``. Search lengths fall: rolling hashes of the
    runs of free words of one length are compared, so that memory stays in proportion to both sequences, however often they repeat.
    """
    sums = prefix(a), prefix(b)
    free = np.ones(len(a), bool), np.ones(len(b), bool)
    found: list[tuple[int, int, int]] = []
    size = min(len(a), len(b)) + 1
    while (size := _longest(sums, free, min_run, size - 1)) >= min_run:
        (at_a, keys_a), (at_b, keys_b) = (_grams(s, f, size) for s, f in zip(sums, free, strict=True))
        places: dict[int, list[int]] = {}
        common = np.isin(keys_a, keys_b)
        for at, key in zip(at_a[common][::-1].tolist(), keys_a[common][::-1].tolist(), strict=True):
            places.setdefault(key, []).append(at)
        for t, key in zip(at_b.tolist(), keys_b.tolist(), strict=True):
            where = places.get(key)
            if not where or not free[1][t : t + size].all():
                continue
            # a place that is taken stays taken
            while where and not free[0][where[-1] : where[-1] + size].all():
                where.pop()
            if where:
                s = where.pop()
                found.append((s, t, size))
                free[0][s : s + size] = False
                free[1][t : t + size] = False
    return found


def _grams(sums: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the runs of ``size`` free words."""
    taken = np.append(np.flatnonzero(~free), len(free))
    at = np.arange(len(free))
    at = at[taken[np.searchsorted(taken, at)] - at >= size]
    return at, spans(sums, at, at + size)


def _longest(sums: tuple, free: tuple, low: int, high: int) -> int:
    """Length from ``low`` to ``high`` of the longest run of free words that both sequences hold, 0 if none is so long."""
    best = 0
    while low <= high:
        size = (low + high + 1) // 2
        _, keys_a = _grams(sums[0], free[0], size)
        _, keys_b = _grams(sums[1], free[1], size)
        if np.isin(keys_b, keys_a).any():
            best, low = size, size + 1
        else:
            high = size - 1
    return best


def _seed_rows(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seeds of each item, one row a position; an item of fewer than ``k`` words is its only seed."""
    for rows, data, offsets in chunks(batches):
        w = Words(data, offsets, lower=True)
        sums = prefix(w.hash)
        for size in range(1, k + 1):
            at = w.windows(size)
            n = w.counts[w.text[at]]
            at, n = (at, n) if size == k else (at[n == size], n[n == size])
            seeds = spans(sums, at, at + size)
            ids = rows.column(0).take(pa.array(w.text[at]))
            yield pa.RecordBatch.from_arrays([pa.array(signed(seeds)), ids, pa.array(n, pa.int64()), pa.array(np.full(len(at), size), pa.int32())], names=["seed", "item_id", "item_words", "width"])


def _with_seeds(widths: list[int], mask: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in chunks(batches):
        w = Words(data, offsets, lower=True)
        sums = prefix(w.hash)
        at = [w.windows(k) for k in widths]
        seeds = np.concatenate([spans(sums, x, x + k) for x, k in zip(at, widths, strict=True)])
        of = w.text[np.concatenate(at)]
        hit = bloom.test(mask, seeds)
        seeds, of = signed(seeds[hit]), of[hit]
        if not len(of):
            continue
        order = np.argsort(of, kind="stable")
        docs, first = np.unique(of[order], return_index=True)
        lists = [np.unique(x) for x in np.split(seeds[order], first[1:])]
        yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(docs)), rows.column(1).take(pa.array(docs)), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "text", "seeds"])


def _tile_rows(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def hashes(texts) -> list[np.ndarray]:
        raw = [(t or "").encode() for t in texts]
        w = Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), lower=True)
        return [w.hash[i:j] for i, j in zip(w.bounds[:-1], w.bounds[1:], strict=True)]

    for b in batches:
        for i in range(0, len(b), 64):
            part = b.slice(i, 64)
            docs, items = hashes(part.column(2).to_pylist()), hashes(part.column(3).to_pylist())
            found = [tiles(d, x, max(1, min(k, len(x)))) for d, x in zip(docs, items, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([len(f) for f in found], pa.int32()), pa.array([max((n for _, _, n in f), default=0) for f in found], pa.int32()), pa.array([sum(n for _, _, n in f) / max(1, len(x)) for f, x in zip(found, items, strict=True)], pa.float64())],
                names=["doc_id", "item_id", "n_tiles", "longest", "coverage"],
            )


def contaminated(docs: DataFrame, benchmark: DataFrame, min_run: int = MIN_RUN, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, n_tiles, longest and coverage of each pair whose tiles cover ``coverage`` of the item.

    ``docs``: doc_id, text; ``benchmark``: item_id, text; other columns are ignored. Words are lower-cased (A-Z) and compared
    whole. Null texts have no words; items of fewer than ``min_run`` words match where all their words stand in a row. Repeated item texts
    are items of their own. Rows without doc_id or item_id are left out, repeated documents are found as often. Either table may be empty.
    """
    spark, docs, benchmark = docs.sparkSession, keyed(docs), keyed(benchmark, "item_id")
    found = benchmark.select("item_id", "text").mapInArrow(partial(_seed_rows, min_run), "seed long, item_id long, item_words long, width int")
    seeds = stage(found.groupBy("seed", "item_id").agg(F.count("*").alias("places"), F.min("item_words").alias("item_words"), F.min("width").alias("width")))
    mask = bloom.build(seeds.select("seed"), SLOTS)
    widths = sorted(r.width for r in seeds.select("width").distinct().collect()) or [min_run]
    held = spark.sparkContext.broadcast(mask)
    near = stage(docs.select("doc_id", "text").mapInArrow(_masked(widths, held), "doc_id long, text string, seeds array<long>"))
    pairs = _met(near.select("doc_id", F.explode("seeds").alias("seed")), seeds).groupBy("doc_id", "item_id").agg(F.sum("places").alias("n"), F.min("item_words").alias("m"))
    # every tile of l words holds l - min_run + 1 seed positions of the item, so covered words are at most min_run times the positions of shared seeds
    pairs = pairs.filter(F.col("n") * min_run >= F.col("m") * coverage)
    full = pairs.join(near.select("doc_id", "text"), "doc_id").join(benchmark.select("item_id", F.col("text").alias("item_text")), "item_id").select("doc_id", "item_id", "text", "item_text")
    return full.mapInArrow(partial(_tile_rows, min_run), "doc_id long, item_id long, n_tiles int, longest int, coverage double").filter(F.col("coverage") >= coverage)


def _met(found: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seeds of documents with the items that hold them. A seed that many documents hold is dealt by a salt, unless the items' seeds are few enough to be broadcast."""
    if seeds.count() <= BROADCAST_ROWS:
        return found.join(F.broadcast(seeds), "seed")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(seeds.withColumn("salt", salts), ["seed", "salt"]).drop("salt")


def _masked(widths: list[int], held):
    return lambda batches: _with_seeds(widths, held.value, batches)
