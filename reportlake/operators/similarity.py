"""Near-duplicate vectors inside groups: pivots say which can be near, blocks of bounded size are compared."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stage_rows

#: Vectors of one block, about; two blocks are compared at a time.
BLOCK = 512
#: Vectors of a group for each of its pivots, about.
CELL = 4096


def _unit(values, dim: int) -> np.ndarray:
    x = np.asarray(values, np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _prepared(vectors: DataFrame, group: str) -> DataFrame:
    """g, dim, vec_id, embedding of the vectors that can be near others: neither null nor empty nor zero."""
    v = vectors.filter(F.size("embedding") > 0).filter(F.exists("embedding", lambda x: x != 0))
    return v.select(F.col(group).alias("g"), F.size("embedding").alias("dim"), "vec_id", "embedding")


def _same_group(n: DataFrame) -> tuple[DataFrame, object]:
    """``n`` with its keys renamed and the condition of a join to a frame with g and dim; null is a group."""
    return n.withColumnRenamed("g", "n_g").withColumnRenamed("dim", "n_dim"), F.col("g").eqNullSafe(F.col("n_g")) & (F.col("dim") == F.col("n_dim"))


def _pivots(v: DataFrame) -> DataFrame:
    """n_g, n_dim, pivots (their values in a row): about one of ``CELL`` vectors of a group, by hash; an empty list in small groups."""
    n, same = _same_group(v.groupBy("g", "dim").agg(F.count("*").alias("n")))
    drawn = F.pmod(F.xxhash64("vec_id", F.lit("pivot")), F.lit(1 << 31)) * F.lit(CELL) < (1 << 31)
    chosen = v.join(n, same).filter(drawn & (F.col("n") > 2 * CELL)).groupBy("g", "dim").agg(F.flatten(F.collect_list("embedding")).alias("pivots"))
    chosen = chosen.select(F.col("g").alias("c_g"), F.col("dim").alias("c_dim"), "pivots")
    both = n.join(chosen, F.col("n_g").eqNullSafe(F.col("c_g")) & (F.col("n_dim") == F.col("c_dim")), "left")
    return both.select("n_g", "n_dim", F.coalesce("pivots", F.array().cast("array<float>")).cast("array<double>").alias("pivots"))


def _in_blocks(v: DataFrame, keys: list[str]) -> DataFrame:
    """Vectors of a key in blocks by hash, so that a hot one is spread over as many as it needs: keys, block, ids, values."""
    n = v.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks"))
    n = n.select(*[F.col(k).alias(f"n_{k}") for k in keys], "blocks")
    placed = v.join(n, [F.col(k).eqNullSafe(F.col(f"n_{k}")) for k in keys]).withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks"))
    return placed.groupBy(*keys, "block").agg(F.collect_list("vec_id").alias("ids"), F.flatten(F.collect_list("embedding")).alias("values"))


def _celled(radius: float, guests: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, cell): the cell of the nearest pivot, or every cell in which a vector within ``radius`` may have its nearest pivot."""
    for b in batches:
        for dim, ids, values, pivots in zip(*(b.column(i) for i in range(4)), strict=True):
            dim, ids = dim.as_py(), np.asarray(ids.values)
            if not len(pivots.values):
                row, cell = np.arange(len(ids)), np.zeros(len(ids), np.int64)
            else:
                angle = np.arccos(np.clip(_unit(values.values, dim) @ _unit(pivots.values, dim).T, -1, 1))
                # triangle inequality, at both ends; a little more for rounding
                row, cell = np.nonzero(angle <= angle.min(axis=1, keepdims=True) + 2 * radius + 1e-6) if guests else (np.arange(len(ids)), angle.argmin(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(cell)], names=["vec_id", "cell"])


def _cells(v: DataFrame, pivots: DataFrame, radius: float, guests: bool) -> DataFrame:
    """g, dim, cell, vec_id, embedding."""
    keyed = _in_blocks(v, ["g", "dim"]).join(pivots, F.col("g").eqNullSafe(F.col("n_g")) & (F.col("dim") == F.col("n_dim")))
    cells = keyed.select("dim", "ids", "values", "pivots").mapInArrow(partial(_celled, radius, guests), "vec_id long, cell long")
    return v.join(cells, "vec_id")


def _compared(threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of the left block with a smaller id of the right block at the threshold or more."""
    for b in batches:
        for dim, ids, values, others, other_values in zip(*(b.column(i) for i in range(5)), strict=True):
            a, c, dim = np.asarray(ids.values), np.asarray(others.values), dim.as_py()
            near = (_unit(values.values, dim) @ _unit(other_values.values, dim).T >= threshold) & (c[None, :] < a[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(a[near.any(axis=1)], pa.int64())], names=["vec_id"])


def with_earlier(vectors: DataFrame, others: DataFrame, group: str, threshold: float) -> DataFrame:
    """vec_id of the ``vectors`` that have a row of ``others`` of their group with a smaller vec_id at cosine ``threshold`` or more.

    Every vector is at home with its nearest pivot, and one of ``others`` is a guest of each pivot that is at most twice the angle of ``threshold`` farther from it than its nearest: by
    the triangle inequality no near pair is missed, and vectors of other cells are never compared. A cell is compared in blocks; only ids leave a comparison, never pairs. Threshold above 0.
    """
    radius = math.acos(min(1.0, threshold))
    a, b = stage_rows(_prepared(vectors, group)), stage_rows(_prepared(others, group))
    pivots = stage_rows(_pivots(a))
    keys = ["g", "dim", "cell"]
    homes, guests = _in_blocks(_cells(a, pivots, radius, False), keys), _in_blocks(_cells(b, pivots, radius, True), keys)
    guests = guests.select(*[F.col(k).alias(f"o_{k}") for k in keys], F.col("ids").alias("others"), F.col("values").alias("other_values"))
    met = homes.join(guests, [F.col(k).eqNullSafe(F.col(f"o_{k}")) for k in keys]).filter(F.array_min("others") < F.array_max("ids"))
    met = met.select("dim", "ids", "values", "others", "other_values")
    return met.repartition("dim", F.xxhash64(F.get("ids", F.lit(0)), F.get("others", F.lit(0)))).mapInArrow(partial(_compared, threshold), "vec_id long").distinct()


def first_of_equals(vectors: DataFrame, group: str) -> DataFrame:
    """Rows without an earlier row of the group with the same vector: both rules drop the others. Null, empty and zero vectors stay."""
    plain = F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    first = vectors.filter(plain).groupBy(group, "embedding").agg(F.min("vec_id").alias("vec_id")).select(group, "vec_id", "embedding")
    return first.unionByName(vectors.filter(~plain).select(group, "vec_id", "embedding"))


def first_kept(vectors: DataFrame, group: str, threshold: float = 0.92) -> DataFrame:
    """Rows without an earlier row of the same group at cosine ``threshold`` or more. ``vectors``: group, vec_id (unique), embedding.

    The keep-smallest-id form of the greedy rule: a row also goes if the earlier one it resembles goes itself. Null, empty and zero vectors stay.
    """
    a = stage_rows(first_of_equals(vectors, group))
    return a.join(with_earlier(a, a, group, threshold), "vec_id", "left_anti")


def greedy_kept(vectors: DataFrame, group: str, threshold: float = 0.92) -> DataFrame:
    """The greedy rule itself: a row stays unless it resembles an earlier row that stayed. Columns: group, vec_id.

    Rounds settle it: rows without an earlier open row that they resemble stay, rows that resemble one that stays go; the others are open for the next round.
    """
    open_rows = stage_rows(first_of_equals(vectors, group))
    kept = None
    while True:
        waiting = stage_rows(with_earlier(open_rows, open_rows, group, threshold))
        stays = stage_rows(open_rows.join(waiting, "vec_id", "left_anti"))
        kept = stays if kept is None else kept.unionByName(stays)
        if waiting.isEmpty():
            return kept.select(group, "vec_id")
        rest = stage_rows(open_rows.join(waiting, "vec_id", "left_semi"))
        open_rows = stage_rows(rest.join(with_earlier(rest, stays, group, threshold), "vec_id", "left_anti"))
