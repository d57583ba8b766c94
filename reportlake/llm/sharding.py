"""Sharding by balanced label propagation under the exact quotas of the shards.

Documents of equal text are linked through their group. All start without a shard. Large groups, at most
``LARGE`` times the number of shards, get their labels first, in pieces no larger than a shard; the others ask for the
shard that their place in the queue falls into and are admitted as a whole; those that a shard's end cuts ask again for
the room that is left. A piece is split only if no shard has room for it. Documents without
links then fill the shards to counts that differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, stage

N_SHARDS = 40
#: Rows that one window of :func:`numbered` holds, about.
BUCKET = 20_000
#: Groups above 1 / LARGE of a shard are placed one by one.
LARGE = 8
KEY = ["doc_id", "copy"]


def numbered(df: DataFrame, part: list[str], name: str, order: Column | None = None, rows: int = BUCKET) -> DataFrame:
    """Number the rows of each ``part`` from 0 without gaps, in the order of ``order`` (its hash bucket if not given).

    Two levels: rows are numbered inside small buckets, and buckets get their offset from their counts,
    so that a part of any size is spread over tasks. ``order`` is a long in [0, 2^31): buckets are its ranges.
    Parts are few (shards, large groups): their counts are broadcast.
    """
    n = df.groupBy(*part).agg(F.count("*").alias("_n"))
    key = order if order is not None else F.pmod(F.xxhash64("doc_id", "copy"), F.lit(1 << 31))
    d = df.withColumn("_k", key).join(F.broadcast(n), part).withColumn("_b", F.floor(F.col("_k") * F.ceil(F.col("_n") / F.lit(rows)) / F.lit(1 << 31)))
    per = d.groupBy(*part, "_b").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.withColumn("_o", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    inside = Window.partitionBy(*part, "_b").orderBy("_k", "doc_id", "copy")
    d = d.withColumn("_r", F.row_number().over(inside)).join(offsets, [*part, "_b"])
    return d.withColumn(name, (F.col("_o") + F.col("_r") - 1).cast("long")).drop("_k", "_n", "_b", "_o", "_r")


def _pack(groups: list[tuple[int, int]], free: dict[int, int], cap: int) -> list[tuple[int, int, int, int]]:
    """(gid, from, to, shard): the rows of each of a few (gid, size) groups by ranges of their numbers; takes the room from ``free``.

    Pieces of ``cap`` rows and the rest of each group, largest first, go to the shard with the least room that holds them
    (the lower one of two). If there is none, they fill the shards with most room.
    """
    pieces = [(min(cap, g - at), gid, at) for gid, g in groups for at in range(0, g, cap)]
    out = []
    for size, gid, at in sorted(pieces, key=lambda p: (-p[0], p[1], p[2])):
        while size:
            fits = [(room, s) for s, room in free.items() if room >= size]
            s = min(fits)[1] if fits else min((-room, s) for s, room in free.items())[1]
            n = min(size, free[s])
            out.append((gid, at, at + n, s))
            free[s] -= n
            at, size = at + n, size - n
    return out


def _dealt(rows: DataFrame, ranges: list[tuple[int, int, int, int]]) -> DataFrame:
    """doc_id, copy and shard of the rows of the groups in ``ranges``."""
    to = rows.sparkSession.createDataFrame(ranges, "gid long, `from` long, upto long, shard int")
    own = rows.join(F.broadcast(to.select("gid").distinct()), "gid", "left_semi")
    return numbered(own, ["gid"], "n").join(F.broadcast(to), "gid").filter("n >= `from` AND n < upto").select(*KEY, "shard")


def _along(rows: DataFrame, free: dict[int, int], order: Column | None = None) -> DataFrame:
    """``rows`` with the shard that their number falls into when the free places are laid end to end."""
    gaps, at = [], 0
    for s, room in sorted(free.items()):
        gaps.append((at, at + room, s))
        at += room
    gaps = rows.sparkSession.createDataFrame(gaps, "`from` long, upto long, shard int")
    return numbered(rows.withColumn("all", F.lit(0)), ["all"], "n", order).join(F.broadcast(gaps), (F.col("n") >= F.col("from")) & (F.col("n") < F.col("upto"))).drop("all", "n", "from", "upto")


def shard_documents(docs: DataFrame, shards: int = N_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, gid, shard and slot of every document; shard counts differ by one at most.

    ``docs``: doc_id (null: left out), text; other columns are ignored. Rows that repeat a doc_id are told apart by ``copy``. A null text counts as an empty one, and all empty texts
    are one group. A group larger than a shard fills as many shards as it needs. Ties go to the lower
    shard; an empty table gives no rows.
    """
    docs = keyed(docs)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = docs.select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(F.md5(raw)).alias("gid"))
    # repeated rows of one doc_id are rows of their own
    base = stage(base.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id").orderBy("gid"))))
    total = base.count()
    cap = max(1, total // shards)
    # exact quotas: the first total % shards shards hold one row more
    free = {s: total // shards + (s < total % shards) for s in range(shards)}
    linked = base.groupBy("gid").agg(F.count("*").alias("g")).filter("g > 1")
    state = stage(base.join(linked, "gid").select(*KEY, "gid", "g"))
    large = state.filter(F.col("g") * LARGE > cap).select("gid", "g").distinct().collect()
    fixed = _dealt(state, _pack([tuple(r) for r in large], free, cap))
    # the rows of a group are neighbours in the queue, so that only the groups at the ends of shards are cut
    asked = stage(_along(state.filter(F.col("g") * LARGE <= cap), free, F.pmod(F.xxhash64("gid"), F.lit(1 << 31))))
    cut = asked.groupBy("gid", "g").agg(F.min("shard").alias("lo"), F.max("shard").alias("hi")).filter("lo < hi").select("gid", "g").collect()
    whole = asked.filter(~F.col("gid").isin([r.gid for r in cut])) if cut else asked
    for r in whole.groupBy("shard").count().collect():
        free[r["shard"]] -= r["count"]
    again = _dealt(asked.drop("shard"), _pack([tuple(r) for r in cut], free, cap))
    loose = _along(stage(base.join(linked, "gid", "left_anti").select(*KEY)), free)
    placed = stage(fixed.unionByName(whole.select(*KEY, "shard")).unionByName(again).unionByName(loose.select(*KEY, "shard")))
    return base.join(numbered(placed, ["shard"], "slot"), KEY)
