"""Mixing sources to target weights by pivotal dependent rounding, DataFrame operations only.

Every document of a source is wanted f = target / source size times. The whole part
of f is taken outright; the fractions are rounded by the pivotal method: two units
with fractions a and b exchange mass at random until one of them is 0 or 1, so that
their sum never changes. Units meet in small blocks of like sizes; each block
leaves one residual unit, and residuals meet again in the next level of the tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, stage, uniform, word_count

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
BLOCK = 32
#: Counts, some 50 bytes each, that are broadcast; more are joined by a shuffle.
FEW = 100_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, source_size, target of ``sizes`` (source, size).

    Sources are ordered by code point, null last, and get ``weights`` in turn; they share the sum of
    all sizes, no target over ``cap`` times its source's size. With the sources in order of cap / weight, those
    below the water level stop at their cap and the rest share what is left by weight.
    The windows run over one row a source, not over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(cap))
    everything = Window.partitionBy()
    level = Window.orderBy(F.col("most") / F.col("w"), F.col("source").isNull(), "source")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    after = level.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("rest", F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))).withColumn("w_rest", F.sum("w").over(after))
    # Below the level while the cap is no more than the share of the rest.
    per = per.withColumn("capped", F.col("most") <= F.col("rest") * F.col("w") / F.col("w_rest"))
    first = F.min_by(F.when(~F.col("capped"), F.col("rest") / F.col("w_rest")), F.when(~F.col("capped"), F.col("most") / F.col("w"))).over(everything)
    return per.withColumn("water", first).select("source", F.col("source_size").cast("long").alias("source_size"), F.when(F.col("capped"), F.col("most")).otherwise(F.col("w") * F.col("water")).cast("double").alias("target"))


#: One step of the pivotal method: the residual (id, p) meets the next unit x.
#: With a + b < 1 one of them falls to 0 and the other holds a + b; else one rises to 1 and the other keeps a + b - 1.
_FOLD = """
aggregate(
  slice(units, 2, size(units)),
  named_struct('id', units[0].id, 'size', units[0].size, 'p', units[0].p, 'one', cast(array() as array<bigint>)),
  (s, x) -> CASE
    WHEN s.p + x.p < 1D THEN
      IF(u(s.id, x.id) * (s.p + x.p) < s.p,
         named_struct('id', s.id, 'size', s.size, 'p', s.p + x.p, 'one', s.one),
         named_struct('id', x.id, 'size', x.size, 'p', s.p + x.p, 'one', s.one))
    ELSE
      IF(u(s.id, x.id) * (2D - s.p - x.p) < 1D - x.p,
         named_struct('id', x.id, 'size', x.size, 'p', s.p + x.p - 1D, 'one', array_append(s.one, s.id)),
         named_struct('id', s.id, 'size', s.size, 'p', s.p + x.p - 1D, 'one', array_append(s.one, x.id)))
  END)
"""


def _fold(seed: int) -> str:
    return _FOLD.replace("u(s.id, x.id)", f"((pmod(xxhash64(s.id, x.id, {seed}L), 4503599627370496L) + 0.5D) / 4503599627370496D)")


def pivotal_round(units: DataFrame, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """ids rounded up to 1. ``units``: id (long, unique), stratum, size (long), p in (0, 1).

    In each stratum the number of ids chosen is its sum of p, rounded up or down. Level 0 blocks
    hold about ``block`` units of one stratum and size class, dealt by hash, so a hot stratum is
    spread over as many blocks as it needs; inside a block units meet in the order of their sizes, so that what is
    exchanged is of like size; each level leaves one unit of each block.
    The last unit of a stratum becomes 1 with its own probability.
    """
    size_class = F.floor(F.log2(F.col("size") + 1) * 2).cast("int")
    live = units.select("id", "size", F.struct("stratum").alias("s"), size_class.alias("c"), "p")
    chosen, level = None, 0
    while True:
        if level:
            # later levels join the classes of a stratum
            n = stage(live.groupBy("s").agg(F.count("*").alias("n")))
            most = n.agg(F.max("n")).first()[0] or 0
            if most <= 1:
                break
            dealt = live.join(n, "s").withColumn("c", F.lit(0))
        else:
            n = stage(live.groupBy("s", "c").agg(F.count("*").alias("n")))
            # a row a source and size class; a plan hint only where it is known to be small
            dealt = live.join(F.broadcast(n) if n.count() <= FEW else n, ["s", "c"])
        blocks = dealt.withColumn("b", F.pmod(F.xxhash64("id", F.lit(seed + level)), F.ceil(F.col("n") / F.lit(block))))
        folded = (
            blocks.groupBy("s", "c", "b")
            .agg(F.sort_array(F.collect_list(F.struct("size", "id", "p"))).alias("units"))
            .select("s", F.expr(_fold(seed + level)).alias("r"))
        )
        folded = stage(folded)
        ones = folded.select(F.explode("r.one").alias("id"))
        chosen = ones if chosen is None else chosen.unionByName(ones)
        live = folded.select(F.col("r.id").alias("id"), F.col("r.size").alias("size"), "s", F.lit(0).alias("c"), F.col("r.p").alias("p"))
        level += 1
    last = live.filter(uniform(F.col("id"), F.lit(seed)) < F.col("p")).select("id")
    return last if chosen is None else chosen.unionByName(last)


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken words of each document.

    ``docs``: doc_id (null: left out; repeated rows are rounded one by one), text, source. A null text has size 0, a null source is a source of its own
    that comes last; empty texts are taken with their source's rate but add no words. Documents of a
    source all have the same expected number of copies, at most ``cap``; reruns give the same copies.
    """
    sized = stage(keyed(docs).select("doc_id", "source", word_count(F.col("text")).alias("size")))
    # a row a source, which four plans read: their windows run once
    targets = stage(source_targets(sized, weights, cap))
    f = F.when(F.col("source_size") > 0, F.least(F.lit(cap), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    t = targets.select(F.struct("source").alias("s"), "source_size", "target", f.alias("f"))
    t = t.withColumn("whole", F.floor(F.col("f") + F.lit(1e-12))).withColumn("p", F.greatest(F.lit(0.0), F.col("f") - F.col("whole")))
    wanted = stage(sized.withColumn("s", F.struct("source")).join(t, "s"))
    units = wanted.filter("p > 1e-12").select(F.col("doc_id").alias("id"), F.col("source").alias("stratum"), "size", "p")
    up = pivotal_round(units, seed=seed).groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("up"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("size"))
    out = wanted.join(up, "doc_id", "left").withColumn("nth", nth)
    copies = (F.col("whole") + F.coalesce((F.col("nth") <= F.col("up")).cast("long"), F.lit(0))).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
