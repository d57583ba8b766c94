"""Connected components by joins.

Joins whose sides grow with the links are merge joins in every round: a broadcast relation would be gathered and kept by the driver, once more in each of many rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(links: DataFrame) -> DataFrame:
    """id, component (its smallest id) of every id in ``links`` (a, b).

    Each round takes the smallest label among neighbours, then the label of that label; rounds end when no label
    changes. Labels are written to the shared folder after each round, and the same plan runs in all. A hot vertex is reduced before the shuffle.
    """
    both = stage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("label"), F.lit(True).alias("changed")))
    while not labels.filter("changed").isEmpty():
        known = labels.select("id", "label")
        # the smallest label of the neighbours, and a label is an id too: its own label is one step ahead
        near = both.join(known.hint("merge"), F.col("b") == F.col("id")).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("m"))
        low = known.join(near.hint("merge"), "id").select("id", F.col("label").alias("old"), F.least("label", "m").alias("low"))
        jump = known.select(F.col("id").alias("low"), F.col("label").alias("next"))
        labels = stage(low.join(jump.hint("merge"), "low").select("id", F.least("low", "next").alias("label"), (F.least("low", "next") < F.col("old")).alias("changed")))
    return labels.select("id", F.col("label").alias("component"))


def merged(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """id, component after further ``links`` (a, b) between ids, of which some have a component in ``label`` already.

    Components are points here: only those that the links join are looked at, so a round costs what is new in it, and nothing without links.
    """
    if label is None:
        return components(links)
    if links.isEmpty():
        return label
    of = lambda x: label.select(F.col("id").alias(x), F.col("component").alias(f"c_{x}")).hint("merge")
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("c_a", "a").alias("x"), F.coalesce("c_b", "b").alias("y"))
    joined = components(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    step = joined.select(F.col("id").alias("component"), F.col("component").alias("next"))
    old = label.join(step.hint("merge"), "component", "left").select("id", F.coalesce("next", "component").alias("component"))
    return stage(old.unionByName(joined.join(label.select("id").hint("merge"), "id", "left_anti")))
