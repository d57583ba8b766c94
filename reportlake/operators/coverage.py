"""Coverage of report techniques by a capability catalogue, and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .extract import top_per
from .ground import platform_ok


def hierarchy_match(wanted: DataFrame, capabilities: DataFrame) -> DataFrame:
    """bundle_id, technique_id, capability_id and the capability's columns: equal ids, or one the parent of the other; siblings never match.

    The condition is a disjunction; three equi joins keep it hashable.
    """
    up = lambda c: F.substring_index(c, ".", 1)
    cap = capabilities.withColumnRenamed("technique_id", "cap_technique")
    sub = lambda c: F.contains(c, F.lit("."))
    same = wanted.join(cap, F.col("technique_id") == F.col("cap_technique"))
    child = wanted.filter(~sub(F.col("technique_id"))).join(cap.filter(sub(F.col("cap_technique"))), F.col("technique_id") == up(F.col("cap_technique")))
    parent = wanted.filter(sub(F.col("technique_id"))).join(cap.filter(~sub(F.col("cap_technique"))), up(F.col("technique_id")) == F.col("cap_technique"))
    return same.unionByName(child).unionByName(parent)


def coverage_status(wanted: DataFrame, capabilities: DataFrame) -> DataFrame:
    """bundle_id, technique_id, n_runnable, n_excluded, status: covered, platform_excluded (only capabilities of other platforms) or unmatched.

    ``wanted``: bundle_id, technique_id, attested platforms; ``capabilities``: capability_id, technique_id, platforms.
    """
    m = hierarchy_match(wanted, capabilities).withColumn("ok", platform_ok(F.col("platforms"), F.col("attested")))
    per = m.groupBy("bundle_id", "technique_id").agg(F.count_if("ok").alias("n_runnable"), F.count_if(~F.col("ok")).alias("n_excluded"))
    status = F.when(F.col("n_runnable") > 0, "covered").when(F.col("n_excluded") > 0, "platform_excluded").otherwise("unmatched")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return wanted.select("bundle_id", "technique_id").distinct().join(per, ["bundle_id", "technique_id"], "left").select("bundle_id", "technique_id", zero("n_runnable"), zero("n_excluded")).withColumn("status", status)


def coverage_report(status: DataFrame) -> DataFrame:
    """One row a bundle: techniques wanted, covered, excluded and unmatched, and the unmatched ids."""
    n = lambda s: F.count_if(F.col("status") == s)
    return status.groupBy("bundle_id").agg(
        F.count("*").alias("n_techniques"), n("covered").alias("n_covered"), n("platform_excluded").alias("n_excluded"), n("unmatched").alias("n_unmatched"),
        F.sum("n_runnable").alias("available"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("status") == "unmatched", F.col("technique_id")))), ",").alias("unmatched"))


def capped(matches: DataFrame, most: int = 3) -> DataFrame:
    """At most ``most`` (one at least) capabilities of each bundle and technique, by id."""
    return top_per(matches, ["bundle_id", "technique_id"], ["capability_id"], max(1, most))


def with_fallback(rows: DataFrame, group: str, primary: str, secondary: str, limit: int = 5) -> DataFrame:
    """Rows of the primary source; in a group without any, the first ``limit`` of the secondary by id. ``rows``: group, source, capability_id."""
    tiered = rows.filter(F.col("source").isin(primary, secondary)).withColumn("tier", F.when(F.col("source") == primary, 1).otherwise(2))
    best = tiered.groupBy(group).agg(F.min("tier").alias("tier"))
    kept = tiered.join(best, [group, "tier"])
    n = F.row_number().over(Window.partitionBy(group).orderBy("capability_id"))
    return kept.filter("tier = 1").unionByName(kept.filter("tier = 2").withColumn("_n", n).filter(F.col("_n") <= limit).drop("_n"))


def score_sets(got: DataFrame, expected: DataFrame, keys: list[str], item: str) -> DataFrame:
    """tp, fp, fn, precision, recall and F1 of each key; a ratio without denominator is 0."""
    a, b = got.select(*keys, item).distinct().withColumn("_g", F.lit(1)), expected.select(*keys, item).distinct().withColumn("_e", F.lit(1))
    j = a.join(b, [*keys, item], "full_outer")
    n = lambda c: F.count_if(c)
    s = j.groupBy(*keys).agg(n(F.col("_g").isNotNull() & F.col("_e").isNotNull()).alias("tp"), n(F.col("_e").isNull()).alias("fp"), n(F.col("_g").isNull()).alias("fn"))
    return with_ratios(s)


def with_ratios(s: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    s = s.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return s.withColumn("f1", F.round(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), 6)).withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))
