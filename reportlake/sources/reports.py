"""Scans of report folders and listings of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx


def scan_reports(spark: SparkSession, path: str) -> DataFrame:
    """report_id, name, ext, stem, content, mtime and size of every file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(tx.slug(F.col("path")).alias("report_id"), name.alias("name"), tx.extension(name).alias("ext"), tx.clean_stem(name).alias("stem"), F.decode("content", "utf-8").alias("content"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def classify_paths(paths: DataFrame) -> DataFrame:
    """Add plan and part (plan, overview, infrastructure) of ``path``; unknown parts and skipped folders go."""
    low = F.lower("path")
    part = F.when(low.rlike("infra"), "infrastructure").when(low.rlike("overview|summary|readme|intro"), "overview").otherwise("plan")
    plan = F.regexp_extract(low, r"^[a-z]+://([^/]+)/", 1)
    return paths.withColumn("plan", plan).withColumn("part", part).filter((F.col("plan") != "") & ~low.rlike(r"/(?:\.git|node_modules|archive)/"))


def largest_candidates(paths: DataFrame) -> DataFrame:
    """The largest file (then the first path) of each plan and part. ``paths``: path, size, plan, part."""
    return paths.groupBy("plan", "part").agg(F.min_by("path", F.struct((-F.col("size")).alias("size"), "path")).alias("path"), F.max("size").alias("size"), F.count("*").alias("n"))


#: Where the parts of a plan folder stand. Part, tier, whether the largest file counts (else the first by path), path below the folder.
PLAN_RULES = (
    ("scenario", 0, False, r"^Scenario\.md$"),
    ("scenario", 1, True, r"^(?:Emulation_Plan/(?:(?!(?i:yaml)/)[^/]+/)?)?(?:(?!README)[^/])*(?i:scenario)(?:(?!README)[^/])*\.md$"),
    ("scenario", 1, True, r"^(?:Emulation_Plan/(?:(?!(?i:yaml)/)[^/]+/)?)?(?i:phase)[^/]*\.md$"),
    ("scenario", 2, False, r"^Emulation_Plan/README\.md$"),
    ("scenario", 3, False, r"^README\.md$"),
    ("overview", 0, False, r"^CTI_Emulation_Resources/[^/]*Overview[^/]*\.md$"),
    ("overview", 1, False, r"^CTI_Emulation_Resources/(?!(?i:readme\.md)$)[^/]+\.md$"),
    ("overview", 2, False, r"^Intelligence_Summary/[^/]+\.md$"),
    ("overview", 3, False, r"^Intelligence_Summary\.md$"),
    ("infrastructure", 0, True, r"^(?:Emulation_Plan/(?:[^/]+/)?)?Infrastructure[^/]*\.md$"),
)
PLAN_FOLDERS = ("Emulation_Plan", "CTI_Emulation_Resources", "Resources", "Intelligence_Summary", "Operations_Flow")


def plan_files(files: DataFrame, depth: int = 2, rules: tuple = PLAN_RULES) -> DataFrame:
    """plan, part, path, size, tier, n: the file of each part of each plan, from its best tier of rules; n files stand in that tier.

    ``files``: path (below the libraries' root), size. A plan is a folder of ``depth`` names with one of the ``PLAN_FOLDERS`` in it; folders that begin with a dot aren't looked at. A rule's path ends the search
    depth by itself. Parts without a file have no row.
    """
    names = F.split("path", "/")
    below = files.filter(F.size(names) > depth).select("path", "size", F.array_join(F.slice(names, 1, depth), "/").alias("plan"), F.array_join(F.slice(names, F.lit(depth + 1), F.size(names)), "/").alias("rest"))
    below = below.filter(~F.col("plan").rlike(r"(?:^|/)\."))
    plans = below.filter(F.col("rest").rlike("^(?:" + "|".join(PLAN_FOLDERS) + ")/")).select("plan").distinct()
    met = F.array(*[F.when(F.col("rest").rlike(p), F.struct(F.lit(part).alias("part"), F.lit(tier).alias("tier"), F.lit(large).alias("large"))) for part, tier, large, p in rules])
    each = below.join(plans, "plan", "left_semi").select("plan", "path", "size", F.explode(F.array_distinct(F.array_compact(met))).alias("m")).select("plan", "path", "size", "m.*")
    first = F.struct(F.when(F.col("large"), -F.col("size")).otherwise(0).alias("a"), F.col("path").alias("b"), (-F.col("size")).alias("c"))
    tiers = each.groupBy("plan", "part", "tier").agg(F.min_by(F.struct("path", "size"), first).alias("f"), F.count("*").alias("n"))
    return tiers.groupBy("plan", "part").agg(F.min_by(F.struct("f", "n"), "tier").alias("b"), F.min("tier").alias("tier")).select("plan", "part", "b.f.path", "b.f.size", "tier", "b.n")


def alias_table(spark: SparkSession, aliases: dict[str, list[str]]) -> DataFrame:
    """alias_lc, field: one row an alias of each field."""
    return spark.createDataFrame([(a.lower(), field) for field, names in aliases.items() for a in names], "alias_lc string, field string")


def alias_scan(settings: DataFrame) -> dict[str, DataFrame]:
    """Lookup tables of a settings document (``value``: JSON): ``sections`` and ``columns`` (alias_lc, field), ``facts`` (fact, field).

    The document's keys section_headers, table_columns and inline_facts each map a field to its aliases. The first field, by name, that has an alias keeps it.
    """
    found = {}
    for name, key in (("sections", "section_headers"), ("columns", "table_columns"), ("facts", "inline_facts")):
        pairs = settings.select(F.explode(F.from_json(F.get_json_object("value", f"$.{key}"), "map<string,array<string>>")).alias("field", "names")).select("field", F.explode("names").alias("alias"))
        found[name] = pairs.groupBy(F.lower(F.trim("alias")).alias("fact" if name == "facts" else "alias_lc")).agg(F.min("field").alias("field"))
    return found


def actor_name(slug_column: str, table: DataFrame, slugs: DataFrame) -> DataFrame:
    """Add actor: the canonical name of a folder slug by ``table`` (slug, actor), else the slug in title case."""
    return slugs.join(table.withColumnRenamed("slug", slug_column), slug_column, "left").withColumn("actor", F.coalesce("actor", F.initcap(F.translate(slug_column, "-_", "  "))))
