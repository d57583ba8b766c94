"""Scans and sinks of bundles and intermediate records; open keys stay JSON."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.objects import valid_json

REFS = "array<struct<source_name:string,external_id:string>>"


def scan_bundles(spark: SparkSession, path: str) -> DataFrame:
    """bundle_id, name, size, mtime and text of each bundle file; a malformed one stays with ``ok`` false."""
    raw = spark.read.option("wholetext", True).text(path).select("value", "_metadata.file_name", "_metadata.file_size", "_metadata.file_modification_time")
    return raw.select(F.regexp_replace("file_name", r"\.json$", "").alias("bundle_id"), F.col("file_name").alias("name"), F.col("file_size").alias("size"), F.col("file_modification_time").alias("mtime"), "value", valid_json(F.col("value")).alias("ok"))


def prefer_tier(bundles: DataFrame, tier: Column) -> DataFrame:
    """One row a name: the smallest tier, then the newest, then the largest bundle_id."""
    from pyspark.sql import Window

    order = Window.partitionBy("name").orderBy(tier, F.desc("mtime"), F.desc("bundle_id"))
    return bundles.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def explode_objects(bundles: DataFrame) -> DataFrame:
    """bundle_id, pos, type, id, name, description, refs, obj (JSON) of the objects of each readable bundle."""
    objs = F.from_json(F.get_json_object("value", "$.objects"), "array<string>")
    each = bundles.filter("ok").select("bundle_id", F.posexplode(objs).alias("pos", "obj"))
    field = lambda n: F.get_json_object("obj", f"$.{n}").alias(n)
    return each.select("bundle_id", "pos", field("type"), field("id"), field("name"), field("description"), field("source_ref"), field("target_ref"), field("relationship_type"), F.from_json(F.get_json_object("obj", "$.external_references"), REFS).alias("refs"), "obj")


def catalogue(bundles: DataFrame) -> DataFrame:
    """name, size, mtime, model, provider, extractor and number of behavioural objects; null for malformed files, which are listed too."""
    types = F.from_json(F.get_json_object("value", "$.objects"), "array<struct<type:string>>")
    n = F.size(F.filter(types, lambda o: o["type"].isin("attack-pattern", "threat-actor")))
    field = lambda key: F.when(F.col("ok"), F.get_json_object("value", f"$.x_{key}")).alias(key)
    return bundles.select("name", "size", "mtime", field("model"), field("provider"), field("extractor"), F.when(F.col("ok") & types.isNotNull(), n).alias("n_behavioural"))


@dataclass(frozen=True)
class Taxonomy:
    """Names that a taxonomy's format gives to its parts: source of technique ids, types of matrix and tactic objects, keys of a technique's platforms and of a tactic's short name."""

    id_source: str
    matrix: str
    tactic: str
    platforms: str
    short_name: str


def taxonomy_tables(objects: DataFrame, names: Taxonomy) -> dict[str, DataFrame]:
    """technique, relationship and kill_chain tables from exploded taxonomy objects (with ``obj`` JSON).

    A tactic's rank is the number of known phases before it in the last matrix. Fails if there are no objects at all, as an empty taxonomy would silently match nothing.
    """
    if objects.isEmpty():
        raise ValueError("the taxonomy holds no objects")
    arr = lambda p: F.coalesce(F.from_json(F.get_json_object("obj", p), "array<string>"), F.array().cast("array<string>"))
    own = F.filter("refs", lambda r: F.lower(r["source_name"]) == names.id_source.lower())
    phases = F.from_json(F.get_json_object("obj", "$.kill_chain_phases"), "array<struct<phase_name:string>>")
    technique = objects.filter("type = 'attack-pattern'").select(
        F.get(own, F.lit(0))["external_id"].alias("technique_id"), "id", "name", "description", F.transform(arr(f"$.{names.platforms}"), lambda p: F.lower(p)).alias("platforms"),
        F.coalesce(F.filter(F.transform(phases, lambda p: p["phase_name"]), lambda p: p.isNotNull()), F.array().cast("array<string>")).alias("phases"), F.coalesce(F.get_json_object("obj", "$.revoked") == "true", F.lit(False)).alias("revoked"), "pos")
    tactic = objects.filter(F.col("type") == names.tactic).select(F.col("id").alias("ref"), F.get_json_object("obj", f"$.{names.short_name}").alias("phase"))
    last = objects.filter(F.col("type") == names.matrix).groupBy().agg(F.max_by("obj", "pos").alias("obj"))
    refs = last.select(F.posexplode(arr("$.tactic_refs")).alias("place", "ref"))
    first = refs.join(tactic, "ref").filter("phase <> ''").groupBy("phase").agg(F.min("place").alias("at"))
    # a row a phase: the window runs over a handful of rows
    kill_chain = first.select("phase", (F.row_number().over(Window.orderBy("at")) - 1).alias("rank"))
    rel = objects.filter("type = 'relationship'").select(F.col("source_ref").alias("src"), F.col("relationship_type").alias("rel_type"), F.col("target_ref").alias("dst"))
    return {"technique": technique, "kill_chain": kill_chain, "relationship": rel}


def enforce_ir(records: DataFrame, column: str = "raw") -> DataFrame:
    """actors, behaviours and techniques of each JSON record as arrays: missing ones empty, a single value wrapped, invalid items
    (a behaviour without description, an actor without name) dropped, strings trimmed."""
    def items(name: str, field: str) -> Column:
        raw = F.get_json_object(column, f"$.{name}")
        as_list = F.when(raw.isNull(), F.array().cast("array<string>")).when(F.startswith(raw, F.lit("[")), F.from_json(raw, "array<string>")).otherwise(F.array(raw))
        value = lambda x: F.trim(F.coalesce(F.get_json_object(x, f"$.{field}"), F.when(~F.startswith(x, F.lit("{")), x)))
        return F.filter(F.transform(F.coalesce(as_list, F.array().cast("array<string>")), value), lambda v: F.coalesce(v, F.lit("")) != "")

    return records.withColumn("actors", items("threat_actors", "name")).withColumn("behaviours", items("behaviors", "description")).withColumn("techniques", items("attack_patterns", "id"))


def write_ir(records: DataFrame, path: str, partition: str = "run_date") -> None:
    records.write.mode("append").partitionBy(partition).parquet(path)


def resume_ir(records: DataFrame, wanted: DataFrame, key: str = "doc_id", column: str = "raw") -> DataFrame:
    """``key`` and ``column`` of every wanted key: its stored record, or ``{}`` where it is missing or isn't a JSON object."""
    ok = valid_json(F.col(column)) & F.startswith(F.trim(column), F.lit("{"))
    return wanted.select(key).join(records.filter(ok).select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit("{}")))


def write_side_outputs(validation: DataFrame, metrics: DataFrame, log: DataFrame, path: str) -> None:
    """Validation, metrics and conversion log of one run, a table each."""
    for name, df in (("validation", validation), ("metrics", metrics), ("conversion_log", log)):
        df.write.mode("append").parquet(f"{path}/{name}")


def read_sessions(raw: DataFrame, column: str = "raw", version: int = 1) -> DataFrame:
    """session_id, turn, prompt, response of a JSON session store; a wrong version gives nothing, turns without both strings and empty sessions go."""
    kind = "struct<version:int,sessions:map<string,array<struct<prompt:string,response:string>>>>"
    s = raw.select(F.from_json(column, kind).alias("s")).filter(F.col("s.version") == version)
    each = s.select(F.explode("s.sessions").alias("session_id", "turns")).select("session_id", F.posexplode("turns").alias("turn", "t"))
    return each.filter("t.prompt IS NOT NULL AND t.response IS NOT NULL").select("session_id", "turn", "t.prompt", "t.response")


def flatten_runs(runs: DataFrame) -> DataFrame:
    """run_id, status, stage, prompt, result of runs with ``tags`` and ``params`` maps."""
    tag = lambda k: F.get(F.map_values(F.map_filter("tags", lambda a, b: a == k)), F.lit(0))
    par = lambda k: F.get(F.map_values(F.map_filter("params", lambda a, b: a == k)), F.lit(0))
    return runs.select("run_id", "status", tag("stage").alias("stage"), par("prompt").alias("prompt"), F.coalesce(tag("process_result_summary"), tag("process_result"), F.lit("")).alias("result"))
