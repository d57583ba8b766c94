"""Context assembly and analytics of runs, sessions and conversations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.objects import valid_json
from ..functions.text import strip
from .extract import top_per


def context_within(blocks: DataFrame, budget: int, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """Blocks of each key that fit the token budget in order: the first always, then up to the first that would overflow; with
    the number left out. Costs aren't negative, so the running sum decides."""
    w = Window.partitionBy(key).orderBy(order)
    cost = tx.estimate_tokens(F.col(text))
    b = blocks.withColumn("cost", cost).withColumn("cum", F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rn", F.row_number().over(w))
    kept = b.filter((F.col("rn") == 1) | (F.col("cum") <= budget)).groupBy(key).agg(F.count("*").alias("n_kept"), F.max("cum").alias("used"))
    return b.groupBy(key).agg(F.count("*").alias("n")).join(kept, key).select(key, "n_kept", "used", (F.col("n") - F.col("n_kept")).alias("omitted"))


@dataclass(frozen=True)
class Enricher:
    """A named step that adds the columns ``fields`` to prompts; ``enrich`` takes the prompts and its settings and returns them with these columns."""

    name: str
    fields: tuple[str, ...]
    enrich: Callable[[DataFrame, dict], DataFrame]


def enriched(prompts: DataFrame, enrichers: list[Enricher], settings: dict[str, dict]) -> DataFrame:
    """``prompts`` with the columns of the enrichers that ``settings`` names, in order. An unknown name, or an enricher that doesn't add what it declares, is an error."""
    known = {e.name for e in enrichers}
    if missing := sorted(set(settings) - known):
        raise ValueError(f"unknown enrichers: {missing}")
    for e in enrichers:
        if e.name in settings:
            prompts = e.enrich(prompts, settings[e.name])
            if lost := [f for f in e.fields if f not in prompts.columns]:
                raise ValueError(f"{e.name} does not add {lost}")
    return prompts


def intel_context(blocks: DataFrame, budget: int, key: str = "bundle_id", order: str = "pos", text: str = "block") -> DataFrame:
    """key, context: blocks of each key in order while the token budget lasts, the first always, then a note on the number left out."""
    w = Window.partitionBy(key).orderBy(order)
    cost = tx.estimate_tokens(F.col(text))
    b = blocks.withColumn("_cum", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_rn", F.row_number().over(w))
    keep = (F.col("_rn") == 1) | (F.col("_cum") <= budget)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct(order, text)))), lambda s: s[text]), "\n\n")
    left = F.count_if(~keep)
    note = F.when(left > 0, F.concat(F.lit("\n\n["), left.cast("string"), F.lit(" further object(s) omitted to stay within the context budget.]"))).otherwise("")
    return b.groupBy(key).agg(F.concat(body, note).alias("context"))


def intel_enricher(blocks: DataFrame, budget: int) -> Enricher:
    """The enricher that adds the context of the bundles attached to a prompt. ``blocks``: bundle_id, pos, block.

    Prompts have bundle_ids, an array; without any the context is null. An attached bundle without blocks is an error of the job: nothing is skipped silently.
    """
    def enrich(prompts: DataFrame, settings: dict) -> DataFrame:
        each = prompts.select("prompt_id", F.posexplode("bundle_ids").alias("place", "bundle_id"))
        rows = each.join(blocks, "bundle_id", "left")
        checked = F.when(F.col("block").isNull(), F.raise_error(F.concat(F.lit("nothing to ground on in bundle "), F.col("bundle_id").cast("string")))).otherwise(F.col("block"))
        rows = rows.select("prompt_id", F.struct("place", "pos").alias("at"), checked.alias("block"))
        return prompts.join(intel_context(rows, settings.get("budget", budget), "prompt_id", "at", "block").withColumnRenamed("context", "intel_context"), "prompt_id", "left")

    return Enricher("intel", ("intel_context",), enrich)


def last_turns(turns: DataFrame, k: int = 8) -> DataFrame:
    return top_per(turns, ["conv_id"], [F.desc("turn")], k)


def transcript(turns: DataFrame, k: int = 8) -> DataFrame:
    """The last k turns of each conversation as ``User: …`` and ``Assistant: …`` paragraphs in order."""
    who = F.initcap("role")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(who, F.lit(": "), "text").alias("t")))), lambda s: s["t"])
    return last_turns(turns, k).groupBy("conv_id").agg(F.array_join(rows, "\n\n").alias("transcript"), F.count("*").alias("n_turns"))


def most_recent(events: DataFrame, key: str, ts: str, k: int = 64) -> DataFrame:
    """The k keys used last; ranks run over one row a key."""
    last = events.groupBy(key).agg(F.max(ts).alias("last_used"))
    return last.orderBy(F.desc("last_used"), key).limit(k)


def time_to_threshold(events: DataFrame, key: str, entity: str, ts: str, n: int, timeout_s: int) -> DataFrame:
    """When the n-th distinct entity of a key first came; ``timed_out`` if later than ``timeout_s`` after the key's first event or never."""
    seen = events.groupBy(key, entity).agg(F.min(ts).alias("first_seen"))
    w = Window.partitionBy(key).orderBy("first_seen", entity)
    nth = seen.withColumn("r", F.row_number().over(w)).filter(F.col("r") == n).select(key, F.col("first_seen").alias("reached"))
    start = seen.groupBy(key).agg(F.min("first_seen").alias("start"), F.count("*").alias("n_entities"))
    late = F.col("reached").isNull() | (F.unix_timestamp("reached") - F.unix_timestamp("start") > timeout_s)
    return start.join(nth, key, "left").withColumn("timed_out", late)


def latest_stage(events: DataFrame, key: str, stage: str, ts: str, terminal: tuple[str, ...], tie: str) -> DataFrame:
    """Last stage of each run; the first terminal stage stays, whatever comes after it."""
    at, ended = F.struct(F.col(ts), F.col(tie)), F.col(stage).isin(*terminal)
    return events.groupBy(key).agg(F.coalesce(F.min_by(F.when(ended, F.col(stage)), F.when(ended, at)), F.max_by(stage, at)).alias("stage"))


def orphans(runs: DataFrame, live: DataFrame) -> DataFrame:
    """Running runs that nobody owns, as proposed KILLED rows."""
    return runs.filter("status = 'RUNNING'").join(live, "run_id", "left_anti").withColumn("status", F.lit("KILLED")).withColumn("stop_reason", F.lit("orphaned"))


def stop_reason(tags: Column) -> Column:
    """``user``, ``orphaned`` or empty, from a map of tags."""
    return F.when(F.get(F.map_values(F.map_filter(tags, lambda k, v: k == "cancelled")), F.lit(0)) == "true", "user").when(F.array_contains(F.map_keys(tags), "orphaned"), "orphaned").otherwise("")


def search(runs: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows with the query in a column, any case, literally; an empty query gives all."""
    q = query.strip().lower()
    if not q:
        return runs
    hit = None
    for c in columns:
        one = F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(q))
        hit = one if hit is None else hit | one
    return runs.filter(hit)


def page(runs: DataFrame, group: str, start: str, tie: str, offset: int = 0, limit: int = 100, per_group: int = 1000) -> DataFrame:
    """Newest first, at most ``per_group`` of each group, then offset and limit; ``total`` is the number of rows before these two."""
    kept = top_per(runs, [group], [F.desc(start), tie], per_group)
    total = kept.agg(F.count("*").alias("total"))
    # one row beside a page
    return kept.orderBy(F.desc(start), tie).offset(offset).limit(limit).join(F.broadcast(total)).orderBy(F.desc(start), tie)


def steps(runs: DataFrame) -> DataFrame:
    """run_id, idx and the fields thought, tool_name, tool_args, observation of the numbered keys of ``params``, in numeric order."""
    # the outer form, as Spark filters the rows of the other one by the size of the map, which makes each map twice
    each = runs.select("run_id", F.explode_outer("params").alias("k", "v")).withColumn("field", F.regexp_extract("k", r"^(thought|tool_name|tool_args|observation)_\d+$", 1)).filter("field <> ''")
    each = each.withColumn("idx", F.regexp_extract("k", r"(\d+)$", 1).cast("int"))
    return each.groupBy("run_id", "idx").pivot("field", ["thought", "tool_name", "tool_args", "observation"]).agg(F.first("v"))


def created_entity(runs: DataFrame, tool: str, id_key: str, item_key: str) -> DataFrame:
    """run_id, name, entity_id, members, names: what the first call of ``tool`` made, from its arguments and observation; runs without such a call, or whose
    arguments hold no list ``atomic_ordering``, have no row. Members are ids in order, names those of members that observations of the run name by ``item_key``, in the
    same order; the last name of an id counts. Unknown ids have no name, and runs without any name no row. ``runs`` has a row a run.

    All work is inside a run's row, so nothing is shuffled. What several expressions read is generated as a list of one first, or Spark would write its expression into each of them.
    """
    once = lambda df, **c: df.select("run_id", F.explode_outer(F.array(F.struct(*[v.alias(k) for k, v in c.items()]))).alias("x")).select("run_id", "x.*")
    number = lambda k: F.substring_index(k, "_", -1)
    numbered = F.filter(F.map_entries("params"), lambda e: e["key"].rlike(r"^(tool_name|tool_args|observation)_\d+$") & e["value"].isNotNull())
    fields = F.transform(numbered, lambda e: F.struct(number(e["key"]).cast("int").alias("idx"), F.substring(e["key"], F.lit(1), F.length(e["key"]) - F.length(number(e["key"])) - 1).alias("field"), e["value"].alias("v")))
    s = once(runs, fields=fields)
    of = lambda field: F.filter("fields", lambda x: x["field"] == field)
    calls = F.transform(F.filter(of("tool_name"), lambda x: x["v"] == tool), lambda x: x["idx"])
    seen = F.transform(of("observation"), lambda x: named_items(x["v"], item_key, x["idx"]))
    s = once(s, fields=F.col("fields"), call=F.array_min(calls), known=F.sort_array(F.flatten(F.array_compact(seen))))
    value = lambda field: F.get(F.filter("fields", lambda x: (x["field"] == field) & (x["idx"] == F.col("call"))), F.lit(0))["v"]
    s = once(s.filter("call IS NOT NULL AND size(known) > 0"), tool_args=value("tool_args"), observation=value("observation"), known=F.col("known"))
    args = F.when(valid_json(F.col("tool_args")) & F.startswith(strip(F.col("tool_args")), F.lit("{")), F.from_json("tool_args", "name string, atomic_ordering string"))
    s = once(s, args=args, observation=F.col("observation"), known=F.col("known")).filter("startswith(args.atomic_ordering, '[')")
    name = F.coalesce(F.nullif("args.name", F.lit("")), F.lit("Unnamed"))
    made = F.coalesce(F.when(valid_json(F.col("observation")), F.get_json_object("observation", f"$.{id_key}")), F.lit("unknown"))
    s = once(s, name=name, entity_id=made, members=F.from_json("args.atomic_ordering", "array<string>"), known=F.col("known"))
    of_member = lambda m: F.try_element_at(F.filter("known", lambda x: x["id"] == m), F.lit(-1))["name"]
    return once(s, name=F.col("name"), entity_id=F.col("entity_id"), members=F.col("members"), names=F.array_compact(F.transform("members", of_member))).filter("size(names) > 0")


def named_items(observation: Column, id_key: str, idx: Column) -> Column:
    """(idx, place, id, name) of the entities that an observation names: a single object, a list of objects or of JSON texts; null for other texts.

    Objects are read in one parse of the observation; lists that hold anything else are read value by value.
    """
    row = lambda i, key, name: F.struct(idx.alias("idx"), i.alias("place"), key.alias("id"), name.alias("name"))
    objects = F.from_json(observation, f"array<struct<`{id_key}`:string,name:string>>")
    several = F.when(F.startswith(strip(observation), F.lit("[")), F.from_json(observation, "array<string>")).otherwise(F.array(observation))
    each = F.transform(several, lambda x, i: row(i, F.get_json_object(x, f"$.{id_key}"), F.get_json_object(x, "$.name")))
    # a list of one, so that the observation is parsed once
    read = F.get(F.transform(F.array(objects), lambda o: F.when(o.isNull() | F.exists(o, lambda x: x.isNull()), each).otherwise(F.transform(o, lambda x, i: row(i, x[id_key], x["name"])))), F.lit(0))
    # a text without the letters of both keys names nothing, unless escapes spell them
    may = F.contains(observation, F.lit("\\u")) | (F.contains(observation, F.lit(id_key)) & F.contains(observation, F.lit("name")))
    return F.when(may & valid_json(observation), F.filter(read, lambda x: (x["id"] != "") & (x["name"] != "")))


#: What a sentence that only repeats a panel beside it holds.
BOILERPLATE = ("I have successfully created", ("abilities", "adversary"))


def spoken_sentences(x: Column) -> Column:
    """Sentences of a thought without those that only announce what was created."""
    head, parts = BOILERPLATE
    announced = lambda s: F.contains(s, F.lit(head)) & (F.contains(s, F.lit(parts[0])) | F.contains(s, F.lit(parts[1])))
    return F.filter(tx.sentences(x), lambda s: ~announced(s))


def batch_outcome(files: DataFrame, batch: str, failed: Column) -> DataFrame:
    """n_done, n_failed and all_failed of each batch: a batch fails only if nothing in it succeeded."""
    n = F.count_if(failed)
    return files.groupBy(batch).agg(F.count("*").alias("n_done"), n.alias("n_failed"), (F.count("*") == n).alias("all_failed"))


def readiness(agents: DataFrame, group: str, agent: str, platform: str, least: int) -> DataFrame:
    """Sorted platforms, number of rows with an id, and whether these are enough."""
    return agents.groupBy(group).agg(F.array_sort(F.collect_set(platform)).alias("platforms"), F.count(agent).alias("n"), (F.count(agent) >= least).alias("ready"))


def profiles_by_name(profiles: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """Profiles whose ``column`` is exactly one of ``names`` (same column)."""
    return profiles.join(names.select(column).distinct(), column, "left_semi")


def credit(rows: DataFrame, extractor: Column, model: Column) -> DataFrame:
    """Add extractor (llm, offline or none) and model, which is credited only for rows that the model made."""
    return rows.withColumn("extractor", extractor).withColumn("model", F.when(F.col("extractor") == "llm", model))


def call_log(events: DataFrame, endpoint: str, code: str) -> DataFrame:
    return events.groupBy(endpoint, code).agg(F.count("*").alias("n"))


def total_or_null(df: DataFrame, key: str, value: str) -> DataFrame:
    """Sum of each key, null if any part is unknown."""
    return df.groupBy(key).agg(F.when(F.count("*") == F.count(value), F.sum(value)).alias("total"))


def freshness(reports: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """status: processed if a result is at least as new as the report (mtime, ir_mtime), else pending."""
    return reports.join(processed, key, "left").withColumn("status", F.when(F.col("ir_mtime") >= F.col("mtime"), "processed").otherwise("pending"))


def containing_profiles(profiles: DataFrame, wanted: DataFrame) -> DataFrame:
    """profile_id, item: profiles whose ordering holds a wanted item; repeats in the ordering give repeated rows."""
    return profiles.select("profile_id", F.explode("ordering").alias("item")).join(wanted, "item")


def ordered_names(profiles: DataFrame, names: DataFrame) -> DataFrame:
    """profile_id, names: names of the ordering in order, unknown ids left out."""
    each = profiles.select("profile_id", F.posexplode("ordering").alias("pos", "item")).join(names, "item")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda s: s["name"])
    return each.groupBy("profile_id").agg(ordered.alias("names"))


def numbered_turns(turns: DataFrame) -> DataFrame:
    """Turns with the number of turns before them in their conversation."""
    return turns.withColumn("turn_index", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
