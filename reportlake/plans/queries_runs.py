"""Context, run-log, conversation, source, sink and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import sql as sqlf
from ..functions import text as tx
from ..operators import extract, jsontree, objects, runlog
from ..sources import bundles as bd
from ..sources import reports as rp
from ..sources.storage import new_folder as scratch
from ..streaming import intake as st
from ..streaming import state
from .registry import query


@query("""SELECT conv_id, count(*) FILTER (WHERE rn = 1 OR cum <= 400) AS n_kept, max(cum) FILTER (WHERE rn = 1 OR cum <= 400) AS used, count(*) FILTER (WHERE rn > 1 AND cum > 400) AS omitted FROM (SELECT conv_id, row_number() OVER w AS rn, sum(length(coalesce(text, '')) // 4) OVER w AS cum FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) c GROUP BY conv_id""")
def context_budget(t):
    return runlog.context_within(t("conversations"), 400)


@query("""SELECT conv_id, string_agg(upper(substr(role, 1, 1)) || substr(role, 2) || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS transcript, count(*) AS n_turns FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) c WHERE r <= 8 GROUP BY conv_id""")
def transcript(t):
    return runlog.transcript(t("conversations"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_index FROM conversations")
def turn_index(t):
    return runlog.numbered_turns(t("conversations")).select("conv_id", "turn", "turn_index")


@query("SELECT user_id, max(ts) AS last_used FROM events GROUP BY user_id ORDER BY last_used DESC, user_id LIMIT 64")
def lru_sessions(t):
    return runlog.most_recent(t("events"), "user_id", "ts", 64)


@query("""SELECT event_type, start, n_entities, reached, reached IS NULL OR epoch(reached) // 1 - epoch(start) // 1 > 3600 AS timed_out FROM (SELECT event_type, min(f) AS start, count(*) AS n_entities, min(f) FILTER (WHERE r = 20) AS reached FROM (SELECT event_type, user_id, min(ts) AS f, row_number() OVER (PARTITION BY event_type ORDER BY min(ts), user_id) AS r FROM events GROUP BY 1, 2) a GROUP BY event_type) b""")
def time_to_threshold(t):
    return runlog.time_to_threshold(t("events"), "event_type", "user_id", "ts", 20, 3600)


@query("""SELECT user_id, coalesce(arg_min(event_type, struct_pack(b := ts, c := event_id)) FILTER (WHERE event_type IN ('purchase', 'error')), arg_max(event_type, struct_pack(b := ts, c := event_id))) AS stage FROM events GROUP BY user_id""")
def latest_stage(t):
    return runlog.latest_stage(t("events"), "user_id", "event_type", "ts", ("purchase", "error"), "event_id")


@query("SELECT run_id, 'KILLED' AS status, 'orphaned' AS stop_reason FROM run r WHERE status = 'RUNNING' AND NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'purchase' AND e.user_id = r.experiment_id AND e.event_id % 5 = 0)", ("run",))
def orphan_runs(t):
    live_users = t("events").filter("event_type = 'purchase' AND event_id % 5 = 0").select(F.col("user_id").alias("experiment_id")).distinct()
    live = t("run").join(live_users, "experiment_id", "left_semi").select("run_id")
    return runlog.orphans(t("run"), live).select("run_id", "status", "stop_reason")


@query("SELECT o_orderkey, o_custkey, o_orderdate, total FROM (SELECT *, count(*) OVER () AS total FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) o WHERE r <= 1000) p ORDER BY o_orderdate DESC, o_orderkey LIMIT 100 OFFSET 50")
def run_listing(t):
    return runlog.page(t("orders"), "o_custkey", "o_orderdate", "o_orderkey", 50, 100).select("o_orderkey", "o_custkey", "o_orderdate", "total")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'tion.') OR contains(lower(source), 'tion.')")
def run_search(t):
    return runlog.search(t("documents"), " TION. ", ["text", "source"]).select("doc_id")


@query("SELECT o_orderkey, CASE WHEN m >= o_orderdate + INTERVAL 30 DAY THEN 'processed' ELSE 'pending' END AS status FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS m FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey")
def freshness(t):
    made = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("ir_mtime"))
    reports = t("orders").select("o_orderkey", (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("mtime"))
    return runlog.freshness(reports, made, "o_orderkey").select("o_orderkey", "status")


@query("SELECT event_type AS endpoint, CASE WHEN value > 50 THEN 500 ELSE 200 END AS code, count(*) AS n FROM events GROUP BY 1, 2")
def call_log(t):
    return runlog.call_log(t("events").select(F.col("event_type").alias("endpoint"), F.when(F.col("value") > 50, 500).otherwise(200).alias("code")), "endpoint", "code")


@query("SELECT user_id, CASE WHEN count(*) = count(v) THEN sum(v) END AS total FROM (SELECT user_id, CASE WHEN event_id % 997 <> 0 THEN event_id END AS v FROM events) e GROUP BY user_id")
def attached_total(t):
    e = t("events").select("user_id", F.when(F.col("event_id") % 997 != 0, F.col("event_id")).alias("v"))
    return runlog.total_or_null(e, "user_id", "v")


@query("SELECT l_orderkey AS profile_id, l_partkey AS item, p_name FROM lineitem JOIN part ON p_partkey = l_partkey")
def array_containment(t):
    profiles = t("lineitem").groupBy(F.col("l_orderkey").alias("profile_id")).agg(F.collect_list("l_partkey").alias("ordering"))
    wanted = t("part").select(F.col("p_partkey").alias("item"), "p_name")
    return runlog.containing_profiles(profiles, wanted).select("profile_id", "item", "p_name")


@query("SELECT l_orderkey AS profile_id, string_agg(p_name, '/' ORDER BY l_linenumber, p_partkey) AS names FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <= 25 GROUP BY l_orderkey")
def ordered_names(t):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: s["l_partkey"])
    profiles = t("lineitem").groupBy(F.col("l_orderkey").alias("profile_id")).agg(ordered.alias("ordering"))
    names = t("part").filter("p_size <= 25").select(F.col("p_partkey").alias("item"), F.col("p_name").alias("name"))
    return runlog.ordered_names(profiles, names).select("profile_id", F.array_join("names", "/").alias("names"))


@query("SELECT user_id AS run_id, i AS idx, 't' || i AS thought, event_type AS tool_name FROM (SELECT DISTINCT user_id, unnest([2, 10]) AS i, 'x' AS event_type FROM events) e")
def trajectory_steps(t):
    one = lambda k, v: (F.lit(k), F.lit(v))
    flat = [x for k, v in (("thought_10", "t10"), ("tool_name_10", "x"), ("thought_2", "t2"), ("tool_name_2", "x"), ("other", "y")) for x in one(k, v)]
    runs = t("events").select(F.col("user_id").alias("run_id")).distinct().withColumn("params", F.create_map(*flat))
    return runlog.steps(runs).select("run_id", "idx", "thought", "tool_name")


@query(r"SELECT doc_id, regexp_replace(text, '\bsk-[A-Za-z0-9_-]{8,}\b', 'sk-***', 'g') AS scrubbed, rtrim(regexp_replace(text, '\[\[\s*##\s*\w+\s*(?:##\s*)?\]\]', '', 'g')) AS bare, CASE WHEN length(text) > 600 THEN substr(text, 1, 599) || '…' ELSE text END AS short FROM intel", ("intel",))
def scrub_secrets(t):
    c = F.col("text")
    return t("intel").select("doc_id", tx.scrub(c).alias("scrubbed"), tx.strip_markers(c).alias("bare"), tx.truncate(c, 600).alias("short"))


@query("""SELECT event_id, '{"' || CASE event_id % 5 WHEN 0 THEN 'max_tokens":"v' WHEN 1 THEN 'n":"' || event_type WHEN 2 THEN 'key_env":"v' WHEN 3 THEN 'model":"v' ELSE 'n":"' || event_type END || '"}' AS kept FROM events""")
def secret_keys(t):
    """Settings with a secret beside and inside an object; what is left of the object."""
    k = F.col("event_id") % 5
    name = F.when(k == 0, "max_tokens").when(k == 1, "api_key").when(k == 2, "key_env").when(k == 3, "model").otherwise("Access_Token")
    inner = F.to_json(F.when(k.isin(1, 4), F.create_map(F.lit("n"), "event_type", name, F.lit("v"))).otherwise(F.create_map(name, F.lit("v"), F.lit("password"), F.lit("x"))))
    doc = F.concat(F.lit('{"settings": '), inner, F.lit(', "secret": "s"}'))
    clean = jsontree.without_secrets(t("events").select("event_id", doc.alias("doc")), "event_id", "doc")
    return clean.select("event_id", F.to_json(F.from_json("doc", "map<string,variant>")["settings"]).alias("kept"))


@query("""SELECT event_id, '{"id":' || event_id || ',"steps":[{"args":{"deep":[' || CASE event_id % 3 WHEN 0 THEN '{}' WHEN 1 THEN '{"env":{"key_env":"v"}}' ELSE '{"n":"' || event_type || '","tags":[]}' END || ',1],"name":"' || event_type || '"}},"s",[]]'
 || CASE WHEN event_id % 5 = 0 THEN ',"text":"a \\"password\\": b"' ELSE '' END || '}' AS kept FROM events""")
def secret_depths(t):
    """Secrets five objects and two lists deep; strings that only look like names stay."""
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    k = F.col("event_id") % 3
    inner = F.when(k == 0, F.lit('{"api_key": [1, {"a": 2}]}')).when(k == 1, F.lit('{"env": {"key_env": "v", "password": {"x": 1}}}')).otherwise(text('{"n": "', F.col("event_type"), '", "tags": [], "Secret": null}'))
    said = F.when(F.col("event_id") % 5 == 0, F.lit(', "text": "a \\"password\\": b"')).otherwise("")
    doc = text('{"steps": [{"args": {"name": "', F.col("event_type"), '", "token": "t", "deep": [', inner, ', 1]}}, "s", []], "id": ', F.col("event_id"), said, ', "client_secret": {}}')
    return jsontree.without_secrets(t("events").select("event_id", doc.alias("kept")), "event_id", "kept")


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'gateway' WHEN 1 THEN 'unknown_model' WHEN 2 THEN 'capacity' WHEN 3 THEN 'auth' WHEN 4 THEN 'truncated' ELSE 'other' END AS class, event_id % 6 = 2 OR event_id % 4 = 0 AS transient FROM events")
def error_classes(t):
    k = F.col("event_id") % 6
    m = F.when(k == 0, "x failure to get a peer from the ring-balancer").when(k == 1, "The model `a/b` does not exist").when(k == 2, "m is temporarily at capacity").when(k == 3, "Incorrect API key provided").when(k == 4, "hit max_tokens").otherwise(F.col("event_type"))
    status = F.when(F.col("event_id") % 4 == 0, 503).otherwise(200)
    return t("events").select("event_id", tx.error_class(m, status).alias("class"), tx.transient(m, status).alias("transient"))


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_name IN (SELECT s_name FROM supplier WHERE s_suppkey % 10 = 3)")
def profile_lookup(t):
    return runlog.profiles_by_name(t("supplier"), t("supplier").filter("s_suppkey % 10 = 3"), "s_name").select("s_suppkey", "s_name", "s_nationkey")


@query("""SELECT conv_id, n, '# ' || conv_id || chr(10) || first || CASE WHEN n > 3 THEN ' … +' || (n - 3) ELSE '' END AS report, printf('%.1f KB', floor(chars / 1024.0 * 10 + 0.5) / 10) AS size, '2024-01-01T00:00:00.000000Z' AS stamp FROM (SELECT conv_id, count(*) AS n, string_agg(role, ', ' ORDER BY turn) FILTER (WHERE r <= 3) AS first, sum(length(text)) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) a GROUP BY conv_id) b""")
def rendered_reports(t):
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"])
    g = t("conversations").groupBy("conv_id").agg(roles.alias("roles"), F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    stamp = tx.iso_utc(F.lit("2024-01-01").cast("timestamp"))
    return g.select("conv_id", "n", F.concat_ws("\n", F.concat(F.lit("# "), F.col("conv_id").cast("string")), tx.preview(F.col("roles"), 3)).alias("report"), tx.kilobytes(F.col("chars")).alias("size"), stamp.alias("stamp"))


@query(r"SELECT doc_id, '<p><strong>' || source || '</strong> &lt;' || lang || '&gt; ' || n_chars || '</p><ul><li>one &amp; <strong>two</strong><ul><li>' || source || '</li></ul></li><li>three</li></ul><p>end</p><ul><ul><li>deep</li></ul></li></ul>' AS html FROM documents")
def light_html(t):
    x = F.concat(F.lit("**"), "source", F.lit("** <"), "lang", F.lit("> "), F.col("n_chars").cast("string"), F.lit("\n- one & **two**\n  - "), "source", F.lit("\n• three\n\nend\n  - deep"))
    return t("documents").select("doc_id", tx.light_html(x).alias("html"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'llm' WHEN 1 THEN 'offline' ELSE 'none' END AS extractor, CASE WHEN doc_id % 3 = 0 THEN lang END AS model FROM documents")
def provenance_credit(t):
    """The branch that made a row names its extractor; a model is credited only for its own rows."""
    k = F.col("doc_id") % 3
    return runlog.credit(t("documents").select("doc_id", "lang"), F.when(k == 0, "llm").when(k == 1, "offline").otherwise("none"), F.col("lang")).select("doc_id", "extractor", "model")


@query("SELECT source, count(*) AS n_done, count(*) FILTER (WHERE n_chars < 200) AS n_failed, count(*) = count(*) FILTER (WHERE n_chars < 200) AS all_failed FROM documents GROUP BY source")
def batch_outcome(t):
    return runlog.batch_outcome(t("documents"), "source", F.col("n_chars") < 200)


@query("SELECT source, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs, count(doc_id) AS n, count(doc_id) >= 50 AS ready FROM documents GROUP BY source")
def readiness(t):
    return runlog.readiness(t("documents"), "source", "doc_id", "lang", 50).select("source", F.array_join("platforms", ",").alias("langs"), "n", "ready")


@query("SELECT session_id, turn, prompt, response FROM (SELECT 's' || conv_id AS session_id, 0 AS turn, min(text) AS prompt, max(text) AS response FROM conversations WHERE conv_id % 3 <> 0 GROUP BY conv_id) s")
def session_scan(t):
    """A session store a conversation: one good turn and one without response; a third of them of another version."""
    g = t("conversations").groupBy("conv_id").agg(F.min("text").alias("p"), F.max("text").alias("r"))
    turns = F.array(F.struct(F.col("p").alias("prompt"), F.col("r").alias("response")), F.struct(F.col("p").alias("prompt"), F.lit(None).cast("string").alias("response")))
    store = F.struct(F.when(F.col("conv_id") % 3 == 0, 2).otherwise(1).alias("version"), F.create_map(F.concat(F.lit("s"), F.col("conv_id").cast("string")), turns).alias("sessions"))
    return bd.read_sessions(g.select(F.to_json(store).alias("raw")))


@query("SELECT run_id, status, stage, 'p' || run_id AS prompt, CASE WHEN run_id % 2 = 0 THEN 'long' ELSE '' END AS result, CASE run_id % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'orphaned' ELSE '' END AS stop FROM run", ("run",))
def run_scan(t):
    k = F.col("run_id") % 3
    tags = F.map_concat(F.create_map(F.lit("stage"), "stage"), F.when(F.col("run_id") % 2 == 0, F.create_map(F.lit("process_result"), F.lit("long"))).otherwise(F.create_map().cast("map<string,string>")), F.when(k == 0, F.create_map(F.lit("cancelled"), F.lit("true"))).when(k == 1, F.create_map(F.lit("orphaned"), F.lit("1"))).otherwise(F.create_map().cast("map<string,string>")))
    runs = t("run").withColumn("tags", tags).withColumn("params", F.create_map(F.lit("prompt"), F.concat(F.lit("p"), F.col("run_id").cast("string"))))
    return bd.flatten_runs(runs).join(runs.select("run_id", runlog.stop_reason(F.col("tags")).alias("stop")), "run_id")


@query("SELECT source, count(*) AS n, sum(length(text) // 4) AS tokens, min(lower(regexp_replace(source, '[^a-z0-9]+', '-', 'g'))) AS slug FROM documents GROUP BY source")
def sql_functions(t):
    d = t("documents")
    sqlf.register(d.sparkSession)
    return d.sparkSession.sql("SELECT source, count(*) AS n, sum(rl_estimate_tokens(text)) AS tokens, min(rl_slug(source)) AS slug FROM {d} GROUP BY source", d=d)


def _bundle_files(t):
    """Folder of bundle files, some two hundred documents each; every seventh is malformed, of the others every fifth has no model."""
    d = t("documents").select(F.floor(F.col("doc_id") / 200).alias("b"), "doc_id", "lang", "source")
    kind = F.when(F.col("doc_id") % 3 == 0, "attack-pattern").when(F.col("doc_id") % 3 == 1, "threat-actor").otherwise("tool")
    obj = F.struct(kind.alias("type"), F.concat(kind, F.lit("--"), F.col("doc_id").cast("string")).alias("id"), F.concat("source", F.lit(" "), F.col("doc_id").cast("string")).alias("name"), F.array(F.struct(F.lit("One").alias("source_name"), F.concat(F.lit("T"), (F.col("doc_id") % 90 + 1000).cast("string")).alias("external_id"))).alias("external_references"))
    g = d.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("doc_id", obj.alias("o")))).alias("o"))
    body = F.struct(F.lit("bundle").alias("type"), F.when(F.col("b") % 5 != 0, F.concat(F.lit("m"), F.col("b").cast("string"))).alias("x_model"), F.lit("p").alias("x_provider"), F.lit("llm").alias("x_extractor"), F.transform("o", lambda x: x["o"]).alias("objects"))
    value = F.when(F.col("b") % 7 == 6, F.concat(F.to_json(body), F.lit("}"))).otherwise(F.to_json(body))
    path = scratch(d.sparkSession, "bundles")
    g.select(F.col("b").alias("part"), value.alias("value")).write.partitionBy("part").text(path)
    files = bd.scan_bundles(d.sparkSession, f"{path}/*")
    return files.join(g.select("b", F.to_json(body).alias("_v")), F.rtrim("value", F.lit("}")) == F.rtrim("_v", F.lit("}"))).drop("_v").withColumn("bundle_id", F.col("b")).drop("b")


@query("SELECT doc_id // 200 AS bundle_id, CASE WHEN (doc_id // 200) % 7 = 6 THEN NULL ELSE count(*) FILTER (WHERE doc_id % 3 < 2) END AS n_behavioural, CASE WHEN (doc_id // 200) % 7 <> 6 AND (doc_id // 200) % 5 <> 0 THEN 'm' || (doc_id // 200) END AS model, CASE WHEN (doc_id // 200) % 7 <> 6 THEN 'llm' END AS extractor, true AS dated FROM documents GROUP BY 1, doc_id // 200")
def bundle_catalogue(t):
    files = _bundle_files(t)
    listed = bd.catalogue(files.withColumn("name", F.col("bundle_id").cast("string")))
    return listed.select(F.col("name").cast("long").alias("bundle_id"), "n_behavioural", "model", "extractor", F.col("mtime").isNotNull().alias("dated"))


@query("SELECT doc_id // 200 AS bundle_id, row_number() OVER (PARTITION BY doc_id // 200 ORDER BY doc_id) - 1 AS pos, CASE doc_id % 3 WHEN 0 THEN 'attack-pattern' WHEN 1 THEN 'threat-actor' ELSE 'tool' END AS type, source || ' ' || doc_id AS name, 'T' || (1000 + doc_id % 90) AS technique_id FROM documents WHERE (doc_id // 200) % 7 <> 6")
def bundle_scan(t):
    """Objects of bundle files, with their first external id."""
    from ..functions.objects import external_id

    return bd.explode_objects(_bundle_files(t)).select("bundle_id", "pos", "type", "name", external_id(F.col("refs"), "one").alias("technique_id"))


@query("""SELECT key, arg_min(id, doc_id) AS id, count(*) AS n_objects, arg_min(name, doc_id) AS name FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'attack-pattern' WHEN 1 THEN 'threat-actor' ELSE 'tool' END || '--' || doc_id AS id, source || ' ' || doc_id AS name,
 CASE doc_id % 3 WHEN 0 THEN 'attack-pattern:T' || (1000 + doc_id % 90) WHEN 1 THEN 'threat-actor:' || lower(source) || '-' || doc_id ELSE 'tool:' || lower(source) || '-' || doc_id END AS key FROM documents WHERE (doc_id // 200) % 7 <> 6) d GROUP BY key""")
def bundle_fusion(t):
    """Objects of bundle files fused."""
    fused, _ = objects.fuse_bundles(bd.explode_objects(_bundle_files(t)), "one")
    return fused.select("key", "id", "n_objects", F.get_json_object("obj", "$.name").alias("name"))


@query("""WITH d AS (SELECT doc_id, doc_id % 13 AS c, CAST(floor(doc_id / 13) AS BIGINT) % 37 AS m, lang FROM documents),
 t AS (SELECT c, m, min(doc_id) AS f, count(*) AS n, string_agg('"tool--' || doc_id || '"', ',' ORDER BY doc_id) AS ids FROM d GROUP BY c, m),
 tl AS (SELECT c, m, string_agg('"' || lang || '"', ',' ORDER BY a) AS labels FROM (SELECT c, m, lang, min(doc_id) AS a FROM d GROUP BY c, m, lang) x GROUP BY c, m),
 r AS (SELECT d.doc_id, d.c, a.f AS src, b.f AS dst, d.doc_id % 2 = 1 AS uses FROM d JOIN t a ON a.c = d.c AND a.m = d.m JOIN d p ON p.doc_id = d.doc_id - 13 JOIN t b ON b.c = p.c AND b.m = p.m WHERE d.doc_id % 3 <> 0 AND d.doc_id % 7 <> 0),
 rl AS (SELECT c, src, uses, dst, string_agg('"l' || l || '"', ',' ORDER BY a) AS labels FROM (SELECT c, src, uses, dst, doc_id % 4 AS l, min(doc_id) AS a FROM r GROUP BY ALL) x GROUP BY ALL),
 rg AS (SELECT c, src, uses, dst, min(doc_id) AS f, count(*) AS n, string_agg('"relationship--' || doc_id || '"', ',' ORDER BY doc_id) AS ids, coalesce(arg_min('d' || doc_id % 5, doc_id) FILTER (WHERE doc_id % 5 <> 0), '') AS description FROM r GROUP BY ALL),
 items AS (SELECT c, 0 AS place, f, '{"id":"tool--' || f || '","labels":[' || labels || '],"name":"n' || m || '","type":"tool"' || CASE WHEN n > 1 THEN ',"x_fused_from":[' || ids || ']' ELSE '' END || '}' AS item FROM t JOIN tl USING (c, m)
  UNION ALL SELECT c, 1, f, '{"id":"relationship--' || f || '","description":"' || description || '","labels":[' || labels || ']' || CASE WHEN uses THEN ',"relationship_type":"uses"' ELSE '' END || ',"source_ref":"tool--' || src || '","target_ref":"tool--' || dst || '","type":"relationship"'
  || CASE WHEN n > 1 THEN ',"x_fused_from":[' || ids || ']' ELSE '' END || '}' FROM rg JOIN rl USING (c, src, uses, dst))
 SELECT c AS case_id, count(*) AS object_count, (SELECT count(DISTINCT CAST(floor(doc_id / 1000) AS BIGINT)) FROM d e WHERE e.c = items.c) AS source_bundle_count, string_agg(item, ',' ORDER BY place, f) AS objects FROM items GROUP BY c""")
def fused_bundles(t):
    """Bundle files with relationships, of several cases, fused to one document a case by the step of that name."""
    from .steps import run_step

    d = t("documents").select("doc_id", "lang", (F.col("doc_id") % 13).alias("case_id"))
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    at = F.col("doc_id")
    thing = text('{"type": "tool", "id": "tool--', at, '", "name": "n', F.floor(at / 13) % 37, '", "labels": ["', F.col("lang"), '"]}')
    target = F.when(at % 7 == 0, "tool--none").otherwise(text("tool--", at - 13))
    kind = F.when(at % 2 == 1, ', "relationship_type": "uses"').otherwise("")
    rel = text('{"type": "relationship", "id": "relationship--', at, '", "source_ref": "tool--', at, '", "target_ref": "', target, '"', kind, ', "description": "', F.when(at % 5 == 0, "").otherwise(text("d", at % 5)), '", "labels": ["l', at % 4, '"]}')
    items = d.withColumn("item", F.when(at % 3 == 0, thing).otherwise(F.concat_ws(",", thing, rel))).withColumn("part", F.col("case_id") * 100000 + F.floor(at / 1000))
    g = items.groupBy("part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "item"))), lambda s: s["item"]), ",").alias("items"))
    path = scratch(d.sparkSession, "cases")
    g.select("part", text('{"type": "bundle", "id": "bundle--', F.col("part"), '", "objects": [', F.col("items"), "]}").alias("value")).write.partitionBy("part").text(path)
    number = F.regexp_extract("value", r"bundle--(\d+)", 1).cast("long")
    files = bd.scan_bundles(d.sparkSession, f"{path}/*").withColumn("bundle_id", number).withColumn("case_id", F.floor(number / 100000).cast("long"))
    fused = run_step("fuse", files, id_source="one", by="case_id")
    body = F.regexp_extract("document", r'(?s)^\{"type":"bundle","id":"bundle--[0-9a-f-]{36}","objects":\[(.*)\],"x_fusion":', 1)
    return fused.select("case_id", "object_count", "source_bundle_count", body.alias("objects"))


@query("SELECT bundle_id, sum(n_runnable) AS available FROM (SELECT w.bundle_id, w.technique_id, count(c.capability_id) AS n_runnable FROM wanted w LEFT JOIN capability c ON w.technique_id = c.technique_id OR (NOT contains(w.technique_id, '.') AND split_part(c.technique_id, '.', 1) = w.technique_id AND contains(c.technique_id, '.')) OR (contains(w.technique_id, '.') AND split_part(w.technique_id, '.', 1) = c.technique_id) GROUP BY 1, 2) x GROUP BY bundle_id", ("wanted", "capability"))
def named_steps(t):
    """The coverage step by its name, without platforms."""
    from .steps import run_step

    none = F.array().cast("array<string>")
    return run_step("coverage", t("wanted").withColumn("attested", none), t("capability").withColumn("platforms", none)).select("bundle_id", "available")


_NAMES = bd.Taxonomy("Source-One", "x-matrix", "x-tactic", "x_platforms", "x_shortname")


@query("SELECT CAST(p_partkey AS BIGINT) AS pos, 'T' || (1000 + p_partkey) AS technique_id, p_name AS name, p_partkey % 2 = 0 AS revoked, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'windows' END AS platforms, CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 7 = 0 THEN 'p' || (p_partkey % 4) || ',p9' ELSE 'p' || (p_partkey % 4) END AS phases, CASE WHEN p_partkey % 5 <> 0 THEN 3 - p_partkey % 4 END AS rank FROM part")
def taxonomy_tables(t):
    """Parts as a taxonomy bundle: techniques of no, one or two phases, and a matrix that orders four tactics and names one that isn't there."""
    k = F.col("p_partkey")
    phase = lambda x: F.struct(x.alias("phase_name"))
    own = F.concat(F.lit("p"), (k % 4).cast("string"))
    phases = F.when(k % 5 == 0, None).when(k % 7 == 0, F.array(phase(own), phase(F.lit("p9")))).otherwise(F.array(phase(own)))
    ref = F.struct(F.lit("source-one").alias("source_name"), F.concat(F.lit("T"), (k + 1000).cast("string")).alias("external_id"))
    body = F.struct(F.lit("attack-pattern").alias("type"), F.col("p_name").alias("name"), (k % 2 == 0).alias("revoked"), F.when(k % 3 != 0, F.array(F.lit("Windows"))).alias("x_platforms"), phases.alias("kill_chain_phases"), F.array(ref).alias("external_references"))
    objs = t("part").select(k.cast("long").alias("pos"), F.to_json(body).alias("obj"))
    spark = objs.sparkSession
    matrix = spark.createDataFrame([(-1, '{"type":"x-matrix","tactic_refs":["t3","t2","t9","t1","t0"]}'), (-9, '{"type":"x-matrix","tactic_refs":["t0","t1"]}')] + [(-2 - i, f'{{"type":"x-tactic","id":"t{i}","x_shortname":"p{i}"}}') for i in range(4)], "pos long, obj string")
    field = lambda n: F.get_json_object("obj", f"$.{n}").alias(n)
    table = objs.unionByName(matrix).select("pos", field("type"), field("id"), field("name"), field("description"), field("source_ref"), field("target_ref"), field("relationship_type"), F.from_json(F.get_json_object("obj", "$.external_references"), bd.REFS).alias("refs"), "obj")
    found = bd.taxonomy_tables(table, _NAMES)
    ranked = found["kill_chain"].select(F.col("phase").alias("first"), "rank")
    tech = found["technique"].withColumn("first", F.get("phases", F.lit(0))).join(ranked, "first", "left")
    return tech.select("pos", "technique_id", "name", "revoked", F.array_join("platforms", ",").alias("platforms"), F.array_join("phases", ",").alias("phases"), "rank")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 OR doc_id % 6 = 1 THEN '{}' ELSE '{\"n\":' || length(text) || '}' END AS raw FROM documents".replace('\\"', '"'))
def ir_roundtrip(t):
    """Records written by date partition and read again for resuming; every fourth was never written, of the others some are damaged."""
    d = t("documents")
    raw = F.concat(F.lit('{"n":'), F.length("text").cast("string"), F.when(F.col("doc_id") % 6 == 1, "").otherwise("}"))
    r = d.filter("doc_id % 4 <> 0").select("doc_id", raw.alias("raw"), F.concat(F.lit("2024-01-0"), (F.col("doc_id") % 3 + 1).cast("string")).alias("run_date"))
    path = scratch(d.sparkSession, "ir")
    bd.write_ir(r, path)
    return bd.resume_ir(d.sparkSession.read.parquet(path), d)


@query("SELECT 'validation' AS kind, count(*) AS n, sum(doc_id) AS total FROM documents UNION ALL SELECT 'metrics', count(DISTINCT source), sum(doc_id) FROM documents UNION ALL SELECT 'conversion_log', 2 * count(DISTINCT lang), 2 * sum(doc_id) FROM documents")
def side_outputs(t):
    """Validation, metrics and log of two runs, read back; the log is written in both."""
    d = t("documents").select("doc_id", "source", "lang")
    path, spark = scratch(d.sparkSession, "side"), d.sparkSession
    by = lambda c: d.groupBy(c).agg(F.sum("doc_id").alias("doc_id"))
    bd.write_side_outputs(d, by("source"), by("lang"), path)
    bd.write_side_outputs(d.limit(0), by("source").limit(0), by("lang"), path)
    read = lambda k: spark.read.parquet(f"{path}/{k}").agg(F.count("*").alias("n"), F.sum("doc_id").alias("total")).select(F.lit(k).alias("kind"), "n", "total")
    return read("validation").unionByName(read("metrics")).unionByName(read("conversion_log"))


@query("SELECT doc_id, length(text) AS n FROM documents")
def report_scan(t):
    """Documents written as text files, a folder a source, and scanned recursively with their names. No file has more than a hundred of them."""
    d = t("documents").select("source", F.concat(F.col("doc_id").cast("string"), F.lit("\u0001"), F.coalesce("text", F.lit(""))).alias("value"))
    path = scratch(d.sparkSession, "scan")
    d.write.partitionBy("source").option("lineSep", "\u0002").option("maxRecordsPerFile", 100).text(path)
    files = rp.scan_reports(d.sparkSession, path)
    each = files.select(F.explode(F.split("content", "\u0002")).alias("v")).filter("v <> ''")
    return each.select(F.substring_index("v", "\u0001", 1).cast("long").alias("doc_id"), F.length(F.substring_index("v", "\u0001", -1)).alias("n"))


@query("SELECT doc_id, length(text) AS n FROM documents")
def stream_intake(t):
    """Documents as files of a stream, processed once by the batch code."""
    d = t("documents").select("doc_id", "text")
    spark = d.sparkSession
    source, sink, check = (scratch(spark, n) for n in ("in", "out", "check"))
    d.write.parquet(source)
    for _ in range(2):
        st.intake(spark, source, check, "doc_id long, text string", lambda df: df.withColumn("n", F.length("text")).drop("text"), sink).awaitTermination()
    # the same content under another name is not new
    d.limit(100).write.mode("append").parquet(source)
    st.intake(spark, source, check, "doc_id long, text string", lambda df: df.withColumn("n", F.length("text")).drop("text"), sink).awaitTermination()
    return spark.read.parquet(sink).select("doc_id", "n")


def _event_stream(t):
    e = t("events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    path = scratch(e.sparkSession, "events")
    e.write.parquet(path)
    return e.sparkSession.readStream.schema(e.schema).parquet(path)


@query("SELECT user_id, coalesce(arg_min(event_type, ts) FILTER (WHERE event_type = 'error'), arg_max(event_type, ts)) AS event_type, coalesce(min(ts) FILTER (WHERE event_type = 'error'), max(ts)) AS ts FROM events GROUP BY user_id")
def stream_latest(t):
    stream = _event_stream(t)
    return st.table_run(st.latest_by_key(stream, "user_id", "event_type", "ts", ("error",)), scratch(stream.sparkSession, "latest"), ["user_id"]).select("user_id", "event_type", "ts")


@query("SELECT user_id, least(8, count(*)) AS n, array_to_string((list(event_type ORDER BY event_id DESC))[1:8], ',') AS newest FROM events GROUP BY user_id")
def last_n_state(t):
    stream = _event_stream(t)
    out = st.table_run(state.last_n(stream, "user_id", "event_id", "event_type"), scratch(stream.sparkSession, "last"), ["user_id"])
    return out.select("user_id", F.col("n").cast("long").alias("n"), F.array_join(F.reverse("last"), ",").alias("newest"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, count(DISTINCT user_id) AS n, count(DISTINCT user_id) >= 10 AS ready FROM events GROUP BY 1")
def heartbeat_ready(t):
    stream = _event_stream(t)
    seen = st.table_run(st.first_sightings(stream, "ts", "user_id", "1 day", "60 days"), scratch(stream.sparkSession, "beats"))
    return st.heartbeats_ready(seen, "user_id", 10).withColumnRenamed("start", "day")


@query("""WITH s AS (SELECT user_id, event_type, min(epoch_us(ts) // 1000) AS seen FROM events GROUP BY ALL), f AS (SELECT user_id, min(seen) AS began FROM s GROUP BY user_id),
 n AS (SELECT user_id, began, seen, row_number() OVER (PARTITION BY user_id ORDER BY seen) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM s JOIN f USING (user_id) WHERE seen <= began + 43200000),
 ready AS (SELECT user_id, 3 AS n, seen - began AS elapsed_ms, false AS timed_out FROM n WHERE k = 3)
 SELECT * FROM ready UNION ALL SELECT user_id, max(n)::INT, 43200000, true FROM n WHERE user_id NOT IN (SELECT user_id FROM ready) AND began + 43200001 <= (SELECT max(epoch_us(ts) // 1000) - 2 * 86400000 FROM events) GROUP BY user_id""")
def ready_by_deadline(t):
    """Users with three kinds of events within twelve hours of their first one; those that waited in vain when the watermark passed."""
    stream = _event_stream(t)
    waits = state.ready_by_deadline(stream, "user_id", "event_type", "ts", 3, 43200, "2 days")
    return st.table_run(waits, scratch(stream.sparkSession, "deadline"))


@query("SELECT doc_id, field, min(i) - 1 AS column_no FROM (SELECT doc_id, unnest(['name', 'type', 'name']) AS field, unnest([1, 2, 3]) AS i FROM documents) a GROUP BY doc_id, field")
def header_alias(t):
    """A table with emphasised headers before each document's own lines."""
    d = t("documents").select("doc_id", F.concat(F.lit("| **Host** | `OS` | Machine | other |\n|---|---|---|---|\n\n"), F.replace("text", F.lit("|"), F.lit(" "))).alias("text"))
    settings = d.sparkSession.createDataFrame([('{"table_columns": {"name": ["Host", "machine "], "type": ["os"]}, "inline_facts": {"domains": ["primary domain"]}}',)], "value string")
    return extract.map_headers(extract.pipe_tables(d), rp.alias_scan(settings)["columns"]).select("doc_id", "field", "column_no")


@query("SELECT p_brand, p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, lower(p_name), p_partkey) AS r FROM part) p WHERE r <= 5")
def ordered_catalogue(t):
    return extract.top_per(t("part"), ["p_brand"], [F.desc("p_size"), F.lower("p_name"), F.col("p_partkey")], 5).select("p_brand", "p_partkey", "p_name")


