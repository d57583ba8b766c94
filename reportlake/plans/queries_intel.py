"""Context, actor, trajectory and rendering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import objects as ob
from ..operators import ground, objects, runlog
from .registry import query

_SOURCE = "source-one"
_INTEL = """SELECT bundle_id, pos, CASE type WHEN 'attack-pattern' THEN 'technique' ELSE 'actor' END AS kind, coalesce(tid, '') AS technique_id, CASE WHEN pos % 3 = 0 THEN '' ELSE trim(name) END AS name, coalesce(trim(description), '') AS description, CASE WHEN pos % 4 = 1 THEN label ELSE '' END AS evidence
 FROM (SELECT bundle_id, pos, type, tid, regexp_replace(name, '^\\s+|\\s+$', '', 'g') AS name, description, label FROM stix_object) o WHERE type IN ('attack-pattern', 'threat-actor') AND ((pos % 3 <> 0 AND name <> '') OR trim(description) <> '')"""
_BLOCK = """'### ' || CASE WHEN technique_id = '' AND name = '' THEN kind WHEN technique_id = '' THEN name WHEN name = '' THEN technique_id ELSE technique_id || ' ' || name END || CASE WHEN evidence <> '' THEN chr(10) || 'Observed in report: ' || evidence ELSE '' END || CASE WHEN description <> '' THEN chr(10) || description ELSE '' END"""


def _intel(t):
    refs = F.array(F.struct(F.lit("Source-One").alias("source_name"), F.lit("T1").alias("external_id")), F.struct(F.lit(_SOURCE).alias("source_name"), F.col("tid").alias("external_id")))
    name = F.when(F.col("pos") % 3 == 0, F.lit("  ")).otherwise(F.col("name"))
    o = t("stix_object").select("bundle_id", "pos", "type", name.alias("name"), "description", F.when(F.col("pos") % 4 == 1, F.col("label")).alias("evidence"), refs.alias("refs"))
    return objects.intel_objects(o, _SOURCE)


@query(_INTEL, ("stix_object",))
def intel_objects(t):
    return _intel(t)


_CONTEXT = f"""SELECT %s, string_agg(block, chr(10) || chr(10) ORDER BY place, pos) FILTER (WHERE keep) || CASE WHEN count(*) FILTER (WHERE NOT keep) > 0 THEN chr(10) || chr(10) || '[' || count(*) FILTER (WHERE NOT keep) || ' further object(s) omitted to stay within the context budget.]' ELSE '' END AS intel_context
 FROM (SELECT *, row_number() OVER w = 1 OR sum(length(block) // 4) OVER w <= 60 AS keep FROM (SELECT *, {_BLOCK} AS block FROM (%s) i) b WINDOW w AS (PARTITION BY %s ORDER BY place, pos ROWS UNBOUNDED PRECEDING)) c GROUP BY %s"""
_ATTACHED = f"SELECT p.prompt_id, a.place, i.* FROM (SELECT n_nationkey AS prompt_id FROM nation WHERE n_nationkey % 4 <> 3) p, (SELECT 0 AS place UNION ALL SELECT 1) a, ({_INTEL}) i WHERE i.bundle_id = (p.prompt_id * 5 + 2 * a.place) % 50"


@query(f"SELECT n_nationkey AS prompt_id, intel_context FROM nation LEFT JOIN ({_CONTEXT % ('prompt_id', _ATTACHED, 'prompt_id', 'prompt_id')}) c ON prompt_id = n_nationkey", ("stix_object",))
def prompt_context(t):
    """Prompts with the blocks of two attached bundles within a token budget; every fourth has none attached."""
    blocks = _intel(t).select("bundle_id", "pos", objects.intel_block(*[F.col(c) for c in ("kind", "technique_id", "name", "description", "evidence")]).alias("block"))
    k = F.col("n_nationkey").cast("long")
    none = F.array().cast("array<bigint>")
    prompts = t("nation").select(F.col("n_nationkey").alias("prompt_id"), F.when(k % 4 == 3, none).otherwise(F.array(k * 5 % 50, (k * 5 + 2) % 50)).alias("bundle_ids"))
    return runlog.enriched(prompts, [runlog.intel_enricher(blocks, 60)], {"intel": {}}).select("prompt_id", "intel_context")


@query("SELECT b.bundle_id, coalesce(actor, 'stem-' || b.bundle_id) AS title FROM (SELECT DISTINCT bundle_id FROM stix_object) b LEFT JOIN (SELECT bundle_id, arg_min(name, pos) AS actor FROM stix_object WHERE type = 'threat-actor' AND bundle_id % 10 <> 2 AND name <> '' GROUP BY bundle_id) a USING (bundle_id)", ("stix_object",))
def bundle_titles(t):
    o = t("stix_object").filter("type <> 'threat-actor' OR bundle_id % 10 <> 2")
    stems = t("stix_object").select("bundle_id").distinct().withColumn("stem", F.concat(F.lit("stem-"), F.col("bundle_id").cast("string")))
    return objects.bundle_names(o, stems)


@query("""SELECT c_custkey AS key, 'x--' || n_nationkey AS enriched_from, CASE WHEN c_custkey % 5 = 0 THEN 'mine' WHEN n_nationkey % 2 = 0 THEN 'a' || n_nationkey ELSE 'o' || n_nationkey END AS aliases, CASE WHEN c_custkey % 7 = 0 THEN 'said' ELSE 'ref' || n_nationkey END AS refs, 'x_segment=' || c_mktsegment AS extra
 FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, NULL, CASE WHEN c_custkey % 5 = 0 THEN 'mine' ELSE '' END, CASE WHEN c_custkey % 7 = 0 THEN 'said' ELSE '' END, 'x_segment=' || c_mktsegment FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 9 <> 0""")
def actor_enrichment(t):
    """Customers as actors named like nations, every third like none and every ninth without a name; nations as intrusion sets, and as actors that come second."""
    k = F.col("c_custkey")
    strings = lambda c: F.array(c)
    actors = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(
        k.alias("key"), F.when(k % 9 == 0, "").when(k % 3 == 0, "nobody").otherwise(F.concat(F.lit(" "), F.lower("n_name"))).alias("name"),
        F.when(k % 5 == 0, strings(F.lit("mine"))).alias("aliases"), F.when(k % 7 == 0, strings(F.lit("said"))).alias("refs"), F.create_map(F.lit("segment"), "c_mktsegment").alias("extra"))
    n = F.col("n_nationkey").cast("string")
    found = lambda kind, p: t("nation").select(F.lit(kind).alias("kind"), F.lower("n_name").alias("name_key"), F.concat(F.lit(p), n).alias("object_id"), F.when(F.col("n_nationkey") % 2 == 0, strings(F.concat(F.lit("a"), n))).alias("aliases"), F.array(F.col("n_name"), F.concat(F.lit("o"), n)).alias("own_aliases"), strings(F.concat(F.lit("ref"), n)).alias("refs"))
    e = objects.enrich_actors(actors, found("intrusion-set", "x--").unionByName(found("threat-actor", "a--")))
    j = lambda c: F.coalesce(F.array_join(c, ","), F.lit("")).alias(c)
    return e.select("key", "enriched_from", j("aliases"), j("refs"), F.array_join(F.transform(F.map_entries("extra"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("extra"))


@query(r"""SELECT doc_id, pos, name, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS canonical, confidence, source FROM (SELECT doc_id, 0 AS pos, source || ' Group' AS name, 0.9 AS confidence, 'model' AS source FROM documents UNION ALL SELECT doc_id, 1, 'APT-' || (doc_id % 40), 0.5, 'recovered-string' FROM documents) a""")
def canonical_actors(t):
    """An object, a bare name, one of too many words and one without a name."""
    d = F.col("doc_id")
    raw = F.concat(F.lit('[{"name": "'), "source", F.lit(' Group\'s", "confidence": 0.9, "source": "model"}, " APT-'), (d % 40).cast("string"), F.lit('", "one two three four five six", {"description": "x"}]'))
    return ground.canonical_actors(t("documents").select("doc_id", raw.alias("raw")))


def _trajectories(t):
    """Orders as runs: two numbered calls, the second of which makes an entity of the order's lines; observations name the lines' parts."""
    lines = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("id"), F.col("p_name").alias("name"))
    row = F.struct("l_linenumber", "id", "name")
    g = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("l"))
    ids = F.transform("l", lambda x: x["id"])
    named = F.to_json(F.transform("l", lambda x: F.struct(x["id"].alias("item_id"), x["name"].alias("name"))))
    k = F.col("l_orderkey").cast("string")
    args = F.when(F.col("l_orderkey") % 5 == 0, F.lit('{"name": "x"}')).otherwise(F.to_json(F.struct(F.concat(F.lit("set "), k).alias("name"), ids.alias("atomic_ordering"))))
    made = F.when(F.col("l_orderkey") % 7 == 0, F.lit("not json")).otherwise(F.to_json(F.struct(F.concat(F.lit("e"), k).alias("set_id"))))
    flat = [F.lit("thought_2"), F.lit("I look. I have successfully created the abilities. Done!"), F.lit("tool_name_2"), F.lit("list_items"), F.lit("tool_args_2"), F.lit("{}"), F.lit("observation_2"), named, F.lit("tool_name_10"), F.lit("make_set"), F.lit("tool_args_10"), args, F.lit("observation_10"), made]
    return g.select(F.col("l_orderkey").alias("run_id"), F.create_map(*flat).alias("params"))


@query("""SELECT l_orderkey AS run_id, 'set ' || l_orderkey AS name, CASE WHEN l_orderkey % 7 = 0 THEN 'unknown' ELSE 'e' || l_orderkey END AS entity_id, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) AS members, string_agg(p_name, '/' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) AS names
 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey % 5 <> 0 GROUP BY l_orderkey""")
def created_entities(t):
    made = runlog.created_entity(_trajectories(t), "make_set", "set_id", "item_id")
    return made.select("run_id", "name", "entity_id", F.array_join("members", ",").alias("members"), F.array_join("names", "/").alias("names"))


@query(r"SELECT conv_id, turn, array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(text || '. I have successfully created the abilities. Next! I have successfully created a plan. ', '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ' || chr(10) || chr(13) || chr(9))), lambda s: s <> '' AND NOT (contains(s, 'I have successfully created') AND (contains(s, 'abilities') OR contains(s, 'adversary')))), '|') AS said FROM conversations")
def spoken_sentences(t):
    text = F.concat("text", F.lit(". I have successfully created the abilities. Next! I have successfully created a plan. "))
    return t("conversations").select("conv_id", "turn", F.array_join(runlog.spoken_sentences(text), "|").alias("said"))


_SECTIONS = " || ".join(f"chr(10) || '{title}:' || chr(10) || coalesce(string_agg('  - ' || line, chr(10) ORDER BY pos) FILTER (WHERE type = '{kind}'), '  (none)') || chr(10)" for kind, title in (("malware", "Malware"), ("tool", "Tools"), ("threat-actor", "Threat Actors"), ("infrastructure", "Infrastructure"), ("attack-pattern", "Attack Patterns (TTPs)"), ("relationship", "Relationships")))
_BAR = "repeat('=', 72)"


@query(f"""SELECT bundle_id, {_BAR} || chr(10) || 'CONVERSION REPORT' || chr(10) || {_BAR} || chr(10) || 'Generated: now' || chr(10) || 'Bundle: ' || bundle_id || chr(10) || 'Objects: ' || count(*) || chr(10) || {_SECTIONS} || chr(10) || {_BAR} || chr(10) || 'END OF REPORT' || chr(10) || {_BAR} AS report
 FROM (SELECT bundle_id, pos, CASE WHEN type = 'note' THEN 'relationship' ELSE type END AS type, CASE WHEN type = 'note' THEN coalesce(id, 'None') || ' --[uses]→ y' ELSE coalesce(name, 'None') || '  (' || coalesce(id, 'None') || ')' END AS line FROM stix_object WHERE bundle_id % 5 <> 1 OR type <> 'tool') o GROUP BY bundle_id""", ("stix_object",))
def object_reports(t):
    o = t("stix_object").filter("bundle_id % 5 <> 1 OR type <> 'tool'").withColumn("type", F.when(F.col("type") == "note", "relationship").otherwise(F.col("type")))
    o = o.select("bundle_id", "pos", "type", "id", "name", F.col("id").alias("source_ref"), F.lit("y").alias("target_ref"), F.lit("uses").alias("relationship_type"))
    return objects.object_report(o, F.lit("now"))


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim, 0.0 AS other FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_cosine(t):
    """Each vector with the next one, and with none."""
    b = t("embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return t("embeddings").join(b, "vec_id").select("vec_id", F.round(ob.cosine(F.col("embedding"), F.col("next")), 6).alias("sim"), ob.cosine(F.col("embedding"), F.lit(None).cast("array<float>")).alias("other"))


@query(r"SELECT key, arg_max(technique_id, pos) AS technique_id FROM (SELECT pos, technique_id, unnest(list_distinct([lower(trim(name)), trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'))])) AS key FROM (SELECT p_partkey AS pos, 'T' || p_partkey AS technique_id, replace(p_name, ' ', CASE WHEN p_partkey % 2 = 0 THEN '-' ELSE ' ' END) AS name FROM part) p) k WHERE key <> '' GROUP BY key")
def name_keys(t):
    k = F.col("p_partkey")
    names = t("part").select(k.alias("pos"), F.concat(F.lit("T"), k.cast("string")).alias("technique_id"), F.when(k % 2 == 0, F.replace("p_name", F.lit(" "), F.lit("-"))).otherwise(F.col("p_name")).alias("name"))
    return ground.name_variants(names)


_ERRORS = """CASE WHEN b % 6 = 5 THEN '"objects" must be a list.' WHEN b % 6 = 4 THEN 'Bundle contains zero STIX objects.' END"""


@query(f"""SELECT b AS bundle_id, CASE b % 6 WHEN 0 THEN '' WHEN 1 THEN 'Bundle "type" must be "bundle".' WHEN 2 THEN 'Bundle missing required field "id".' WHEN 3 THEN 'Bundle id "bundle--zz" is not a valid bundle--<uuid4>.' ELSE {_ERRORS} END
 || CASE WHEN b % 6 < 4 THEN CASE WHEN b % 6 = 0 THEN '' ELSE '|' END || format('Object 1 is not a JSON object.|Object 2 of type ''tool'' missing ''id''.|Unknown STIX type ''file'' in object 3.|Relationship 4 missing ''relationship_type''.|Relationship 4 missing ''target_ref''.|Relationship 4 source_ref ''tool--{{}}'' does not exist.', md5('t' || b)) ELSE '' END AS errors FROM (SELECT c_custkey AS b FROM customer) c""")
def bundle_errors(t):
    """Bundle documents, a customer each, that break another rule of bundles each, and the same rules of objects."""
    b = F.col("c_custkey")
    k = b % 6
    text = b.cast("string")
    uid = lambda p: F.md5(F.concat(F.lit(p), text).cast("binary"))
    head = F.when(k == 1, '"type": "x", ').otherwise('"type": "bundle", ')
    bid = F.when(k == 2, "").when(k == 3, '"id": "bundle--zz", ').otherwise(F.concat(F.lit('"id": "bundle--'), uid("b"), F.lit('", ')))
    objs = F.when(k == 5, '{"a": 1}').when(k == 4, "[]").otherwise(F.concat(
        F.lit('[{"type": "tool", "id": "tool--'), uid("o"), F.lit('"}, 5, {"type": "tool"}, {"type": "file", "id": "file--'), uid("f"), F.lit('"}, {"type": "relationship", "id": "relationship--'), uid("r"), F.lit('", "source_ref": "tool--'), uid("t"), F.lit('"}]')))
    docs = t("customer").select(b.alias("bundle_id"), F.concat(F.lit("{"), head, bid, F.lit('"objects": '), objs, F.lit("}")).alias("value"))
    return objects.validate_bundles(docs).select("bundle_id", F.array_join("errors", "|").alias("errors"))


