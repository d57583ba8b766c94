"""Object, fusion, coverage and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import objects as ob
from ..functions import text as tx
from ..operators import clean, coverage, ground, objects, similarity
from ..sources import bundles as bd
from ..sources import reports as rp
from .registry import query


def _list(column: str):
    return F.filter(F.split(column, ","), lambda x: x != "")


def _uuid(expr: str) -> str:
    h = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({expr}))"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || (CASE WHEN substr({h}, 17, 1) IN ('0','4','8','c') THEN '8' WHEN substr({h}, 17, 1) IN ('1','5','9','d') THEN '9' WHEN substr({h}, 17, 1) IN ('2','6','a','e') THEN 'a' ELSE 'b' END) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


_SLUG = r"trim(regexp_replace(lower(trim(regexp_replace(name, '^\s+|\s+$', '', 'g'))), '[^a-z0-9]+', '-', 'g'), '-')"
_KEY = rf"""CASE WHEN type = 'attack-pattern' AND coalesce(tid, '') <> '' THEN 'attack-pattern:' || upper(tid) WHEN type = 'vulnerability' AND upper(regexp_extract(cve_text, '(?i)CVE-\d{{4}}-\d{{4,7}}')) <> '' THEN 'vulnerability:' || upper(regexp_extract(cve_text, '(?i)CVE-\d{{4}}-\d{{4,7}}'))
 WHEN type IN ('tool', 'threat-actor') AND name <> '' THEN type || ':' || {_SLUG} ELSE type || ':' || coalesce(id, name) END"""


def _keyed(t):
    o = t("stix_object")
    cve = tx.cve_key(F.lit(None).cast("string"), F.col("name"), F.col("cve_text"))
    none = F.lit(None).cast("string")
    key = ob.object_key(F.col("type"), F.col("tid"), cve, none, none, F.col("name"), none, F.coalesce("id", "name"), none)
    return o.withColumn("key", key).withColumn("labels", F.array("label"))


_AT = "pos + bundle_id * 10000000"


@query(rf"""SELECT g.key, id, n_objects, name, description, CASE WHEN n_objects > 1 THEN coalesce(ids, '') END AS fused_from, labels FROM (SELECT key, (list(id ORDER BY {_AT}))[1] AS id, count(*) AS n_objects, arg_min(name, {_AT}) FILTER (WHERE name <> '') AS name, arg_min(description, {_AT}) FILTER (WHERE description <> '') AS description
 FROM (SELECT *, {_KEY} AS key FROM stix_object) o GROUP BY key) g LEFT JOIN (SELECT key, string_agg(id, ',' ORDER BY a) AS ids FROM (SELECT {_KEY} AS key, id, min({_AT}) AS a FROM stix_object WHERE id IS NOT NULL GROUP BY 1, 2) x GROUP BY key) i ON i.key = g.key
 JOIN (SELECT key, string_agg(label, ',' ORDER BY a) AS labels FROM (SELECT {_KEY} AS key, label, min({_AT}) AS a FROM stix_object GROUP BY 1, 2) x GROUP BY key) l ON l.key = g.key""", ("stix_object",))
def fuse_objects(t):
    f = objects.fuse(_keyed(t), ["name", "description"], ["labels"])
    return f.select("key", "id", "n_objects", "name", "description", F.array_join("fused_from", ",").alias("fused_from"), F.array_join("labels", ",").alias("labels"))


@query("""WITH d AS (SELECT doc_id % 301 AS key, doc_id AS p, lang FROM documents), f AS (SELECT key, min(p) AS f, count(*) AS n FROM d GROUP BY key),
 i AS (SELECT key, p, 0 AS place, 'l' || (p % 4) AS v FROM d UNION ALL SELECT key, p, 1, 'l' || (p % 5) FROM d), own AS (SELECT i.* FROM i JOIN f ON i.key = f.key AND p = f),
 later AS (SELECT key, v, min(p * 2 + place) AS o FROM i WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.key = i.key AND own.v = i.v) GROUP BY key, v),
 labels AS (SELECT key, string_agg('"' || v || '"', ',' ORDER BY o) AS labels FROM (SELECT key, v, p * 2 + place AS o FROM own UNION ALL SELECT key, v, o FROM later) x GROUP BY key),
 a AS (SELECT key, string_agg('{"v":' || m || '}', ',' ORDER BY o) AS a FROM (SELECT key, p % 2 AS m, min(p) AS o FROM d GROUP BY 1, 2) x GROUP BY key),
 k AS (SELECT key, string_agg('"k' || m || '":1', ',' ORDER BY m) AS k FROM (SELECT DISTINCT key, p % 3 AS m FROM d) x GROUP BY key),
 g AS (SELECT key, arg_min('n' || p, p) FILTER (WHERE p % 3 <> 0) AS name, arg_min(p, p) FILTER (WHERE p % 5 <> 0) AS num, arg_min(lang, p) AS lang FROM d GROUP BY key),
 ids AS (SELECT key, string_agg(id, ',' ORDER BY o) AS ids FROM (SELECT key, 'x' || (p % 500) AS id, min(p) AS o FROM d GROUP BY 1, 2) x GROUP BY key)
 SELECT f.key, 'x' || (f % 500) AS id, n AS n_objects, CASE WHEN n > 1 THEN ids END AS fused_from, '{"flag":' || CASE WHEN f % 2 = 0 THEN '0' ELSE '"x"' END || ',"labels":[' || labels || '],"meta":{"deep":{"a":[' || a || '],' || k || '},"lang":"' || lang || '","n":' || coalesce(CAST(num AS STRING), 'null') || '},"name":"' || coalesce(name, '') || '"}' AS obj
 FROM f JOIN labels USING (key) JOIN a USING (key) JOIN k USING (key) JOIN g USING (key) JOIN ids USING (key)""".replace("AS STRING", "AS VARCHAR"))
def fuse_deep(t):
    """Documents as JSON objects with nested values, fused by a key of several."""
    at = F.col("doc_id")
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    obj = F.concat(
        text('{"name": "'), F.when(at % 3 == 0, "").otherwise(text("n", at)), text('", "id": "x', at % 500, '", "labels": ["l', at % 4, '", "l', at % 5, '"], "meta": {"lang": "'), F.col("lang"), text('", "n": '),
        F.when(at % 5 == 0, "null").otherwise(text("", at)), text(', "deep": {"a": [{"v": ', at % 2, '}], "k', at % 3, '": 1}}, "flag": '), F.when(at % 2 == 0, "0").otherwise('"x"'), text("}"))
    d = t("documents").select((at % 301).alias("key"), at.alias("at_"), obj.alias("obj"))
    return objects.fuse_documents(d, ["at_"]).select("key", "id", "n_objects", F.array_join("fused_from", ",").alias("fused_from"), "obj")


@query("""SELECT CAST(p_partkey % 900 AS BIGINT) AS src, CASE WHEN l_returnflag = 'N' THEN 'related-to' ELSE l_returnflag END AS rel_type, CAST(s_nationkey AS BIGINT) AS dst, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_suppkey % 10 <> 3 GROUP BY 1, 2, 3""")
def fuse_edges(t):
    edges = t("lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("rel_type"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    parts = t("part").select(F.concat(F.lit("p"), "p_partkey").alias("old_id"), (F.col("p_partkey") % 900).cast("long").alias("new_id"))
    sup = t("supplier").filter("s_suppkey % 10 <> 3").select(F.concat(F.lit("s"), "s_suppkey").alias("old_id"), F.col("s_nationkey").cast("long").alias("new_id"))
    return objects.remap_edges(edges, parts.unionByName(sup))


_MATCH = """SELECT w.bundle_id, w.technique_id, capability_id, platform_list = '' OR platform_list = CASE bundle_id % 3 WHEN 0 THEN 'windows' WHEN 1 THEN 'linux' ELSE platform_list END AS ok FROM wanted w JOIN capability c ON w.technique_id = c.technique_id
 OR (NOT contains(w.technique_id, '.') AND split_part(c.technique_id, '.', 1) = w.technique_id AND contains(c.technique_id, '.')) OR (contains(w.technique_id, '.') AND split_part(w.technique_id, '.', 1) = c.technique_id)"""


def _wanted(t):
    b = F.col("bundle_id") % 3
    return t("wanted").withColumn("attested", F.when(b == 0, F.array(F.lit("windows"))).when(b == 1, F.array(F.lit("linux"))).otherwise(F.array().cast("array<string>")))


def _capabilities(t):
    return t("capability").withColumn("platforms", _list("platform_list"))


_STATUS = f"SELECT w.bundle_id, w.technique_id, coalesce(n_runnable, 0) AS n_runnable, coalesce(n_excluded, 0) AS n_excluded, CASE WHEN n_runnable > 0 THEN 'covered' WHEN n_excluded > 0 THEN 'platform_excluded' ELSE 'unmatched' END AS status FROM wanted w LEFT JOIN (SELECT bundle_id, technique_id, count(*) FILTER (WHERE ok) AS n_runnable, count(*) FILTER (WHERE NOT ok) AS n_excluded FROM ({_MATCH}) m GROUP BY 1, 2) g USING (bundle_id, technique_id)"


@query(_STATUS, ("wanted", "capability"))
def coverage_status(t):
    return coverage.coverage_status(_wanted(t), _capabilities(t))


@query(f"SELECT bundle_id, count(*) AS n_techniques, count(*) FILTER (WHERE status = 'covered') AS n_covered, count(*) FILTER (WHERE status = 'platform_excluded') AS n_excluded, count(*) FILTER (WHERE status = 'unmatched') AS n_unmatched, sum(n_runnable) AS available, coalesce(string_agg(DISTINCT CASE WHEN status = 'unmatched' THEN technique_id END, ',' ORDER BY CASE WHEN status = 'unmatched' THEN technique_id END), '') AS unmatched FROM ({_STATUS}) s GROUP BY bundle_id", ("wanted", "capability"))
def coverage_report(t):
    return coverage.coverage_report(coverage.coverage_status(_wanted(t), _capabilities(t)))


@query(f"""SELECT q.bundle_id, q.technique_id, q.capability_id, coalesce(CASE WHEN k.technique_id IS NOT NULL THEN coalesce(k.r, 1048576) ELSE p.r END, 1048576) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY bundle_id, technique_id ORDER BY capability_id) AS n FROM ({_MATCH}) m WHERE ok) q
 LEFT JOIN (SELECT technique_id, list_min(list_transform(list_filter(string_split(phase_list, ','), lambda x: x <> ''), lambda x: CASE x WHEN 'execution' THEN 0 WHEN 'discovery' THEN 1 WHEN 'collection' THEN 2 ELSE 3 END)) AS r FROM technique) k ON k.technique_id = q.technique_id
 LEFT JOIN (SELECT technique_id, list_min(list_transform(list_filter(string_split(phase_list, ','), lambda x: x <> ''), lambda x: CASE x WHEN 'execution' THEN 0 WHEN 'discovery' THEN 1 WHEN 'collection' THEN 2 ELSE 3 END)) AS r FROM technique) p ON p.technique_id = split_part(q.technique_id, '.', 1) WHERE n <= 3""", ("wanted", "capability", "technique"))
def topn_capability(t):
    m = coverage.hierarchy_match(_wanted(t), _capabilities(t)).filter(ground.platform_ok(F.col("platforms"), F.col("attested")))
    order = t("region").sparkSession.createDataFrame([("execution", 0), ("discovery", 1), ("collection", 2), ("impact", 3)], "phase string, rank int")
    ranked = ground.kill_chain_rank(coverage.capped(m, 3), t("technique").withColumn("phases", _list("phase_list")), order)
    return ranked.select("bundle_id", "technique_id", "capability_id", "rank")


@query("""SELECT tactic, capability_id, technique_id, source FROM (SELECT *, min(CASE source WHEN 'primary' THEN 1 ELSE 2 END) OVER (PARTITION BY tactic) AS tier, row_number() OVER (PARTITION BY tactic, source ORDER BY capability_id) AS n FROM capability) c
 WHERE (tier = 1 AND source = 'primary') OR (tier = 2 AND source = 'secondary' AND n <= 5)""", ("capability",))
def catalogue_fallback(t):
    return coverage.with_fallback(t("capability"), "tactic", "primary", "secondary").select("tactic", "capability_id", "technique_id", "source")


_PRF = """SELECT source, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM
 (SELECT source, count(*) FILTER (WHERE g AND e) AS tp, count(*) FILTER (WHERE g AND NOT e) AS fp, count(*) FILTER (WHERE e AND NOT g) AS fn FROM (SELECT %s AS source, n_chars > 300 AS g, quality = 1 AS e FROM documents JOIN labels USING (doc_id)) a WHERE g OR e GROUP BY source) b) c"""


def _labelled(t):
    return t("documents").select("doc_id", "source", "n_chars").join(t("labels"), "doc_id")


@query(_PRF % "source")
def score_prf(t):
    d = _labelled(t)
    return coverage.score_sets(d.filter("n_chars > 300"), d.filter("quality = 1"), ["source"], "doc_id")


@query(f"SELECT * FROM ({_PRF % 'source'}) x UNION ALL SELECT * FROM ({_PRF % repr('all')}) y")
def recall_lift(t):
    """Scores of single sources beside those of all of them together."""
    d = _labelled(t)
    single = coverage.score_sets(d.filter("n_chars > 300"), d.filter("quality = 1"), ["source"], "doc_id")
    u = d.withColumn("source", F.lit("all"))
    return single.unionByName(coverage.score_sets(u.filter("n_chars > 300"), u.filter("quality = 1"), ["source"], "doc_id"))


@query(rf"""SELECT label, CASE WHEN a.name IS NOT NULL THEN 'id' WHEN b.n IS NOT NULL THEN 'name' ELSE 'bare' END AS how, coalesce(a.name, b.n, label) AS name, 'attack-pattern--' || {_uuid('coalesce(CASE WHEN a.name IS NOT NULL THEN a.technique_id END, b.technique_id, label)')} AS id FROM
 (SELECT DISTINCT p_name || CASE p_partkey % 3 WHEN 0 THEN ' (t' || CAST(1000 + p_partkey % 45 AS STRING) || ')' WHEN 1 THEN '' ELSE ' x' END AS label FROM part) l LEFT JOIN technique a ON a.technique_id = regexp_extract(upper(label), 'T\d{{4}}(?:\.\d{{3}})?') LEFT JOIN (SELECT lower(name) AS nl, min(technique_id) AS technique_id, min(name) AS n FROM technique GROUP BY 1) b ON b.nl = lower(trim(label))""", ("technique",))
def enrich_fallback(t):
    k = F.col("p_partkey") % 3
    labels = t("part").select(F.concat("p_name", F.when(k == 0, F.concat(F.lit(" (t"), (1000 + F.col("p_partkey") % 45).cast("string"), F.lit(")"))).when(k == 1, "").otherwise(" x")).alias("label")).distinct()
    tech = t("technique")
    return objects.enrich_techniques(labels, tech.select("technique_id", "name"), tech.select(F.lower("name").alias("name_lc"), "technique_id", "name")).select("label", "how", "name", "id")


_CHECKED = """SELECT bundle_id, pos, CASE WHEN pos % 17 = 0 THEN NULL WHEN pos % 19 = 0 THEN 'sighting' WHEN pos % 23 = 0 THEN 'user-account' ELSE type END AS type, CASE WHEN pos % 2 = 0 AND id IS NOT NULL THEN type || '--' || substr(id, 4) ELSE id END AS id FROM stix_object"""
_REL = """SELECT doc_id % 50 AS bundle_id, doc_id AS pos, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'uses' END AS rel_type, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 'x--' || md5(CAST(doc_id % 700 AS VARCHAR)) END AS src, 'x--' || md5(CAST(doc_id % 900 AS VARCHAR)) AS dst FROM documents"""
_KNOWN_ID = "EXISTS (SELECT 1 FROM o WHERE o.bundle_id = r.bundle_id AND o.id = r.%s AND type <> '')"


@query(rf"""SELECT * FROM (WITH o AS ({_CHECKED}), r AS ({_REL}), n AS (SELECT *, row_number() OVER (PARTITION BY bundle_id, id ORDER BY pos) AS k FROM o WHERE type IS NOT NULL AND id IS NOT NULL)
 SELECT bundle_id, pos, 1 AS rule, format('Object {{}} missing ''type''.', pos) AS message FROM o WHERE type IS NULL UNION ALL SELECT bundle_id, pos, 2, format('Object {{}} of type ''{{}}'' missing ''id''.', pos, type) FROM o WHERE type IS NOT NULL AND id IS NULL
 UNION ALL SELECT bundle_id, pos, 3, format('Object {{}} ID ''{{}}'' does not match {{}}--<uuid4>.', pos, id, type) FROM n WHERE NOT regexp_full_match(id, type || '--[0-9a-f]{{32}}')
 UNION ALL SELECT bundle_id, pos, 4, 'Duplicate STIX ID detected: ' || id FROM n WHERE k > 1 UNION ALL SELECT bundle_id, pos, 5, format('Unknown STIX type ''sighting'' in object {{}}.', pos) FROM n WHERE type = 'sighting'
 UNION ALL SELECT bundle_id, pos, 6, format('Relationship {{}} missing ''relationship_type''.', pos) FROM r WHERE rel_type = '' UNION ALL SELECT bundle_id, pos, 7, format('Relationship {{}} missing ''source_ref''.', pos) FROM r WHERE src IS NULL
 UNION ALL SELECT bundle_id, pos, 9, format('Relationship {{}} source_ref ''{{}}'' does not exist.', pos, src) FROM r WHERE src IS NOT NULL AND NOT {_KNOWN_ID % "src"} UNION ALL SELECT bundle_id, pos, 10, format('Relationship {{}} target_ref ''{{}}'' does not exist.', pos, dst) FROM r WHERE NOT {_KNOWN_ID % "dst"}) e""", ("stix_object",))
def object_validate(t):
    pos, typed = F.col("pos"), F.when(F.col("pos") % 17 == 0, None).when(F.col("pos") % 19 == 0, "sighting").when(F.col("pos") % 23 == 0, "user-account").otherwise(F.col("type"))
    oid = F.when((pos % 2 == 0) & F.col("id").isNotNull(), F.concat("type", F.lit("--"), F.substring("id", 4, 40))).otherwise(F.col("id"))
    o = t("stix_object").select("bundle_id", "pos", typed.alias("type"), oid.alias("id"))
    d, ref = F.col("doc_id"), lambda k: F.concat(F.lit("x--"), F.md5((F.col("doc_id") % k).cast("string").cast("binary")))
    rel = t("documents").select((d % 50).alias("bundle_id"), d.alias("pos"), F.when(d % 7 == 0, "").otherwise("uses").alias("rel_type"), F.when(d % 11 != 0, ref(700)).alias("src"), ref(900).alias("dst"))
    return objects.validate(o, rel)


@query("SELECT bundle_id, count(*) AS n_objects, count(*) FILTER (WHERE type = 'attack-pattern') AS n_techniques, count(*) FILTER (WHERE type = 'threat-actor') AS n_actors, count(*) FILTER (WHERE type = 'relationship') AS n_relationships, count(*) FILTER (WHERE type = 'observed-data') AS n_observed FROM stix_object GROUP BY bundle_id", ("stix_object",))
def bundle_metrics(t):
    return objects.bundle_metrics(t("stix_object"))


@query(rf"""SELECT bundle_id, 'bundle--' || {_uuid('CAST(bundle_id AS STRING)')} AS id, count(*) AS n_objects, md5('{{"type":"bundle","id":"bundle--' || {_uuid('CAST(bundle_id AS STRING)')} || '","x_model":"none","x_provider":"offline","objects":[' || string_agg('{{"type":"' || type || '","pos":' || pos || '}}', ',' ORDER BY pos) || ']}}') AS digest FROM stix_object GROUP BY bundle_id""", ("stix_object",))
def bundle_json(t):
    o = t("stix_object").select("bundle_id", "pos", F.to_json(F.struct("type", "pos")).alias("obj"))
    return objects.bundle_documents(o, "none", "offline").select("bundle_id", "id", "n_objects", F.md5(F.col("document").cast("binary")).alias("digest"))


@query(rf"SELECT doc_id, value, 'observed-data--' || {_uuid('''CAST(doc_id AS STRING) || '|SHA1|' || value''')} AS id FROM (SELECT DISTINCT doc_id, unnest(list_transform(regexp_extract_all(text, '\b[a-fA-F0-9]{{40}}\b'), lambda v: lower(v))) AS value FROM documents) d")
def observed_data(t):
    from ..operators import extract

    h = extract.hash_evidence(t("documents")).filter("kind = 'SHA1'")
    o = objects.observed_data(h, F.lit("2024-01-01T00:00:00.000000Z"))
    return o.select("doc_id", F.regexp_extract("object", r'"SHA1":"([^"]*)"', 1).alias("value"), "id")


@query("SELECT bundle_id, string_agg(DISTINCT tid, ',' ORDER BY tid) AS ids FROM stix_object WHERE tid IS NOT NULL GROUP BY bundle_id", ("stix_object",))
def bundle_technique_ids(t):
    refs = F.array(F.struct(F.lit("Taxonomy-One").alias("source_name"), F.col("tid").alias("external_id")), F.struct(F.lit("other").alias("source_name"), F.lit("T9").alias("external_id")))
    return objects.bundle_technique_ids(t("stix_object").withColumn("refs", refs), "taxonomy-one").select("bundle_id", F.array_join("ids", ",").alias("ids"))


@query(r"SELECT pos, upper(regexp_extract(cve_text, '(?i)CVE-\d{4}-\d{4,7}')) AS cve FROM stix_object WHERE type = 'vulnerability'", ("stix_object",))
def cve_keys(t):
    return t("stix_object").filter("type = 'vulnerability'").select("pos", tx.cve_key(F.lit(""), F.col("name"), F.col("cve_text")).alias("cve"))


@query("SELECT event_id, '{\"a\":' || event_id || ',\"z\":[2,1]}' AS canonical FROM events")
def list_identity(t):
    return t("events").select("event_id", ob.canonical_json(F.concat(F.lit('{"z": [2, 1], "a":'), F.col("event_id").cast("string"), F.lit("}"))).alias("canonical"))


@query("SELECT event_id, CASE WHEN event_id % 6 = 3 THEN NULL ELSE '{\"v\": \"v' || event_id || '\"' || CASE event_id % 6 WHEN 1 THEN ', \"o\": {\"x\": 1}' ELSE '' END || '}' END AS value FROM events".replace('\\"', '"'))
def json_salvage(t):
    """Fenced, with text round it, with text behind deep nesting, without its closing brace, and none at all."""
    body = F.concat(F.lit('{"v": "v'), F.col("event_id").cast("string"), F.lit('"'))
    k = F.col("event_id") % 6
    deep = F.concat(F.lit('{"a": {"b": {"c": 1}}, "d": '), body, F.lit("}} trailing"))
    raw = F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("}\n```"))).when(k == 1, F.concat(F.lit("Sure: "), body, F.lit(', "o": {"x": 1}} done'))).when(k == 2, body).when(k == 4, F.concat(body, F.lit("} and {more}"))).when(k == 5, F.concat(F.lit(" "), body, F.lit("}```"))).otherwise(F.when(k == 3, F.lit("no json")).otherwise(deep))
    return t("events").select("event_id", ob.salvage_json(raw).alias("value"))


@query("SELECT event_id, 'u' || user_id AS actors, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS behaviours, CASE WHEN event_id % 3 = 0 THEN 'T1' ELSE '' END AS techniques FROM events")
def ir_schema(t):
    raw = F.concat(F.lit('{"threat_actors": '), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('[{"name": " u'), F.col("user_id").cast("string"), F.lit(' "}, {"description": "x"}]'))).otherwise(F.concat(F.lit('{"name": "u'), F.col("user_id").cast("string"), F.lit('"}'))),
                   F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(', "behaviors": [{"description": "'), "event_type", F.lit('"}, {"x": 1}]'))).otherwise(""), F.when(F.col("event_id") % 3 == 0, ', "attack_patterns": {"id": "T1"}').otherwise(""), F.lit("}"))
    ir = bd.enforce_ir(t("events").select("event_id", raw.alias("raw")))
    j = lambda c: F.array_join(c, ",").alias(c)
    return ir.select("event_id", j("actors"), j("behaviours"), j("techniques"))


@query("""SELECT a.vec_id, a.label FROM embeddings a WHERE NOT EXISTS (SELECT 1 FROM embeddings b WHERE b.label = a.label AND b.vec_id < a.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.5)""")
def vector_dedupe(t):
    v = t("embeddings")
    return similarity.first_kept(v, "label", 0.5).select("vec_id", "label")


@query()
def vector_dedupe_greedy(t):
    return similarity.greedy_kept(t("embeddings"), "label", 0.5).select("vec_id", "label")


@query(r"SELECT key, arg_max(technique_id, pos) AS technique_id FROM (SELECT pos, technique_id, unnest(list_distinct([upper(trim(technique_id)), trim(regexp_replace(upper(trim(technique_id)), '\s*\(.*?\)', '', 'g')), trim(split_part(upper(trim(technique_id)), '/', 1))])) AS key FROM (SELECT s_suppkey AS pos, ' t' || CAST(1000 + s_suppkey % 30 AS STRING) || CASE s_suppkey % 3 WHEN 0 THEN ' (old)' WHEN 1 THEN '/b' ELSE '' END AS technique_id FROM supplier) s) k GROUP BY key")
def key_variants(t):
    k = F.col("s_suppkey") % 3
    raw = t("supplier").select(F.col("s_suppkey").alias("pos"), F.concat(F.lit(" t"), (1000 + F.col("s_suppkey") % 30).cast("string"), F.when(k == 0, " (old)").when(k == 1, "/b").otherwise("")).alias("technique_id"))
    return ground.id_variants(raw)


@query(r"""SELECT needle, arg_min(n_name, n_nationkey) AS name FROM (SELECT DISTINCT 'x ' || lower(n_name) AS needle FROM nation JOIN supplier ON s_nationkey = n_nationkey) w JOIN nation ON contains(regexp_replace(lower(n_name), '[^a-z0-9]+', '', 'g'), regexp_replace(needle, '[^a-z0-9]+', '', 'g')) OR contains(regexp_replace(needle, '[^a-z0-9]+', '', 'g'), regexp_replace(lower(n_name), '[^a-z0-9]+', '', 'g')) GROUP BY needle""")
def fuzzy_key(t):
    wanted = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("x "), F.lower("n_name")).alias("needle")).distinct()
    return ground.fuzzy_lookup(wanted, t("nation").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("name")))


@query("""SELECT wanted_name, arg_min(kind, k) AS kind, arg_min(entity_id, k) AS entity_id FROM (SELECT p_name AS wanted_name, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS name_key FROM (SELECT DISTINCT p_name FROM part) p) w JOIN
 (SELECT kind, k, name_key, min(id) AS entity_id FROM (SELECT CASE p_partkey % 3 WHEN 0 THEN 'attack-pattern' WHEN 1 THEN 'malware' ELSE 'tool' END AS kind, CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS k, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS name_key, p_partkey AS id FROM part) q GROUP BY ALL) n USING (name_key) GROUP BY wanted_name""")
def name_precedence(t):
    k = F.col("p_partkey") % 3
    names = t("part").select(F.when(k == 0, "attack-pattern").when(k == 1, "malware").otherwise("tool").alias("kind"), tx.spaced(F.col("p_name")).alias("name_key"), F.col("p_partkey").alias("entity_id"))
    names = names.groupBy("kind", "name_key").agg(F.min("entity_id").alias("entity_id"))
    return ground.first_kind(names, t("part").select(F.col("p_name").alias("wanted_name")).distinct())


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 1 OR doc_id % 6 = 0")
def incremental_docs(t):
    """Documents that the store doesn't hold with the same text and provenance."""
    cur = t("documents").select("doc_id", F.sha2("text", 256).alias("content"), F.lit("v2").alias("provenance"))
    stored = t("documents").filter("doc_id % 2 = 0").select("doc_id", F.sha2("text", 256).alias("content"), F.when(F.col("doc_id") % 3 == 0, "v1").otherwise("v2").alias("provenance"))
    return clean.changed(cur, stored, ["doc_id", "content", "provenance"]).select("doc_id")


@query("SELECT doc_id, name FROM reports WHERE source IN ('src1', 'src2')", ("reports",))
def selected_reports(t):
    r = t("reports").withColumn("stem", F.col("source"))
    chosen = t("documents").select(F.col("source").alias("stem")).filter("stem IN ('src1', 'src2')")
    return clean.selected(r, chosen).select("doc_id", "name")


@query("SELECT doc_id, CASE WHEN n = 1 THEN nm ELSE regexp_replace(nm, '\\.[^.]*$', '') || '_20240101_' || n || '.json' END AS stored_name FROM (SELECT *, row_number() OVER (PARTITION BY lower(nm) ORDER BY doc_id) AS n FROM (SELECT doc_id, source || '.json' AS nm FROM documents WHERE doc_id % 5 <> 1 AND doc_id % 5 <> 2) a) b".replace("\\\\", "\\"))
def accepted_uploads(t):
    """Uploads of one name a source: JSON files that hold a value and nothing else, and programs, which aren't accepted."""
    k = F.col("doc_id") % 5
    content = F.when(k == 1, '{"a": 1} x').otherwise(F.concat(F.lit('{"a": '), F.col("doc_id").cast("string"), F.lit("}")))
    files = t("documents").select(F.col("doc_id").alias("upload_id"), F.concat("source", F.when(k == 2, ".exe").otherwise(".json")).alias("name"), content.alias("content"))
    return clean.accepted_uploads(files, (".txt", ".md", ".json"), F.lit("20240101")).select(F.col("upload_id").alias("doc_id"), "stored_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey % 7 <> 0")
def name_quality(t):
    """Names of parts, every seventh with a separator or only blanks in its place."""
    k = F.col("p_partkey")
    name = F.when(k % 14 == 0, F.concat(F.lit("a/"), "p_name")).when(k % 7 == 0, F.lit("  ")).otherwise(F.col("p_name"))
    return clean.bare_names(t("part").select("p_partkey", name.alias("p_name")), "p_name").select("p_partkey", "p_name")


@query("SELECT n_nationkey, CASE n_nationkey WHEN 3 THEN 'Amber Group' WHEN 5 THEN 'Blue' ELSE 'Nation ' || substr(n_name, 8) END AS actor FROM nation")
def alias_tables(t):
    spark = t("nation").sparkSession
    table = rp.alias_table(spark, {"Amber Group": ["Nation_3"], "Blue": ["nation_5"]}).withColumnsRenamed({"alias_lc": "slug", "field": "actor"})
    return rp.actor_name("slug", table, t("nation").select("n_nationkey", F.lower("n_name").alias("slug"))).select("n_nationkey", "actor")


@query("SELECT 'labels' AS side, count(*) AS n FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents) a UNION ALL SELECT 'documents', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) b UNION ALL SELECT 'both', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) c")
def set_diff(t):
    d, lab = t("documents").select("doc_id"), t("labels").select("doc_id")
    n = lambda df, side: df.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return n(lab.subtract(d), "labels").unionByName(n(d.subtract(lab), "documents")).unionByName(n(d.intersect(lab), "both"))
