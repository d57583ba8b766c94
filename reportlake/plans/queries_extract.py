"""Cleaning, extraction and grounding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import clean, extract, ground, markup
from ..sources import reports as rp
from .registry import query

_HEX = r"\b[a-fA-F0-9]{%d}\b"
_OBS = " UNION ALL ".join(f"SELECT doc_id, source, '{k}' AS kind, unnest(list_distinct(list_transform(regexp_extract_all(text, '{p}'), lambda v: lower(v)))) AS value FROM documents" for k, p in [*[(k, _HEX % n) for k, n in (("MD5", 32), ("SHA1", 40), ("SHA256", 64), ("SHA512", 128))], ("IPV4", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b")])


@query(f"SELECT source, kind, count(*) AS n, count(DISTINCT value) AS n_distinct FROM ({_OBS}) o GROUP BY source, kind")
def observables_by_source(t):
    return extract.observables(t("documents").select("doc_id", "source", "text")).groupBy("source", "kind").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_distinct"))


_LINE_HASHES = " UNION ALL ".join(rf"SELECT doc_id, '{k}' AS kind, line, i, unnest(list_transform(regexp_extract_all(line, '{_HEX % n}'), lambda v: lower(v))) AS value FROM l" for k, n in (("MD5", 32), ("SHA1", 40), ("SHA256", 64), ("SHA512", 128)))
_EVIDENCE = f"""SELECT doc_id, kind, value, trim(min_by(line, i)) AS evidence FROM (WITH l AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) a) {_LINE_HASHES}) c GROUP BY doc_id, kind, value"""


@query(_EVIDENCE)
def hash_evidence(t):
    return extract.hash_evidence(t("documents")).select("doc_id", "kind", "value", "evidence")


@query("""SELECT doc_id, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS entropy, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) > 4.8 AS code FROM
 (SELECT doc_id, ch, count(*)::DOUBLE AS c FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents) a WHERE ch <> '' GROUP BY doc_id, ch) b GROUP BY doc_id""")
def entropy_gate(t):
    e = F.round(clean.entropy(F.col("text")), 6)
    return t("documents").select("doc_id", e.alias("entropy"), (e > clean.ENTROPY_LIMIT).alias("code"))


_EXT = r"lower(regexp_extract(name, '(\.[^.]*)$', 1))"


_VERBS = ",".join(f"'{v}'" for v in clean.VERBS)
_PROSE = rf"""SELECT doc_id, n_sentences, n_tokens, n_alpha, n_verbs, n_sentences >= 2 AND n_verbs >= 2 AND n_tokens > 0 AND n_alpha >= 0.25 * n_tokens AS dominant FROM (
 SELECT doc_id, len(regexp_extract_all(text, '[.!?](\s|$)')) AS n_sentences, len(w) AS n_tokens, len(list_filter(w, lambda x: regexp_full_match(x, '\p{{L}}+'))) AS n_alpha, len(list_filter(w, lambda x: x IN ({_VERBS}))) AS n_verbs
 FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM %s) a) b"""


@query(rf"""SELECT doc_id, CASE WHEN regexp_extract(name, '\.([^.]*)$', 1) <> '' THEN regexp_replace(name, '\.[^.]*$', '') || '_' || lower(regexp_extract(name, '\.([^.]*)$', 1)) ELSE name END AS stem,
 CASE WHEN reason IS NOT NULL THEN '[SKIP]' WHEN ext = '.pdf' AND text IS NULL THEN '[ERR]' WHEN ext = '.png' THEN '[IMG]' WHEN ext = '.html' THEN '[HTML]' WHEN ext = '.pdf' THEN '[PDF]' ELSE '[TEXT]' END AS status, reason AS skip_reason FROM (
 SELECT r.*, CASE WHEN ext IN ('.txt', '.md') AND blank THEN 'empty' WHEN ext IN ('.txt', '.md') AND code AND NOT prose THEN 'code' WHEN ext IN ('.txt', '.md') AND NOT regexp_matches(regexp_replace(name, '\.[^.]*$', ''), '[a-zA-Z]{{3,}}') THEN 'filename'
 WHEN ext IN ('.html', '.pdf') AND blank AND (ext = '.html' OR text IS NOT NULL) THEN 'empty' WHEN ext NOT IN ('.txt', '.md', '.html', '.pdf', '.png') THEN 'extension' END AS reason FROM (
 SELECT reports.*, {_EXT} AS ext, NOT regexp_matches(coalesce(text, ''), '[^\s]') AS blank, coalesce(e.entropy > 4.8, false) AS code, coalesce(p.dominant, false) AS prose FROM reports LEFT JOIN ({_PROSE % "reports"}) p USING (doc_id) LEFT JOIN (SELECT doc_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS entropy FROM
 (SELECT doc_id, ch, count(*)::DOUBLE AS c FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM reports) a WHERE ch <> '' GROUP BY doc_id, ch) b GROUP BY doc_id) e USING (doc_id)) r) q""", ("reports",))
def route_status(t):
    return clean.route(t("reports")).select("doc_id", "stem", "status", "skip_reason")


@query(_PROSE % "documents")
def prose_gate(t):
    return clean.prose_columns(t("documents")).select("doc_id", "n_sentences", "n_tokens", "n_alpha", "n_verbs", "dominant")


_DECODED = "x"
for _entity, _char in markup.ENTITIES.items():
    _DECODED = f"replace({_DECODED}, '{_entity.replace(chr(39), chr(39) * 2)}', '{_char.replace(chr(39), chr(39) * 2)}')"


def _blocks(tag: str, bare: str = "bare") -> str:
    return rf"list_filter(list_transform(list_transform(regexp_extract_all({bare}, '(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>', 1), lambda x: regexp_replace(x, '(?s)<[^>]*>', '', 'g')), lambda x: trim(regexp_replace({_DECODED}, '\s+', ' ', 'g'))), lambda x: x <> '')"


_BARE = "html"
for _tag in ("script", "style", "nav", "footer", "header", "aside"):
    _BARE = rf"regexp_replace({_BARE}, '(?is)<{_tag}\b.*?</{_tag}\s*>', '', 'g')"


# a paragraph ends where the next one begins
_PARAGRAPHS = r"regexp_replace(bare, '(?i)<p\b', '</p><p', 'g')"


@query(rf"SELECT page_id, array_to_string(list_concat({_blocks('p', _PARAGRAPHS)}, list_transform({_blocks('li')}, lambda x: '• ' || x)), chr(10)) AS text FROM (SELECT page_id, {_BARE} AS bare FROM pages) p")
def page_text(t):
    return markup.html_texts(t("pages").select("page_id", "html")).select("page_id", "text")


@query(r"""SELECT doc_id, concat_ws(chr(10), a || ' & ' || b, '• ' || a || b || ' ' || c, '• ' || b, '• ' || c, '[Table]', a || ' | ' || b || c || a || ' | ' || c || ' | ' || a, c || ' | ' || a, b || ' | ' || b, '[Table]', c || ' | ' || a) AS text
 FROM (SELECT doc_id, coalesce(w[1], 'x') AS a, coalesce(w[2], 'y') AS b, coalesce(w[3], 'z') AS c FROM (SELECT doc_id, regexp_extract_all(text, '[a-z]+') AS w FROM documents) d) e""")
def nested_markup(t):
    """Lists in lists and a table in a table, with end tags left out, around the first words of each document."""
    w = F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))
    a, b, c = (F.coalesce(F.get(w, F.lit(i)), F.lit(x)) for i, x in enumerate("xyz"))
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    html = text(
        "<!-- <p>no</p> --><nav><ul><li>no<nav>no</nav><li>no</ul></nav><p class='x'>", a, " &amp; ", b, "<p>&nbsp;<ul><li>", a, "<ol><LI>", b, "</LI><li> ", c, "</ol></li></ul><table><tr><th>", a, "<td>", b,
        "<table><tr><td>", c, "</td><td>", a, "</table></td></tr><tr><td>", b, "</td><td>", b, "</table>")
    docs = t("documents").select("doc_id", html.alias("html"))
    return markup.html_texts(docs).select("doc_id", "text")


@query(rf"""SELECT doc_id, CASE WHEN ext = '.html' THEN '[HTML]' WHEN ext = '.pdf' THEN '[PDF]' ELSE '[TEXT]' END AS status, CASE WHEN ext = '.html' THEN trim(regexp_replace(text, '\s+', ' ', 'g')) ELSE text END AS text FROM (
 SELECT r.*, {_EXT} AS ext, coalesce(e.entropy > 4.8, false) AS code, coalesce(p.dominant, false) AS prose FROM reports r LEFT JOIN ({_PROSE % "reports"}) p USING (doc_id) LEFT JOIN (SELECT doc_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS entropy FROM
 (SELECT doc_id, ch, count(*)::DOUBLE AS c FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM reports) a WHERE ch <> '' GROUP BY doc_id, ch) b GROUP BY doc_id) e USING (doc_id)) q
 WHERE regexp_matches(coalesce(text, ''), '[^\s]') AND ext IN ('.txt', '.md', '.html', '.pdf') AND (ext NOT IN ('.txt', '.md') OR NOT (code AND NOT prose) AND regexp_matches(regexp_replace(name, '\.[^.]*$', ''), '[a-zA-Z]{{3,}}'))""", ("reports",))
def ingested(t):
    """Report files that pass the gates, by the step of that name; those of web pages have their text in a paragraph."""
    from .steps import run_step

    html = F.concat(F.lit("<html><header>no</header><p>"), F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p></html>"))
    files = t("reports").withColumn("text", F.when(F.endswith("name", F.lit(".html")), html).otherwise(F.col("text")))
    return run_step("ingest", files).select("doc_id", "status", "text")


@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(text, '\b((?:\d{1,3}\.){3}\d{1,3}/\d{1,2})\b', 1), list_transform(list_filter(regexp_extract_all(text, '\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b', 1),
 lambda ip: split_part(ip, '.', 1)::INT = 10 OR (split_part(ip, '.', 1)::INT = 172 AND split_part(ip, '.', 2)::INT BETWEEN 16 AND 31) OR (split_part(ip, '.', 1)::INT = 192 AND split_part(ip, '.', 2)::INT = 168)),
 lambda ip: split_part(ip, '.', 1) || '.' || split_part(ip, '.', 2) || '.' || split_part(ip, '.', 3) || '.0/24')))), ',') AS subnets FROM intel""", ("intel",))
def subnets(t):
    return t("intel").select("doc_id", F.array_join(tx.subnets(F.col("text")), ",").alias("subnets"))


# RE2 knows ASCII words only: matches are found in a copy of the text that has one ASCII sign for each other one (blank, mark or letter), and names are cut from the text at their place
_ASCII = r"regexp_replace(regexp_replace(regexp_replace(text, '[\t-\r\x1c-\x20\x85\xa0\p{Z}]', ' ', 'g'), '[^\x00-\x7F\p{L}\p{N}]', '!', 'g'), '[^\x00-\x7F]', '_', 'g')"
_VERSIONED = r"\b([A-Za-z][\w-]{2,30}) +v?([0-9]+\.[0-9]+(?:\.[0-9]+(?:\.[0-9]+)?)?)\b"
_NAMED_VERSIONS = f"""SELECT doc_id, substr(text, CAST(1 + sum(length(gap)) OVER (PARTITION BY doc_id ORDER BY i) + coalesce(sum(length(w)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT), length(a)) AS n, b AS v, i
 FROM (SELECT doc_id, text, unnest(string_split_regex(s, '{_VERSIONED}')) AS gap, unnest(regexp_extract_all(s, '{_VERSIONED}')) AS w, unnest(regexp_extract_all(s, '{_VERSIONED}', 1)) AS a, unnest(regexp_extract_all(s, '{_VERSIONED}', 2)) AS b, generate_subscripts(string_split_regex(s, '{_VERSIONED}'), 1) AS i
 FROM (SELECT doc_id, text, {_ASCII} AS s FROM intel) z) x QUALIFY a IS NOT NULL"""


@query(f"SELECT doc_id, lower(n) AS key, min_by(n, i) AS name, min_by(v, i) AS version FROM ({_NAMED_VERSIONS}) y GROUP BY doc_id, lower(n)", ("intel",))
def name_versions(t):
    return extract.name_versions(t("intel"))


@query(r"""SELECT doc_id, n_lines, cells FROM (SELECT doc_id, count(*) AS n_lines, sum(c) AS cells FROM (SELECT doc_id, len(string_split(line, '|')) AS c FROM (SELECT doc_id, unnest(list_concat([' a | b | c ', '|---|---|---|'],
 list_filter(string_split(text, chr(10)), lambda l: contains(l, '|')))) AS line FROM documents WHERE contains(text, '|')) x WHERE NOT starts_with(line, '|---')) y GROUP BY doc_id) z""")
def pipe_tables(t):
    """Lines with pipes of each document under a header that every document gets."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.contains(x, F.lit("|")))
    docs = t("documents").filter(F.contains("text", F.lit("|"))).select("doc_id", F.array_join(F.concat(F.array(F.lit("x | a | b | c | x"), F.lit("|---|---|---|")), F.transform(lines, lambda x: F.concat(F.lit("x|"), x, F.lit("|x")))), "\n").alias("text"))
    rows = extract.pipe_tables(docs)
    # the outer x cells keep a line's own empty ends, so cells add up
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.size("cells") - 2).alias("cells"))


@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_concat(regexp_extract_all(text, '(?i)%[A-Za-z]+%\\[\w.\\$-]+'), regexp_extract_all(text, '(?i)[A-Z]:\\[\w\\$. -]+')), lambda v: rtrim(trim(v), '.,;:!)')), lambda v: length(v) >= 4))), ',') AS paths,
 array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(?i)\b(?:HK(?:LM|CU|CR|U|CC)|HKEY_(?:LOCAL_MACHINE|CURRENT_USER|CLASSES_ROOT|USERS|CURRENT_CONFIG))\\[\\\w]+'))), ',') AS keys, CASE WHEN regexp_matches(text, '`\.lock\d`') THEN '.lock' || CAST(doc_id % 4 AS STRING) ELSE '' END AS extensions FROM intel""", ("intel",))
def paths_registry_ext(t):
    c = F.col("text")
    return t("intel").select("doc_id", F.array_join(tx.file_paths(c), ",").alias("paths"), F.array_join(tx.registry_keys(c), ",").alias("keys"), F.array_join(tx.marker_extensions(c), ",").alias("extensions"))


_IDS = r"SELECT doc_id, technique_id, i - 1 AS pos FROM (SELECT doc_id, unnest(a) AS technique_id, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, regexp_extract_all(upper(text), '\bT\d{4}(?:\.\d{3})?\b') AS a FROM intel) x) y WHERE technique_id IN (SELECT technique_id FROM technique)"


@query(_IDS, ("intel", "technique"))
def explicit_ids(t):
    return extract.explicit_techniques(t("intel"), t("technique")).select("doc_id", "technique_id", "pos")


@query(r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\bT\d{4}(?:\.\d{3})?\b'))), ',') AS ids FROM intel", ("intel",))
def written_ids(t):
    return t("intel").select("doc_id", F.array_join(tx.sorted_set(tx.matches(F.col("text"), tx.TECHNIQUE_ID)), ",").alias("ids"))


_ANCHORS = "SELECT anchor_id, pattern, CASE anchor_id % 3 WHEN 0 THEN substr(p, 1, 3) ELSE substr(p, 2, 2) END AS fragment, 0.7 + (anchor_id % 4) * 0.05 AS confidence, substr(p, 1, 3) AS word FROM (SELECT min(p_partkey) AS anchor_id, '(?i)' || substr(p_name, 1, 3) AS pattern, min(p_name) AS p FROM part GROUP BY substr(p_name, 1, 3)) x"


def _anchors(t):
    """An anchor for each beginning of a part's name: a dimension, whatever the size of the corpus."""
    g = t("part").groupBy(F.substring("p_name", 1, 3).alias("s")).agg(F.min("p_partkey").alias("anchor_id"), F.min("p_name").alias("p"))
    return g.select("anchor_id", F.concat(F.lit("(?i)"), F.col("s")).alias("pattern"), F.when(F.col("anchor_id") % 3 == 0, F.substring("p", 1, 3)).otherwise(F.substring("p", 2, 2)).alias("fragment"), (F.lit(0.7) + (F.col("anchor_id") % 4) * 0.05).alias("confidence"))


@query(f"SELECT doc_id, count(*) AS n, min(anchor_id) AS first_anchor, round(sum(confidence), 4) AS total FROM documents JOIN ({_ANCHORS}) a ON regexp_matches(text, pattern) GROUP BY doc_id")
def anchor_matches(t):
    hits = ground.anchor_hits(t("documents").select("doc_id", "text"), _anchors(t))
    return hits.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("anchor_id").alias("first_anchor"), F.round(F.sum("confidence"), 4).alias("total"))


_RESOLVED = f"""SELECT fragment, technique_id FROM (SELECT f.fragment, technique_id, row_number() OVER (PARTITION BY f.fragment ORDER BY revoked, CASE WHEN lower(name) = lower(f.fragment) THEN 0 WHEN ends_with(lower(name), lower(f.fragment)) THEN 1 ELSE 2 END, length(name), NOT contains(technique_id, '.'), technique_id) AS r
 FROM (SELECT DISTINCT fragment FROM ({_ANCHORS}) a) f JOIN technique ON contains(lower(name), lower(f.fragment))) q WHERE r = 1"""


@query(f"""SELECT doc_id, technique_id, round(least(1.0, min_by(confidence, anchor_id) + 0.05 * (count(*) - 1)), 3) AS confidence, min(anchor_id) AS anchor_id, min_by(regexp_replace(replace(substr(text, greatest(1, instr(lower(text), lower(word)) - 100), instr(lower(text), lower(word)) + 3 + 100 - greatest(1, instr(lower(text), lower(word)) - 100)), chr(10), ' '), '^\\s+|\\s+$', '', 'g'), anchor_id) AS evidence FROM documents JOIN ({_ANCHORS}) a ON regexp_matches(text, pattern) JOIN ({_RESOLVED}) r USING (fragment) GROUP BY doc_id, technique_id""", ("technique",))
def grounded_techniques(t):
    anchors = _anchors(t)
    hits = ground.anchor_hits(t("documents").select("doc_id", "text"), anchors)
    return ground.grounded(hits, ground.resolve_fragments(anchors, t("technique"))).select("doc_id", "technique_id", "confidence", "anchor_id", "evidence")


_NAMES = "SELECT 'amber group' AS name_key, 'G1' AS entity_id UNION ALL SELECT 'blue team', 'G2' UNION ALL SELECT 'carbon', 'G3' UNION ALL SELECT lower(n_name), 'N' || CAST(n_nationkey AS STRING) FROM nation"
_HITS = f"""SELECT doc_id, entity_id, name_key, count(*) AS n FROM (SELECT doc_id, unnest(list_concat(w, list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS g
 FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM intel) a) b JOIN ({_NAMES}) n ON g = name_key WHERE length(name_key) >= 3 GROUP BY doc_id, entity_id, name_key"""


def _names(t):
    spark = t("nation").sparkSession
    own = spark.createDataFrame([("amber group", "G1"), ("blue team", "G2"), ("carbon", "G3")], "name_key string, entity_id string")
    return own.unionByName(t("nation").select(F.lower("n_name").alias("name_key"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("entity_id")))


@query(_HITS, ("intel",))
def gazetteer_hits(t):
    return extract.gazetteer(t("intel"), _names(t))


_WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


@query(f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), n AS (SELECT item_id AS entity_id, v[1:k] AS v, array_to_string(v[1:k], ' ') AS name_key FROM (SELECT item_id, {_WORDS} AS v FROM benchmark) b, (SELECT unnest([1, 4, 6, 12]) AS k) k WHERE len(v) >= k)
 SELECT doc_id, entity_id, name_key, count(*) AS n FROM (SELECT doc_id, entity_id, name_key FROM (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s FROM w) d JOIN (SELECT DISTINCT * FROM n) n ON length(name_key) >= 3 AND contains(s, ' ' || name_key || ' '), unnest(range(1, len(w) - len(v) + 2)) AS u(i) WHERE w[i:i + len(v) - 1] = v) h GROUP BY ALL""")
def long_names(t):
    """Names of one, four, six and twelve words, the beginnings of benchmark items, in all documents."""
    w = tx.tokens(F.col("text"))
    heads = t("benchmark").select("item_id", w.alias("w")).withColumn("k", F.explode(F.array(*map(F.lit, (1, 4, 6, 12))))).filter("size(w) >= k")
    return extract.gazetteer(t("documents"), heads.select(F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("name_key"), F.col("item_id").alias("entity_id")))


@query(rf"""SELECT doc_id, entity_id, salience FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY salience DESC, entity_id) AS r FROM (SELECT h.doc_id, entity_id, n
 + 3 * CAST(contains(' ' || trim(regexp_replace(lower(regexp_extract(text, '^([^\n]*)', 1)), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || name_key || ' ') AS INT)
 + CAST(contains(' ' || trim(regexp_replace(lower(CASE WHEN contains(text, chr(10) || chr(10)) THEN split_part(text, chr(10) || chr(10), 1) ELSE substr(text, 1, 500) END), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || name_key || ' ') AS INT) AS salience
 FROM ({_HITS}) h JOIN intel USING (doc_id)) a WHERE salience >= 2) b WHERE r <= 3""", ("intel",))
def actor_salience(t):
    scored = extract.salience(t("intel"), extract.gazetteer(t("intel"), _names(t))).filter("salience >= 2")
    return extract.top_per(scored, ["doc_id"], [F.desc("salience"), "entity_id"], 3).select("doc_id", "entity_id", "salience")


def _techniques(t):
    arr = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    return t("technique").withColumn("platforms", arr("platform_list")).withColumn("phases", arr("phase_list"))


@query(r"""SELECT e.doc_id, e.technique_id, attested, list_has_any(list_filter(string_split(platform_list, ','), lambda x: x <> ''), string_split(attested, ',')) OR attested = '' OR platform_list = '' AS ok,
 NOT (platform_list <> '' AND NOT contains(platform_list, ',') AND NOT contains(lower(text), platform_list)) AS single_ok FROM (SELECT DISTINCT doc_id, technique_id FROM (""" + _IDS + r""") i) e JOIN technique USING (technique_id) JOIN (SELECT doc_id, text, array_to_string(list_filter(['linux', 'macos', 'windows'], lambda p: regexp_matches(lower(text), '\b' || p || '\b')), ',') AS attested FROM intel) a USING (doc_id)""", ("intel", "technique"))
def platform_filter(t):
    tech = _techniques(t)
    docs = t("intel")
    pairs = extract.explicit_techniques(docs, tech).select("doc_id", "technique_id").distinct()
    j = pairs.join(tech, "technique_id").join(ground.attested_platforms(docs, tech), "doc_id").join(docs.select("doc_id", "text"), "doc_id")
    return j.select("doc_id", "technique_id", F.array_join("attested", ",").alias("attested"), ground.platform_ok(F.col("platforms"), F.col("attested")).alias("ok"), ground.single_platform_ok(F.col("platforms"), F.col("text")).alias("single_ok"))


_NAMED = "SELECT DISTINCT doc_id, 0 AS pos, 'T' || CAST(1000 + doc_id % 45 AS STRING) AS technique_id FROM documents"


@query(f"""SELECT doc_id, technique_id, CASE min(k) // 1000000 WHEN 0 THEN 'ir' WHEN 1 THEN 'explicit' ELSE 'inferred' END AS source, min(k) // 1000000 AS priority, min(k) % 1000000 AS pos, count(*) AS n FROM (
 SELECT doc_id, technique_id, pos AS k FROM ({_NAMED}) a UNION ALL SELECT doc_id, technique_id, 1000000 + pos FROM ({_IDS}) b UNION ALL SELECT doc_id, 'T' || CAST(1000 + doc_id % 17 AS STRING), 2000000 + 1 FROM documents) u GROUP BY doc_id, technique_id""", ("intel", "technique"))
def source_merge(t):
    docs = t("documents").select("doc_id")
    tid = lambda k: F.concat(F.lit("T"), (F.lit(1000) + F.col("doc_id") % k).cast("string"))
    ir = docs.select("doc_id", tid(45).alias("technique_id"), F.lit(0).alias("pos"), F.lit("ir").alias("source"))
    explicit = extract.explicit_techniques(t("intel"), t("technique")).withColumn("source", F.lit("explicit"))
    inferred = docs.select("doc_id", tid(17).alias("technique_id"), F.lit(1).alias("pos"), F.lit("inferred").alias("source"))
    return ground.merge_sources(ir, explicit, inferred)


@query(f"SELECT DISTINCT doc_id, technique_id FROM ({_IDS}) a WHERE NOT EXISTS (SELECT 1 FROM ({_IDS}) b WHERE b.doc_id = a.doc_id AND contains(b.technique_id, '.') AND split_part(b.technique_id, '.', 1) = a.technique_id)", ("intel", "technique"))
def parent_collapse(t):
    return ground.collapse_parents(extract.explicit_techniques(t("intel"), t("technique")).select("doc_id", "technique_id").distinct())


_STOPS = "the a of to in and is it".split()
_ACTS = "is was are in on at to".split()
_Q = lambda words: ",".join(repr(w) for w in words)
# a verb, then a word that is neither a verb nor a stop word
_HAS_OBJECT = f"(len(list_filter(w, lambda x: x IN ({_Q(_ACTS)}))) > 0 AND len(list_filter(w[list_min(list_transform(list_filter(range(1, len(w) + 1), lambda i: w[i] IN ({_Q(_ACTS)})), lambda i: i)) + 1:], lambda x: x NOT IN ({_Q([*_ACTS, *_STOPS])}))) > 0)"
_NOUNS = f"list_filter(w, lambda x: x NOT IN ({_Q([*_ACTS, *_STOPS])}))"
_ABSTRACT = f"len(list_filter({_NOUNS}, lambda x: regexp_matches(x, '(ity|ness|tion|ment)$')))"
_SPECIFIC = f"greatest(0.6, 1.0 - CASE WHEN NOT {_HAS_OBJECT} THEN 0.25 ELSE 0 END - CASE WHEN {_ABSTRACT} > 0 AND {_ABSTRACT} * 2 >= len({_NOUNS}) THEN 0.15 ELSE 0 END - CASE WHEN len(list_filter(w, lambda x: x IN ({_Q(_ACTS)}))) = 1 AND NOT {_HAS_OBJECT} THEN 0.15 ELSE 0 END)::DOUBLE"
_REASON = f"CASE WHEN trim(text) = '' THEN 'missing' WHEN NOT {_HAS_OBJECT} THEN 'no-object' WHEN len(w) < 4 THEN 'short' WHEN len(list_filter(w, lambda x: x IN ({_Q(_STOPS)}))) >= 0.75 * len(w) THEN 'stop-words' END"
_BEHAVIOURS = f"""SELECT *, {_REASON} AS reason, {_SPECIFIC} AS specificity, list_distinct(list_filter(w, lambda x: x NOT IN ({_Q(tx.REPORT_WORDS)}))) AS words FROM (SELECT *, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM (
 SELECT conv_id AS doc_id, turn AS seq, c.text || ' it was identify ' || coalesce(p, '') || CASE WHEN conv_id % 2 = 0 THEN ' windows' ELSE '' END AS text, CASE WHEN conv_id % 3 = 0 THEN 'impact' END AS phase, e.embedding AS vector
 FROM conversations c LEFT JOIN (SELECT p_partkey % 40 AS m, min(p_name) AS p FROM part GROUP BY 1) q ON q.m = (conv_id + turn) % 40 LEFT JOIN embeddings e ON e.vec_id = conv_id + turn) z) y"""
_SIM = "coalesce(list_cosine_similarity(b.vector::DOUBLE[], t.vector::DOUBLE[]), 0.0)"
_SCORED = f"""SELECT doc_id, seq, technique_id, round((6.0 + 2.0 * CAST(list_has_any(n, d) AS INT) + 0.5 * CAST(len(list_filter(n, lambda a: len(list_filter(words, lambda b: starts_with(b, substr(a, 1, 4)))) > 0)) > 0 AS INT) + sim * 3 * CASE WHEN sim >= 0.65 THEN 1.0 WHEN sim >= 0.45 THEN 0.7 WHEN sim >= 0.30 THEN 0.4 ELSE 0.1 END)
 * CASE WHEN known AND phase_list <> '' AND NOT contains(phase_list, 'impact') THEN 0.5 ELSE 1.0 END * specificity, 6) AS score FROM (SELECT b.*, t.technique_id, t.n, t.phase_list, t.platform_list, {_SIM} AS sim, d.d, d.whole, d.known FROM b JOIN t ON list_has_any(n, words) JOIN d ON d.doc_id = b.doc_id WHERE reason IS NULL) x
 WHERE NOT (platform_list <> '' AND NOT contains(platform_list, ',') AND NOT contains(whole, platform_list))"""


@query(f"""SELECT doc_id, seq, technique_id, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, seq, technique_id) AS k FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, seq ORDER BY score DESC, technique_id) AS r FROM (
 WITH b AS ({_BEHAVIOURS}), t AS (SELECT technique_id, regexp_extract_all(lower(name), '[a-z0-9]+') AS n, phase_list, platform_list, embedding AS vector FROM technique LEFT JOIN embeddings ON vec_id = pos), d AS (SELECT doc_id, regexp_extract_all(string_agg(lower(text), ' '), '[a-z0-9]+') AS d, string_agg(lower(text), ' ') AS whole, bool_or(phase IS NOT NULL) AS known FROM b GROUP BY doc_id)
 {_SCORED}) s WHERE score >= 3.0) q WHERE r <= 2) p WHERE k <= 15""", ("technique",))
def technique_inference(t):
    """Turns of a conversation, each with a part name in it, as behaviours of one document; vectors from the embeddings."""
    part = t("part").groupBy((F.col("p_partkey") % 40).alias("m")).agg(F.min("p_name").alias("p"))
    vectors = t("embeddings").select("vec_id", F.col("embedding").alias("vector"))
    c = t("conversations").withColumn("m", (F.col("conv_id") + F.col("turn")) % 40).join(part, "m", "left").join(vectors, F.col("vec_id") == F.col("conv_id") + F.col("turn"), "left")
    text = F.concat("text", F.lit(" it was identify "), F.coalesce("p", F.lit("")), F.when(F.col("conv_id") % 2 == 0, " windows").otherwise(""))
    behaviours = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), text.alias("text"), F.when(F.col("conv_id") % 3 == 0, "impact").alias("phase"), "vector")
    docs = behaviours.groupBy("doc_id").agg(F.array_join(F.collect_list("text"), " ").alias("text"))
    techniques = _techniques(t).join(vectors, F.col("vec_id") == F.col("pos"), "left").select("technique_id", tx.tokens(F.col("name")).alias("tokens"), "platforms", "phases", "vector")
    return ground.infer(behaviours, docs, techniques, _ACTS, _STOPS).select("doc_id", "seq", "technique_id", "score")


@query(f"SELECT conv_id, turn, {_REASON} AS reject_reason, len(w) AS n_tokens, {_SPECIFIC} AS specificity FROM (SELECT conv_id, turn, text, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM conversations) c")
def behaviour_quality(t):
    q = ground.behaviour_quality(t("conversations"), _STOPS, _ACTS)
    return q.select("conv_id", "turn", "reject_reason", F.size("tokens").alias("n_tokens"), ground.specificity(F.col("tokens"), _ACTS, _STOPS).cast("double").alias("specificity"))


@query(r"""SELECT doc_id, h AS host, coalesce(nullif(t_ip, ''), i_ip) AS ip FROM (SELECT doc_id, lower(regexp_extract(text, '(?i)(srv\d)`?\s*\(\s*((?:\d{1,3}\.){3}\d{1,3})\s*\)', 1)) AS h, regexp_extract(text, '(?i)(srv\d)`?\s*\(\s*((?:\d{1,3}\.){3}\d{1,3})\s*\)', 2) AS i_ip FROM intel) a
 FULL JOIN (SELECT doc_id, 'srv' || CAST(doc_id % 9 AS STRING) AS h, CASE WHEN doc_id % 2 = 0 THEN '' ELSE '172.16.0.' || CAST(doc_id % 250 AS STRING) END AS t_ip FROM documents) b USING (doc_id, h)""", ("intel",))
def host_inventory(t):
    listed = t("documents").select("doc_id", F.concat(F.lit("srv"), (F.col("doc_id") % 9).cast("string")).alias("host"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.concat(F.lit("172.16.0."), (F.col("doc_id") % 250).cast("string"))).alias("ip"))
    return extract.merge_hosts(listed, extract.hosts(t("intel")))


@query(r"""SELECT doc_id, min_by(name, k) AS name FROM (SELECT doc_id, unnest(a) AS name, generate_subscripts(a, 1) AS k FROM (SELECT doc_id, list_filter(regexp_extract_all(text, '\b([A-Z][A-Z0-9_-]{1,30})\\([A-Za-z][A-Za-z0-9._-]+)\b', 1), lambda d: NOT starts_with(d, 'HK') AND length(d) > 2 AND d <> 'TEMP') AS a FROM intel) x
 UNION ALL SELECT doc_id, 'corp' || (doc_id % 3), 1000 FROM documents) y GROUP BY doc_id, lower(name)""", ("intel",))
def domains_accounts(t):
    docs = t("intel").select("doc_id", F.concat("text", F.lit("\n**Primary Domain**: `corp"), (F.col("doc_id") % 3).cast("string"), F.lit("` and more")).alias("text"))
    return extract.domains(docs, ["Primary Domain"])


@query("SELECT c_nationkey AS doc_id, replace(c_name, '#', '_') AS username, CASE c_custkey % 3 WHEN 0 THEN 'ACME' WHEN 1 THEN '.' ELSE '' END AS domain, c_custkey % 2 = 0 AS has_password FROM customer UNION ALL SELECT n_nationkey, 'svc_' || lower(replace(n_name, ' ', '_')), '', false FROM nation")
def account_tables(t):
    """Customers as rows of account tables, one table a nation, and an account in prose."""
    k = F.col("c_custkey") % 3
    user = F.concat(F.when(k == 0, "ACME\\").when(k == 1, ".\\").otherwise(""), F.replace("c_name", F.lit("#"), F.lit("_")))
    row = F.concat(F.lit("> | `"), user, F.lit("` | "), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(""), F.lit(" | x |"))
    rows = t("customer").groupBy("c_nationkey").agg(F.array_join(F.collect_list(row), "\n").alias("rows"))
    name = F.lower(F.replace("n_name", F.lit(" "), F.lit("_")))
    docs = t("nation").join(rows, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("n_nationkey").alias("doc_id"), F.concat(F.lit("The service account `svc_"), name, F.lit("` and user `RDP`.\n\n> | **User** | `Secret` | Note |\n> | --- | :-: | --- |\n"), F.coalesce("rows", F.lit(""))).alias("text"))
    aliases = rp.alias_table(docs.sparkSession, {"username": ["user", "login"], "password": ["secret"]})
    return extract.accounts(docs, aliases)


_KNOWN = "SELECT DISTINCT CASE WHEN doc_id % 6 < 2 THEN 'malware' ELSE 'tool' END AS kind, 'tool' || (doc_id % 6) || CASE WHEN doc_id % 6 = 0 THEN '.exe' ELSE '' END AS name_key FROM documents WHERE doc_id % 6 < 3"
_NO_TOOLS = ",".join(f"'{w}'" for w in tx.NO_TOOLS)
_SOFTWARE = rf"""SELECT DISTINCT doc_id, name, how FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{tx.FILENAME}')) AS name, 'file' AS how FROM intel UNION ALL SELECT doc_id, name, CASE WHEN contains(name, '.') THEN 'file' ELSE 'trigger' END FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{tx.TOOL_TRIGGER}', 1)) AS name FROM intel) a
 WHERE contains(name, '.') OR (lower(name) NOT IN ({_NO_TOOLS}) AND (regexp_matches(name, '^[A-Z].*[A-Z]') OR (upper(name) = name AND regexp_matches(name, '[A-Za-z]')) OR lower(name) IN (SELECT 'rclone' AS k)))) b"""


@query(f"""SELECT doc_id, name, how, CASE WHEN EXISTS (SELECT 1 FROM ({_KNOWN}) k WHERE kind = 'malware' AND name_key IN (lower(name), lower(regexp_replace(name, '\\.[A-Za-z0-9]+$', '')))) THEN 'malware' ELSE 'tool' END AS kind FROM ({_SOFTWARE}) f""", ("intel",))
def software_split(t):
    d = t("documents").select(F.col("doc_id") % 6).distinct().toDF("k").filter("k < 3")
    known = d.select(F.when(F.col("k") < 2, "malware").otherwise("tool").alias("kind"), F.concat(F.lit("tool"), F.col("k").cast("string"), F.when(F.col("k") == 0, ".exe").otherwise("")).alias("name_key"))
    names = d.limit(1).select(F.lit("rclone").alias("name_key"))
    return extract.split_software(extract.software_tokens(t("intel"), names), known).select("doc_id", "name", "how", "kind")


@query(rf"""SELECT doc_id, min_by(name, p || name) AS name, max(version) AS version, min_by(how, p || name) AS how FROM (SELECT doc_id, name, how, NULL AS version, CASE how WHEN 'file' THEN '0' ELSE '2' END AS p FROM ({_SOFTWARE}) f UNION ALL
 SELECT doc_id, min_by(n, i), 'version', min_by(v, i), '1' FROM ({_NAMED_VERSIONS}) y GROUP BY doc_id, lower(n)) z
 WHERE length(trim(name, '`*.')) BETWEEN 3 AND 40 GROUP BY doc_id, lower(trim(name, '`*.'))""", ("intel",))
def software_rows(t):
    names = t("documents").limit(1).select(F.lit("rclone").alias("name_key"))
    return extract.software_rows(t("intel"), names)


@query(r"SELECT doc_id, '.lock' || CAST(doc_id % 4 AS STRING) AS ext FROM documents WHERE doc_id % 4 <> 3")
def marker_extensions(t):
    """Markers that aren't on a stop list, by an anti join."""
    stop = t("documents").filter("doc_id % 4 = 3").select(F.concat(F.lit(".lock"), (F.col("doc_id") % 4).cast("string")).alias("ext")).distinct()
    return t("intel").select("doc_id", F.explode(tx.marker_extensions(F.col("text"))).alias("ext")).join(stop, "ext", "left_anti").select("doc_id", "ext")


@query(r"""SELECT plan, part, arg_min(url, struct_pack(a := -length(html), b := url)) AS path, max(length(html)) AS size, count(*) AS n FROM (SELECT *, regexp_extract(lower(url), '^[a-z]+://([^/]+)/', 1) AS plan,
 CASE WHEN regexp_matches(lower(url), 'infra') THEN 'infrastructure' WHEN regexp_matches(lower(url), 'overview|summary|readme|intro') THEN 'overview' ELSE 'plan' END AS part FROM pages) p WHERE plan <> '' AND NOT regexp_matches(lower(url), '/(?:\.git|node_modules|archive)/') GROUP BY plan, part""")
def corpus_discovery(t):
    listed = rp.classify_paths(t("pages").select(F.col("url").alias("path"), F.length("html").alias("size")))
    return rp.largest_candidates(listed).select("plan", "part", "path", "size", "n")


@query(r"""SELECT * FROM (WITH f AS (SELECT *, regexp_extract(path, '^([^/]+/[^/]+)/', 1) AS plan, regexp_replace(path, '^[^/]+/[^/]+/', '') AS rest, split_part(path, '/', -1) AS file FROM plan_file WHERE NOT starts_with(path, '.')),
 t AS (SELECT *, CASE WHEN rest = 'Scenario.md' THEN 0 WHEN regexp_matches(rest, '^(Emulation_Plan/([^/]+/)?)?[^/]+\.md$') AND NOT starts_with(lower(rest), 'emulation_plan/yaml/') AND (contains(lower(file), 'scenario') AND NOT contains(file, 'README') OR starts_with(lower(file), 'phase')) THEN 1
  WHEN rest = 'Emulation_Plan/README.md' THEN 2 WHEN rest = 'README.md' THEN 3 END AS scenario,
  CASE WHEN regexp_matches(rest, '^CTI_Emulation_Resources/[^/]*\.md$') THEN CASE WHEN contains(file, 'Overview') THEN 0 WHEN lower(file) <> 'readme.md' THEN 1 END WHEN regexp_matches(rest, '^Intelligence_Summary/[^/]*\.md$') THEN 2 WHEN rest = 'Intelligence_Summary.md' THEN 3 END AS overview,
  CASE WHEN regexp_matches(rest, '^(Emulation_Plan/([^/]+/)?)?Infrastructure[^/]*\.md$') THEN 0 END AS infrastructure FROM f WHERE plan IN (SELECT plan FROM f WHERE regexp_matches(rest, '^(Emulation_Plan|CTI_Emulation_Resources|Resources|Intelligence_Summary|Operations_Flow)/'))),
 p AS (SELECT plan, 'scenario' AS part, scenario AS tier, path, size FROM t UNION ALL SELECT plan, 'overview', overview, path, size FROM t UNION ALL SELECT plan, 'infrastructure', infrastructure, path, size FROM t)
 SELECT plan, part, path, size, tier, n FROM (SELECT *, count(*) OVER (PARTITION BY plan, part, tier) AS n, row_number() OVER (PARTITION BY plan, part ORDER BY tier, CASE WHEN part = 'infrastructure' OR part = 'scenario' AND tier = 1 THEN -size ELSE 0 END, path, -size) AS r FROM p WHERE tier IS NOT NULL) q WHERE r = 1) y""", ("plan_file",))
def plan_discovery(t):
    """Scenario, overview and infrastructure file of each plan folder, by tiers of rules and size."""
    return rp.plan_files(t("plan_file").select("path", "size"))


@query(r"""SELECT n_nationkey, actor, valid FROM (SELECT n_nationkey, trim(replace(replace(regexp_replace(raw, '''s$', ''), 'operator', ''), 'team', '')) AS actor, len(string_split(raw, ' ')) <= 5 AND (regexp_matches(lower(raw), 'group|apt|team|gang|operator|raas') OR (length(raw) <= 25 AND regexp_matches(raw, '^[\p{L}\p{N}\s-]+$'))) AS valid
 FROM (SELECT n_nationkey, n_name || CASE n_nationkey % 4 WHEN 0 THEN ' team''s' WHEN 1 THEN ' operator' WHEN 2 THEN '-9' ELSE ' a b c d e f' END AS raw FROM nation) a) b""")
def actor_cleanup(t):
    k = F.col("n_nationkey") % 4
    raw = F.concat("n_name", F.when(k == 0, " team's").when(k == 1, " operator").when(k == 2, "-9").otherwise(" a b c d e f"))
    return t("nation").select("n_nationkey", raw.alias("raw")).select("n_nationkey", tx.normal_actor(F.col("raw")).alias("actor"), tx.valid_actor(F.col("raw")).alias("valid"))


_SENTENCES = r"SELECT conv_id, turn, unnest(a) AS p, generate_subscripts(a, 1) - 1 AS i FROM (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ' || chr(10) || chr(13) || chr(9))), lambda s: s <> '') AS a FROM conversations) x"


# forms of each reporter's verb, by hand
_REPORTING = [v + e for v in ("report", "document") for e in ("", "s", "ed", "ing")] + [v[:-1] + e for v in ("describe", "note", "observe", "analyze", "state") for e in ("e", "es", "ed", "ing")]
_REPORTING += "identify identifies identified identifying assess assesses assessed assessing publish publishes published publishing".split()
_FORMS = "reported describes observing identified analyzed assesses publishing stating moved downloads".split()


@query(f"""SELECT conv_id, phrase, n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS r FROM (SELECT conv_id, min_by(p, turn * 100000 + i) AS phrase, min(turn * 100000 + i) AS k, count(*) AS n FROM (
 SELECT conv_id, turn, i, [{_Q(_FORMS)}][1 + (turn + i) % {len(_FORMS)}] || ' ' || p AS p FROM ({_SENTENCES}) y) x WHERE lower(split_part(p, ' ', 1)) NOT IN ({_Q(_REPORTING)}) GROUP BY conv_id, lower(p)) z) q WHERE r <= 20""")
def behaviour_cleanup(t):
    """Distinct sentences of a conversation, each with a verb before it, without those whose verb is a form of a reporter's; any case, first spelling kept, twenty at most."""
    each = t("conversations").select("conv_id", "turn", F.posexplode(tx.sentences(F.col("text"))).alias("i", "phrase"))
    verb = F.get(F.array(*map(F.lit, _FORMS)), ((F.col("turn") + F.col("i")) % len(_FORMS)).cast("int"))
    each = each.withColumn("phrase", F.concat(verb, F.lit(" "), "phrase")).withColumn("verb", F.substring_index("phrase", " ", 1))
    return ground.distinct_behaviours(ground.acting(each, "verb"), "conv_id", ["turn", "i"], "phrase").select("conv_id", "phrase", "n")


@query(r"""SELECT conv_id, turn, array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(x, '\b(?:and|then|but|before|after)\b', chr(1), 'gi'), chr(1)), lambda s: trim(s)), lambda s: length(s) > 3), '/') AS clauses, CASE WHEN contains(x, 'weaken organizational security posture') THEN 'degrade security controls' ELSE x END AS canonical
 FROM (SELECT conv_id, turn, trim(lower(regexp_replace(regexp_replace(text, '[^A-Za-z ]', ' ', 'g'), ' +', ' ', 'g'))) || CASE WHEN turn % 2 = 0 THEN ' weaken organizational security posture' ELSE '' END AS x FROM conversations) c""")
def clause_split(t):
    plain = F.trim(F.lower(F.regexp_replace(F.regexp_replace("text", "[^A-Za-z ]", " "), " +", " ")))
    x = t("conversations").select("conv_id", "turn", F.concat(plain, F.when(F.col("turn") % 2 == 0, " weaken organizational security posture").otherwise("")).alias("x"))
    return x.select("conv_id", "turn", F.array_join(tx.split_clauses(F.col("x")), "/").alias("clauses"), tx.canonical_phrase(F.col("x")).alias("canonical"))
