"""The scalar functions under SQL names, inlined by Catalyst."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import objects as ob
from . import text as tx


def _r(pattern: str) -> str:
    """A raw string of SQL."""
    return 'r"' + pattern + '"' if "'" in pattern else "r'" + pattern + "'"


_STRIP = r"regexp_replace(%s, r'^\s+|\s+$', '')"
_SECRET_KEY = f"(k rlike {_r(tx.SECRET_KEY)} AND NOT lower(k) like '%\\\\_env')"
_UUID = f"concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', lower(hex((cast(conv(substr(h, 17, 1), 16, 10) as int) & 3) + 8)), substr(h, 18, 3), '-', substr(h, 21, 12))"
_NAMED = f"sha1(concat(unhex('{ob.NAMESPACE}'), cast(x as binary)))"
_STOPS = ", ".join(f"'{x}'" for x in tx.EXTENSION_STOPLIST)
_PHRASES = " ".join(f"WHEN contains(lower({_STRIP % 'x'}), '{a}') THEN '{b}'" for a, b in tx.CANONICAL_PHRASES)
_JSON = "(regexp_replace(x, r'^\\s+|\\s+$', '') <> '' AND try_parse_json(concat('[', x, ']')) IS NOT NULL AND try_parse_json(concat('{\"v\":', x, '}')) IS NOT NULL)"
_DOT = "aggregate(zip_with(%s, %s, (p, q) -> cast(p as double) * cast(q as double)), 0D, (s, v) -> s + v)"
_NORM = f"(sqrt({_DOT % ('a', 'a')}) * sqrt({_DOT % ('b', 'b')}))"
_PRIVATE = "(cast(split_part(ip, '.', 1) as int) = 10 OR (cast(split_part(ip, '.', 1) as int) = 172 AND cast(split_part(ip, '.', 2) as int) BETWEEN 16 AND 31) OR (cast(split_part(ip, '.', 1) as int) = 192 AND cast(split_part(ip, '.', 2) as int) = 168))"

#: name: (arguments, type, expression)
SQL_FUNCTIONS = {
    "rl_strip": ("x STRING", "STRING", _STRIP % "x"),
    "rl_slug": ("x STRING", "STRING", f"coalesce(btrim(regexp_replace(lower({_STRIP % 'x'}), '[^a-z0-9]+', '-'), '-'), '')"),
    "rl_squash": ("x STRING", "STRING", "regexp_replace(lower(x), '[^a-z0-9]+', '')"),
    "rl_spaced": ("x STRING", "STRING", "trim(regexp_replace(lower(x), '[^a-z0-9]+', ' '))"),
    "rl_tokens": ("x STRING", "ARRAY<STRING>", "regexp_extract_all(lower(x), '[a-z0-9]+', 0)"),
    "rl_sorted_set": ("x ARRAY<STRING>", "ARRAY<STRING>", "array_sort(array_distinct(x))"),
    "rl_matches": ("x STRING, p STRING", "ARRAY<STRING>", "regexp_extract_all(x, p, 0)"),
    "rl_extension": ("x STRING", "STRING", r"lower(regexp_extract(x, r'(\.[^.]*)$', 1))"),
    "rl_clean_stem": ("x STRING", "STRING", r"CASE WHEN regexp_extract(x, r'\.([^.]*)$', 1) <> '' AND regexp_replace(x, r'\.[^.]*$', '') <> '' THEN concat_ws('_', regexp_replace(x, r'\.[^.]*$', ''), lower(regexp_extract(x, r'\.([^.]*)$', 1))) ELSE x END"),
    "rl_technique_ids": ("x STRING", "ARRAY<STRING>", f"array_sort(array_distinct(regexp_extract_all(x, {_r(tx.TECHNIQUE_ID)}, 0)))"),
    "rl_md5s": ("x STRING", "ARRAY<STRING>", f"regexp_extract_all(x, {_r(tx.HASHES['MD5'])}, 0)"),
    "rl_sha1s": ("x STRING", "ARRAY<STRING>", f"regexp_extract_all(x, {_r(tx.HASHES['SHA1'])}, 0)"),
    "rl_sha256s": ("x STRING", "ARRAY<STRING>", f"regexp_extract_all(x, {_r(tx.HASHES['SHA256'])}, 0)"),
    "rl_ipv4s": ("x STRING", "ARRAY<STRING>", f"regexp_extract_all(x, {_r(tx.IPV4)}, 1)"),
    "rl_subnets": ("x STRING", "ARRAY<STRING>", f"array_sort(array_union(regexp_extract_all(x, {_r(tx.CIDR)}, 1), transform(filter(regexp_extract_all(x, {_r(tx.IPV4)}, 1), ip -> {_PRIVATE}), ip -> concat(regexp_extract(ip, r'^(\\d+\\.\\d+\\.\\d+)\\.', 1), '.0/24'))))"),
    "rl_file_paths": ("x STRING", "ARRAY<STRING>", "array_sort(array_distinct(filter(transform(concat(" + ", ".join(f"regexp_extract_all(x, {_r(p)}, 0)" for p in tx.PATHS) + f"), v -> rtrim('.,;:!)', {_STRIP % 'v'})), v -> length(v) >= 4)))"),
    "rl_registry_keys": ("x STRING", "ARRAY<STRING>", f"array_sort(array_union(transform(regexp_extract_all(x, {_r(tx.REGISTRY_KEY)}, 0), v -> rtrim('.,;:', v)), regexp_extract_all(x, {_r(tx.REGISTRY_VALUE)}, 1)))"),
    "rl_marker_extensions": ("x STRING", "ARRAY<STRING>", f"array_sort(array_distinct(transform(filter(transform(regexp_extract_all(x, {_r(tx.EXTENSION)}, 1), v -> lower(v)), v -> length(v) >= 3 AND v NOT IN ({_STOPS})), v -> concat('.', v))))"),
    "rl_cve_key": ("reference STRING, name STRING, description STRING", "STRING", f"upper(coalesce(nullif(trim(reference), ''), nullif(regexp_extract(name, {_r(tx.CVE)}, 0), ''), nullif(regexp_extract(description, {_r(tx.CVE)}, 0), '')))"),
    "rl_normal_actor": ("x STRING", "STRING", _STRIP % "replace(replace(regexp_replace(x, r\"’s|'s$\", ''), 'operator', ''), 'team', '')"),
    "rl_valid_actor": ("x STRING", "BOOLEAN", f"coalesce(size(split({_STRIP % 'x'}, r'\\s+')) <= 5 AND (lower(x) rlike '{'|'.join(tx.ACTOR_CUES)}' OR (length(x) <= 25 AND x rlike r'^[\\p{{L}}\\p{{N}}\\s-]+$' AND x rlike r'\\p{{L}}')), false)"),
    "rl_split_clauses": ("x STRING", "ARRAY<STRING>", f"filter(transform(split(x, r'(?i)\\b(?:and|then|but|before|after|,)\\b'), p -> {_STRIP % 'p'}), p -> length(p) > 3)"),
    "rl_canonical_phrase": ("x STRING", "STRING", f"CASE {_PHRASES} ELSE lower({_STRIP % 'x'}) END"),
    "rl_sentences": ("x STRING", "ARRAY<STRING>", f"filter(transform(split(x, r'(?<=[.?!])\\s+'), s -> {_STRIP % 's'}), s -> s <> '')"),
    "rl_evidence_window": ("x STRING, start INT, len INT", "STRING", _STRIP % "replace(substr(x, greatest(1, start - 100), start + len + 100 - greatest(1, start - 100)), '\\n', ' ')"),
    "rl_scrub": ("x STRING", "STRING", f"regexp_replace(coalesce(x, ''), {_r(tx.SECRET)}, 'sk-***')"),
    "rl_strip_markers": ("x STRING", "STRING", f"regexp_replace(regexp_replace(coalesce(x, ''), {_r(tx.OUTPUT_MARKER)}, ''), r'\\s+$', '')"),
    "rl_truncate": ("x STRING, n INT", "STRING", "CASE WHEN length(x) > n THEN concat(substr(x, 1, n - 1), '…') ELSE x END"),
    "rl_secret_key": ("k STRING", "BOOLEAN", _SECRET_KEY),
    "rl_without_secrets": ("m MAP<STRING, STRING>", "MAP<STRING, STRING>", f"map_filter(m, (k, v) -> NOT {_SECRET_KEY})"),
    "rl_transient": ("message STRING, status INT", "BOOLEAN", "coalesce(status = 429 OR status >= 500, false) OR contains(coalesce(message, ''), 'at capacity')"),
    "rl_kilobytes": ("size BIGINT", "STRING", "format_string('%.1f KB', size / 1024.0D)"),
    "rl_estimate_tokens": ("x STRING", "BIGINT", "cast(floor(length(coalesce(x, '')) / 4) as bigint)"),
    "rl_iso_utc": ("ts TIMESTAMP", "STRING", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"),
    "rl_preview": ("v ARRAY<STRING>, k INT", "STRING", "concat(array_join(slice(v, 1, k), ', '), CASE WHEN size(v) > k THEN concat(' … +', cast(size(v) - k as string)) ELSE '' END)"),
    "rl_uuid5": ("x STRING", "STRING", _UUID.replace("(h,", f"({_NAMED},")),
    "rl_stix_id": ("kind STRING, x STRING", "STRING", "concat(kind, '--', " + _UUID.replace("(h,", f"({_NAMED},") + ")"),
    "rl_valid_stix_id": ("kind STRING, x STRING", "BOOLEAN", "coalesce(startswith(x, concat(kind, '--')) AND regexp_replace(regexp_replace(substr(x, length(kind) + 3), 'urn:|uuid:', ''), '[{}-]', '') rlike '^[0-9a-fA-F]{32}$', false)"),
    "rl_valid_json": ("x STRING", "BOOLEAN", f"coalesce({_JSON}, false)"),
    "rl_canonical_json": ("x STRING", "STRING", f"CASE WHEN coalesce({_JSON}, false) THEN to_json(try_parse_json(x)) END"),
    "rl_cosine": ("a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE", f"CASE WHEN size(a) = size(b) AND {_NORM} > 0 THEN {_DOT % ('a', 'b')} / {_NORM} ELSE 0D END"),
    "rl_similarity_term": ("sim DOUBLE", "DOUBLE", "sim * 3 * CASE WHEN sim >= 0.65 THEN 1D WHEN sim >= 0.45 THEN 0.7D WHEN sim >= 0.30 THEN 0.4D ELSE 0.1D END"),
    "rl_platform_ok": ("a ARRAY<STRING>, b ARRAY<STRING>", "BOOLEAN", "a IS NULL OR size(a) = 0 OR b IS NULL OR size(b) = 0 OR arrays_overlap(a, b)"),
    "rl_f1": ("tp BIGINT, fp BIGINT, fn BIGINT", "DOUBLE", "case when tp = 0 then 0D else 2D * tp / (2 * tp + fp + fn) end"),
}


def register(spark: SparkSession) -> None:
    for name, (args, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
