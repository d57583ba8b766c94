"""Identifiers, JSON and vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CVE, slug, strip

#: Namespace of deterministic ids: the URL namespace of RFC 4122.
NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
#: Object types that are named uniquely.
NAMED_TYPES = ("campaign", "identity", "infrastructure", "intrusion-set", "malware", "threat-actor", "tool")


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """RFC 4122 version 5 UUID of a name: repeatable, so a retried task gives the same id."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 8))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def stix_id(kind: str, name: Column) -> Column:
    return F.concat(F.lit(f"{kind}--"), uuid5(name))


def valid_stix_id(kind: Column, value: Column) -> Column:
    """``<kind>--`` followed by 32 hex digits with optional hyphens, braces or urn prefix; the version isn't looked at."""
    rest = F.substring(value, F.length(kind) + 3, F.length(value))
    bare = F.regexp_replace(F.regexp_replace(rest, "urn:|uuid:", ""), r"[{}-]", "")
    return F.coalesce(value.startswith(F.concat(kind, F.lit("--"))) & bare.rlike("^[0-9a-fA-F]{32}$"), F.lit(False))


# Fixed value: the first object of an answer, with one level of objects inside.
FIRST_OBJECT = r"\{(?:[^{}]|\{[^{}]*\})*\}"


def valid_json(x: Column) -> Column:
    """Whether the text is one JSON value and nothing else; null counts as not."""
    # the parser stops after the first value: text behind it fails inside a list or inside an object
    inside = lambda a, b: F.try_parse_json(F.concat(F.lit(a), x, F.lit(b))).isNotNull()
    return F.coalesce((strip(x) != "") & inside("[", "]") & inside('{"v":', "}"), F.lit(False))


def salvage_json(raw: Column) -> Column:
    """The JSON text of a model's answer: fences off; as it is, else its first object, else with a closing brace; null if none parses."""
    bare = strip(F.replace(F.replace(raw, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))
    block = F.regexp_extract(bare, FIRST_OBJECT, 0)
    closed = F.when((F.length(bare) - F.length(F.replace(bare, F.lit("{"), F.lit(""))) == 1) & ~F.contains(bare, F.lit("}")), F.concat(bare, F.lit("}")))
    ok = lambda c: F.when(valid_json(c), c)
    return F.coalesce(ok(bare), ok(block), ok(closed))


def canonical_json(x: Column) -> Column:
    """JSON with sorted keys; arrays keep their order; null if it doesn't parse."""
    return F.when(valid_json(x), F.to_json(F.try_parse_json(x)))


def object_key(kind: Column, technique: Column, cve: Column, cpe: Column, vendor: Column, name: Column, version: Column, object_id: Column, raw: Column) -> Column:
    """The key under which objects of several bundles are the same."""
    kind = F.coalesce(kind, F.lit("object"))
    return (
        F.when((kind == "attack-pattern") & (F.coalesce(technique, F.lit("")) != ""), F.concat(F.lit("attack-pattern:"), F.upper(technique)))
        .when((kind == "vulnerability") & cve.isNotNull(), F.concat(F.lit("vulnerability:"), cve))
        .when((kind == "software") & (F.coalesce(cpe, F.lit("")) != ""), F.concat(F.lit("software:cpe:"), cpe))
        .when(kind == "software", F.concat_ws(":", F.lit("software"), slug(vendor), slug(name), slug(version)))
        .when(kind == "relationship", F.concat(F.lit("relationship:"), object_id))
        .when(kind.isin(*NAMED_TYPES) & (F.coalesce(name, F.lit("")) != ""), F.concat(kind, F.lit(":"), slug(name)))
        .otherwise(F.concat(kind, F.lit(":"), F.coalesce(object_id, canonical_json(raw))))
    )


def external_id(references: Column, source: str, exact: bool = False) -> Column:
    """First non-blank external id of a source in an array of (source_name, external_id)."""
    same = (lambda r: r["source_name"] == source) if exact else (lambda r: F.lower(r["source_name"]) == source.lower())
    ids = F.transform(F.filter(references, same), lambda r: F.trim(r["external_id"]))
    return F.get(F.filter(ids, lambda v: v != ""), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays, 0 if one is null, empty or zero or the lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


__all__ = ["CVE", "canonical_json", "cosine", "external_id", "object_key", "salvage_json", "stix_id", "uuid5", "valid_stix_id"]
