"""STIX-shaped objects: building, enrichment, validation, fusion and bundle documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.objects import external_id, object_key, stix_id, valid_json, valid_stix_id
from ..functions.text import cve_key, strip
from ..sources.storage import stage_rows

#: Fixed list of object types that a bundle may hold.
ALLOWED_TYPES = (
    "attack-pattern campaign course-of-action identity indicator intrusion-set infrastructure location malware note observed-data "
    "report threat-actor tool user-account vulnerability relationship"
).split()


def enrich_techniques(labels: DataFrame, by_id: DataFrame, by_name: DataFrame) -> DataFrame:
    """label, id, name, how: a technique object by the id in the label, else by its lower-case name, else a bare one.

    ``by_id``: technique_id, name; ``by_name``: name_lc, technique_id. The id of a bare object depends on its label alone.
    """
    tid = F.regexp_extract(F.upper("label"), r"T\d{4}(?:\.\d{3})?", 0)
    j = labels.withColumn("_tid", tid).withColumn("_name", F.lower(F.trim("label")))
    a = by_id.select(F.col("technique_id").alias("_tid"), F.col("name").alias("n1"))
    b = by_name.groupBy(F.col("name_lc").alias("_name")).agg(F.min("technique_id").alias("t2"), F.min("name").alias("n2"))
    j = j.join(a, "_tid", "left").join(b, "_name", "left")
    how = F.when(F.col("n1").isNotNull(), "id").when(F.col("t2").isNotNull(), "name").otherwise("bare")
    key = F.coalesce(F.when(F.col("n1").isNotNull(), F.col("_tid")), F.col("t2"), F.col("label"))
    return j.select("label", stix_id("attack-pattern", key).alias("id"), F.coalesce("n1", "n2", "label").alias("name"), how.alias("how"))


def observed_data(hashes: DataFrame, stamp: Column) -> DataFrame:
    """One observed-data object a hash row (doc_id, kind, value, evidence): one time for all four stamps, seen once."""
    oid = stix_id("observed-data", F.concat_ws("|", F.col("doc_id").cast("string"), "kind", "value"))
    body = F.struct(
        F.lit("observed-data").alias("type"), oid.alias("id"), stamp.alias("created"), stamp.alias("modified"), stamp.alias("first_observed"), stamp.alias("last_observed"),
        F.lit(1).alias("number_observed"), F.create_map("kind", "value").alias("hashes"), F.array(F.lit("malicious-activity")).alias("labels"), F.col("evidence").alias("x_evidence"))
    return hashes.select("doc_id", oid.alias("id"), F.to_json(body).alias("object"))


def validate(objects: DataFrame, relationships: DataFrame) -> DataFrame:
    """bundle_id, pos, rule, message of each structural error.

    ``objects``: bundle_id, pos, type, id; ``relationships``: bundle_id, pos, rel_type, src, dst. An object
    without type or id has that error only; only the second and later rows of an id are repeats. Ends are known if an object with type and id has them.
    """
    typed, named = F.coalesce("type", F.lit("")) != "", F.coalesce("id", F.lit("")) != ""
    # objects without a type are no repeats and known by no relationship
    o = objects.withColumn("_n", F.when(typed & named, F.row_number().over(Window.partitionBy("bundle_id", "id", typed).orderBy("pos"))))
    text = lambda *parts: F.concat(*[F.lit(p) if i % 2 == 0 else F.col(p).cast("string") for i, p in enumerate(parts)])
    rules = [
        (1, ~typed, text("Object ", "pos", " missing 'type'.")),
        (2, typed & ~named, text("Object ", "pos", " of type '", "type", "' missing 'id'.")),
        (3, typed & named & ~valid_stix_id(F.col("type"), F.col("id")), text("Object ", "pos", " ID '", "id", "' does not match ", "type", "--<uuid4>.")),
        (4, F.col("_n") > 1, text("Duplicate STIX ID detected: ", "id")),
        (5, typed & named & ~F.col("type").isin(ALLOWED_TYPES), text("Unknown STIX type '", "type", "' in object ", "pos", ".")),
    ]
    found = F.filter(F.array(*[F.when(test, F.struct(F.lit(n).alias("rule"), message.alias("message"))) for n, test, message in rules]), lambda r: r.isNotNull())
    own = o.select("bundle_id", "pos", F.inline(found))
    ids = objects.filter(typed & named).select("bundle_id", "id").distinct()
    untyped = relationships.filter(F.coalesce("rel_type", F.lit("")) == "").select("bundle_id", "pos", F.lit(6).alias("rule"), text("Relationship ", "pos", " missing 'relationship_type'.").alias("message"))
    side = lambda n, name, c: F.struct(F.lit(n).alias("rule"), F.lit(name).alias("side"), F.col(c).alias("id"))
    ends = relationships.select("bundle_id", "pos", F.inline(F.array(side(7, "source_ref", "src"), side(8, "target_ref", "dst"))))
    missing = ends.filter(~named).select("bundle_id", "pos", "rule", text("Relationship ", "pos", " missing '", "side", "'.").alias("message"))
    dangling = ends.filter(named).join(ids, ["bundle_id", "id"], "left_anti").select("bundle_id", "pos", (F.col("rule") + 2).alias("rule"), text("Relationship ", "pos", " ", "side", " '", "id", "' does not exist.").alias("message"))
    return own.unionByName(untyped).unionByName(missing).unionByName(dangling)


def validate_bundles(bundles: DataFrame) -> DataFrame:
    """bundle_id, errors: ordered messages of each bundle document (bundle_id, value: JSON text); an empty list if it is valid.

    Errors of the bundle itself come first, then those of objects, then those of relationships, each by place and rule. Objects are not looked at
    if they are no list or an empty one. Text that is no JSON object has one error.
    """
    value = F.when(valid_json(F.col("value")) & F.startswith(strip(F.col("value")), F.lit("{")), F.try_parse_json("value"))
    b = bundles.select("bundle_id", value.alias("v"))
    field = lambda path, kind: F.try_variant_get("v", path, kind)
    bid, objs = F.to_json(F.try_variant_get("v", "$.id", "variant")), F.to_json(F.try_variant_get("v", "$.objects", "variant"))
    bad_id = F.when(bid.isNull(), 'Bundle missing required field "id".').when(~valid_stix_id(F.lit("bundle"), field("$.id", "string")), F.concat(F.lit('Bundle id "'), field("$.id", "string"), F.lit('" is not a valid bundle--<uuid4>.')))
    shape = F.when(F.coalesce(objs, F.lit("[]")) == "[]", "Bundle contains zero STIX objects.").when(~F.startswith(objs, F.lit("[")), '"objects" must be a list.')
    own = F.when(F.col("v").isNull(), F.array(F.lit("Bundle is not a JSON object."))).otherwise(
        F.filter(F.array(F.when(F.coalesce(field("$.type", "string"), F.lit("")) != "bundle", 'Bundle "type" must be "bundle".'), bad_id, shape), lambda m: m.isNotNull()))
    heads = b.select("bundle_id", own.alias("own"))
    listed = b.filter(F.startswith(objs, F.lit("["))).select("bundle_id", F.posexplode(F.from_json(objs, "array<string>")).alias("pos", "obj"))
    is_object = F.startswith(F.coalesce("obj", F.lit("")), F.lit("{"))
    get = lambda n, alias: F.get_json_object("obj", f"$.{n}").alias(alias)
    # every rule asks for the objects' fields: documents are parsed once, and the fields alone read again
    fields = stage_rows(listed.select("bundle_id", "pos", is_object.alias("is_object"), get("type", "type"), get("id", "id"), get("relationship_type", "rel_type"), get("source_ref", "src"), get("target_ref", "dst")))
    each = fields.filter("is_object")
    strange = fields.filter("NOT is_object").select("bundle_id", "pos", F.lit(0).alias("rule"), F.concat(F.lit("Object "), F.col("pos").cast("string"), F.lit(" is not a JSON object.")).alias("message"))
    found = validate(each.select("bundle_id", "pos", "type", "id"), each.filter("type = 'relationship'").select("bundle_id", "pos", "rel_type", "src", "dst")).unionByName(strange)
    order = F.struct((F.col("rule") > 5).alias("late"), "pos", F.when(F.col("rule") > 8, F.col("rule") + 2).otherwise(F.col("rule")).alias("rule"), "message")
    rolled = found.groupBy("bundle_id").agg(F.array_sort(F.collect_list(order)).alias("e"))
    errors = F.concat("own", F.coalesce(F.transform("e", lambda x: x["message"]), F.array().cast("array<string>")))
    return heads.join(rolled, "bundle_id", "left").select("bundle_id", errors.alias("errors"))


def fuse(objects: DataFrame, scalars: list[str], lists: list[str], order: list[str] | None = None) -> DataFrame:
    """One row a canonical key (``key``): id of the first object, first non-empty value of each scalar, items of the lists in order
    of appearance without repeats, number of objects and, if several merged, their distinct ids in order of appearance.

    Objects are in order of ``order`` (bundle_id, pos). Empty is null or an empty string; zero and false are values. For objects with open keys see :func:`fuse_documents`.
    """
    at = F.struct(*(order or ["bundle_id", "pos"]))
    # the smallest place of each item and id is found before anything is collected, so what is collected has no repeats
    aggs = [F.min(F.struct(at.alias("at"), "id"))["id"].alias("id"), F.count("*").alias("n_objects")]
    for c in scalars:
        empty = F.col(c).isNull() | (F.col(c).cast("string") == "")
        aggs.append(F.min_by(F.when(~empty, F.col(c)), F.when(~empty, at)).alias(c))
    out = objects.groupBy("key").agg(*aggs)
    items = [(c, objects.select("key", at.alias("at"), F.posexplode(c).alias("place", "v"))) for c in lists]
    items.append(("fused_from", objects.select("key", at.alias("at"), F.lit(0).alias("place"), F.col("id").alias("v")).filter("coalesce(v, '') <> ''")))
    for c, rows in items:
        first = rows.groupBy("key", "v").agg(F.min(F.struct("at", "place")).alias("first"))
        listed = first.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "v"))), lambda s: s["v"]).alias(c))
        out = out.join(listed, "key", "left").withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    return out.withColumn("fused_from", F.when(F.col("n_objects") > 1, F.col("fused_from")))


def fuse_documents(objects: DataFrame, order: list[str] | None = None) -> DataFrame:
    """key, id, n_objects, fused_from, obj, first_at: JSON objects of one ``key`` merged in depth, in order of ``order`` (bundle_id, pos).

    ``objects``: key, the order columns, obj (JSON text; null or no object: left out). Key by key: of values that aren't empty (null, "", [], {}) the first counts;
    if it is a list, items of later lists follow that are not there yet, told apart by their canonical JSON; if it is an object, the objects
    merge in the same way; values of another kind than the first are left out. If all are empty the last one stays. The id is
    that of the first object. ``fused_from`` has the distinct ids of objects that merged, in order; null for a single object. Keys of the result are sorted.

    One pass a level of nesting: each level's values are rows, so nothing but a merged list is ever collected.
    """
    at = F.struct(*(order or ["bundle_id", "pos"])).alias("at")
    base = objects.filter(valid_json(F.col("obj")) & F.startswith(strip(F.col("obj")), F.lit("{"))).select("key", at, "obj")
    spark = objects.sparkSession
    ids = base.select("key", "at", F.get_json_object("obj", "$.id").alias("id"))
    heads = ids.groupBy("key").agg(F.min(F.struct("at", "id"))["id"].alias("id"), F.count("*").alias("n_objects"), F.min("at").alias("first_at"))
    first = ids.filter("coalesce(id, '') <> ''").groupBy("key", "id").agg(F.min("at").alias("at"))
    heads = heads.join(first.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda s: s["id"]).alias("fused_from")), "key", "left")
    open_rows = base.select("key", F.array().cast("array<string>").alias("path"), "at", "obj")
    levels = []
    while True:
        values = spark.sql("SELECT o.key, concat(o.path, array(e.key)) AS path, o.at, to_json(e.value) AS json FROM {o} o, LATERAL variant_explode(parse_json(o.obj)) e", o=open_rows)
        kind = F.when(F.coalesce("json", F.lit("null")).isin("null", '""', "[]", "{}"), 0).when(F.startswith("json", F.lit("[")), 2).when(F.startswith("json", F.lit("{")), 3).otherwise(1)
        values = values.filter(~((F.size("path") == 1) & (F.get("path", F.lit(0)) == "id"))).withColumn("kind", kind)
        full = F.col("kind") > 0
        lead = values.groupBy("key", "path").agg(
            F.min(F.when(full, F.struct("at", "kind", "json"))).alias("first"), F.max(F.struct("at", "json"))["json"].alias("last"))
        lead = stage_rows(lead)
        ready = lead.filter("first.kind IS NULL OR first.kind = 1").select("key", "path", F.coalesce("first.json", "last", F.lit("null")).alias("json"))
        lists = values.filter("kind = 2").join(lead.filter("first.kind = 2").select("key", "path", F.col("first.at").alias("start")), ["key", "path"])
        items = lists.select("key", "path", "at", (F.col("at") == F.col("start")).alias("own"), F.posexplode(F.transform(F.variant_get(F.parse_json("json"), "$", "array<variant>"), lambda x: F.to_json(x))).alias("place", "v"))
        # repeats inside the first list stay, later ones go
        later = items.filter("NOT own").join(items.filter("own").select("key", "path", "v").distinct(), ["key", "path", "v"], "left_anti").groupBy("key", "path", "v").agg(F.min(F.struct("at", "place")).alias("first"))
        kept = items.filter("own").select("key", "path", "v", F.struct("at", "place").alias("first")).unionByName(later)
        ready = ready.unionByName(kept.groupBy("key", "path").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "v"))), lambda s: s["v"]), ","), F.lit("]")).alias("json")))
        deeper = values.filter("kind = 3").join(lead.filter("first.kind = 3").select("key", "path"), ["key", "path"]).select("key", "path", "at", F.col("json").alias("obj"))
        levels.append(ready)
        deeper = stage_rows(deeper)
        if deeper.isEmpty():
            break
        open_rows = deeper
    below = None
    for ready in reversed(levels):
        rows = ready if below is None else ready.unionByName(below)
        name = F.to_json(F.array(F.element_at("path", -1)))
        entry = F.concat(F.substring(name, F.lit(2), F.length(name) - 2), F.lit(":"), "json")
        up = F.slice("path", F.lit(1), F.size("path") - 1)
        body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.element_at("path", -1).alias("k"), entry.alias("e")))), lambda s: s["e"]), ",")
        below = rows.groupBy("key", up.alias("path")).agg(F.concat(F.lit("{"), body, F.lit("}")).alias("json"))
    out = heads.join(below.select("key", F.col("json").alias("obj")), "key", "left")
    return out.select("key", "id", "n_objects", F.when(F.col("n_objects") > 1, F.col("fused_from")).alias("fused_from"), F.coalesce("obj", F.lit("{}")).alias("obj"), "first_at")


def with_keys(objects: DataFrame, id_source: str) -> DataFrame:
    """Add ``key`` to exploded objects: what makes objects of several bundles the same. ``objects``: type, id, name, description, refs, obj."""
    ref = lambda source: external_id(F.col("refs"), source)
    own = lambda n: F.get_json_object("obj", f"$.{n}")
    cve = cve_key(ref("cve"), F.col("name"), F.col("description"))
    return objects.withColumn("key", object_key(F.col("type"), ref(id_source), cve, own("cpe"), own("vendor"), F.col("name"), own("version"), F.col("id"), F.col("obj")))


def fuse_bundles(objects: DataFrame, id_source: str, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(objects, relationships) of several bundles fused, both as by :func:`fuse_documents`; ``by`` names a column whose values are fused apart from each other.

    ``objects``: exploded objects of all bundles (bundle_id, pos, type, id, name, description, source_ref, target_ref, relationship_type, refs, obj).
    Objects come first, by their keys. Relationships then are documents too: their ends become the surviving ids and (source, type, target) their key, so that descriptions, references and
    all other values merge; those with an unknown end go. They also have src, rel_type and dst.
    """
    by_columns = [by] if by else []
    part = F.concat(F.coalesce(F.col(by).cast("string"), F.lit("")), F.lit("\n")) if by else F.lit("")
    things, rels = objects.filter("coalesce(type, '') <> 'relationship'"), objects.filter("type = 'relationship'")
    keyed = stage_rows(with_keys(things, id_source).withColumn("key", F.concat(part, "key")))
    fused = stage_rows(fuse_documents(keyed))
    ids = keyed.filter("coalesce(id, '') <> ''").select(*by_columns, F.col("id").alias("old_id"), "key").distinct().join(fused.select("key", F.col("id").alias("new_id")), "key").filter("new_id IS NOT NULL").drop("key")
    ends = surviving_ends(rels, ids, by_columns)
    linked = stage_rows(ends.withColumn("key", F.concat(part, F.to_json(F.array("src", "rel_type", "dst")))))
    names = linked.groupBy("key").agg(*[F.first(c).alias(c) for c in (*by_columns, "src", "rel_type", "dst")])
    edges = fuse_documents(linked).join(names, "key")
    if by:
        fused = fused.join(keyed.groupBy("key").agg(F.first(by).alias(by)), "key").withColumn("key", F.substring_index("key", "\n", -1))
    return fused, edges.withColumnRenamed("n_objects", "n")


def surviving_ends(rels: DataFrame, ids: DataFrame, by: list[str]) -> DataFrame:
    """Relationships with src, dst (surviving ids, also in ``obj``) and rel_type; those with an unknown end go. ``ids``: old_id, new_id and the columns ``by``.

    A missing type is ``related-to``, though the object stays as it is.
    """
    end = lambda old, new: ids.select(*by, F.col("old_id").alias(old), F.col("new_id").alias(new))
    kind = F.coalesce(F.nullif("relationship_type", F.lit("")), F.lit("related-to")).alias("rel_type")
    joined = rels.join(end("source_ref", "src"), [*by, "source_ref"]).join(end("target_ref", "dst"), [*by, "target_ref"])
    remapped = F.expr("""to_json(map_concat(map_filter(CAST(parse_json(obj) AS MAP<STRING, VARIANT>), (k, v) -> k NOT IN ('source_ref', 'target_ref')),
        map('source_ref', CAST(src AS VARIANT), 'target_ref', CAST(dst AS VARIANT))))""")
    return joined.select(*by, "bundle_id", "pos", "src", kind, "dst", remapped.alias("obj"))


def remap_edges(edges: DataFrame, id_map: DataFrame) -> DataFrame:
    """src, rel_type, dst, n: edges without further values between surviving ids, equal ones merged; edges with an unknown end go.

    ``id_map``: old_id, new_id over all bundles, so edges across bundles resolve; a missing type is ``related-to``.
    """
    a, b = id_map.select(F.col("old_id").alias("src"), F.col("new_id").alias("src_new")), id_map.select(F.col("old_id").alias("dst"), F.col("new_id").alias("dst_new"))
    kind = F.coalesce(F.nullif("rel_type", F.lit("")), F.lit("related-to"))
    return edges.withColumn("rel_type", kind).join(a, "src").join(b, "dst").groupBy(F.col("src_new").alias("src"), "rel_type", F.col("dst_new").alias("dst")).agg(F.count("*").alias("n"))


def fused_documents(fused: DataFrame, edges: DataFrame, sources: DataFrame, by: str) -> DataFrame:
    """One JSON bundle of each value of ``by``: id, object_count, source_bundle_count, document.

    Objects are in order of their first appearance, then relationships; ``x_fused_from`` lists the ids of those that merged. ``sources``: ``by``, bundle_id.
    A document is one row; what is too large for that is better written as the rows of :func:`fuse_bundles`.
    """
    text = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    inner = F.substring("obj", F.lit(2), F.length("obj") - 2)
    fields = F.array_compact(F.array(F.when(F.col("id").isNotNull(), F.concat(F.lit('"id":'), text("id"))), F.nullif(inner, F.lit("")), F.when(F.col("fused_from").isNotNull(), F.concat(F.lit('"x_fused_from":'), F.to_json("fused_from")))))
    item = lambda df, place: df.select(by, F.struct(F.lit(place).alias("place"), "first_at", F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}")).alias("item")).alias("o"))
    g = item(fused, 0).unionByName(item(edges, 1)).groupBy(by).agg(F.transform(F.array_sort(F.collect_list("o")), lambda o: o["item"]).alias("items"), F.count("*").alias("object_count"))
    g = g.join(sources.groupBy(by).agg(F.count_distinct("bundle_id").alias("source_bundle_count")), by)
    bid = stix_id("bundle", F.concat(F.lit("fused:"), F.coalesce(F.col(by).cast("string"), F.lit(""))))
    counts = F.concat(F.lit('{"source_bundle_count":'), F.col("source_bundle_count").cast("string"), F.lit(',"object_count":'), F.col("object_count").cast("string"), F.lit("}"))
    document = F.concat(F.lit('{"type":"bundle","id":"'), bid, F.lit('","objects":['), F.array_join("items", ","), F.lit('],"x_fusion":'), counts, F.lit("}"))
    return g.select(by, bid.alias("id"), "object_count", "source_bundle_count", document.alias("document"))


def bundle_documents(objects: DataFrame, model: str, provider: str) -> DataFrame:
    """bundle_id, id, n_objects, document: the JSON bundle of each report; its objects (pos, obj JSON) in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "obj"))), lambda s: s["obj"])
    g = objects.groupBy("bundle_id").agg(ordered.alias("objs"), F.count("*").alias("n_objects"))
    bid = stix_id("bundle", F.col("bundle_id").cast("string"))
    doc = F.concat(F.lit('{"type":"bundle","id":"'), bid, F.lit('","x_model":"' + model + '","x_provider":"' + provider + '","objects":['), F.array_join("objs", ","), F.lit("]}"))
    return g.select("bundle_id", bid.alias("id"), "n_objects", doc.alias("document"))


def bundle_technique_ids(objects: DataFrame, id_source: str) -> DataFrame:
    """bundle_id, ids: sorted distinct ids of attack patterns that start with T, of the source ``id_source`` in any case. ``objects``: bundle_id, type, refs."""
    refs = objects.filter("type = 'attack-pattern'").select("bundle_id", F.explode("refs").alias("r")).select("bundle_id", F.lower("r.source_name").alias("s"), F.trim("r.external_id").alias("id"))
    return refs.filter((F.col("s") == id_source.lower()) & F.startswith("id", F.lit("T"))).groupBy("bundle_id").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def bundle_names(objects: DataFrame, stems: DataFrame) -> DataFrame:
    """bundle_id, title: name of the first actor or intrusion set (``objects``: bundle_id, pos, type, name), else the stem (``stems``: bundle_id, stem)."""
    actors = objects.filter("type IN ('threat-actor', 'intrusion-set') AND coalesce(name, '') <> ''")
    first = actors.groupBy("bundle_id").agg(F.min_by("name", "pos").alias("actor"))
    return stems.join(first, "bundle_id", "left").select("bundle_id", F.coalesce("actor", "stem").alias("title"))


def enrich_actors(actors: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Actor objects enriched from intrusion sets, else from actors, of the taxonomy by lower-case name.

    ``actors``: key, name, aliases, refs (null where the report says nothing) and ``extra``, a map of further keys, which become ``x_<key>``;
    without a name they are left out. ``taxonomy``: kind, name_key, object_id, aliases, own_aliases, refs. What the report says stays; aliases are the taxonomy's,
    else its own list without the actor's name. ``enriched_from`` is the object that was found. Of several objects of a name the smallest id counts.
    """
    rank = F.when(F.col("kind") == "intrusion-set", 0).otherwise(1)
    known = taxonomy.filter("kind IN ('intrusion-set', 'threat-actor')").groupBy("name_key").agg(
        F.min_by(F.struct(F.col("object_id").alias("id"), F.col("aliases").alias("aliases"), F.col("own_aliases").alias("own"), F.col("refs").alias("refs")), F.struct(rank, "object_id")).alias("t"))
    a = actors.filter("coalesce(name, '') <> ''").withColumn("name_key", F.lower(F.trim("name"))).join(known, "name_key", "left")
    rest = F.filter("t.own", lambda x: F.lower(F.trim(x)) != F.col("name_key"))
    aliases = F.coalesce("aliases", "t.aliases", F.when(F.size(rest) > 0, rest))
    extra = F.transform_keys(F.coalesce("extra", F.create_map().cast("map<string,string>")), lambda k, v: F.concat(F.lit("x_"), k))
    return a.select("key", "name", aliases.alias("aliases"), F.col("t.own").alias("own_aliases"), F.coalesce(a["refs"], F.col("t.refs")).alias("refs"), F.col("t.id").alias("enriched_from"), extra.alias("extra"))


#: Object types that say how somebody behaves, and what a context calls them.
INTEL_KINDS = {"attack-pattern": "technique", "threat-actor": "actor"}


def intel_objects(objects: DataFrame, id_source: str) -> DataFrame:
    """bundle_id, pos, kind, technique_id, name, description, evidence of the behavioural objects that have a name or a description.

    ``objects``: bundle_id, pos, type, name, description, evidence, refs. The source of ids is compared as written.
    """
    kind = F.get(F.map_values(F.map_filter(F.create_map(*[F.lit(x) for kv in INTEL_KINDS.items() for x in kv]), lambda k, v: k == F.col("type"))), F.lit(0))
    text = lambda c: strip(F.coalesce(c, F.lit(""))).alias(c)
    tid = F.get(F.filter("refs", lambda r: (r["source_name"] == id_source) & (F.coalesce(r["external_id"], F.lit("")) != "")), F.lit(0))["external_id"]
    o = objects.filter(F.col("type").isin(*INTEL_KINDS)).select("bundle_id", "pos", kind.alias("kind"), strip(F.coalesce(tid, F.lit(""))).alias("technique_id"), text("name"), text("description"), text("evidence"))
    return o.filter("name <> '' OR description <> ''")


def intel_block(kind: Column, technique_id: Column, name: Column, description: Column, evidence: Column) -> Column:
    """An object as a block of text: heading, what the report says, description."""
    heading = F.array_join(F.filter(F.array(technique_id, name), lambda x: x != ""), " ")
    said = F.when(evidence != "", F.concat(F.lit("Observed in report: "), evidence))
    return F.concat_ws("\n", F.concat(F.lit("### "), F.when(heading != "", heading).otherwise(kind)), said, F.nullif(description, F.lit("")))


def object_report(objects: DataFrame, stamp: Column) -> DataFrame:
    """bundle_id, report: a bundle's malware, tools, actors, infrastructure, techniques and relationships as sections of text; ``(none)`` for an empty one.

    ``objects``: bundle_id, pos, type, id, name, source_ref, target_ref, relationship_type.
    """
    sections = {"malware": "Malware", "tool": "Tools", "threat-actor": "Threat Actors", "infrastructure": "Infrastructure", "attack-pattern": "Attack Patterns (TTPs)", "relationship": "Relationships"}
    none = lambda c: F.coalesce(c, F.lit("None"))
    line = F.when(F.col("type") == "relationship", F.concat(none("source_ref"), F.lit(" --["), none("relationship_type"), F.lit("]→ "), none("target_ref"))).otherwise(F.concat(none("name"), F.lit("  ("), none("id"), F.lit(")")))
    rows = objects.select("bundle_id", "pos", "type", line.alias("line"))
    lines = lambda t: F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == t, F.struct("pos", "line")))), lambda s: F.concat(F.lit("  - "), s["line"]))
    g = rows.groupBy("bundle_id").agg(F.count("*").alias("n"), *[lines(t).alias(t) for t in sections])
    body = [F.concat(F.lit(f"{title}:\n"), F.when(F.size(f"`{t}`") > 0, F.array_join(f"`{t}`", "\n")).otherwise("  (none)"), F.lit("\n")) for t, title in sections.items()]
    bar = F.lit("=" * 72)
    head = [bar, F.lit("CONVERSION REPORT"), bar, F.concat(F.lit("Generated: "), stamp), F.concat(F.lit("Bundle: "), F.col("bundle_id").cast("string")), F.concat(F.lit("Objects: "), F.col("n").cast("string")), F.lit("")]
    return g.select("bundle_id", F.concat_ws("\n", *head, *body, bar, F.lit("END OF REPORT"), bar).alias("report"))


def bundle_metrics(objects: DataFrame) -> DataFrame:
    """bundle_id, objects by type and in total. ``objects``: bundle_id, type."""
    n = lambda t: F.count_if(F.col("type") == t)
    return objects.groupBy("bundle_id").agg(F.count("*").alias("n_objects"), n("attack-pattern").alias("n_techniques"), n("threat-actor").alias("n_actors"), n("relationship").alias("n_relationships"), n("observed-data").alias("n_observed"))
