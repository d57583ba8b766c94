"""Extraction of observables, names and tables from report text; one row a match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.storage import stage_rows


def hash_evidence(docs: DataFrame) -> DataFrame:
    """doc_id, kind, value, evidence: distinct hashes of a document (lower case) with the first line that has them."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", r"\R")).alias("line_no", "line"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), tx.matches(F.col("line"), p).alias("found")) for k, p in tx.HASHES.items()])
    each = lines.select("doc_id", "line_no", "line", F.inline(kinds)).select("doc_id", "line_no", "kind", F.explode("found").alias("value"), tx.strip(F.col("line")).alias("evidence")).withColumn("value", F.lower("value"))
    return each.groupBy("doc_id", "kind", "value").agg(F.min_by("evidence", "line_no").alias("evidence"))


def observables(docs: DataFrame) -> DataFrame:
    """Distinct hashes and IPv4-shaped tokens of each document; duplicates go inside the row, so nothing is shuffled."""
    kinds = {**tx.HASHES, "IPV4": tx.IPV4}
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.array_distinct(F.transform(tx.matches(F.col("text"), p), lambda v: F.lower(v))).alias("found")) for k, p in kinds.items()])
    keep = [c for c in docs.columns if c != "text"]
    return docs.select(*keep, F.inline(each)).select(*keep, "kind", F.explode("found").alias("value"))


def named_pairs(docs: DataFrame, pattern: str, left: str, right: str) -> DataFrame:
    """doc_id, pos and the two groups of each match of a two-group pattern."""
    t = F.col("text")
    both = F.arrays_zip(tx.matches(t, pattern, 1).alias(left), tx.matches(t, pattern, 2).alias(right))
    return docs.select("doc_id", F.posexplode(both).alias("pos", "m")).select("doc_id", "pos", f"m.{left}", f"m.{right}")


def name_versions(docs: DataFrame) -> DataFrame:
    """Software names with versions; per document and name (any case) the first spelling and first version."""
    found = named_pairs(docs, tx.NAME_VERSION, "name", "version")
    return found.groupBy("doc_id", F.lower("name").alias("key")).agg(F.min_by("name", "pos").alias("name"), F.min_by("version", "pos").alias("version"))


def software_tokens(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, name, how: file names with a program extension (``file``), and capitalised words after a trigger (``trigger``).

    A triggered word with an extension counts as a file; others must not be on the stop list, and be in ``known`` (name_key) or look
    like a product's name: a capital inside, or capitals only.
    """
    t = F.col("text")
    files = docs.select("doc_id", F.explode(tx.matches(t, tx.FILENAME)).alias("name"), F.lit("file").alias("how"))
    triggered = docs.select("doc_id", F.explode(tx.matches(t, tx.TOOL_TRIGGER, 1)).alias("name")).distinct()
    dotted = triggered.filter(F.contains("name", F.lit("."))).select("doc_id", "name", F.lit("file").alias("how"))
    plain = triggered.filter(~F.contains("name", F.lit(".")) & ~F.lower("name").isin(*tx.NO_TOOLS))
    product = F.col("name").rlike("^[A-Z].*[A-Z]") | ((F.upper("name") == F.col("name")) & F.col("name").rlike("[A-Za-z]"))
    if known is not None:
        plain = plain.join(known.select(F.col("name_key").alias("_k"), F.lit(True).alias("_known")).distinct(), F.lower("name") == F.col("_k"), "left")
        product = product | F.col("_known").isNotNull()
    plain = plain.filter(product).select("doc_id", "name", F.lit("trigger").alias("how"))
    return files.unionByName(dotted).unionByName(plain).distinct()


def software_rows(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, name, version, how: file names, names with versions and triggered names merged, any case; the first source's spelling and the first version count."""
    rank = F.when(F.col("how") == "file", 0).when(F.col("how") == "version", 1).otherwise(2)
    tokens = software_tokens(docs, known).select("doc_id", "name", F.lit(None).cast("string").alias("version"), "how")
    versions = name_versions(docs).select("doc_id", "name", "version", F.lit("version").alias("how"))
    rows = tokens.unionByName(versions).withColumn("name", F.btrim(tx.strip(F.col("name")), F.lit("`*."))).filter("length(name) BETWEEN 3 AND 40").withColumn("rank", rank)
    g = rows.groupBy("doc_id", F.lower("name").alias("key")).agg(F.min(F.struct("rank", "name", "how")).alias("f"), F.max("version").alias("version"))
    return g.select("doc_id", "f.name", "version", "f.how")


def split_software(found: DataFrame, known: DataFrame) -> DataFrame:
    """Add ``kind``: malware or tool as ``known`` (kind, name_key) has the name or its stem, malware first; others are tools."""
    malware, tool = known.filter("kind = 'malware'").select("name_key"), known.filter("kind = 'tool'").select("name_key")
    keyed = found.withColumn("full", F.lower("name")).withColumn("stem", F.lower(F.regexp_replace("name", r"\.[A-Za-z0-9]+$", "")))
    for label, names in (("in_malware", malware), ("in_tool", tool)):
        one = names.distinct().withColumn(label, F.lit(True))
        keyed = keyed.join(one.select(F.col("name_key").alias("full"), F.col(label).alias("_a")), "full", "left").join(one.select(F.col("name_key").alias("stem"), F.col(label).alias("_b")), "stem", "left")
        keyed = keyed.withColumn(label, F.coalesce("_a", "_b", F.lit(False))).drop("_a", "_b")
    return keyed.withColumn("kind", F.when(F.col("in_malware"), "malware").otherwise("tool")).drop("full", "stem", "in_malware", "in_tool")


#: A separator row of a table: dashes, colons, pipes and blanks only.
SEPARATOR_ROW = r"^\s*\|?\s*[:\-\s|]+\s*\|?\s*$"


def pipe_tables(docs: DataFrame) -> DataFrame:
    """doc_id, table_no, row_no, cells of Markdown pipe tables: a header with two pipes or more, a separator row, then rows of two pipes or more.

    A quote prefix is removed; further separator rows are skipped; a table ends at the first line of fewer than two pipes. Row 0 is the header.

    Lines with two pipes make runs. Inside a run the first line before a separator is the header of what follows in the run.
    A separator of fewer pipes ends its run: its header is the run's last line and its table the next run, unless that line is a row itself.
    Texts without a pipe are left where they are. Rows that share a doc_id are texts of their own, equal ones count once.
    """
    key = ["doc_id", "_text"]
    docs = docs.filter(F.contains("text", F.lit("|"))).select("doc_id", "text", F.xxhash64("text").alias("_text")).dropDuplicates(key)
    line = F.regexp_replace("raw", r"^\s*>\s?", "")
    lines = docs.select(*key, F.posexplode(F.split("text", r"\R")).alias("line_no", "raw")).select(*key, "line_no", line.alias("line"))
    w = Window.partitionBy(*key).orderBy("line_no")
    wide = F.length("line") - F.length(F.replace("line", F.lit("|"), F.lit(""))) >= 2
    marked = lines.withColumn("wide", wide).withColumn("sep", F.col("line").rlike(SEPARATOR_ROW))
    marked = marked.withColumn("run", F.sum((~F.col("wide")).cast("int")).over(w)).withColumn("head", F.coalesce(F.lead("sep").over(w), F.lit(False))).withColumn("next_wide", F.coalesce(F.lead("wide").over(w), F.lit(False))).filter("wide")
    runs = marked.groupBy(*key, "run").agg(F.min(F.when(F.col("head") & F.col("next_wide"), F.col("line_no"))).alias("first"), F.max(F.when(F.col("head") & ~F.col("next_wide"), F.col("line_no"))).alias("last"))
    # runs that follow each other and whose last lines would be headers: every other one is a row of the one before
    ends = runs.filter("first IS NULL AND last IS NOT NULL").withColumn("chain", F.col("run") - F.row_number().over(Window.partitionBy(*key).orderBy("run")))
    ends = ends.withColumn("k", F.row_number().over(Window.partitionBy(*key, "chain").orderBy("run"))).filter("k % 2 = 1").select(*key, "run", "last")
    before = ends.select(*key, (F.col("run") + 1).alias("run"), F.col("last").alias("above"))
    heads = runs.select(*key, "run", "first").join(before, [*key, "run"], "left").join(ends, [*key, "run"], "left")
    j = marked.join(heads, [*key, "run"])
    table = F.when(F.col("above").isNotNull(), F.col("above")).when(F.col("line_no") >= F.col("first"), F.col("first")).when(F.col("line_no") == F.col("last"), F.col("last"))
    inside = j.withColumn("table", table).filter("table IS NOT NULL AND (line_no = table OR NOT sep)")
    cells = F.transform(F.split("line", r"\|"), lambda c: tx.strip(c))
    cells = F.when(F.get(cells, F.lit(0)) == "", F.slice(cells, 2, F.size(cells))).otherwise(cells)
    cells = F.when(F.element_at(cells, -1) == "", F.slice(cells, 1, F.size(cells) - 1)).otherwise(cells)
    n = F.row_number().over(Window.partitionBy(*key, "table").orderBy("line_no")) - 1
    number = F.dense_rank().over(Window.partitionBy(*key).orderBy("table"))
    return inside.select("doc_id", number.alias("table_no"), n.alias("row_no"), cells.alias("cells"))


def plain_cell(x: Column) -> Column:
    """A cell without blanks, asterisks and backticks at its ends."""
    return F.btrim(tx.strip(x), F.lit("*` "))


def map_headers(tables: DataFrame, aliases: DataFrame) -> DataFrame:
    """doc_id, table_no, field, column_no: canonical field of each header cell by ``aliases`` (alias_lc, field); the first column wins. Emphasis and backticks round a header don't count."""
    heads = tables.filter("row_no = 0").select("doc_id", "table_no", F.posexplode("cells").alias("column_no", "cell"))
    hit = heads.join(aliases, F.lower(plain_cell(F.col("cell"))) == F.col("alias_lc"))
    return hit.groupBy("doc_id", "table_no", "field").agg(F.min("column_no").alias("column_no"))


def table_fields(tables: DataFrame, aliases: DataFrame) -> DataFrame:
    """doc_id, table_no, row_no, field, value of the cells below known headers; ``cells`` of the row beside."""
    columns = map_headers(tables, aliases)
    rows = tables.filter("row_no > 0").join(columns, ["doc_id", "table_no"])
    return rows.select("doc_id", "table_no", "row_no", "field", F.get("cells", F.col("column_no")).alias("raw"), "cells").filter("raw IS NOT NULL").withColumn("value", plain_cell(F.col("raw")))


def accounts(docs: DataFrame, aliases: DataFrame) -> DataFrame:
    """doc_id, username, domain, has_password: accounts of tables with a username column, then those that prose names in backticks.

    Of one account, any case, the first spelling counts and the first domain that isn't empty. A password is only noted, never kept. ``domain\\name`` cells are split.
    """
    fields = table_fields(pipe_tables(docs), aliases)
    of = ["doc_id", "table_no", "row_no"]
    row = fields.filter("field IN ('username', 'password')").groupBy(*of).agg(
        F.max(F.when(F.col("field") == "username", F.col("value"))).alias("u"), F.max((F.col("field") == "password") & (F.col("value") != "")).alias("p"))
    both = F.regexp_extract("u", r"^([A-Za-z][\w.-]+)\\([A-Za-z][\w.-]+)", 1)
    domain = F.when(both != "", both).when(F.startswith("u", F.lit(".\\")), ".").otherwise("")
    name = F.when(both != "", F.regexp_extract("u", r"^([A-Za-z][\w.-]+)\\([A-Za-z][\w.-]+)", 2)).when(F.startswith("u", F.lit(".\\")), F.substring("u", 3, 1000)).otherwise(F.col("u"))
    listed = row.filter("u IS NOT NULL").select("doc_id", F.trim(name).alias("username"), domain.alias("domain"), F.coalesce("p", F.lit(False)).alias("has_password"), F.struct(F.lit(0).alias("k"), F.col("table_no").alias("a"), F.col("row_no").alias("b")).alias("at"))
    listed = listed.filter((F.length("username") >= 2) & ~F.lower("username").isin(*tx.NO_ACCOUNTS))
    prose = docs.select("doc_id", F.posexplode(tx.matches(F.col("text"), tx.ACCOUNT, 1)).alias("i", "raw")).withColumn("username", plain_cell(F.col("raw")))
    low = F.lower("username")
    shouted = (F.col("username") == F.upper("username")) & F.col("username").rlike("[A-Za-z]") & (F.length("username") > 4)
    prose = prose.filter((F.length("username") >= 3) & ~low.rlike("(mon|host|server)$") & ~shouted & ~low.isin(*tx.NO_PROSE_ACCOUNTS))
    prose = prose.select("doc_id", "username", F.lit("").alias("domain"), F.lit(False).alias("has_password"), F.struct(F.lit(1).alias("k"), F.col("i").alias("a"), F.lit(0).alias("b")).alias("at"))
    # domain and password of a table's account come from its table rows alone, and prose rows have none
    g = listed.unionByName(prose).groupBy("doc_id", F.lower("username").alias("key")).agg(
        F.min_by("username", "at").alias("username"), F.min_by(F.nullif("domain", F.lit("")), F.when(F.col("domain") != "", F.col("at"))).alias("domain"), F.max("has_password").alias("has_password"))
    return g.select("doc_id", "username", F.coalesce("domain", F.lit("")).alias("domain"), "has_password")


def domains(docs: DataFrame, facts: list[str]) -> DataFrame:
    """doc_id, name: distinct domains, any case with the first spelling: prefixes of accounts, then values of the inline facts ``**<fact>:** value``."""
    prefix = named_pairs(docs, tx.DOMAIN_USER, "name", "account").filter("NOT startswith(name, 'HK') AND length(name) > 2 AND name <> 'TEMP'").select("doc_id", F.lit(0).alias("k"), "pos", "name")
    found = prefix
    for i, fact in enumerate(facts):
        pattern = rf"(?i)\*?\*?\Q{fact}\E\*?\*?\s*:\s*[`*]*([A-Za-z][A-Za-z0-9 .\-]{{2,40}})"
        each = docs.select("doc_id", F.lit(i + 1).alias("k"), F.posexplode(tx.matches(F.col("text"), pattern, 1)).alias("pos", "raw"))
        found = found.unionByName(each.select("doc_id", "k", "pos", F.regexp_extract(plain_cell(F.col("raw")), r"^(\S+)", 1).alias("name")).filter("name <> ''"))
    return found.groupBy("doc_id", F.lower("name").alias("key")).agg(F.min_by("name", F.struct("k", "pos")).alias("name")).select("doc_id", "name")


def hosts(docs: DataFrame) -> DataFrame:
    """Distinct host names, lower case: those with an address in brackets, then those of bulleted or quoted lists, without address.

    Plain numbers and protocol names aren't hosts. A list's name needs a digit or a usual ending, and a word for a host within 200 characters.
    """
    found = named_pairs(docs, tx.HOST_IP, "host", "ip").withColumn("host", F.lower("host"))
    paired = found.filter(~F.replace("host", F.lit("."), F.lit("")).rlike(r"^\d+$") & ~F.col("host").isin(*tx.NO_HOSTS)).select("doc_id", "host", "ip", F.struct(F.lit(0).alias("k"), "pos").alias("at"))
    t = F.col("text")
    # matches and the text between them alternate, so running lengths give their places
    gaps, hits = F.split(t, tx.LISTED_HOST), tx.matches(t, tx.LISTED_HOST)
    each = docs.select("doc_id", "text", F.posexplode(F.arrays_zip(gaps.alias("g"), hits.alias("m"), tx.matches(t, tx.LISTED_HOST, 1).alias("host"))).alias("pos", "x")).select("doc_id", "text", "pos", "x.*").filter("m IS NOT NULL")
    w = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("g") + F.length("m")).over(w), F.lit(0)) + F.length("g")
    each = each.withColumn("start", start).withColumn("host", F.lower("host"))
    lo = F.greatest(F.lit(1), F.col("start") + 1 - 200).cast("int")
    around = F.substring("text", lo, (F.col("start") + 1 + F.length("m") + 200 - lo).cast("int"))
    shaped = F.col("host").rlike(r"\d") | F.col("host").rlike("(" + "|".join(tx.HOST_ENDINGS) + ")$")
    listed = each.filter(shaped & ~F.col("host").isin(*tx.NO_LISTED_HOSTS) & around.rlike(tx.HOST_WORD)).select("doc_id", "host", F.lit("").alias("ip"), F.struct(F.lit(1).alias("k"), "pos").alias("at"))
    return paired.unionByName(listed).groupBy("doc_id", "host").agg(F.min_by("ip", "at").alias("ip"))


def merge_hosts(table_hosts: DataFrame, inline_hosts: DataFrame) -> DataFrame:
    """Full merge on doc_id and host; the table's address counts unless blank."""
    a, b = table_hosts.withColumnRenamed("ip", "t_ip"), inline_hosts.withColumnRenamed("ip", "i_ip")
    return a.join(b, ["doc_id", "host"], "full_outer").select("doc_id", "host", F.coalesce(F.nullif("t_ip", F.lit("")), "i_ip").alias("ip"))


def explicit_techniques(docs: DataFrame, techniques: DataFrame) -> DataFrame:
    """doc_id, pos, technique_id: ids written in the text, in any case, that the taxonomy has; repeats stay."""
    found = docs.select("doc_id", F.posexplode(tx.matches(F.upper("text"), tx.TECHNIQUE_ID)).alias("pos", "technique_id"))
    return found.join(techniques.select("technique_id").distinct(), "technique_id", "left_semi")


def name_prefixes(names: DataFrame) -> DataFrame:
    """prefix: the nodes of the token trie of ``name_key``, each as its words from the root with single blanks."""
    words = F.split("name_key", " ")
    return names.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(words, F.lit(1), k), " "))).alias("prefix")).distinct()


def gazetteer(docs: DataFrame, names: DataFrame) -> DataFrame:
    """doc_id, entity_id, name_key, n: whole-word occurrences of entity names and aliases (name_key, entity_id) of three letters or more and any number of words.

    From each place of a text whose word starts a name, the trie of the names is walked word by word as long as it has a node, by a filter of fixed size
    over its nodes; the nodes on the way meet the names in a hash join. So cost grows with the text and its hits, not with the number or length of names.
    """
    known = stage_rows(names.filter(F.length("name_key") >= 3).select("name_key", "entity_id").distinct())
    mask = _word_mask(name_prefixes(known))
    most = F.coalesce(known.agg(F.max(F.size(F.split("name_key", " ")))).scalar(), F.lit(1))
    toks = docs.select("doc_id", tx.tokens(F.col("text")).alias("w"), most.alias("most"))
    starts = F.filter(F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1)), lambda i: _in_mask(mask, F.get("w", i)))
    root = F.struct(F.lit("").alias("node"), F.lit(True).alias("on"), F.array().cast("array<string>").alias("met"))

    def step(s, word):
        node = F.when(s["node"] == "", word).otherwise(F.concat(s["node"], F.lit(" "), word))
        on = s["on"] & _in_mask(mask, node)
        return F.struct(F.when(on, node).otherwise("").alias("node"), on.alias("on"), F.when(on, F.array_append(s["met"], node)).otherwise(s["met"]).alias("met"))

    walk = lambda i: F.aggregate(F.slice("w", i + 1, F.col("most")), root, step, lambda s: s["met"])
    # the outer form, as the inner one would walk twice to drop texts without hits
    each = toks.select("doc_id", F.explode_outer(F.flatten(F.transform(starts, walk))).alias("name_key"))
    return each.join(known, "name_key").groupBy("doc_id", "entity_id", "name_key").agg(F.count("*").alias("n"))


#: Bits of the filter of trie nodes.
MASK_BITS = 1 << 16


def _word_mask(words: DataFrame) -> Column:
    """A filter of 64-bit numbers for one column of words; at most MASK_BITS / 64 rows reach the driver."""
    place = F.pmod(F.xxhash64(words.columns[0]), F.lit(MASK_BITS))
    bits = words.select(F.floor(place / 64).cast("int").alias("slot"), F.pmod(place, F.lit(64)).cast("int").alias("bit")).distinct()
    held = [0] * (MASK_BITS // 64)
    for r in bits.groupBy("slot").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).collect():
        held[r.slot] = r.bits
    return F.array(*[F.lit(x).cast("long") for x in held])


def _in_mask(mask: Column, word: Column) -> Column:
    place = F.pmod(F.xxhash64(word), F.lit(MASK_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    return F.get(mask, F.floor(place / 64).cast("int")).bitwiseAND(bit) != 0


def salience(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """Add salience to ``hits`` (doc_id, entity_id, name_key, n): count, 3 more in the first line, 1 more in the first paragraph."""
    t = F.col("text")
    first = F.lower(F.regexp_extract(t, r"^([^\n]*)", 1))
    para = F.lower(F.when(F.instr(t, "\n\n") > 0, F.substring_index(t, "\n\n", 1)).otherwise(F.substring(t, 1, 500)))
    heads = docs.select("doc_id", tx.spaced(first).alias("first"), tx.spaced(para).alias("para"))
    has = lambda c: F.contains(F.concat(F.lit(" "), c, F.lit(" ")), F.concat(F.lit(" "), F.col("name_key"), F.lit(" "))).cast("int")
    return hits.join(heads, "doc_id").withColumn("salience", F.col("n") + 3 * has(F.col("first")) + has(F.col("para"))).drop("first", "para")


def top_per(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The k first rows of each key; Spark limits groups before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")
