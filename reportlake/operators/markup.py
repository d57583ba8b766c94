"""Plain text of HTML with nested lists and tables: tags as rows, nesting as running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.storage import stage_rows

#: Parts of a page that are not its content.
FURNITURE = ("nav", "footer", "header", "aside")
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
LISTS, CELLS = ("ul", "ol"), ("td", "th")


def tag_events(pages: DataFrame) -> DataFrame:
    """key, i, tag, kind (1 opens, -1 closes, 0 text), text: pieces of the content of each page (key, html) in order.

    Scripts, styles, comments and page furniture are gone, tags that close themselves have no part in nesting.
    """
    raw = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", ""), r"(?s)<!--.*?-->", "")
    pieces = pages.select("key", F.posexplode(F.regexp_extract_all(raw, F.lit(r"(?s)</?[A-Za-z!?][^>]*>|[^<]+|<"), F.lit(0))).alias("i", "piece"))
    tag = F.lower(F.regexp_extract("piece", r"^</?\s*([A-Za-z][A-Za-z0-9]*)[^>]*>$", 1))
    kind = F.when((tag == "") | F.endswith("piece", F.lit("/>")), 0).when(F.startswith("piece", F.lit("</")), -1).otherwise(1)
    is_tag = F.startswith("piece", F.lit("<")) & F.endswith("piece", F.lit(">"))
    e = pieces.select("key", "i", tag.alias("tag"), kind.alias("kind"), F.when(is_tag, "").otherwise(F.col("piece")).alias("text"))
    outside = F.sum(F.when(F.col("tag").isin(*FURNITURE), F.col("kind")).otherwise(0)).over(Window.partitionBy("key").orderBy("i"))
    return e.withColumn("_f", outside).filter((F.col("_f") <= 0) & ~F.col("tag").isin(*FURNITURE)).drop("_f")


def elements(events: DataFrame) -> DataFrame:
    """key, kind (p, li, tr, td, table), level, i, end: elements with the place of their end; level is the depth of lists or tables around them.

    An element ends where its end tag stands at its level, where its list or table ends, or where the next one of its kind begins there, as HTML allows; a table needs its end tag, and a paragraph
    ends at any other one.
    """
    order = Window.partitionBy("key").orderBy("i")
    depth = lambda *tags: F.sum(F.when(F.col("tag").isin(*tags), F.col("kind")).otherwise(0)).over(order)
    e = events.filter("kind <> 0").withColumn("lists", depth(*LISTS)).withColumn("tables", depth("table"))
    tag, opens, closes = F.col("tag"), F.col("kind") == 1, F.col("kind") == -1
    # a container's end belongs to the level that it closes
    level = lambda c, *tags: F.col(c) + F.when(closes & tag.isin(*tags), 1).otherwise(0)
    part = lambda name, of, at, own: F.when(of, F.struct(F.lit(name).alias("kind"), at.cast("long").alias("level"), own.alias("opens")))
    no = F.lit(False)
    parts = F.array_compact(F.array(
        part("p", tag == "p", F.lit(0), opens),
        part("li", (tag == "li") | (tag.isin(*LISTS) & closes), level("lists", *LISTS), F.when(tag == "li", opens).otherwise(no)),
        part("tr", (tag == "tr") | ((tag == "table") & closes), level("tables", "table"), F.when(tag == "tr", opens).otherwise(no)),
        part("td", tag.isin("tr", *CELLS) | ((tag == "table") & closes), level("tables", "table"), F.when(tag.isin(*CELLS), opens).otherwise(no)),
        part("table", tag == "table", level("tables", "table"), opens)))
    each = e.select("key", "i", F.inline(parts))
    end = F.lead("i").over(Window.partitionBy("key", "kind", "level").orderBy("i"))
    return each.withColumn("end", end).filter("opens AND end IS NOT NULL").drop("opens")


def _around(inner: DataFrame, outer: DataFrame, name: str) -> DataFrame:
    """``inner`` elements once for each of the ``outer`` ones (their ``i`` as ``name``) that they stand in."""
    levels = inner.filter("level > 0").select("key", F.explode(F.sequence(F.lit(1).cast("long"), F.col("level"))).alias("at"), "i", F.struct(*inner.columns).alias("element"))
    both = levels.unionByName(outer.select("key", F.col("level").alias("at"), "i", F.lit(None).cast(levels.schema["element"].dataType).alias("element")))
    holder = F.last(F.when(F.col("element").isNull(), F.col("i")), True).over(Window.partitionBy("key", "at").orderBy("i", F.col("element").isNotNull()))
    return both.withColumn(name, holder).filter(F.col("element").isNotNull() & F.col(name).isNotNull()).select("element.*", name)


def _decoded(text: Column) -> Column:
    for entity, character in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def html_texts(pages: DataFrame, column: str = "html", to: str = "text") -> DataFrame:
    """``pages`` with the column ``to``: paragraphs, then list items as ``• …``, then each table as ``[Table]`` and its rows as ``a | b``, one to a line.

    Nested items and tables stand in the text of those around them and for themselves, too. Null gives an empty text. Equal pages are worked on once, by their hash.
    """
    key = F.sha2(F.coalesce(column, F.lit("")), 256)
    distinct = pages.select(key.alias("key"), F.coalesce(column, F.lit("")).alias("html")).dropDuplicates(["key"])
    events = stage_rows(tag_events(distinct))
    size = F.sum(F.length("text")).over(Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    places = events.select("key", "i", F.coalesce(size, F.lit(0)).alias("at"))
    plain = events.filter("kind = 0").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda s: s["text"]), "").alias("plain"))
    e = elements(events).join(places.withColumnRenamed("at", "from"), ["key", "i"])
    e = e.join(places.select("key", F.col("i").alias("end"), F.col("at").alias("upto")), ["key", "end"]).join(plain, "key")
    text = tx.strip(F.regexp_replace(_decoded(F.expr("substring(plain, `from` + 1, upto - `from`)")), r"\s+", " "))
    e = stage_rows(e.select("key", "kind", "level", "i", text.alias("text")))
    of = lambda kind: e.filter(F.col("kind") == kind).drop("kind")
    cells = _around(of("td"), of("tr"), "row").groupBy("key", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda s: s["text"]), " | ").alias("text"))
    rows = _around(of("tr").drop("text").join(cells.withColumnRenamed("row", "i"), ["key", "i"]), of("table"), "tab")
    line = lambda df, section, tab, i, said: df.select("key", F.struct(F.lit(section).alias("section"), tab.alias("tab"), i.alias("i"), said.alias("line")).alias("l"))
    none = F.lit(-1)
    lines = line(of("p"), 0, none, F.col("i"), F.col("text")).unionByName(line(of("li"), 1, none, F.col("i"), F.when(F.col("text") != "", F.concat(F.lit("• "), "text"))))
    lines = lines.unionByName(line(of("table"), 2, F.col("i"), none, F.lit("[Table]"))).unionByName(line(rows, 2, F.col("tab"), F.col("i"), F.col("text")))
    done = lines.filter("coalesce(l.line, '') <> ''").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda s: s["line"]), "\n").alias(to))
    return pages.withColumn("_key", key).drop(to).join(done.withColumnRenamed("key", "_key"), "_key", "left").withColumn(to, F.coalesce(to, F.lit(""))).drop("_key")
