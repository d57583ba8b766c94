"""SpotSigs document fingerprints, DataFrame operations only.

A signature is a common word (the anchor) with the next two content words after it, common words
between them skipped. A document's fingerprint is its sorted set of signature hashes; likeness is the
Jaccard coefficient of two sets, and near pairs are searched among sets of compatible length only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, stage

#: Fixed list: common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be by for from in is it of on or than that the this to was with "
    "auf das dem den der des die ein eine ist mit nicht sich und von zu "
    "au aux avec dans de du en est et la le les par pas pour qui que un une "
    "con del el las los no por se su y"
).split()
#: Rows of one block in :func:`next_documents`, about, blocks of one group, and parts of the ids that have blocks of their own width.
BLOCK = 256
GROUP = 4096
PARTS = 64
#: Bits of the filter that holds back rows before the join of :func:`next_documents`; its size is fixed.
FILTER_BITS = 1 << 18


def words_of(text: Column) -> Column:
    """Lower-case words without ASCII punctuation at their ends."""
    edge = r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]*"
    return F.filter(F.split(F.regexp_replace(F.lower(text), rf"{edge}[\x01\x02\x20\x09-\x0D]+{edge}", " "), " "), lambda w: w != "")


def _chains(words: Column, common) -> Column:
    """Hashes of each common word with the two content words after it, common words between them skipped."""
    # pieces end with a content word, after the common words before it
    joined = F.array_join(F.transform(words, lambda w: F.concat(w, F.when(common(w), " ").otherwise("\x02"))), "")
    pairs = lambda p: F.arrays_zip(p.alias("a"), F.slice(p, 2, F.greatest(F.size(p) - 2, F.lit(0))).alias("b"))

    def of(x):
        parts = F.split(x["a"], " ")
        first, second = F.element_at(parts, -1), F.substring_index(x["b"], " ", -1)
        return F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda w: F.xxhash64(w, first, second))

    # an array of one holds the pieces, so that they are made once
    return F.flatten(F.flatten(F.transform(F.array(F.split(joined, "\x02")), lambda p: F.transform(F.filter(pairs(p), lambda x: x["b"].isNotNull()), of))))


def signature_set(text: Column, anchors: list[str] = ANCHORS) -> Column:
    """Sorted distinct 64-bit hashes of the signatures.

    A text without common words takes one in four of its words, by hash, in their place; one that has no signature even so, the hash of the whole text.
    """
    def made(words):
        usual = _chains(words, lambda w: w.isin(anchors))
        return F.when(F.size(usual) > 0, usual).otherwise(_chains(words, lambda w: F.pmod(F.xxhash64(w), F.lit(4)) == 0))

    sigs = F.get(F.transform(F.array(words_of(text)), made), F.lit(0))
    return F.get(F.transform(F.array(sigs), lambda s: F.when(F.size(s) > 0, F.sort_array(F.array_distinct(s))).otherwise(F.array(F.xxhash64(text)))), F.lit(0))


def fingerprint_text(sigs: Column) -> Column:
    """A set as text: its hashes in 16 hexadecimal digits each."""
    return F.array_join(F.transform(sigs, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), " ")


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two sets without repeats; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(1.0)).cast("double")


def _maybe_in(keys: DataFrame, column: str) -> Column:
    """True for the keys of ``keys`` and few others, by a bitmap of fixed size; at most FILTER_BITS / 64 rows reach the driver."""
    place = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))
    slot, bit = F.floor(place / 64).cast("int"), F.pmod(place, F.lit(64)).cast("int")
    words = [0] * (FILTER_BITS // 64)
    for r in keys.groupBy(slot.alias("slot")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(pmod(xxhash64({column}), {FILTER_BITS}L), 64) as int))")).alias("bits")).collect():
        words[r.slot] = r.bits
    held = F.from_json(F.lit(str(words)), "array<bigint>")
    return F.get(held, slot).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bit)) != 0


def _blocks(docs: DataFrame, block: int) -> Column:
    """Block number of a doc_id, in its order: ids are cut at quantiles, and each part into equal ranges of about ``block`` ids."""
    q = docs.agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.percentile_approx("doc_id", [i / PARTS for i in range(1, PARTS + 1)], 1000).alias("cuts")).first()
    if not q.n:
        return F.lit(0).cast("long")
    cuts = sorted({q.lo - 1, *q.cuts})
    per = max(1, q.n // PARTS // block)
    number = F.lit(len(cuts) * (per + 1)).cast("long")
    for i in reversed(range(len(cuts) - 1)):
        a, b = cuts[i], cuts[i + 1]
        inside = F.floor((F.col("doc_id").cast("double") - float(a)) / float(max(1, b - a)) * per)
        number = F.when(F.col("doc_id") <= b, F.lit(i * (per + 1)) + F.greatest(F.lit(0), F.least(F.lit(per), inside))).otherwise(number)
    return number.cast("long")


def next_documents(docs: DataFrame, columns: list[str], block: int = BLOCK) -> DataFrame:
    """Each row with ``next_<column>`` of the row with the next smaller doc_id (after the smallest: the largest).

    doc_ids are dealt to blocks of a range each, so that a block's rows are few; the largest row of a
    block is also sent to the next block above as its last row. Blocks are ordered in groups, and only one row a group globally.
    """
    d = docs.withColumn("_b", _blocks(docs, block))
    tops = d.groupBy("_b").agg(F.max("doc_id").alias("doc_id")).withColumn("_g", F.floor(F.col("_b") / F.lit(GROUP)))
    tops = stage(tops)
    firsts = tops.groupBy("_g").agg(F.min("_b").alias("_first"))
    above = Window.orderBy("_g")
    wrap = F.first("_first").over(above.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = firsts.select("_g", F.coalesce(F.lead("_first").over(above), wrap).alias("_after"))
    to = tops.withColumn("_to", F.lead("_b").over(Window.partitionBy("_g").orderBy("_b"))).join(firsts, "_g").select("doc_id", F.coalesce("_to", "_after").alias("_to"))
    to = stage(to)
    guests = d.filter(_maybe_in(to, "doc_id")).join(to, "doc_id").withColumn("_b", F.col("_to")).drop("_to").withColumn("_guest", F.lit(True))
    both = d.withColumn("_guest", F.lit(False)).unionByName(guests)
    w = Window.partitionBy("_b").orderBy(F.col("_guest"), F.col("doc_id").desc(), *[F.xxhash64(c) for c in columns])
    out = both.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return out.filter(~F.col("_guest")).drop("_guest", "_b")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``sigs``. A null text counts as empty; equal texts have equal sets, which are never empty."""
    return docs.withColumn("sigs", signature_set(F.coalesce(F.col(text), F.lit(""))))


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """left_id < right_id and likeness of the pairs of different signature sets with Jaccard >= ``threshold``, one
    document (the smallest doc_id) standing for each set; members are found by their set.

    Sets are partitioned by length: lengths l and m can only be near if min >= threshold * max, and only the
    first l - ceil(threshold * l) + 1 signatures, rarest first, need to be indexed. A signature is joined inside
    its length partition and the next one.
    """
    base = docs.groupBy("sigs").agg(F.min("doc_id").alias("id")).withColumn("n", F.size("sigs"))
    base = stage(base)
    df = base.select(F.explode("sigs").alias("s")).groupBy("s").agg(F.count("*").alias("f"))
    # lengths in one partition or its neighbour cover every compatible pair
    part = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(threshold))).cast("int")
    ranked = base.select("id", "n", part.alias("part"), F.explode("sigs").alias("s")).join(df, "s")
    w = Window.partitionBy("id").orderBy("f", "s")
    keep = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    index = stage(ranked.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= keep).select("id", "n", "part", "s"))
    left = index.select("s", F.col("id").alias("a"), F.col("n").alias("n_a"), F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    right = index.select("s", F.col("id").alias("b"), F.col("n").alias("n_b"), "part")
    pairs = left.join(right, ["s", "part"]).filter("a <> b AND n_a <= n_b").filter(F.col("n_a") >= F.col("n_b") * threshold - 1e-9)
    pairs = pairs.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id")).distinct()
    sets = base.select("id", "sigs")
    full = pairs.join(sets.withColumnsRenamed({"id": "left_id", "sigs": "x"}), "left_id").join(sets.withColumnsRenamed({"id": "right_id", "sigs": "y"}), "right_id")
    return full.select("left_id", "right_id", jaccard(F.col("x"), F.col("y")).alias("likeness")).filter(F.col("likeness") >= threshold)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness.

    The edited text has its last third of code points replaced by as many first ones of the next document
    in descending doc_id. ``docs``: doc_id (null: left out), text; null texts count as empty. The only document of a table is its
    own next one; of rows that share a doc_id one follows the other in the order of their text's hash, and any of them may follow a larger doc_id. An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    base = keyed(docs).select("doc_id", text.alias("text"), F.length(text).cast("long").alias("n_chars"), signature_set(text).alias("sigs"))
    j = next_documents(base, ["text", "sigs"])
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - third).cast("int")), F.substring("next_text", F.lit(1), third))
    j = j.select("doc_id", "n_chars", "sigs", "next_sigs", edited.alias("edited")).withColumn("edited_sigs", signature_set(F.col("edited")))
    return j.select(
        "doc_id", "n_chars", "sigs", "edited_sigs", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        jaccard(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), jaccard(F.col("sigs"), F.col("next_sigs")).alias("near_next"))
