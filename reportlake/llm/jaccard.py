"""N-gram Jaccard join by prefixes of shingles and combinations of frequent ones.

Sets are ordered from rare to frequent shingles (:mod:`rarity`). Sets with Jaccard >= t share k shingles within their first
n - ceil(t n) + k ones, for every k. Prefixes are extended for k = 2: shingles that are rare in these prefixes are indexed
alone; where two sets share only frequent ones, they share a pair of them, so frequent shingles are indexed as pairs.
Candidates are verified on their whole sets. A shingle of one document can be in no intersection, so sets are kept
without these: most texts then have short lists.

Links matter through their components. Each round links the members of a key to its hubs; a key
whose sets are all in one component needs no further pair. What is left open is searched in full, first a small part of the keys.
There two sets are paired under the first key that they share: if they share nothing before a key, its places leave room for a link
only near the start of both sets. Parity sketches (their distance is at most that of the sets) hold back further pairs that can't link.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rarity
from .common import keyed, stage
from .graph import merged
from .textnum import Words, chunks, mix, prefix, signed, spans

#: Sets of the index that may hold a shingle that is indexed alone.
RARE = 24
#: Rounds of hubs, and hubs of a key in each.
ROUNDS = 1
HUBS = 3
#: Parts of the keys that the full search takes one after the other, by hash: what one joins needs no pairs in the next.
SLICES = ((0, 8), (8, 64), (64, 512))
K = 2
#: Longs of a parity sketch.
SKETCH = 8
#: Rows of one block of a key in the full search.
KEY_BLOCK = 512


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct k-word shingles of each text, sorted by text and hash.

    A text of fewer than k words has its whole sequence as its only shingle, one without words none.
    """
    w = Words(data, offsets, lower=True)
    sums = prefix(w.hash)
    at = w.windows(k)
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    text = np.concatenate([w.text[at], short])
    hashes = np.concatenate([spans(sums, at, at + k), spans(sums, w.bounds[short], w.bounds[short + 1])])
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    return text[new], hashes[new]


def _hashes(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for _, data, offsets in chunks(batches):
        yield shingle_sets(data, offsets, k)[1]


def _sets(k: int, num: int, den: int, held, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of each text: size, 128-bit sum, sketch, how many shingles of several documents are in the prefix, and all these in order if any is."""
    for rows, data, offsets in chunks(batches):
        m = len(offsets) - 1
        text, hashes = shingle_sets(data, offsets, k)
        n = np.bincount(text, minlength=m)
        at = np.concatenate([[0], np.cumsum(n)])
        total = lambda x: np.add.reduceat(np.concatenate([x, np.zeros(1, np.uint64)]), np.minimum(at[:-1], len(x))) * (n > 0)
        parity = np.bincount(text * (64 * SKETCH) + (mix(hashes) & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=m * 64 * SKETCH) & 1
        sketch = np.packbits(parity.astype(np.uint8).reshape(m, -1), axis=1).reshape(-1).view(np.int64)
        klass = rarity.classes(held.value, hashes)
        shared = np.flatnonzero(klass)
        size = np.bincount(text[shared], minlength=m)
        # what is left of the prefix after the shingles of this text alone; without that the set can't link
        first = np.maximum(0, np.where(n > 0, np.minimum(n, n - -(-num * n // den) + K), 0) - (n - size))
        size = np.where(first > 0, size, 0)
        shared = shared[first[text[shared]] > 0]
        order = shared[np.lexsort((hashes[shared], klass[shared], text[shared]))]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(signed(hashes[order])))
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(n, pa.int64()), pa.array(signed(total(mix(hashes)))), pa.array(signed(total(mix(hashes ^ np.uint64(0x5DEECE66D))))),
             pa.array(first, pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * SKETCH, pa.int32()), pa.array(sketch)), lists],
            names=["doc_id", "n", "f1", "f2", "first", "sketch", "tokens"])


def _possible(num: int, den: int, first: bool = False) -> Column:
    """Sizes of two sets and their places of a shared key leave room for enough shared shingles.

    ``first``: True at least under the first key that linking sets share. It is a shingle that is indexed alone, if they share one; else
    it is the pair of their first two shared shingles, and they share none before it and between the two.
    """
    rest = lambda x, pos: F.col(f"n_{x}") - F.col(f"{pos}_{x}") - 1
    most = F.least("i_a", "i_b") + 1 + F.least(rest("a", "pos"), rest("b", "pos"))
    if first:
        most = F.when(F.col("single_a") | F.col("single_b"), most).otherwise(2 + F.least(rest("a", "last"), rest("b", "last")))
    return (F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num) & (most * (num + den) >= (F.col("n_a") + F.col("n_b")) * num)


def _close(num: int, den: int) -> Column:
    """The distance of two sketches is at most that of the sets, which a link bounds."""
    apart = F.lit(0)
    for i in range(SKETCH):
        apart = apart + F.bit_count(F.col("s_a")[i].bitwiseXOR(F.col("s_b")[i]))
    return apart * (num + den) <= (F.col("n_a") + F.col("n_b")) * (den - num)


def jaccard_components(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, class_id and component_id of every document.

    Two documents link when den * intersection >= num * union of their sets of k-word shingles, A-Z in lower case; ``num / den`` is above 1/2. class_id is
    the smallest doc_id with the same set, component_id the smallest reachable by links. ``docs``: doc_id
    (null: left out; repeated: a row each, and rows of one doc_id count as linked), text; other columns are ignored. Null and empty texts have no shingles and are alone. Sets are compared by
    128-bit sums of their hashes and shingles by 64-bit hashes. Copies of a set are one class from the start.
    """
    if num * 2 <= den:
        raise ValueError("the threshold must be above 1/2")
    spark, docs = docs.sparkSession, keyed(docs).select("doc_id", "text")
    held = spark.sparkContext.broadcast(rarity.frequency_table(docs, partial(_hashes, k), rarity.total_bytes(docs)))
    schema = "doc_id long, n long, f1 long, f2 long, first int, sketch array<long>, tokens array<long>"
    sets = stage(docs.mapInArrow(lambda batches: _sets(k, num, den, held, batches), schema))
    held.destroy()
    sized = sets.filter("n > 0").select("doc_id", "n", "f1", "f2")
    classes = sized.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("class_id"))
    members = sized.join(classes.hint("merge"), ["n", "f1", "f2"]).select("doc_id", F.col("n").alias("n_shingles"), "class_id")
    members = stage(members.unionByName(sets.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"))))
    reps = members.filter("n_shingles > 0 AND doc_id = class_id").select("doc_id", F.col("n_shingles").alias("n")).distinct()
    reps = stage(sets.filter("first > 0").join(reps.hint("merge"), ["doc_id", "n"], "left_semi").select(F.col("doc_id").alias("id"), "n", "first", "sketch", "tokens"))

    keys = _index(reps)
    label = merged(None, _one_document(members))
    for r in range(ROUNDS + len(SLICES)):
        last = SLICES[r - ROUNDS] if r >= ROUNDS else None
        pairs = _spokes(keys, r, num, den) if last is None else _met(_slice(keys, last), reps, num, den)
        linked = _verified(pairs, reps, num, den)
        if linked is not None:
            label = merged(label, linked)
        if last is None or (linked is not None and last != SLICES[-1]):
            keys = _open(keys, label)
            if keys.isEmpty():
                break
    joined = members.join(label.withColumnRenamed("id", "class_id").hint("merge"), "class_id", "left")
    return joined.select("doc_id", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id"))


def _one_document(members: DataFrame) -> DataFrame:
    """Links between the classes of rows that share a doc_id."""
    several = members.groupBy("doc_id").agg(F.min("class_id").alias("b"), F.max("class_id").alias("hi")).filter("b < hi").select("doc_id", "b")
    return stage(members.join(several.hint("merge"), "doc_id").filter("class_id > b").select(F.col("class_id").alias("a"), "b").distinct())


def _index(reps: DataFrame) -> DataFrame:
    """key, id, n, i, pos, last, single, c: prefixes by rare shingles and by pairs of frequent ones; keys of one set are left out.

    ``pos`` and ``last`` are the places of a key's first and last shingle in the set, ``i`` that of the first among those of several documents.
    """
    places = reps.select("id", "n", (F.col("n") - F.size("tokens")).alias("own"), F.posexplode(F.slice("tokens", F.lit(1), F.col("first"))).alias("i", "token"))
    places = stage(places.select("token", "id", "n", "i", (F.col("own") + F.col("i")).cast("int").alias("pos")))
    df = stage(places.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"))
    listed = stage(places.join(df.hint("merge"), "token"))
    rare = listed.filter(F.col("df") <= RARE).select(F.col("token").alias("key"), "id", "n", "i", "pos", F.col("pos").alias("last"), F.lit(True).alias("single"))
    held_by = listed.filter(F.col("df") > RARE).groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "i", "token"))).alias("t"))
    two = F.expr("flatten(transform(t, (x, j) -> transform(slice(t, j + 2, size(t)), y -> struct(xxhash64(x.token, y.token) as key, x.i as i, x.pos as pos, y.pos as last))))")
    combos = held_by.select("id", "n", F.explode(two).alias("p")).select("p.key", "id", "n", "p.i", "p.pos", "p.last", F.lit(False).alias("single"))
    return stage(rare.unionByName(combos).withColumn("c", F.col("id")))


def _spokes(keys: DataFrame, r: int, num: int, den: int) -> DataFrame:
    """Pairs of sets with the hubs of their keys. The hubs of a key are its sets with the smallest hashes of this round."""
    hub = lambda i: F.min(F.struct(F.xxhash64("id", F.lit(r * HUBS + i)).alias("h"), "id", "n", "i", "pos", "c"))
    hubs = keys.groupBy("key").agg(F.array(*map(hub, range(HUBS))).alias("hubs"), F.max("c").alias("hi"), F.min("c").alias("lo")).filter("lo < hi")
    spokes = keys.join(hubs.select("key", F.explode("hubs").alias("hub")).hint("merge"), "key").filter("c <> hub.c")
    spokes = spokes.select(*[F.col(c).alias(f"{c}_a") for c in ("id", "n", "i", "pos")], *[F.col(f"hub.{c}").alias(f"{c}_b") for c in ("id", "n", "i", "pos")])
    return spokes.filter(_possible(num, den)).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def _slice(keys: DataFrame, part: tuple[int, int]) -> DataFrame:
    place = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(SLICES[-1][1]))
    return keys.filter((place >= part[0]) & (place < part[1]))


def _met(keys: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of different components that may link, under the first key that they share. A key of many sets is cut into blocks, and each pair of blocks is a key of its own."""
    size = keys.groupBy("key").agg(F.ceil(F.count("*") / F.lit(KEY_BLOCK)).cast("int").alias("blocks"))
    rows = keys.join(size.hint("merge"), "key").join(reps.select("id", F.col("sketch").alias("s")).hint("merge"), "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    own = F.col("block")
    left = rows.withColumn("x", own).withColumn("y", F.explode(F.sequence(own, F.col("blocks") - 1)))
    right = rows.withColumn("y", own).withColumn("x", F.explode(F.sequence(F.lit(0), own)))
    named = lambda d, side: d.select("key", "x", "y", *[F.col(c).alias(f"{c}_{side}") for c in ("id", "n", "i", "pos", "last", "single", "c", "s")])
    pairs = named(left, "a").join(named(right, "b").hint("merge"), ["key", "x", "y"]).filter("c_a <> c_b AND (x < y OR id_a < id_b)").filter(_possible(num, den, first=True) & _close(num, den))
    return pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def _verified(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame | None:
    """The ``pairs`` (a, b) that link, by their whole sets; None if their sketches hold back all. They hold back most others, so that few sets are moved."""
    light = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")).hint("merge")
    near = stage(pairs.join(light("a"), "a").join(light("b"), "b").filter(_close(num, den)).select("a", "b", "n_a", "n_b"))
    if near.isEmpty():
        return None
    ids = near.select(F.col("a").alias("id")).union(near.select("b")).distinct()
    need = stage(reps.join(ids.hint("merge"), "id", "left_semi").select("id", "tokens"))
    both = F.size(F.array_intersect("t_a", "t_b"))
    side = lambda x: need.select(F.col("id").alias(x), F.col("tokens").alias(f"t_{x}")).hint("merge")
    linked = near.join(side("a"), "a").join(side("b"), "b").filter((both > 0) & (both * den >= (F.col("n_a") + F.col("n_b") - both) * num))
    return stage(linked.select("a", "b").distinct())


def _open(keys: DataFrame, label: DataFrame) -> DataFrame:
    """Keys whose sets are in more than one component, with the component of each set."""
    with_c = keys.drop("c").join(label.withColumnRenamed("component", "c").hint("merge"), "id", "left").withColumn("c", F.coalesce("c", "id"))
    several = with_c.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key")
    return stage(with_c.join(several.hint("merge"), "key", "left_semi"))
