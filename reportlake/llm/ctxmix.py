"""Language-model scoring by online logistic context mixing.

A text is a sequence of tokens, each coded as bits. Where a phrase of the text stands in another training document, the token
that followed there is predicted: the first bit says whether it comes. Other tokens are coded by the class of their rank (a
Huffman code) and the place in it, rare words are spelled in bytes. Every bit is predicted by three hashed contexts
(none, one and two tokens; earlier bytes of the word; the record of predicted tokens); their predictions are mixed in the logistic domain
by weights that the bit's place selects, and refined by an adaptive probability map.

Bits of all training documents are counted; weights start equal, and they and the map learn inside each document, from its first bits on. Low-order contexts have tables of fixed size; the index of phrases, which
holds content of the corpus, is a table that grows with it and reaches texts by joins.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import keyed, maybe_among, stage
from .textnum import Words, chunks, mix, prefix, signed, spans

#: Words that are coded by rank; the vocabulary that is broadcast has no more.
MAX_WORDS = 1 << 20
SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
#: Cells for bits about predicted tokens, after the hashed slots.
FLAG_CELLS = 256
TABLE = SLOTS + FLAG_CELLS
ROW = 256
CONTEXTS = 3
#: Bits of a text after which its weights and map are updated, and tokens of one text that are in memory as bits.
STEP = 64
SEGMENT = 1 << 15
#: Learning rate of a bit; bits that the starting map counts for.
RATE = 0.2 / 64
MAP_PRIOR = 64.0
END = np.uint64(0x2545F4914F6CDD1D)
GATES = 25
FLAG_GATE = 21
ESCAPE = 31
#: Gates of the bits of a place in a class; later bits share the last one.
OFFSET_GATES = 3
CHUNK = 1 << 18
#: Counters that wait to be added to a task's table, 4 bytes each.
COUNTED = 1 << 22
#: Words of a phrase; one in ``EVERY`` phrases, by its hash, is indexed with the ``AHEAD`` tokens after it.
PHRASE = 6
EVERY = 16
AHEAD = 32


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words, hash of each token, its text, index of its word or -1); each text ends with one end token."""
    w = Words(data, offsets, lower=True)
    n = len(offsets) - 1
    total = len(w.hash) + n
    is_end = np.zeros(total, bool)
    is_end[w.bounds[1:] + np.arange(n)] = True
    key = np.empty(total, np.uint64)
    key[~is_end], key[is_end] = w.hash, END
    word = np.full(total, -1)
    word[~is_end] = np.arange(len(w.hash))
    text = np.repeat(np.arange(n), w.counts + 1)
    return w, key, text, word


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, n): kind 0 counts tokens, kind 1 bytes of words."""
    for _, data, offsets in chunks(batches):
        w, key, _, _ = _tokens(data, offsets)
        keys, n = np.unique(key, return_counts=True)
        by = np.bincount(w.data, minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], [len(keys), 256]), pa.int32()), pa.array(np.concatenate([signed(keys), np.arange(256)])), pa.array(np.concatenate([n, by]), pa.int64())], names=["kind", "key", "n"])


def _huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, length) of a Huffman code of the symbols 0, 1, ..., none longer than 24 bits."""
    weight = counts + max(1, int(counts.sum()) >> 16)
    heap = [(int(c), i, [i]) for i, c in enumerate(weight)]
    heapq.heapify(heap)
    code, length = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    at = len(counts)
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        for side, symbols in ((0, x), (1, y)):
            code[symbols] |= side << length[symbols]
            length[symbols] += 1
        heapq.heappush(heap, (a + b, at, x + y))
        at += 1
    # codes were built from their last bit on: bit length-1 is read first
    return code, length


@dataclass
class Vocabulary:
    """The frequent words in order of their hashes, with counts and ranks; corpus totals; the byte code."""

    keys: np.ndarray
    counts: np.ndarray
    ranks: np.ndarray
    total: int
    distinct: int
    code: np.ndarray
    length: np.ndarray
    klass_code: np.ndarray
    klass_length: np.ndarray

    def find(self, key: np.ndarray) -> np.ndarray:
        """Index of each key, -1 if it isn't a frequent word."""
        if not len(self.keys):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)


def vocabulary(counts: DataFrame, max_words: int = MAX_WORDS) -> tuple[Vocabulary, float]:
    """The words with at least the least count that leaves ``max_words`` or fewer, and that count.

    Words counted once are never among them, so that training learns to spell what it hasn't seen.
    Counts are compared in steps of 1/64 of an octave, so at most some 4,000 rows decide the limit.
    """
    words = counts.filter("kind = 0")
    step = F.floor(F.log2(F.col("n").cast("double")) * 64)
    per = words.groupBy(step.alias("step")).agg(F.count("*").alias("w"), F.sum("n").alias("n"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    kept, least = 0, float("inf")
    for r in per:
        kept += r.w
        if kept > max_words or r.least < 2:
            break
        least = r.least
    top = words.filter(F.col("n") >= F.lit(least)).select("key", "n").toArrow() if per and least < float("inf") else None
    key = top.column("key").to_numpy().view(np.uint64) if top is not None else np.zeros(0, np.uint64)
    n = top.column("n").to_numpy() if top is not None else np.zeros(0, np.int64)
    order = np.argsort(key)
    key, n = key[order], n[order]
    ranks = np.empty(len(key), np.int64)
    ranks[np.lexsort((key, -n))] = np.arange(len(key))
    by = np.zeros(256, np.int64)
    for r in counts.filter("kind = 1").collect():
        by[r.key] = r.n
    total = sum(r.n for r in per)
    return Vocabulary(key, n, ranks, total, sum(r.w for r in per), *_huffman(by), *_huffman(_klass_counts(ranks, n, total))), least


def _klass(rank: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(rank + 1.0)).astype(np.int64)


def _klass_counts(ranks: np.ndarray, n: np.ndarray, total: int) -> np.ndarray:
    """Tokens in each class of ranks; what is not in the vocabulary is in the last one."""
    per = np.bincount(_klass(ranks), n, ESCAPE + 1).astype(np.int64)
    per[ESCAPE] = total - int(n.sum())
    return per


def _slots(contexts: list[np.ndarray], node: np.ndarray) -> list[np.ndarray]:
    # contexts are mixed already: one multiplication spreads the node, another takes the top bits
    spread = node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return [((c ^ spread) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - SLOT_BITS)).astype(np.int32) for c in contexts]


def _phrases(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(last word, hash) of the phrases that are indexed."""
    at = w.windows(PHRASE)
    hashes = spans(prefix(w.hash), at, at + PHRASE)
    hit = hashes % np.uint64(EVERY) == 0
    return at[hit] + PHRASE - 1, hashes[hit]


def _phrase_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in chunks(batches):
        w = Words(data, offsets, lower=True)
        last, hashes = _phrases(w)
        of = w.text[last]
        yield pa.RecordBatch.from_arrays([pa.array(signed(hashes)), rows.column(0).take(pa.array(of)), rows.column(2).take(pa.array(of))], names=["phrase", "doc_id", "learn"])


def _phrase_rows(held, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of phrases that may recur; with the tokens after them, four bytes of hash each, if they may be learnt."""
    for rows, data, offsets in chunks(batches):
        w, key, _, _ = _tokens(data, offsets)
        last, hashes = _phrases(w)
        hit = bloom.test(held.value, hashes)
        last, hashes = last[hit], hashes[hit]
        of = w.text[last]
        raw, learn = key.astype("<u4").tobytes(), rows.column(2).to_pylist()
        # a text's tokens are its words and one end
        first = last + of + 1
        until = np.minimum(first + AHEAD, w.bounds[of + 1] + of + 1)
        ahead = [raw[4 * a : 4 * b] if learn[t] else None for a, b, t in zip(first.tolist(), until.tolist(), of.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(signed(hashes)), rows.column(0).take(pa.array(of)), rows.column(1).take(pa.array(of)), pa.array(last - w.bounds[of], pa.int32()), pa.array(ahead, pa.binary())],
            names=["phrase", "doc_id", "text_hash", "at", "ahead"])


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, and for each phrase of the text that stands in another document that is learnt from: its place (``at``) and what follows (``ahead``).

    ``docs``: doc_id, text_hash, learn, text. Of the documents with a phrase, the one with the smallest doc_id, or the largest if that is the
    text's own, tells what follows.
    """
    spark = docs.sparkSession
    met = docs.select("doc_id", "text_hash", "learn", "text").mapInArrow(_phrase_keys, "phrase long, doc_id long, learn boolean")
    several = met.groupBy("phrase").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max("learn").alias("learn")).filter("lo < hi AND learn").select("phrase")
    several = stage(several)
    held = spark.sparkContext.broadcast(bloom.build(several))
    rows = stage(docs.select("doc_id", "text_hash", "learn", "text").mapInArrow(lambda b: _phrase_rows(held, b), "phrase long, doc_id long, text_hash long, at int, ahead binary"))
    of = F.struct("doc_id", "text_hash", "at")
    told = rows.filter("ahead IS NOT NULL").groupBy("phrase").agg(
        F.min("doc_id").alias("lo"), F.min_by("ahead", of).alias("lo_ahead"), F.max("doc_id").alias("hi"), F.max_by("ahead", of).alias("hi_ahead"))
    asked = rows.select("phrase", "doc_id", "text_hash", "at").join(told, "phrase").filter("lo < hi OR doc_id <> lo")
    ahead = F.when(F.col("doc_id") == F.col("lo"), F.col("hi_ahead")).otherwise(F.col("lo_ahead"))
    per = asked.select("doc_id", "text_hash", F.struct("at", ahead.alias("ahead")).alias("x")).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("x")).alias("x"))
    return per.select("doc_id", "text_hash", F.col("x.at").alias("at"), F.col("x.ahead").alias("ahead"))


@dataclass
class Texts:
    """Tokens of a chunk of texts: hash, text, word number, index in the vocabulary; predicted token (four bytes of hash) where ``told``."""

    w: Words
    key: np.ndarray
    text: np.ndarray
    word: np.ndarray
    found: np.ndarray
    orders: list[np.ndarray]
    told: np.ndarray
    hit: np.ndarray
    flag: list[np.ndarray]
    bucket: np.ndarray


def _texts(v: Vocabulary, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> Texts:
    w, key, text, word = _tokens(data, offsets)
    new = np.ones(len(key), bool)
    new[1:] = text[1:] != text[:-1]
    one = np.where(new, np.uint64(0), np.concatenate([np.zeros(1, np.uint64), key[:-1]]))
    two = np.where(new | np.concatenate([[True], new[:-1]]), np.uint64(0), np.concatenate([np.zeros(1, np.uint64), one[:-1]]))
    orders = [np.full(len(key), 0x9FB21C651E98DF25, np.uint64), mix(one + np.uint64(3)), mix(mix(one + np.uint64(5)) + two)]
    told, want = np.zeros(len(key), bool), np.zeros(len(key), np.uint32)
    first = w.bounds[:-1] + np.arange(len(offsets) - 1)
    last = w.bounds[1:] + np.arange(1, len(offsets))
    places, ahead = rows.column(rows.schema.get_field_index("at")), rows.column(rows.schema.get_field_index("ahead"))
    for t in np.flatnonzero(np.asarray(places.is_valid())).tolist():
        for at, raw in zip(places[t].as_py(), ahead[t].as_py(), strict=True):
            a = int(first[t]) + at + 1
            b = min(a + len(raw) // 4, int(last[t]))
            told[a:b] = True
            want[a:b] = np.frombuffer(raw, "<u4")[: b - a]
    hit = told & (want == key.astype(np.uint32))
    at = np.flatnonzero(told)
    came, of = hit[at], text[at]
    # predicted tokens that came in a row up to here, and the last six records of the text
    index = np.arange(len(at))
    begin = np.ones(len(at), bool)
    begin[1:] = of[1:] != of[:-1]
    broken = np.maximum.accumulate(np.where(begin, index, np.where(np.concatenate([[False], ~came[:-1]]), index, 0))) if len(at) else index
    bucket = np.minimum(3, np.log2(index - broken + 1.0)).astype(np.int64)
    history = np.zeros(len(at), np.int64)
    since = index - np.maximum.accumulate(np.where(begin, index, 0)) if len(at) else index
    for i in range(1, 7):
        ok = np.flatnonzero(since >= i)
        history[ok] |= came[ok - i].astype(np.int64) << (i - 1)
    flag = [np.zeros(len(key), np.int32) for _ in range(CONTEXTS)]
    known = np.minimum(15, np.log2(since + 1.0)).astype(np.int64)
    for f, c in zip(flag, (bucket, known * 4 + bucket, bucket * 64 + history), strict=True):
        f[at] = SLOTS + c
    wide = np.zeros(len(key), np.int64)
    wide[at] = bucket
    return Texts(w, key, text, word, v.find(key), orders, told, hit, flag, wide)


@dataclass
class Events:
    """Bits of several texts in coding order: value, slots of the contexts, gate, text; ``raw``: bits of each text that cost one each, none of a token."""

    bit: np.ndarray
    slots: list[np.ndarray]
    gate: np.ndarray
    text: np.ndarray
    raw: np.ndarray


def _events(v: Vocabulary, x: Texts, take: np.ndarray) -> Events:
    """The bits of the tokens ``take``, in order."""
    w, text, found, told, hit = x.w, x.text[take], x.found[take], x.told[take], x.hit[take]
    known = (found >= 0) & ~hit
    rank = np.where(known, v.ranks[np.maximum(found, 0)] if len(v.ranks) else 0, 0)
    klass = np.where(known, _klass(rank), ESCAPE)
    offset = rank + 1 - (np.int64(1) << np.minimum(klass, 40))
    shown = np.where(known, klass, 0)
    coded = np.where(hit, 0, v.klass_length[klass])
    # an unknown word is spelled, then ended by a blank
    spelled = np.flatnonzero(~known & ~hit)
    word = x.word[take[spelled]]
    # an end without a vocabulary is spelled as an empty word
    first, size = np.where(word >= 0, w.start[word] if len(w.start) else 0, 0), np.where(word >= 0, (w.end[word] - w.start[word]) if len(w.start) else 0, 0) + 1
    owner = np.repeat(np.arange(len(spelled)), size)
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    final = place == size[owner] - 1
    at = np.minimum(first[owner] + place, max(0, len(w.data) - 1))
    byte = np.where(final, 32, w.data[at] if len(w.data) else 32).astype(np.int64)
    bits = v.length[byte]
    start_bits = np.cumsum(bits) - bits
    base_of = np.cumsum(size) - size
    inside = start_bits - start_bits[base_of[owner]] if len(owner) else start_bits
    per_token = told + coded + shown
    per_token[spelled] += np.add.reduceat(bits, base_of) if len(spelled) else 0
    base = np.cumsum(per_token) - per_token
    m = int(per_token.sum())
    out_bit, gate, of = np.empty(m, np.uint8), np.empty(m, np.int8), np.repeat(text, per_token)
    slots = [np.empty(m, np.int32) for _ in range(CONTEXTS)]

    def put(dest, bit, found_slots, g) -> None:
        out_bit[dest], gate[dest] = bit, g
        for s, c in zip(slots, found_slots, strict=True):
            s[dest] = c

    t = np.flatnonzero(told)
    put(base[t], hit[t], [f[take[t]] for f in x.flag], FLAG_GATE + x.bucket[take[t]])
    base = base + told
    code = v.klass_code[klass]
    orders = [o[take] for o in x.orders]
    for d in range(int(coded.max()) if len(coded) else 0):
        t = np.flatnonzero(coded > d)
        n, c = coded[t], code[t]
        node = (1 << d) | (c >> (n - d))
        put(base[t] + d, (c >> (n - 1 - d)) & 1, _slots([o[t] for o in orders], node), min(d, 7))
    for d in range(int(shown.max()) if len(shown) else 0):
        t = np.flatnonzero(shown > d)
        k, o = klass[t], offset[t]
        node = (k << 22) + ((1 << d) | (o >> (k - d)))
        put(base[t] + coded[t] + d, (o >> (k - 1 - d)) & 1, _slots([c[t] for c in orders], node), 8 + min(d, OFFSET_GATES - 1))
    if len(byte):
        back = []
        for i in range(1, 5):
            b = np.zeros(len(byte), np.uint64)
            ok = np.flatnonzero(place >= i)
            b[ok] = byte[ok - i].astype(np.uint64) + np.uint64(1)
            back.append(b << np.uint64(9 * (i - 1)))
        sums = [mix(back[0] + back[1] + np.uint64(11)), mix(back[0] + back[1] + back[2] + np.uint64(13)), mix(back[0] + back[1] + back[2] + back[3] + np.uint64(17))]
        start = base[spelled][owner] + coded[spelled][owner] + inside
        code = v.code[byte]
        for d in range(int(bits.max())):
            t = np.flatnonzero(bits > d)
            n, c = bits[t], code[t]
            node = (1 << 21) + ((1 << d) | (c >> (n - d)))
            put(start[t] + d, (c >> (n - 1 - d)) & 1, _slots([z[t] for z in sums], node), min(11 + d, FLAG_GATE - 1))
    return Events(out_bit, slots, gate, of, np.zeros(int(text[-1]) + 1 if len(text) else 0, np.int64))


def _segments(x: Texts, n: int) -> Iterator[np.ndarray]:
    """Token numbers: the first ``SEGMENT`` tokens of each text, then the next ones of longer texts."""
    first = np.searchsorted(x.text, np.arange(n + 1))
    place = (np.arange(len(x.text)) - first[x.text]) // SEGMENT if len(x.text) else x.text
    for r in range(int(place.max()) + 1 if len(place) else 0):
        yield np.flatnonzero(place == r)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most ``CHUNK`` bytes of text, or one row, of texts of like length: side by side they have about as many steps, and none waits for a long one."""
    for batch in batches:
        size = pc.binary_length(batch.column(batch.schema.get_field_index("text"))).to_numpy(zero_copy_only=False)
        order = np.argsort(size, kind="stable")
        at = np.concatenate([[0], np.cumsum(size[order], dtype=np.int64)])
        i = 0
        while i < len(order):
            j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, side="right")) - 1)
            yield batch.take(pa.array(order[i:j]))
            i = j


def _count_bits(held, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of one task as rows of ``ROW`` counters: context, bit and slot make the counter's number."""
    v, total = held.value, np.zeros((CONTEXTS, 2 * TABLE), np.int64)
    waiting: list[list[np.ndarray]] = [[] for _ in range(CONTEXTS)]

    def add() -> None:
        # many bits at a time: each addition passes the whole table of a context
        for own, parts in zip(total, waiting, strict=True):
            own += np.bincount(np.concatenate(parts), minlength=len(own))
            parts.clear()

    for rows, data, offsets in chunks(batches, limit=CHUNK):
        x = _texts(v, rows, data, offsets)
        for take in _segments(x, len(offsets) - 1):
            e = _events(v, x, take)
            row = e.bit * np.int32(TABLE)
            for parts, s in zip(waiting, e.slots, strict=True):
                parts.append(row + s)
            if sum(map(len, waiting[0])) * CONTEXTS > COUNTED:
                add()
    if waiting[0]:
        add()
    lines = total.reshape(-1, ROW)
    used = np.flatnonzero(lines.any(axis=1))
    for i in range(0, len(used), 512):
        part = used[i : i + 512]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(list(lines[part]), pa.list_(pa.int64()))], names=["row", "counts"])


def _sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, x in zip(b.column(0).to_pylist(), np.asarray(b.column(1).flatten()).reshape(-1, ROW), strict=True):
            total[k] = total[k] + x if k in total else x.copy()
    for k, x in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x], pa.list_(pa.int64()))], names=["row", "counts"])


def _stretch(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.clip(np.log((np.maximum(n1, 0) + 0.4) / (np.maximum(n0, 0) + 0.4)), -9, 9).astype(np.float32)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


#: The map before it has seen a bit: the mixed prediction itself.
PLAIN_MAP = np.tile(_squash((np.arange(33) - 16) / 2), GATES)
#: Starting weight of every prediction; a fit over all training documents changed the bits of a byte by 0.1 %.
START = 0.6


@dataclass
class Model:
    """All of fixed size: stretched predictions of each context and starting weights by gate."""

    tables: list[np.ndarray]
    weights: np.ndarray


class Learner:
    """Weights and maps of several texts, which learn from the bits of their own text every ``STEP`` bits from its start."""

    def __init__(self, model: Model, texts: int) -> None:
        self.tables, self.texts = model.tables, texts
        self.weights = np.tile(model.weights.T.astype(np.float32), texts)
        self.refine = np.tile(PLAIN_MAP.astype(np.float32), texts)
        self.seen = np.full(len(self.refine), MAP_PRIOR, np.float32)

    def cost(self, e: Events) -> np.ndarray:
        """Cost of each text in bits; a call starts a step of each of its texts."""
        total = np.zeros(self.texts)
        total[: len(e.raw)] += e.raw
        if not len(e.bit):
            return total
        n = np.bincount(e.text, minlength=self.texts)
        # texts side by side, one step of each after the other; those with most bits first, so that a step has the first texts only
        by = np.argsort(-n, kind="stable")
        seat = np.empty(self.texts, np.int64)
        seat[by] = np.arange(self.texts)
        step = (np.arange(len(e.bit)) - np.repeat(np.cumsum(n) - n, n)) // STEP
        # short numbers sort in linear time
        step = step.astype(np.uint16) if len(e.bit) < STEP << 16 else step
        order = np.argsort(step, kind="stable")
        ends = np.cumsum(np.bincount(step))
        del step
        wide = GATES * np.searchsorted(-n[by], -STEP * np.arange(len(ends)))
        bit, text = e.bit[order].astype(np.float32), e.text[order]
        place = seat[text] * GATES + e.gate[order]
        x = np.empty((CONTEXTS, len(bit)), np.float32)
        for t, s, to in zip(self.tables, e.slots, x, strict=True):
            t.take(s[order], out=to, mode="clip")
        del order
        p = np.empty(len(bit), np.float32)
        of = lambda a, rows: a.reshape(rows, self.texts, -1)
        weights = of(self.weights, CONTEXTS)[:, by].reshape(CONTEXTS, -1)
        refine, seen = of(self.refine, 1)[0, by].reshape(-1), of(self.seen, 1)[0, by].reshape(-1)
        rows = np.arange(CONTEXTS)[:, None]
        one, half, rate, middle = np.float32(1), np.float32(0.5), np.float32(RATE), np.float32(16.5)
        a = 0
        for b, m in zip(ends.tolist(), wide.tolist(), strict=True):
            w, y, xs = place[a:b], bit[a:b], x[:, a:b]
            z = np.einsum("ij,ij->j", weights.take(w, axis=1), xs)
            q = one / (one + np.exp(-z))
            cell = np.minimum(np.maximum(z * 2 + middle, 0), 32).astype(np.int64)
            cell += w * 33
            old = refine.take(cell)
            p[a:b] = (q + old) * half
            err = (y - q) * rate
            weights[:, :m] += np.bincount((rows * m + w).reshape(-1), (xs * err).reshape(-1), CONTEXTS * m).reshape(CONTEXTS, m)
            # the map holds means: counts of all bits of the step first, then each bit's share
            np.add.at(seen, cell, one)
            np.add.at(refine, cell, (y - old) / seen.take(cell))
            a = b
        of(self.weights, CONTEXTS)[:, by] = of(weights, CONTEXTS)
        of(self.refine, 1)[0, by], of(self.seen, 1)[0, by] = of(refine, 1)[0], of(seen, 1)[0]
        p = np.clip(p, 1e-6, 1 - 1e-6)
        return total + np.bincount(text, -np.log2(np.where(bit == 1, p, 1 - p)), self.texts)


def _score(held, model_held, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    v, model = held.value, model_held.value
    for rows, data, offsets in chunks(_alike(batches), limit=CHUNK):
        n = len(offsets) - 1
        x = _texts(v, rows, data, offsets)
        text, known = x.text, x.found >= 0
        logs = np.bincount(text, np.where(known, np.log10(v.counts[np.maximum(x.found, 0)] + 1.0) if len(v.counts) else 0.0, 0.0), n)
        learner = Learner(model, n)
        cost = sum((learner.cost(_events(v, x, take)) for take in _segments(x, n)), np.zeros(n))
        tail = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(text, ~known, n).astype(np.int64))]), pa.int32()), pa.array(signed(x.key[~known])))
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), rows.column(1), pa.array(np.diff(offsets), pa.int64()), pa.array(np.bincount(text, minlength=n), pa.int64()), pa.array(np.bincount(text, known, n).astype(np.int64)), pa.array(np.bincount(text, x.hit, n).astype(np.int64)), pa.array(logs), pa.array(cost), tail],
            names=["doc_id", "text_hash", "n_bytes", "n_tokens", "known", "n_predicted", "logs", "bits", "tail"],
        )


def score_documents(docs: DataFrame, learn: Column, max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte and n_predicted of every row of ``docs``.

    The model learns from the rows where ``learn`` is true (null: not). ``docs``: doc_id (null: left out; rows are told apart by doc_id and text, a repeated row is scored as often), text; other
    columns are ignored. A null text counts as empty: one end token. Words are
    lower-cased (A-Z) and told apart by 64-bit hashes. base_score is the add-one unigram log10 probability, score the mixing
    model's, where phrases predict from other documents than the text's own. n_predicted: tokens that a phrase predicted. Without training rows
    every bit costs one. Words below the broadcast vocabulary are spelled, and get their counts for base_score by a join.
    """
    text = F.coalesce("text", F.lit(""))
    docs = keyed(docs).select("doc_id", F.xxhash64(text).alias("text_hash"), F.coalesce(learn, F.lit(False)).alias("learn"), text.alias("text"))
    sc = docs.sparkSession.sparkContext
    counts = stage(docs.filter("learn").select("text").mapInArrow(_count_words, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    v, least = vocabulary(counts, max_words)
    held = sc.broadcast(v)
    told = stage(predictions(docs))
    # only texts with predictions are shuffled to them
    near = maybe_among(told, ["doc_id", "text_hash"])
    touched = stage(docs.filter(near).join(told, ["doc_id", "text_hash"], "left"))
    others = docs.filter(~near).select("*", F.lit(None).cast("array<int>").alias("at"), F.lit(None).cast("array<binary>").alias("ahead"))
    base = touched.unionByName(others).select("doc_id", "text_hash", "learn", "text", "at", "ahead")
    training = base.filter("learn")
    rows = training.mapInArrow(lambda b: _count_bits(held, b), "row int, counts array<long>").repartition("row").mapInArrow(_sum_rows, "row int, counts array<long>").toArrow()
    total = np.zeros((CONTEXTS * 2 * TABLE // ROW, ROW), np.int64)
    if len(rows):
        total[rows.column(0).to_numpy()] = rows.column(1).combine_chunks().flatten().to_numpy().reshape(-1, ROW)
    total = total.reshape(CONTEXTS, 2, TABLE)
    counted = sc.broadcast(total)
    model = sc.broadcast(Model([_stretch(c[0], c[1]) for c in total], np.full((GATES, CONTEXTS), START, np.float32)))
    scored = stage(base.mapInArrow(lambda b: _score(held, model, b), "doc_id long, text_hash long, n_bytes long, n_tokens long, known long, n_predicted long, logs double, bits double, tail array<long>"))
    rare = counts.filter((F.col("kind") == 0) & (F.col("n") < F.lit(least))).select("key", "n")
    tail = scored.dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", F.explode("tail").alias("key")).groupBy("doc_id", "text_hash", "key").agg(F.count("*").alias("k"))
    tail = tail.join(rare, "key").groupBy("doc_id", "text_hash").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("n") + 1.0)).alias("more_logs"))
    per = float(np.log10(v.total + v.distinct + 1.0))
    out = scored.drop("tail").join(tail, ["doc_id", "text_hash"], "left")
    return out.select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(per)).alias("base_score"),
        (-F.col("bits") * F.lit(float(np.log10(2.0)))).alias("score"), (F.col("bits") / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"), "n_predicted")
