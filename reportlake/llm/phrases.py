"""Substring deduplication by repeated-phrase automata.

A phrase is a window of ``width`` words; it recurs if it starts more than once in the corpus. Runs of windows are dealt
by their smallest k-word seed, so that equal windows meet under one seed. Three steps:

1. confirm: seeds are counted; under each recurring seed the windows that stand twice are confirmed;
2. compile: one window each time a phrase is confirmed gives the pattern; the patterns of a shard of seeds make an Aho-Corasick automaton;
3. stream: the runs of all documents with these seeds go through the automata, and only their matches mark words.

A seed with many distinct runs is cut into blocks: each automaton holds one block of patterns, each task streams one block of runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import keyed, maybe_among, stage
from .textnum import Words, chunks, mix, prefix, signed, sliding_min, spans

WIDTH = 35
SEED = 10
#: Bytes of text in one automaton's shard, about, and bytes of distinct runs of a seed in one block.
SHARD_BYTES = 1 << 19
BLOCK_BYTES = 2 << 20


def _pieces(w: Words, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, seed) of the runs of windows that share their seed, and the prefix sums of the word hashes."""
    sums = prefix(w.hash)
    n = len(w.hash) - width + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none.view(np.uint64), sums
    at = np.arange(len(w.hash) - k + 1)
    low = sliding_min(spans(sums, at, at + k), width - k + 1)
    valid = w.text[:n] == w.text[width - 1 :]
    new = valid.copy()
    new[1:] &= (low[1:] != low[:-1]) | ~valid[:-1] | (w.text[1:n] != w.text[: n - 1])
    start = np.flatnonzero(new)
    count = np.bincount(np.cumsum(new)[valid] - 1, minlength=len(start)) if len(start) else none
    return start, count, low[start], sums


def _again(w: Words, width: int, k: int) -> np.ndarray:
    """Seeds that stand twice in one run of windows: such a run may hold one window twice."""
    n = len(w.hash) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(len(w.hash) - k + 1)
    values = spans(prefix(w.hash), at, at + k)
    span = width - k + 1
    low = sliding_min(values, span)
    # a place is the smallest of some window if the largest minimum around it is its own value
    padded = np.concatenate([np.zeros(span - 1, np.uint64), low, np.zeros(span - 1, np.uint64)])
    places = np.flatnonzero(~sliding_min(~padded, span) == values)
    twice = (values[places[1:]] == values[places[:-1]]) & (np.diff(places) <= span)
    return values[places[1:]][twice]


def _seed_counts(width: int, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, data, offsets in chunks(batches):
        w = Words(data, offsets)
        keys, n = np.unique(np.concatenate([_pieces(w, width, k)[2], _again(w, width, k)]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(n, pa.int64())], names=["seed", "n"])


def _occurrence(doc: np.ndarray, text: np.ndarray, start: np.ndarray) -> np.ndarray:
    return mix(mix(doc.view(np.uint64) + mix(text.view(np.uint64))) + start.astype(np.uint64))


def _stretches(width: int, k: int, recurring, chosen, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces whose seed may recur: their place as numbers, or with ``chosen`` the words of the chosen ones."""
    for rows, data, offsets in chunks(batches):
        w = Words(data, offsets)
        start, count, seed, sums = _pieces(w, width, k)
        hit = np.flatnonzero(bloom.test(recurring.value, seed))
        start, count, seed = start[hit], count[hit], seed[hit]
        of, end = w.text[start], start + count - 1 + width
        piece, first = spans(sums, start, end), start - w.bounds[of]
        doc, text = (np.asarray(rows.column(i))[of] for i in (0, 1))
        key = _occurrence(doc, text, first)
        if chosen is None:
            size = w.end[end - 1] - w.start[start]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (signed(seed), signed(piece), doc, text, first, size, signed(key))], names=["seed", "piece", "doc_id", "text_hash", "start", "size", "occurrence"])
            continue
        hit = np.flatnonzero(bloom.test(chosen.value, key))
        words = [w.word_bytes(a, b).decode() for a, b in zip(start[hit].tolist(), end[hit].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(signed(seed[hit])), pa.array(signed(piece[hit])), pa.array(words, pa.string())], names=["seed", "piece", "words"])


def _window_rows(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the windows of distinct pieces, each with its piece's count and its place."""
    for rows, data, offsets in chunks(batches, "words"):
        w = Words(data, offsets)
        at = w.windows(width)
        of = pa.array(w.text[at])
        hashes = spans(prefix(w.hash), at, at + width)
        columns = [rows.column(rows.schema.get_field_index(c)).take(of) for c in ("seed", "piece", "n")]
        yield pa.RecordBatch.from_arrays([*columns[:1], pa.array(signed(hashes)), *columns[1:], pa.array(at - w.bounds[w.text[at]], pa.int32())], names=["seed", "window", "piece", "n", "at"])


def _confirmed(w: Words, width: int, group: np.ndarray, times: np.ndarray) -> np.ndarray:
    """First place of each window that stands twice under its seed; ``group`` (-1: not looked at) and ``times`` are those of the texts."""
    at = w.windows(width)
    at = at[group[w.text[at]] >= 0]
    if not len(at):
        return at
    hashes, seed = spans(prefix(w.hash), at, at + width), group[w.text[at]]
    order = np.lexsort((at, hashes, seed))
    new = np.ones(len(at), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (seed[order][1:] != seed[order][:-1])
    first = np.flatnonzero(new)
    return at[order[first[np.add.reduceat(times[w.text[at[order]]], first) > 1]]]


def _matches(w: Words, width: int, patterns: np.ndarray, streamed: np.ndarray) -> list[tuple[int, list[int], list[int]]]:
    """(text, starts, ends) of the words that the patterns, windows given by their first word, cover in the streamed texts. A word is one character."""
    _, number = np.unique(w.hash, return_inverse=True)
    number = number + 1
    letters = np.where(number < 0xD800, number, number + 0x800).astype("<u4").tobytes().decode("utf-32-le")
    auto = ahocorasick.Automaton()
    for a in patterns.tolist():
        auto.add_word(letters[a : a + width], width)
    if not len(auto):
        return []
    auto.make_automaton()
    found = []
    for t in streamed.tolist():
        starts, ends = [], []
        for last, n in auto.iter(letters[w.bounds[t] : w.bounds[t + 1]]):
            if ends and last - n + 1 <= ends[-1]:
                ends[-1] = last + 1
            else:
                starts.append(last - n + 1)
                ends.append(last + 1)
        if starts:
            found.append((t, starts, ends))
    return found


def _locate(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges that phrases cover in each piece. Rows are sorted by seed, blocks and piece; equal pieces are streamed once.

    ``leads`` gives the windows of a piece that are patterns; where it is null they are confirmed here.
    """
    held: list[tuple] = []
    size, key = 0, None

    def flush() -> Iterator[pa.RecordBatch]:
        raw = [h[2].encode() for h in held]
        w = Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        keys = {}
        group = np.array([keys.setdefault(h[0], len(keys)) if h[4] is None else -1 for h in held])
        patterns = _confirmed(w, width, group, np.array([h[3] for h in held]))
        led = [w.bounds[t] + np.asarray(h[4], np.int64) for t, h in enumerate(held) if h[4]]
        patterns = np.concatenate([patterns, *led])
        found = _matches(w, width, patterns, np.array([t for t, h in enumerate(held) if h[5]], np.int64))
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array([held[t][0][0] for t, _, _ in found], pa.int64()), pa.array([held[t][1] for t, _, _ in found], pa.int64()), pa.array([x for _, x, _ in found], pa.list_(pa.int32())), pa.array([x for _, _, x in found], pa.list_(pa.int32()))],
                names=["seed", "piece", "starts", "ends"])

    for b in batches:
        for i in range(0, len(b), 1000):
            part = b.slice(i, 1000)
            for seed, p, q, piece, words, leads, own in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("seed", "p", "q", "piece", "words", "leads", "own")), strict=True):
                new = (seed, p, q)
                if new != key:
                    if size > SHARD_BYTES:
                        yield from flush()
                        held, size = [], 0
                    key = new
                if held and held[-1][0] == new and held[-1][1] == piece and leads is None and held[-1][4] is None:
                    held[-1] = (*held[-1][:3], held[-1][3] + 1, None, own)
                    continue
                held.append((new, piece, words, 1, leads, own))
                size += len(words)
    if held:
        yield from flush()


def _kept(keep_text: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in chunks(batches):
        w = Words(data, offsets)
        starts, ends = rows.column(rows.schema.get_field_index("starts")), rows.column(rows.schema.get_field_index("ends"))
        gone = np.zeros(len(w.hash) + 1, np.int64)
        for i in range(len(rows)):
            if starts[i].is_valid:
                base = w.bounds[i]
                np.add.at(gone, base + np.asarray(starts[i].values), 1)
                np.add.at(gone, base + np.asarray(ends[i].values), -1)
        lost = np.cumsum(gone[:-1]) > 0
        raw = data.tobytes()
        digests, removed, kept_texts = [], [], []
        for i in range(len(rows)):
            a, b = w.bounds[i], w.bounds[i + 1]
            live = np.flatnonzero(~lost[a:b]) + a
            kept = b" ".join([raw[x:y] for x, y in zip(w.start[live].tolist(), w.end[live].tolist(), strict=True)])
            digests.append(hashlib.sha256(kept).hexdigest())
            removed.append(int(b - a - len(live)))
            if keep_text:
                kept_texts.append(kept.decode())
        out = [rows.column(0), pa.array(w.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests)]
        yield pa.RecordBatch.from_arrays([*out, pa.array(kept_texts)] if keep_text else out, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 4 + keep_text])


def _blocked(emitted: DataFrame, sizes: DataFrame, width: int) -> DataFrame:
    """Rows for :func:`_locate`: seeds of usual size in one block; the pieces of others in several, with their patterns found by a shuffle of windows."""
    usual = emitted.withColumns({"p": F.lit(0), "q": F.lit(0), "leads": F.lit(None).cast("array<int>"), "own": F.lit(True)})
    hot = stage(sizes.groupBy("seed").agg(F.ceil(F.sum("size") / F.lit(BLOCK_BYTES)).cast("int").alias("blocks")).filter("blocks > 1"))
    if hot.isEmpty():
        return usual
    pieces = stage(emitted.join(hot, "seed").groupBy("seed", "piece", "blocks").agg(F.first("words").alias("words"), F.count("*").alias("n")))
    windows = pieces.select("seed", "piece", "n", "words").mapInArrow(partial(_window_rows, width), "seed long, window long, piece long, n long, at int")
    lead = windows.groupBy("seed", "window").agg(F.sum("n").alias("n"), F.min(F.struct("piece", "at")).alias("lead")).filter("n > 1")
    leads = lead.groupBy("seed", F.col("lead.piece").alias("piece")).agg(F.collect_list("lead.at").alias("leads"))
    block = F.pmod("piece", "blocks").cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    none = F.array().cast("array<int>")
    streamed = F.transform(every, lambda p: F.struct(p.alias("p"), block.alias("q"), none.alias("leads"), F.lit(True).alias("own")))
    compiled = F.transform(every, lambda q: F.struct(block.alias("p"), q.alias("q"), F.col("leads").alias("leads"), F.lit(False).alias("own")))
    parts = F.when(F.col("leads").isNull(), streamed).otherwise(F.concat(streamed, compiled))
    split = pieces.join(leads, ["seed", "piece"], "left").select("seed", "piece", "words", F.explode(parts).alias("x")).select("seed", "piece", "words", "x.*")
    return usual.join(hot, "seed", "left_anti").unionByName(split)


def occurrences(docs: DataFrame, width: int = WIDTH, seed_words: int = SEED) -> DataFrame:
    """doc_id, text_hash, starts, ends: the word ranges of each document that recurring phrases cover, in no order.

    ``docs``: doc_id, text_hash, text. A document without such phrases has no row.
    """
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    counts = docs.select("doc_id", "text").mapInArrow(partial(_seed_counts, width, seed_words), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    recurring = share(bloom.build(counts.filter("n > 1").select("seed")))
    schema = "seed long, piece long, doc_id long, text_hash long, start long, size long, occurrence long"
    pieces = stage(docs.mapInArrow(lambda b: _stretches(width, seed_words, recurring, None, b), schema))
    # words are sent of two occurrences of a piece at most: that a piece stands twice is all that counts
    distinct = stage(pieces.groupBy("seed", "piece").agg(F.min("size").alias("size"), F.min("occurrence").alias("lo"), F.max("occurrence").alias("hi")))
    chosen = share(bloom.build(distinct.select(F.explode(F.array("lo", "hi")).alias("occurrence"))))
    emitted = docs.mapInArrow(lambda b: _stretches(width, seed_words, recurring, chosen, b), "seed long, piece long, words string")
    rows = _blocked(emitted, distinct, width).repartition("seed", "p", "q").sortWithinPartitions("seed", "p", "q", "piece")
    located = rows.mapInArrow(partial(_locate, width), "seed long, piece long, starts array<int>, ends array<int>")
    places = pieces.select("seed", "piece", "doc_id", "text_hash", "start").join(located, ["seed", "piece"])
    shift = lambda c: F.transform(c, lambda x: (x + F.col("start")).cast("int"))
    places = places.select("doc_id", "text_hash", shift("starts").alias("starts"), shift("ends").alias("ends"))
    return places.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))


def remove_repeats(docs: DataFrame, width: int = WIDTH, seed_words: int = SEED, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with ``keep_text``, kept_text of every document without its recurring phrases.

    A word goes if a window of ``width`` words that covers it also starts elsewhere, in the same or another document.
    ``docs``: doc_id (null: left out), text; other columns are ignored. Rows are told apart by doc_id and text, so rows that share a doc_id
    are documents of their own and repeated rows are copies. Null and empty texts have no words; kept words are joined by one space.
    Texts of fewer than ``width`` words lose nothing. Exact copies lose everything. An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    docs = keyed(docs).select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))
    spots = stage(occurrences(docs, width, seed_words))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if keep_text else "")
    # only documents that may lose words are shuffled to their ranges
    near = maybe_among(spots, ["doc_id", "text_hash"])
    touched = docs.filter(near).join(spots, ["doc_id", "text_hash"], "left").select("doc_id", "text", "starts", "ends")
    none = F.lit(None).cast("array<int>")
    others = docs.filter(~near).select("doc_id", "text", none.alias("starts"), none.alias("ends"))
    kept = partial(_kept, keep_text)
    return touched.mapInArrow(kept, schema).unionByName(others.mapInArrow(kept, schema))
