"""Alignment of two tokenizers of the same texts.

Token ends that both tokenizers share cut a text into groups. A byte range of a text gives a fragment: the tokens up to
its first common end (open prefix), the groups between its common ends (closed) and the tokens after its last one
(open suffix). Fragments of neighbours compose to a fragment, associatively: a suffix and the next prefix close a group.
Texts above ``RANGE`` bytes are spread over tasks and their fragments meet in a tree reduction; closed groups stay
where they are. Neither tokenizer joins two words across a blank between visible characters, so the tokens of such
words are found once in a worker and looked up.

Counts of linked ids are made over packs of documents: a pack sends each distinct pair once with the number of its
documents that hold it, and gets the pair's corpus-wide count back.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache, partial
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, stage
from .textnum import chunks
from .vocab import public_path

BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"
#: Bytes of a range; longer texts are composed of fragments.
RANGE = 1 << 16
#: Bytes of texts that are looked at together.
BATCH = 1 << 20
#: Distinct pairs of documents in a pack, words that a worker keeps, fragments that one step of the tree composes.
PACK_PAIRS = 1 << 19
KEPT = 120_000
FAN = 8
#: Words that are encoded as one text.
JOINED = 256
#: Between visible characters, before one blank: both tokenizers have an end there.
CUT = re.compile(r"(?<=\S)(?=\x20\S)")
#: White space beside a blank or at an end: not every blank of such a text is a cut.
CARELESS = re.compile(r"\A\s|\s\Z|\x20\s|\s\x20")

SHORT = (
    "pack long, key array<long>, held array<int>, size array<int>, at binary, times binary, "
    "doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>"
)
FRAGMENT = "row long, doc_id long, at long, cut boolean, pre_a array<int>, pre_b array<int>, post_a array<int>, post_b array<int>"
CLOSED = "ok boolean, text string, n_a long, n_b long, n_groups long, n_links long, key array<long>, times array<long>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_values() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if visible, else the next one from U+0100."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligned:
    """Tokens and groups of several words in a row: ids, ends (bytes), and the group of each token."""

    def __init__(self, a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray):
        self.a, self.b, self.end_a, self.end_b = a, b, end_a, end_b
        self.cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        self.group_a, self.group_b = np.searchsorted(self.cuts, end_a), np.searchsorted(self.cuts, end_b)

    def pairs(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, key, times) of the links in groups ``first`` to ``last`` - 1; key: a in the upper, b in the lower 32 bits."""
        i, j = np.searchsorted(self.group_a, [first, last])
        k, m = np.searchsorted(self.group_b, [first, last])
        ga, gb = self.group_a[i:j] - first, self.group_b[k:m] - first
        n_a, n_b = np.bincount(ga, minlength=last - first), np.bincount(gb, minlength=last - first)
        large = n_a * n_b > 1 << 12
        a, b = self.a[i:j].astype(np.int64), self.b[k:m].astype(np.int64)
        start = np.cumsum(n_b) - n_b
        reps = np.where(large, 0, n_b)[ga]
        group = np.repeat(ga, reps)
        at = np.arange(len(group)) - np.repeat(np.cumsum(reps) - reps, reps) + start[group]
        found = [(group, np.repeat(a, reps) << 32 | b[at], np.ones(len(group), np.int64))]
        for g in np.flatnonzero(large):
            x, nx = np.unique(a[ga == g], return_counts=True)
            y, ny = np.unique(b[gb == g], return_counts=True)
            found.append((np.full(len(x) * len(y), g), (x[:, None] << 32 | y).ravel(), (nx[:, None] * ny).ravel()))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def texts(self, bounds: np.ndarray) -> list[str]:
        """Groups ``bounds[i]`` to ``bounds[i + 1]`` - 1 as ``a1,a2|b1;a3|b2``, for each i."""
        i, j = np.searchsorted(self.group_a, bounds[[0, -1]])
        k, m = np.searchsorted(self.group_b, bounds[[0, -1]])
        ids, group = np.concatenate([self.a[i:j], self.b[k:m]]), np.concatenate([self.group_a[i:j], self.group_b[k:m]])
        side = np.repeat([0, 1], [j - i, m - k])
        order = np.argsort(2 * group + side, kind="stable")
        ids, group, side = ids[order], group[order], side[order]
        # a comma within a side, a bar between sides, a semicolon between groups
        mark = np.full(len(ids), 2)
        mark[:-1] = np.where(group[1:] != group[:-1], 2, side[1:] != side[:-1])
        names = id_names(int(ids.max()) + 1 if len(ids) else 0)
        pieces = list(map(names.__getitem__, (3 * ids + mark).tolist()))
        ends = np.concatenate([[0], np.cumsum(list(map(len, pieces)))]).astype(np.int64)[np.searchsorted(group, bounds)].tolist()
        whole = "".join(pieces)
        return [whole[x : y - 1] if x < y else "" for x, y in zip(ends[:-1], ends[1:], strict=True)]


_NAMES: list[str] = []


def id_names(n: int) -> list[str]:
    """Numbers below ``n``, and some more, each with a comma, a bar and a semicolon behind it."""
    if len(_NAMES) < 3 * n:
        _NAMES.extend(f"{i}{mark}" for i in range(len(_NAMES) // 3, max(n, 1 << 16)) for mark in ",|;")
    return _NAMES


class Aligner:
    """Both tokenizers, and what a worker knows of words. A word goes with the blank before it."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(byte_path)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        value = byte_values()
        names = self.first.get_vocab()
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes_a[i] = bytes(value[c] for c in name) if all(c in value for c in name) else name.encode()
        pieces = [self.second.id_to_piece(i) for i in range(self.second.vocab_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece of the vocabulary goes on after a blank")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.forget()

    def forget(self) -> None:
        #: Numbers of words, and of pairs.
        self.words: defaultdict[str, int] = defaultdict()
        self.words.default_factory = self.words.__len__
        self.numbers: defaultdict[int, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.text: list[str] = []
        # by word: start of its links, how many it has (distinct ones, tokens, groups, all), and whether its bytes come back
        self.start, self.links, self.n_a, self.n_b, self.n_groups, self.n_links = (np.zeros(0, np.int64) for _ in range(6))
        self.fine = np.zeros(0, bool)
        self.pair, self.times = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def keys(self) -> np.ndarray:
        """Pairs by their number in this worker."""
        return np.fromiter(self.numbers, np.int64, len(self.numbers))

    def _ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        if not texts:
            return [], []
        return [e.ids for e in self.first.encode_batch_fast(texts, add_special_tokens=False)], self.second.encode([t[1:] for t in texts], num_threads=1)

    def _comes_back(self, raw: bytes, a: list[int], b: list[int]) -> bool:
        return b"".join(map(self.bytes_a.__getitem__, a)) == raw and b"".join(map(self.bytes_b.__getitem__, b)) == raw

    def encode(self, words: list[str]) -> tuple[Aligned, np.ndarray]:
        """The tokens of ``words``, each with the blank before it, as one row of tokens, and the end of each word; a word that a side doesn't give back has no tokens.

        Words between which both tokenizers have ends are encoded as one text.
        """
        joined = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        whole = ["".join(g) for g in joined]
        a, b, sizes = [], [], []
        # encodings are large, so only some are there at a time
        each = chain.from_iterable(zip(*self._ids(whole[i : i + 16]), strict=True) for i in range(0, len(whole), 16))
        for group, text, (x, y) in zip(joined, whole, each, strict=True):
            size = [len(w.encode()) for w in group]
            ends = np.cumsum(size)
            apart = self._comes_back(text.encode(), x, y) and all(np.isin(ends, np.cumsum(n[i]), assume_unique=False).all() for n, i in ((self.length_a, x), (self.length_b, y)))
            if not apart or any(w[1:2].isspace() or w[-1].isspace() for w in group):
                x, y = [], []
                for k, (w, p, q) in enumerate(zip(group, *self._ids(group), strict=True)):
                    fine = self._comes_back(w.encode(), p, q)
                    size[k] *= fine
                    x += p if fine else []
                    y += q if fine else []
            a.append(x)
            b.append(y)
            sizes += size
        ids_a, ids_b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b))
        return Aligned(ids_a, ids_b, np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b])), np.cumsum(np.array(sizes, np.int64))

    def learn(self) -> None:
        """Know the words that have got numbers since last time."""
        words = list(islice(self.words, len(self.text), None))
        if not words:
            return
        both, ends = self.encode([w if w[0] == " " else " " + w for w in words])
        # groups, tokens and links of each word
        bounds = np.concatenate([[0], np.searchsorted(both.cuts, ends, side="right")])
        tokens = lambda e: np.diff(np.searchsorted(e, ends, side="right"), prepend=0)
        group, key, times = both.pairs(0, len(both.cuts))
        order = np.argsort(group, kind="stable")
        word = np.repeat(np.arange(len(words)), np.diff(bounds))[group[order]]
        links = np.bincount(word, minlength=len(words))
        self.text += both.texts(bounds)
        join = lambda old, new: np.concatenate([old, np.asarray(new, old.dtype)])
        self.start = join(self.start, len(self.pair) + np.cumsum(links) - links)
        self.links, self.n_groups = join(self.links, links), join(self.n_groups, np.diff(bounds))
        self.n_a, self.n_b = join(self.n_a, tokens(both.end_a)), join(self.n_b, tokens(both.end_b))
        self.n_links = join(self.n_links, np.bincount(word, times[order], len(words)))
        self.fine = join(self.fine, np.diff(ends, prepend=0) > 0)
        self.pair = join(self.pair, list(map(self.numbers.__getitem__, key[order].tolist())))
        self.times = join(self.times, times[order])


@cache
def aligner(byte_path: str, piece_path: str) -> Aligner:
    """The tokenizers of this worker."""
    return Aligner(byte_path, piece_path)


def _aligner(paths: tuple[str | None, str | None]) -> Aligner:
    return aligner(paths[0] or public_path(BYTE_VOCABULARY), paths[1] or public_path(PIECE_VOCABULARY))


def words_of(text: str) -> list[str]:
    """The blank and ``text``, cut where both tokenizers have an end; a word without the blank before it if that isn't its first character."""
    if not text:
        return []
    return CUT.split(" " + text) if CARELESS.search(text) else text.split(" ")


def planes(x: np.ndarray) -> bytes:
    """Numbers below 2^32 as four planes of bytes, which compress well when most are small."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


class _Pack:
    """Distinct pairs of documents, and results that don't need counts."""

    def __init__(self):
        self.pack = TaskContext.get().partitionId() << 24
        self.clear()

    def clear(self) -> None:
        self.pair, self.times, self.size, self.docs, self.n = [], [], [], [], 0

    def add(self, pair: np.ndarray, times: np.ndarray, size: np.ndarray, docs: tuple) -> None:
        for kept, new in ((self.pair, pair), (self.times, times), (self.size, size), (self.docs, docs)):
            kept.append(new)
        self.n += len(pair)

    def flush(self, keys: np.ndarray) -> pa.RecordBatch:
        pair, times, size = np.concatenate(self.pair), np.concatenate(self.times), np.concatenate(self.size)
        used, at = np.unique(pair, return_inverse=True)
        # a document's pairs ascend, so that steps are small
        step = np.diff(at, prepend=0)
        first = (np.cumsum(size) - size)[size > 0]
        step[first] = at[first]
        docs = [list(chain.from_iterable(c)) for c in zip(*self.docs, strict=True)]
        row = [self.pack, keys[used], np.bincount(at, minlength=len(used)).astype(np.int32), size.astype(np.int32), planes(step), planes(times), *docs]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string())]
        self.pack += 1
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in SHORT.split(", ")])


def _short(paths: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs of short texts."""
    known, pack = _aligner(paths), _Pack()
    for rows, data, offsets in chunks(batches, limit=BATCH):
        ids = rows.column(rows.schema.get_field_index("doc_id")).to_pylist()
        raw, at = data.tobytes(), offsets.tolist()
        if len(known.words) > KEPT:
            if pack.n:
                yield pack.flush(known.keys())
            known.forget()
        # nothing here is cyclic, and the collector would go through all kept words again and again
        gc.disable()
        try:
            number = known.words.__getitem__
            found = [list(map(number, words_of(raw[i:j].decode()))) for i, j in zip(at[:-1], at[1:], strict=True)]
            known.learn()
        finally:
            gc.enable()
        if not known.fine.all():
            found = [f if known.fine[f].all() else [] for f in found]
        word = np.fromiter(chain.from_iterable(found), np.int64)
        doc = np.repeat(np.arange(len(found)), list(map(len, found)))
        total = lambda x: np.bincount(doc, x[word], len(found)).astype(np.int64).tolist()
        n = known.links[word]
        where = np.repeat(known.start[word] - np.cumsum(n) + n, n) + np.arange(n.sum())
        key = np.repeat(doc, n) << 32 | known.pair[where]
        times = known.times[where]
        if (times > 1).any():
            key, inverse = np.unique(key, return_inverse=True)
            times = np.bincount(inverse, times, len(key)).astype(np.int64)
        else:
            key, times = np.unique(key, return_counts=True)
        texts = [";".join(map(known.text.__getitem__, f)) for f in found]
        sha = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]
        pack.add((key & 0xFFFFFFFF).astype(np.int32), times.astype(np.int32), np.bincount(key >> 32, minlength=len(found)), (ids, total(known.n_a), total(known.n_b), total(known.n_groups), total(known.n_links), sha))
        if pack.n >= PACK_PAIRS:
            yield pack.flush(known.keys())
    if pack.docs:
        yield pack.flush(known.keys())


def _spread(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of long texts (row, doc_id, at, part): whole words of about ``width`` characters with their blanks."""
    row = TaskContext.get().partitionId() << 40
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            text, at, i = " " + text, 0, 0
            while i < len(text):
                cut = CUT.search(text, i + width)
                j = cut.start() if cut else len(text)
                yield pa.RecordBatch.from_pydict({"row": [row], "doc_id": [doc_id], "at": [at], "part": [text[i:j]]})
                at, i = at + len(text[i:j].encode()), j
            row += 1


_FRAGMENT = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("cut", pa.bool_()), *[(c, pa.list_(pa.int32())) for c in ("pre_a", "pre_b", "post_a", "post_b")]])
_CLOSED = pa.schema([("ok", pa.bool_()), ("text", pa.string()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("key", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])


def _closed(both: Aligned, first: int, last: int) -> tuple:
    """Text, counts and distinct pairs of groups ``first`` to ``last`` - 1."""
    if first >= last:
        return True, "", 0, 0, 0, 0, [], []
    _, key, times = both.pairs(first, last)
    key, inverse = np.unique(key, return_inverse=True)
    n_a, n_b = (int(np.diff(np.searchsorted(g, [first, last]))[0]) for g in (both.group_a, both.group_b))
    return True, both.texts(np.array([first, last]))[0], n_a, n_b, last - first, int(times.sum()), key, np.bincount(inverse, times, len(key)).astype(np.int64)


def _fragments(paths: tuple, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fragment of each byte range of ``width`` in each part."""
    known = _aligner(paths)
    schema = pa.schema([*_FRAGMENT, *_CLOSED])
    for rows in batches:
        for row, doc_id, at, text in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            words = CUT.split(text)
            both, ends = known.encode(words)
            if not (np.diff(ends, prepend=0) > 0).all():
                out = [[row], [doc_id], [at], [False], [[]], [[]], [[]], [[]], [False], [""], [0], [0], [0], [0], [[]], [[]]]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)
                continue
            for r in range(at // width, (at + int(both.end_a[-1]) - 1) // width + 1):
                ends = [r * width - at, (r + 1) * width - at]
                (i, j), (k, m), (x, y) = (np.searchsorted(e, ends, side="right").tolist() for e in (both.end_a, both.end_b, both.cuts))
                if i == j and k == m:
                    continue
                if x == y:
                    opened = [both.a[i:j], both.b[k:m], [], []]
                else:
                    pa_, qa = np.searchsorted(both.end_a, [both.cuts[x], both.cuts[y - 1]], side="right").tolist()
                    pb, qb = np.searchsorted(both.end_b, [both.cuts[x], both.cuts[y - 1]], side="right").tolist()
                    opened = [both.a[i:pa_], both.b[k:pb], both.a[qa:j], both.b[qb:m]]
                out = [row, doc_id, max(at, r * width), x < y, *opened, *_closed(both, x + 1, y)]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(out, schema, strict=True)], schema=schema)


def compose(fragments: list[dict]) -> tuple[dict, list[dict]]:
    """One fragment of neighbours in order, and the groups that close between them; ``at`` of a group is that of the fragment it closes in."""
    first_of = lambda f: f["at"] if f.get("first") is None else f["first"]
    done, bridges = dict(fragments[0]), []
    done["first"] = first_of(done) if done["cut"] else None
    for f in fragments[1:]:
        side, first = "post" if done["cut"] else "pre", first_of(f)
        a, b = done[f"{side}_a"] + f["pre_a"], done[f"{side}_b"] + f["pre_b"]
        if not f["cut"]:
            done[f"{side}_a"], done[f"{side}_b"] = a, b
            continue
        if done["cut"]:
            bridges.append({"at": first, "pre_a": a, "pre_b": b})
        else:
            done |= {"cut": True, "pre_a": a, "pre_b": b, "first": first}
        done["post_a"], done["post_b"] = f["post_a"], f["post_b"]
    return done, bridges


_STEP = pa.schema([*_FRAGMENT, ("first", pa.int64()), ("closes", pa.bool_())])


def _step(table: pa.Table) -> pa.Table:
    """One step of the tree: rows that close are groups, the other one is the composed fragment."""
    fragments = sorted(table.to_pylist(), key=lambda f: f["at"])
    done, bridges = compose(fragments)
    same = {"row": done["row"], "doc_id": done["doc_id"]}
    out = [{**done, "closes": False}] + [{**same, **g, "cut": True, "post_a": [], "post_b": [], "first": None, "closes": True} for g in bridges]
    return pa.Table.from_pylist(out, _STEP)


def _bridged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text and pairs of single groups."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), *_CLOSED])
    for b in batches:
        for g in b.to_pylist():
            both = Aligned(np.array(g["pre_a"], np.int64), np.array(g["pre_b"], np.int64), np.arange(-len(g["pre_a"]), 0) + 1, np.arange(-len(g["pre_b"]), 0) + 1)
            # only the last ends are common
            both.cuts, both.group_a, both.group_b = both.cuts[-1:], np.zeros(len(both.a), np.int64), np.zeros(len(both.b), np.int64)
            out = [g["row"], g["doc_id"], g["at"], *_closed(both, 0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(out, schema, strict=True)], schema=schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the groups of each row; rows come in order."""
    row, sha, empty = None, None, True
    done = lambda: pa.RecordBatch.from_pydict({"row": [row], "groups_sha256": [sha.hexdigest()]})
    for b in batches:
        for r, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if r != row:
                if row is not None:
                    yield done()
                row, sha, empty = r, hashlib.sha256(), True
            if text:
                sha.update(text.encode() if empty else b";" + text.encode())
                empty = False
    if row is not None:
        yield done()


def _tree(fragments: DataFrame, width: int) -> DataFrame:
    """Groups that close between byte ranges (row, doc_id, at, text, counts, pairs): a tree reduction of the open parts."""
    level = fragments.filter("ok").select(*_FRAGMENT.names, F.lit(None).cast("long").alias("first"))
    top = fragments.agg(F.max("at")).first()[0] or 0
    groups = []
    span = width
    while True:
        span *= FAN
        schema = f"{FRAGMENT}, first long, closes boolean"
        met = stage(level.groupBy("row", F.floor(F.col("at") / span).alias("span")).applyInArrow(_step, schema))
        groups.append(met.filter("closes"))
        level = met.filter("NOT closes").drop("closes")
        if span > top:
            break
    # what is before the first common end of a text is its first group
    groups.append(level.withColumn("at", F.col("first")).withColumn("closes", F.lit(True)))
    out = groups[0]
    for g in groups[1:]:
        out = out.unionByName(g)
    return stage(out.select("row", "doc_id", "at", "pre_a", "pre_b").mapInArrow(_bridged, f"row long, doc_id long, at long, {CLOSED}"))


def _answered(left: pa.Table, right: pa.Table) -> pa.Table:
    """Results of a pack's documents, by the counts of its pairs."""
    if not len(left):
        return pa.Table.from_pylist([], _RESULT)
    p = {c: left.column(c)[0] for c in left.column_names}
    size = np.asarray(p["size"].values)
    doc = np.repeat(np.arange(len(size)), size)
    step, times = from_planes(p["at"].as_py()), from_planes(p["times"].as_py())
    # sums of steps from each document's start
    at = np.cumsum(step)
    first = (np.cumsum(size) - size)[size > 0]
    if len(first):
        at -= np.repeat(at[first] - step[first], size[size > 0])
    order = np.argsort(np.asarray(right.column("nth")))
    n, best = np.asarray(right.column("n"))[order], np.asarray(right.column("best"))[order]
    run = np.concatenate([[0], np.cumsum(times * n[at])])
    end = np.cumsum(size)
    sums, bests = run[end] - run[end - size], np.bincount(doc, times * best[at], len(size)).astype(np.int64)
    out = [p[c].values for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + [pa.array(bests), pa.array(sums), p["sha"].values]
    return pa.Table.from_arrays(out, schema=_RESULT)


_RESULT = pa.schema([*[(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups_sha256", pa.string())])


def align_documents(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, width: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """Alignment of each document, and the linked ids (a, b, n: documents that hold them linked, best: whether n is the highest of a).

    Documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. ``docs``: doc_id (null: left out), text; other columns are ignored;
    repeated rows are documents of their own. Null and empty texts, and those that a side doesn't give back byte by byte, have no tokens: zeros and an empty
    string. ``width``: bytes of a range; texts above are spread over tasks. An empty table gives no rows.
    A group's distinct pairs are made in one task; groups end at least where a blank stands between visible characters.
    """
    paths = (byte_path, piece_path)
    docs = keyed(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    long = F.coalesce(F.octet_length("text"), F.lit(0)) > width
    packs = stage(docs.filter(~long).mapInArrow(partial(_short, paths), SHORT))
    parts = stage(docs.filter(long).mapInArrow(partial(_spread, width), "row long, doc_id long, at long, part string"))
    fragments = stage(parts.repartition("row", "at").mapInArrow(partial(_fragments, paths, width), f"{FRAGMENT}, {CLOSED}"))
    lost = fragments.filter("NOT ok").select("row").distinct()
    names = [c.split()[0] for c in CLOSED.split(", ")]
    groups = fragments.select("row", "doc_id", F.col("at"), F.lit(1).alias("nth"), *names).join(lost, "row", "left_anti")
    bridges = _tree(fragments.join(lost, "row", "left_anti"), width).withColumn("nth", F.lit(0))
    closed = groups.unionByName(bridges)
    pairs = closed.select("row", F.explode(F.arrays_zip("key", "times")).alias("p")).groupBy("row", F.col("p.key").alias("key")).agg(F.sum("p.times").alias("times"))
    pairs = stage(pairs)
    held = packs.select(F.explode(F.arrays_zip("key", "held")).alias("p")).select("p.key", F.col("p.held").cast("long").alias("n"))
    counts = stage(held.unionByName(pairs.select("key", F.lit(1).cast("long").alias("n"))).groupBy("key").agg(F.sum("n").alias("n")))
    a = F.shiftright("key", 32).alias("a")
    top = counts.groupBy(a).agg(F.max("n").alias("top"))
    counts = counts.withColumn("a", a).join(top, "a").select("key", "a", F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"), "n", (F.col("n") == F.col("top")).alias("best"))
    # short texts: answers go back to the pack
    asked = packs.select(F.col("pack").alias("of_pack"), F.posexplode("key").alias("nth", "key")).join(counts, "key").select("of_pack", "nth", "n", "best")
    short = packs.drop("key", "held").groupBy("pack").cogroup(asked.groupBy("of_pack")).applyInArrow(_answered, RESULT)
    # long texts
    digests = closed.select("row", "text", "at", "nth").repartition("row").sortWithinPartitions("row", "at", "nth").select("row", "text").mapInArrow(_digests, "row long, groups_sha256 string")
    totals = closed.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")])
    sums = pairs.join(counts, "key").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    each = parts.select("row", "doc_id").distinct().join(totals, "row", "left").join(sums, "row", "left").join(digests, "row", "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    spread = each.select("doc_id", *zero, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    return short.unionByName(spread), counts.select("a", "b", "n", "best")
