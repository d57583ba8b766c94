"""Ranked search and packing against brute force on small tables with nulls, empties, repeats, ties and clashing columns."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import connect, rows
from pyspark.sql import functions as F

from reportlake.llm import packing, queries, ranked, vocab

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, score long, rank int, size int, query long, row long, gap int"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus():
    rng = random.Random(5)
    vocabulary = ["the", "of", "Über", "naïve", "ÉTÉ", "x1"] + [f"w{i}" for i in range(150)]
    make = lambda n: ", ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [None, "", "  \n\t ", "--- !!", "one", make(40), make(4000), "\x00a\x7fB\x00", "the " * 900, "日本語 テキスト 日本語", "à é  x", "z" * 3000]
    texts += [make(rng.randrange(1, 60)) for _ in range(80)]
    texts += [texts[5]] * 6
    out = [(i * 3, t, 9, 1, 7, 5, 3, 2) for i, t in enumerate(texts)]
    return [*out, out[5], (out[4][0], "one the of", 9, 1, 7, 5, 3, 2)]


@pytest.fixture(scope="module")
def table():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, table):
    return spark.createDataFrame([*table, (None, "the one w1", 0, 0, 0, 0, 0, 0)], SCHEMA).repartition(5)


def brute(table, text, k):
    terms = [Counter(TERM.findall((t or "").translate(LOW))) for _, t, *_ in table]
    sizes = [sum(c.values()) for c in terms]
    n_docs, total = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for c in terms for t in c)
    found = []
    for (doc_id, *_), c, n in zip(table, terms, sizes, strict=True):
        score = 0
        for t in set(TERM.findall(text.translate(LOW))):
            if c[t]:
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * (10 + 90 * n * n_docs // total)))
        if score > 0:
            found.append((-score, doc_id))
    return [(i + 1, d, -s) for i, (s, d) in enumerate(sorted(found)[:k])]


def asked(table):
    rng = random.Random(8)
    texts = ["the of", "ONE", "nothing matches", "", None, "日本語", "w1 w2 w3 w1", "été ÉTÉ", table[5][1]]
    return [(i, t) for i, t in enumerate(texts + [" ".join(f"w{rng.randrange(150)}" for _ in range(12)) for _ in range(20)])]


def by_item(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.item_id].append((r["rank"], r.doc_id, r.score))
    return {i: sorted(v) for i, v in out.items()}


@pytest.mark.parametrize("block", [2048, 4])
def test_ranks_are_those_of_brute_force(spark, docs, table, monkeypatch, block):
    monkeypatch.setattr(ranked, "BLOCK_ITEMS", block)
    items = spark.createDataFrame([(*r, 4, 5) for r in asked(table)] + [(None, "the", 4, 5)], "item_id long, text string, score int, query int")
    want = {i: b for i, t in asked(table) if (b := brute(table, t or "", 10))}
    assert by_item(ranked.rank_documents(docs, items)) == want


def test_repeated_items_have_ranks_of_their_own(spark, docs, table):
    items = spark.createDataFrame([(1, "w1"), (1, "w2")], "item_id long, text string")
    assert by_item(ranked.rank_documents(docs, items, 3))[1] == sorted(brute(table, "w1", 3) + brute(table, "w2", 3))


def test_empty_tables_of_search(spark, docs):
    none, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert ranked.rank_documents(none, items).isEmpty()
    assert ranked.rank_documents(docs, items.limit(0)).isEmpty()


def shard(seed, n_docs=400, n_terms=30):
    rng = np.random.default_rng(seed)
    docs, adds, start = [], [], [0]
    for t in range(n_terms):
        where = np.sort(rng.choice(n_docs, min(n_docs, 2 + t * t // 3), replace=False))
        docs.append(where)
        adds.append(rng.integers(1, 2000 // (t + 1) + 2, len(where)))
        start.append(start[-1] + len(where))
    return np.array(start), np.concatenate(docs), np.concatenate(adds)


@pytest.mark.parametrize("seed", range(8))
def test_accumulators_are_limited_and_survivors_exact(seed):
    start, docs, adds = shard(seed)
    best = np.maximum.reduceat(adds, start[:-1])
    exact = np.bincount(docs, adds, 400).astype(int)
    found, score, alive = ranked.search_shard(list(range(30)), start, docs, adds, best, 400, 10, 0)
    assert (exact[found] == score).all()
    kth = np.sort(exact)[-10]
    assert set(np.flatnonzero(exact >= kth)) <= set(found)
    assert alive < 400
    # a score that is reached already leaves fewer
    again, score, fewer = ranked.search_shard(list(range(30)), start, docs, adds, best, 400, 10, int(kth))
    assert fewer <= alive and set(again) == set(np.flatnonzero(exact >= kth)) and (exact[again] == score).all()
    assert ranked.search_shard(list(range(30)), start, docs, adds, best, 400, 10, int(best.sum()) + 1)[2] == 0


def test_search_query_is_its_sql(spark):
    got = queries.QUERIES["op11_ranked_search"](spark, DIR).toPandas()
    assert rows(got) == rows(connect(DIR).sql(queries.ORACLE["op11_ranked_search"]).df())


def plain_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocab.public_path("word_bpe_49k.json")).encode(text or "", add_special_tokens=False).ids + [0]


def check_packed(got, texts, capacity):
    """Pieces hold the ids of brute force; sequences are gapless and within their capacity."""
    want = []
    for d, t in texts:
        ids = plain_ids(t)
        for i in range(0, len(ids), capacity):
            part = ids[i : i + capacity]
            want.append((d, i // capacity, i, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


@pytest.mark.parametrize("capacity", [2048, 64, 7])
def test_packing_keeps_all_ids(spark, docs, table, capacity):
    got = packing.pack_documents(docs, capacity=capacity).collect()
    check_packed(got, [r[:2] for r in table], capacity)


def test_packing_of_an_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA)).isEmpty()


def best_fit_decreasing(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else capacity) - s)
    return len(gaps)


@pytest.mark.parametrize("kind", ["mixed", "same", "large", "small"])
def test_few_sequences(spark, kind):
    rng = random.Random(kind)
    make = {"mixed": lambda: min(999, int(rng.paretovariate(0.7)) * 9), "same": lambda: 300, "large": lambda: rng.randrange(400, 999), "small": lambda: rng.randrange(1, 9)}[kind]
    sizes = [make() for _ in range(1500)]
    items = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "row long, size int").repartition(6)
    got = packing.best_fit(items, 1000).collect()
    assert sorted((r.row, r["size"]) for r in got) == list(enumerate(sizes))
    load = Counter()
    for r in got:
        load[r.sequence_id] += r["size"]
    assert max(load.values()) <= 1000
    assert len(load) <= best_fit_decreasing(sizes, 1000) * 1.02 + 1


def test_sweep_is_best_fit_of_one_round():
    rng = random.Random(4)
    for _ in range(40):
        sizes, gaps = np.zeros(51, int), np.zeros(51, int)
        for _ in range(rng.randrange(1, 60)):
            sizes[rng.randrange(1, 50)] += 1
        for _ in range(rng.randrange(0, 40)):
            gaps[rng.randrange(1, 51)] += 1
        left, want = Counter({g: int(n) for g, n in enumerate(gaps) if n}), Counter()
        for s in range(50, 0, -1):
            for _ in range(int(sizes[s])):
                fits = [g for g, n in left.items() if n and g >= s]
                if fits:
                    left[min(fits)] -= 1
                    want[min(fits), s] += 1
        got = Counter()
        for gap, _, used, size, _, placed in packing.sweep(sizes, gaps, np.zeros(51, int), 1):
            assert used == placed
            got[gap, size] += used
        assert got == want


def test_long_texts_are_encoded_in_parts(monkeypatch):
    encoder = vocab.WordIds(vocab.public_path("word_bpe_49k.json"))
    text = "  Some words, don't stop İX Σας ẖH̱ x\x1cy <|endoftext|> 12 345\n\n" * 40 + "z" * 200
    monkeypatch.setattr(vocab, "SLICE", 50)
    monkeypatch.setattr(vocab, "KEPT", 20)
    got = b"".join(encoder.stream(text.encode()))
    assert np.frombuffer(got, "<u4").tolist() == plain_ids(text)[:-1]


def test_packing_query(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op12_best_fit_packing"](spark, DIR).collect()
    n = check_packed(got, texts, 2048)
    assert n <= -(-sum(r.length for r in got) // 2048) * 1.02 + 1
