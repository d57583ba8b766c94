"""Training-data operators against brute force on small tables with nulls, empties, repeats, ties and clashing columns."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from reportlake.llm import bloom, ctxmix, graph, jaccard, mixing, nbsvm, phrases, secrets, sharding, spotsigs, textnum, tiling, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, copies int, n int, label string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def corpus():
    rng = random.Random(3)
    vocabulary = ["the", "and", "of"] + [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(300)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = make(60), make(120)
    texts = [None, "", "  \n\t ", "one", "one two three", base, base, base + " tail", base.replace("the", "teh", 1), make(200) + " " + passage, passage + "\n" + make(90), "rep " * 80, make(3000), passage]
    for i in range(20):
        w = base.split()
        w[rng.randrange(len(w))] = f"edit{i}"
        texts.append(" ".join(w))
    texts += [make(rng.randrange(1, 80)) for _ in range(20)]
    rows = [(i * 3, t, "en" if i % 2 else None, [None, "a", "b", "ä"][i % 4], None if t is None else len(t), 1.5, 9, 7, "x") for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([*rows, (None, "no key", None, None, 6, 0.0, 0, 0, None)], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_hashes_do_not_depend_on_place():
    raw = ["a bb a", "", "bb\x0bccé", "a"]
    data = np.frombuffer("".join(raw).encode(), np.uint8)
    offsets = np.cumsum([0, *[len(x.encode()) for x in raw]])
    w = textnum.Words(data, offsets)
    assert w.counts.tolist() == [3, 0, 2, 1]
    assert w.hash[0] == w.hash[2] == w.hash[5] and w.hash[1] == w.hash[3] != w.hash[0]
    assert [w.word_bytes(*w.bounds[i : i + 2]).decode() for i in range(4)] == ["a bb a", "", "bb ccé", "a"]


def test_word_hashes_of_long_texts(monkeypatch):
    rng = random.Random(1)
    raw = " ".join("x" * rng.randrange(1, 9) + str(i % 13) for i in range(2000)).encode() + b" " + b"y" * 300
    data, offsets = np.frombuffer(raw, np.uint8), np.array([0, 700, 700, len(raw)])
    whole = textnum.Words(data, offsets)
    monkeypatch.setattr(textnum, "PIECE", 64)
    parts = textnum.Words(data, offsets)
    assert (whole.hash == parts.hash).all() and len(set(whole.hash.tolist())) == len(set(whole.word_bytes(i, i + 1) for i in range(len(whole.hash))))


def without_repeats(rows, width):
    """(doc_id, words, words removed, kept text) of each row, by definition."""
    seqs = [(r[0], words(r[1])) for r in rows]
    count = Counter(tuple(w[i : i + width]) for _, w in seqs for i in range(len(w) - width + 1))
    out = []
    for d, w in seqs:
        gone = {j for i in range(len(w) - width + 1) if count[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


@pytest.mark.parametrize("block", [phrases.BLOCK_BYTES, 400])
def test_substring_dedup(docs, empty, rows, block, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", block)
    got = phrases.remove_repeats(docs, 12, 5).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == without_repeats(rows, 12)
    assert all(r.kept_sha256 == hashlib.sha256(r.kept_text.encode()).hexdigest() for r in got)
    assert phrases.remove_repeats(empty).count() == 0


def test_substring_dedup_of_rows_that_share_a_doc_id(spark):
    rng = random.Random(1)
    a, b = (" ".join(f"v{rng.randrange(900)}" for _ in range(n)) for n in (42, 40))
    rows = [(1, a), (1, "short text"), (2, b + " " + a), (2, None), (3, b), (4, "x " * 90), (5, b), (5, b), (6, "y z " * 40 + a[:80])]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = phrases.remove_repeats(d).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == without_repeats(rows, 35)
    bare = phrases.remove_repeats(d, keep_text=False)
    assert bare.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"] and bare.count() == len(rows)


def test_substring_dedup_marks_only_what_the_automata_match(monkeypatch):
    """Without its matches nothing is marked: the patterns come from other pieces than those that they are found in."""
    raw = ["a b c d e f", "z a b c d e f", "b c d e y"]
    w = textnum.Words(np.frombuffer("".join(raw).encode(), np.uint8), np.cumsum([0, *map(len, raw)]))
    patterns = phrases._confirmed(w, 4, np.zeros(3, np.int64), np.ones(3, np.int64))
    assert sorted(patterns.tolist()) == [0, 1, 2]
    assert phrases._matches(w, 4, patterns, np.arange(3)) == [(0, [0], [6]), (1, [1], [7]), (2, [0], [4])]

    class Silent:
        def __len__(self):
            return 1

        add_word = make_automaton = lambda *_: None
        iter = lambda *_: iter(())

    monkeypatch.setattr(phrases.ahocorasick, "Automaton", Silent)
    assert phrases._matches(w, 4, patterns, np.arange(3)) == []


def shingles(text, k):
    w = words((text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize("rare", [jaccard.RARE, 1])
def test_jaccard_components(docs, empty, rows, rare, monkeypatch):
    monkeypatch.setattr(jaccard, "RARE", rare)
    if rare == 1:
        monkeypatch.setattr(jaccard, "ROUNDS", 1)
    sets = {r[0]: shingles(r[1], 4) for r in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, 4, 85, 100).collect()}
    assert got == {d: (len(s), find(d)) for d, s in sets.items()}
    if rare > 1:
        assert jaccard.jaccard_components(empty).count() == 0


def test_sets_are_paired_where_their_places_leave_room(spark, monkeypatch):
    """Texts with 128 of 1,500 shingles of their own share nearly all others, but no two link: none of their keys is near the start of two sets."""
    rng, base, seen = random.Random(3), [f"w{i}" for i in range(1503)], []
    texts = [list(base) for _ in range(40)]
    for d, t in enumerate(texts):
        for at in rng.sample(range(1, 375), 32):
            t[4 * at] = f"own{d}x{at}"
    verified = jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *a: (seen.append(pairs.count()), verified(pairs, *a))[1])
    monkeypatch.setattr(jaccard, "ROUNDS", 0)
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()} == {d: d for d in range(40)}
    assert sum(seen) < 40


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 8), (2, 5)], "a long, b long")
    assert {r.id: r.component for r in graph.components(links).collect()} == {2: 2, 3: 2, 4: 2, 5: 2, 7: 7, 8: 7, 9: 7}


def test_components_are_merged_by_further_links(spark):
    rng = random.Random(3)
    edges, label, parent = [], None, {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for _ in range(4):
        new = [(rng.randrange(60), rng.randrange(60)) for _ in range(12)]
        edges += new
        for a, b in new:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
        label = graph.merged(label, spark.createDataFrame([e for e in new if e[0] != e[1]], "a long, b long"))
        got = {r.id: r.component for r in label.collect()}
        assert all(got[v] == find(v) for v in got) and {v for e in edges if e[0] != e[1] for v in e} == set(got)
    assert {r.id: r.component for r in graph.merged(label, spark.createDataFrame([], "a long, b long")).collect()} == got


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(1000).select(F.xxhash64("id").alias("k"))
    mask = bloom.build(keys, 1024)
    values = np.array([r.k for r in keys.collect()], np.int64).view(np.uint64)
    assert bloom.test(mask, values).all()
    assert bloom.test(mask, np.arange(5000, dtype=np.uint64)).mean() < 0.1


def test_tiling_covers_reordered_passages():
    item = np.arange(30, dtype=np.uint64)
    doc = np.concatenate([item[15:], np.array([99, 98], np.uint64), item[:15]])
    found = tiling.tiles(doc, item)
    assert sum(n for _, _, n in found) == 30 and len(found) == 2
    assert tiling.tiles(doc[:4], item) == [] and tiling.tiles(np.zeros(0, np.uint64), item) == []


def test_tiling_is_greedy_and_disjoint():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.integers(0, 4, 60).astype(np.uint64), rng.integers(0, 4, 40).astype(np.uint64)
        found = tiling.tiles(a, b, 3)
        for s, t, n in found:
            assert (a[s : s + n] == b[t : t + n]).all() and n >= 3
        for side in (0, 1):
            used = [i for x in found for i in range(x[side], x[side] + x[2])]
            assert len(used) == len(set(used))
        assert [n for *_, n in found] == sorted((n for *_, n in found), reverse=True)


def test_decontamination(spark, docs, empty):
    rng = random.Random(9)
    item = " ".join(f"q{rng.randrange(10**6)}" for _ in range(40))
    w = item.split()
    texts = [(1, "x y " + item.upper()), (2, " ".join(w[20:] + ["zz"] + w[:20])), (3, " ".join(w[:15])), (4, None), (5, ""), (6, item), (6, item)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item, 1), (8, None, 1), (9, "too short", 1), (None, item, 1)], "item_id long, text string, doc_id int")
    got = sorted((r.doc_id, r.item_id, round(r.coverage, 3)) for r in tiling.contaminated(d, bench).distinct().collect())
    assert got == [(1, 7, 1.0), (2, 7, 1.0), (6, 7, 1.0)]
    assert tiling.contaminated(empty, bench).count() == 0 and tiling.contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_of_items_with_repeats_and_of_short_items(spark):
    repeats = "alpha beta gamma " * 20
    texts = [(1, "x " + repeats + "y"), (2, "see Two Words here"), (3, "two x words"), (4, "words two"), (5, "alpha beta gamma " * 11), (6, "two")]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame([(1, repeats), (2, "two words"), (3, ""), (4, "a b c d")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_tiles, r.longest, round(r.coverage, 3)) for r in tiling.contaminated(d, bench).collect())
    # document 5 holds 33 of 60 words once
    assert got == [(1, 1, 1, 60, 1.0), (2, 2, 1, 2, 1.0)]


def plain_tiles(a, b, k):
    """Greedy string tiling by comparing all places."""
    free_a, free_b, found = [True] * len(a), [True] * len(b), []
    while True:
        best = (k - 1, 0, 0)
        for t in range(len(b)):
            for s in range(len(a)):
                n = 0
                while s + n < len(a) and t + n < len(b) and a[s + n] == b[t + n] and free_a[s + n] and free_b[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, s, t)
        n, s, t = best
        if n < k:
            return found
        found.append((s, t, n))
        free_a[s : s + n] = [False] * n
        free_b[t : t + n] = [False] * n


def test_tiling_against_brute_force():
    rng = np.random.default_rng(7)
    for i in range(150):
        letters, k = 1 + i % 5, 1 + i % 4
        a, b = rng.integers(0, letters, rng.integers(0, 30)), rng.integers(0, letters, rng.integers(0, 22))
        if i % 3 == 0:
            a, b = np.tile(np.arange(letters), 8), np.tile(np.arange(letters), 5)[i % 4 :]
        want = plain_tiles(a.tolist(), b.tolist(), k)
        assert tiling.tiles(textnum.mix(a.astype(np.uint64)), textnum.mix(b.astype(np.uint64)), k) == want


def test_tiling_of_long_repeats():
    a, b = np.tile(np.arange(3, dtype=np.uint64), 1000), np.tile(np.arange(3, dtype=np.uint64), 20)
    assert tiling.tiles(a, b) == [(0, 0, 60)]
    # 20,000 equal words against 5,001, twice broken
    one = np.ones(20_000, np.uint64)
    item = np.ones(5001, np.uint64)
    item[[1000, 3000]] = 5
    assert tiling.tiles(one, item) == [(0, 3001, 2000), (2000, 1001, 1999), (3999, 0, 1000)]


@pytest.mark.parametrize("rows", [0, tiling.BROADCAST_ROWS])
def test_decontamination_against_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(tiling, "BROADCAST_ROWS", rows)
    rng = random.Random(11)
    item = lambda n, m: [f"t{rng.randrange(m)}" for _ in range(n)]
    items = [item(30, 500), item(25, 4), item(40, 3), item(12, 500), ["a", "b", "c"], item(60, 2)]
    docs = []
    for i in range(60):
        w = [x for part in rng.sample(items, 2) for x in part[rng.randrange(6) : rng.randrange(8, 50)]] + item(rng.randrange(20), 6)
        docs.append((i, " ".join(w)))
    docs.append((99, "repeat " * 20_000))
    bench = [(i, " ".join(w)) for i, w in enumerate(items)]
    bench.append((50, "repeat " * 30))
    want = set()
    for d, text in docs[:-1]:
        for i, x in bench:
            a, b = text.split(), x.split()
            tiles = plain_tiles(a, b, min(5, len(b)))
            if sum(n for *_, n in tiles) >= 0.6 * len(b):
                want.add((d, i, len(tiles)))
    got = {(r.doc_id, r.item_id, r.n_tiles) for r in tiling.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == want | {(99, 50, 1)} and len(want) > 20


def test_trigram_queries():
    assert secrets.trigram_query(r"[0-9a-f]{24,}") == []
    assert secrets.trigram_query(secrets.BASE_RULES[1].pattern) == [[frozenset({"aki", "kia"})]]
    assert secrets.trigram_query(r"AKIA[A-Z0-9]+") == [[frozenset({"aki", "kia"})]]
    for rule, sample in ((secrets.BASE_RULES[0], "PassWd='abcdef'"), (secrets.MORE_RULES[0], "ghp_" + "a" * 36), (secrets.MORE_RULES[1], "-----BEGIN RSA PRIVATE KEY-----")):
        low = sample.lower()
        for clause in secrets.trigram_query(rule.pattern):
            assert any(all(t in low for t in a) for a in clause), rule.kind


def test_secrets(spark, empty):
    key, h = "AKIA" + "Z9" * 8, "0123456789abcdef" * 2
    texts = [(1, f"é password = 'abcdef' {key} x {h}"), (2, "token: abc secret=token:abcdefg"), (3, None), (4, ""), (5, "AKIA short, deadbeef"), (6, f"API_KEY={h}"), (6, f"API_KEY={h}"), (7, "ghp_" + "a" * 40)]
    d = spark.createDataFrame(texts, "doc_id long, text string").withColumn("found", F.lit(1)).withColumn("kinds", F.lit(2))
    rules = secrets.BASE_RULES + secrets.MORE_RULES
    got = [(r.doc_id, r.s) for r in secrets.scan_secrets(d, rules).select("doc_id", secrets.spans_text(F.col("found"), rules).alias("s")).collect()]
    want = []
    for i, t in texts:
        t, spans = t or "", []
        for m in re.finditer(secrets.BASE_RULES[0].pattern, t, re.A):
            if len(m[2]) >= 6:
                spans.append((m.start(), 0, m.end()))
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        spans += [(m.start(), 3, m.end()) for m in re.finditer("gh[pousr]_[A-Za-z0-9]+", t) if len(m[0]) >= 40]
        want.append((i, ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in sorted(spans))))
    assert sorted(got) == sorted(want)
    assert secrets.scan_secrets(empty).count() == 0


def test_secrets_of_rows_that_share_a_doc_id(spark, empty):
    h = "0123456789abcdef" * 2
    many = " ".join(f"token=abc{i:06d}" for i in range(3000))
    texts = [(1, f"hex {h}"), (1, "nothing"), (1, None), (2, many), (2, many), (3, f"{h} AKIA{'B' * 15} AKIA{'C' * 16}")]
    d = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, [tuple(x) for x in r.found]) for r in secrets.scan_secrets(d).collect())
    tokens = [(i * 16, 0, i * 16 + 15) for i in range(3000)]
    assert got == sorted([(1, [(4, 2, 36)]), (1, []), (1, []), (2, tokens), (2, tokens), (3, [(0, 2, 32), (53, 1, 73)])])


def test_lm_base_and_score(docs, empty, rows):
    learn = F.col("doc_id") % 2 == 1
    got = {r.doc_id: r for r in ctxmix.score_documents(docs, learn).collect()}
    seqs = {r[0]: words((r[1] or "").translate(LOW)) + ["\0end"] for r in rows}
    c = Counter(x for d, w in seqs.items() if d % 2 for x in w)
    n, v = sum(c.values()), len(c)
    assert set(got) == set(seqs)
    for d, w in seqs.items():
        assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(got[d].base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), abs_tol=1e-6)
        assert -10 * (len(w) + 1) * 5 < got[d].score < 0
    long = max(seqs, key=lambda d: len(seqs[d]))
    assert got[long].bits_per_byte < 8
    small = ctxmix.score_documents(docs, learn, max_words=5)
    for r in small.select("doc_id", "base_score", "n_known").collect():
        assert math.isclose(r.base_score, got[r.doc_id].base_score, abs_tol=1e-6) and r.n_known == got[r.doc_id].n_known
    assert ctxmix.score_documents(empty, learn).count() == 0


def test_lm_bits_are_a_code():
    """Probabilities of all continuations of a bit sum to one, so a text's cost is that of its bits."""
    code, length = ctxmix._huffman(np.arange(256))
    assert sum(2.0 ** -int(n) for n in length) == 1.0
    seen = {format(int(c), f"0{int(n)}b") for c, n in zip(code, length, strict=True)}
    assert len(seen) == 256 and not any(a != b and b.startswith(a) for a in seen for b in seen)


def test_lm_models_every_bit_of_a_word(spark):
    vocab = [f"w{i}" for i in range(300)]
    text = " ".join(w for i, w in enumerate(vocab) for _ in range(2 + i % 5))
    docs = spark.createDataFrame([(text,)], "text string")
    v, _ = ctxmix.vocabulary(docs.mapInArrow(ctxmix._count_words, "kind int, key long, n long"))
    rows = pa.RecordBatch.from_arrays([pa.array([" ".join([*vocab, text])]), pa.array([None], pa.list_(pa.int32())), pa.array([None], pa.list_(pa.binary()))], names=["text", "at", "ahead"])
    raw = rows.column(0)[0].as_py().encode()
    x = ctxmix._texts(v, rows, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    each = [ctxmix._events(v, x, np.array([i])) for i in range(len(vocab))]
    assert not any(e.raw.any() for e in each)
    # the modelled bits alone tell words apart
    codes = {"".join(map(str, e.bit.tolist())) for e in each}
    assert len(codes) == len(vocab) and not any(a != b and b.startswith(a) for a in codes for b in codes)


def plain_mix(e, tables, weights, texts):
    """Costs of texts bit by bit, with Python numbers."""
    cost = [float(x) for x in np.pad(e.raw, (0, texts - len(e.raw)))]
    for t in range(texts):
        w = {g: [float(x) for x in weights[g]] for g in range(ctxmix.GATES)}
        cells, seen = {}, Counter()
        mine = np.flatnonzero(e.text == t)
        for at in range(0, len(mine), ctxmix.STEP):
            step = []
            for i in mine[at : at + ctxmix.STEP]:
                g, y = int(e.gate[i]), int(e.bit[i])
                x = [float(tables[k][e.slots[k][i]]) for k in range(ctxmix.CONTEXTS)]
                z = sum(a * b for a, b in zip(w[g], x, strict=True))
                cell = (g, min(32, max(0, round(z * 2) + 16)))
                q = 1 / (1 + math.exp(-max(-20, min(20, z))))
                m = cells.setdefault(cell, 1 / (1 + math.exp(-(cell[1] - 16) / 2)))
                p = min(1 - 1e-6, max(1e-6, (q + m) / 2))
                cost[t] -= math.log2(p if y else 1 - p)
                step.append((g, y, x, q, cell, m))
            for g, y, x, q, cell, _ in step:
                seen[cell] += 1
                for k in range(ctxmix.CONTEXTS):
                    w[g][k] += ctxmix.RATE * (y - q) * x[k]
            for _, y, _, _, cell, m in step:
                cells[cell] += (y - m) / (ctxmix.MAP_PRIOR + seen[cell])
    return cost


def random_events(rng, sizes):
    text = np.repeat(np.arange(len(sizes)), sizes)
    n = len(text)
    gate = rng.integers(0, ctxmix.GATES, n).astype(np.int32)
    bit = (rng.random(n) < 0.2 + 0.6 * (gate % 2)).astype(np.uint8)
    return ctxmix.Events(bit, [rng.integers(0, 50, n).astype(np.int32) for _ in range(ctxmix.CONTEXTS)], gate, text, np.arange(len(sizes), dtype=float))


def test_lm_texts_of_like_length_are_scored_together(monkeypatch):
    monkeypatch.setattr(ctxmix, "CHUNK", 100)
    texts = ["x" * (i * 37 % 120) for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    parts = [[(len(t), d) for d, t in zip(*(c.to_pylist() for c in b.columns), strict=True)] for b in ctxmix._alike([batch])]
    assert [x for p in parts for x in p] == sorted((len(t), d) for d, t in enumerate(texts))
    assert all(len(p) == 1 or sum(n for n, _ in p) <= 100 for p in parts)
    assert list(ctxmix._alike([batch.slice(0, 0)])) == []


def test_lm_mixing_against_plain_python():
    rng = np.random.default_rng(2)
    tables = [rng.normal(0, 1, 50).astype(np.float32) for _ in range(ctxmix.CONTEXTS)]
    weights = rng.normal(0.4, 0.1, (ctxmix.GATES, ctxmix.CONTEXTS)).astype(np.float32)
    e = random_events(rng, [0, 5, 64, 700, 1, 130])
    got = ctxmix.Learner(ctxmix.Model(tables, weights), 6).cost(e)
    assert np.allclose(got, plain_mix(e, tables, weights, 6), rtol=1e-3, atol=0.05)


def test_lm_learns_within_short_texts():
    """A text of few bits that go against the model costs less a bit the longer it is, whatever is scored beside it."""
    model = ctxmix.Model([np.full(4, 1.0, np.float32)] * ctxmix.CONTEXTS, np.full((ctxmix.GATES, ctxmix.CONTEXTS), 0.4, np.float32))

    def cost(sizes):
        text = np.repeat(np.arange(len(sizes)), sizes)
        n = len(text)
        return ctxmix.Learner(model, len(sizes)).cost(ctxmix.Events(np.zeros(n, np.uint8), [np.zeros(n, np.int32)] * ctxmix.CONTEXTS, np.zeros(n, np.int32), text, np.zeros(len(sizes))))

    short, double = cost([64])[0], cost([128])[0]
    assert double < 1.9 * short
    many = cost([64, 128] * 400)
    assert np.allclose(many[::2], short, rtol=1e-4) and np.allclose(many[1::2], double, rtol=1e-4)


def test_lm_uses_all_documents_and_predicts_repeats(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(2000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, text(400)) for i in range(60)]
    rows += [(100, rows[1][1]), (101, rows[3][1] + " " + text(50)), (200, rows[2][1]), (3, "short"), (3, None), (7, rows[7][1])]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = ctxmix.score_documents(d, F.col("doc_id") < 200).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_tokens): r for r in got}
    # 100 and 1 predict each other, as do 101 and 3; 200 isn't learnt from, so 2 has nothing to be told by
    for key in ((100, 401), (1, 401), (101, 451), (3, 401), (200, 401)):
        assert by[key].n_predicted > 250 and by[key].bits_per_byte < 0.6 * by[(5, 401)].bits_per_byte, key
    assert by[(2, 401)].n_predicted == by[(5, 401)].n_predicted == by[(7, 401)].n_predicted == 0
    assert by[(3, 2)].n_tokens == 2 and by[(3, 1)].n_known == 1
    # long texts are cut into segments at fixed places: neighbours do not matter
    alone = {r.doc_id: r.score for r in ctxmix.score_documents(d.coalesce(1), F.col("doc_id") < 200).collect() if r.n_tokens == 401}
    assert all(math.isclose(r.score, alone[r.doc_id], rel_tol=1e-3) for r in got if r.n_tokens == 401)


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 1), ("b", 100), ("c", 100), (None, 40)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # a stops at 3; the rest of 241 goes to b, c and null by 2, 1 and 5, where null stops at 120
    assert got["a"] == 3.0 and got[None] == 120.0
    assert math.isclose(got["b"], 118 * 2 / 3) and math.isclose(got["c"], 118 / 3)


def test_mixing_plans_targets_once(docs):
    plan = mixing.mix_sources(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window ") == 1


def test_components_leave_nothing_with_the_driver(spark, monkeypatch):
    plans, real = [], graph.stage
    monkeypatch.setattr(graph, "stage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    label = graph.merged(None, spark.createDataFrame([(1, 2), (3, 4)], "a long, b long"))
    more = graph.merged(label, spark.createDataFrame([(2, 3), (4, 9)], "a long, b long"))
    assert sorted(map(tuple, more.collect())) == [(1, 1), (2, 1), (3, 1), (4, 1), (9, 1)]
    assert plans and not any("Broadcast" in p for p in plans)
    assert graph.merged(label, spark.createDataFrame([], "a long, b long")) is label


def test_mixing(spark, docs, empty, rows):
    got = mixing.mix_sources(docs).collect()
    again = {(r.doc_id, r.taken) for r in mixing.mix_sources(docs.repartition(2)).collect()}
    assert {(r.doc_id, r.taken) for r in got} == again and len(got) == len(rows)
    assert all(r.taken <= 3 * r["size"] and r["size"] == len(words(next(x[1] for x in rows if x[0] == r.doc_id))) for r in got)
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"))
    per = mixing.mix_sources(many).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
    for r in per:
        assert abs(r.taken - r.target) < 0.02 * r.target, r
    assert mixing.mix_sources(empty).count() == 0


def test_pivotal_sum_is_kept(spark):
    units = spark.range(1000).select("id", F.lit("s").alias("stratum"), (F.col("id") % 9 + 1).alias("size"), F.lit(0.3).alias("p"))
    chosen = [r.id for r in mixing.pivotal_round(units).collect()]
    assert len(chosen) == len(set(chosen)) and abs(len(chosen) - 300) <= 1


def plain_pivotal(units, block, seed):
    """Chosen ids of {stratum: [(id, size, p)]}, fold by fold."""
    chosen, live, level = [], [(s, math.floor(math.log2(z + 1) * 2), i, z, p) for s, rows in units.items() for i, z, p in rows], 0
    while True:
        n = Counter((s, c) for s, c, *_ in live)
        if level:
            n = Counter(s for s, *_ in live)
            if max(n.values()) <= 1:
                break
        blocks = {}
        for s, c, i, z, p in live:
            key, k = ((s, c), c) if not level else (s, 0)
            blocks.setdefault((s, k, xx(i, seed + level) % -(-n[key] // block)), []).append((z, i, p))
        live = []
        for (s, _, _), rows in blocks.items():
            rows.sort()
            size, at, a = rows[0]
            for z, i, p in rows[1:]:
                u = (xx(at, i, seed + level, wide=True) % (1 << 52) + 0.5) / (1 << 52)
                if a + p < 1:
                    (at, size), a = ((at, size) if u * (a + p) < a else (i, z)), a + p
                elif u * (2 - a - p) < 1 - p:
                    chosen.append(at)
                    (at, size), a = (i, z), a + p - 1
                else:
                    chosen.append(i)
                    a = a + p - 1
            live.append((s, 0, at, size, a))
        level += 1
    return chosen + [i for _, _, i, _, p in live if (xx(i, seed) % (1 << 52) + 0.5) / (1 << 52) < p]


def xx(*parts, wide=False):
    """Spark's xxhash64 of ids and of a seed, which is an int beside a column and a long in an expression."""
    h = 42
    for k, p in enumerate(parts):
        is_int = k == len(parts) - 1 and not wide
        h = int_hash(p, h) if is_int else xxhash.xxh64(p.to_bytes(8, "little", signed=True), seed=h).intdigest()
    return h - (1 << 64) if h >> 63 else h


def int_hash(p, seed):
    return xxhash.xxh64(p.to_bytes(4, "little", signed=True), seed=seed).intdigest()


def test_pivotal_rounding_against_plain_python(spark):
    rng = random.Random(12)
    units = {s: [(i, rng.randrange(1, 300), round(rng.uniform(0.05, 0.95), 3)) for i in range(a, b)] for s, a, b in (("x", 0, 700), ("y", 700, 760), ("z", 760, 761))}
    df = spark.createDataFrame([(i, s, z, p) for s, rows in units.items() for i, z, p in rows], "id long, stratum string, size long, p double").repartition(5)
    got = sorted(r.id for r in mixing.pivotal_round(df, 8, 7).collect())
    assert got == sorted(plain_pivotal(units, 8, 7))
    for rows in units.values():
        assert abs(len(set(got) & {i for i, *_ in rows}) - sum(p for *_, p in rows)) < 1


def test_sharding(docs, empty, rows):
    got = sharding.shard_documents(docs, 5).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        text = next(x[1] for x in rows if x[0] == r.doc_id) or ""
        assert r["size"] == len(text.encode()) + 16 and r.text_crc32 == zlib.crc32(text.encode())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and set(by) == set(range(5))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    groups = {}
    for r in got:
        groups.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(s) == 1 for s in groups.values())
    assert sharding.shard_documents(empty, 5).count() == 0


def test_sharding_splits_a_group_larger_than_a_shard(spark):
    df = spark.range(300).select((F.col("id") % 290).alias("doc_id"), F.when(F.col("id") < 200, "same").otherwise(F.col("id").cast("string")).alias("text"))
    got = sharding.shard_documents(df, 7).collect()
    n = Counter(r.shard for r in got)
    assert len(got) == 300 and max(n.values()) - min(n.values()) <= 1


def spread(got):
    """Number of shards of each text."""
    shards = {}
    for r in got:
        shards.setdefault(r.text_crc32, set()).add(r.shard)
    return {t: len(s) for t, s in shards.items()}


def test_sharding_gives_each_group_no_more_shards_than_it_needs(spark):
    # "same" is a third of all rows; the others are in groups of 2 to 9; no row is without links
    sizes = [400, *(2 + i % 8 for i in range(145))]
    sizes.append(1200 - sum(sizes))
    texts = [f"t{i}" for i, g in enumerate(sizes) for _ in range(g)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for shards in (7, 40):
        got = sharding.shard_documents(df, shards).collect()
        n, quota = Counter(r.shard for r in got), len(texts) // shards
        assert len(got) == len(texts) and set(n.values()) <= {quota, quota + 1}
        per, need = spread(got), {zlib.crc32(f"t{i}".encode()): -(-g // quota) for i, g in enumerate(sizes)}
        assert per[zlib.crc32(b"t0")] <= need[zlib.crc32(b"t0")] + 1
        # only a group that meets the end of a shard may be split further
        assert sum(per[t] > need[t] for t in per) < shards


def test_sharding_of_groups_queued_at_shard_ends(spark):
    # groups of two in shards of 51 and 50 rows: all small, nearly all rows linked
    df = spark.range(2021).select(F.col("id").alias("doc_id"), F.floor(F.col("id") / 2).cast("string").alias("text"))
    got = sharding.shard_documents(df, 40).collect()
    assert len(got) == 2021 and set(Counter(r.shard for r in got).values()) == {50, 51}
    assert sum(n > 1 for n in spread(got).values()) <= 11


def test_spotsigs(docs, empty, rows):
    got = {r.doc_id: r for r in spotsigs.fingerprint_edits(docs).collect()}
    text = {r[0]: r[1] or "" for r in rows}
    order = sorted(text, reverse=True)
    for i, d in enumerate(order):
        t, nxt = text[d], text[order[(i + 1) % len(order)]]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
        if t == edited:
            assert got[d].near_edited == 1.0
    same = [got[d].sigs for d in text if text[d] == rows[5][1]]
    assert len(same) >= 2 and all(x == same[0] for x in same)
    assert spotsigs.fingerprint_edits(empty).count() == 0


def spark_hash(*parts):
    """Spark's xxhash64 of texts and longs."""
    h = 42
    for p in parts:
        h = xxhash.xxh64(p.encode() if isinstance(p, str) else p.to_bytes(8, "little", signed=True), seed=h).intdigest()
    return h - (1 << 64) if h >> 63 else h


def plain_signatures(text):
    edge = r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]*"
    w = [x for x in re.sub(rf"{edge}[\x01\x02\x20\x09-\x0D]+{edge}", " ", text.lower()).split(" ") if x]
    for common in (lambda x: x in spotsigs.ANCHORS, lambda x: spark_hash(x) % 4 == 0):
        content = [x for x in w if not common(x)]
        before, found = 0, set()
        for x in w:
            if not common(x):
                before += 1
            elif before + 1 < len(content):
                found.add(spark_hash(x, content[before], content[before + 1]))
        if found:
            return sorted(found)
    return [spark_hash(text)]


def test_spotsigs_signatures(spark):
    texts = ["", "The cat, and the dog ran to a far land.", "the " * 5000 + "end of it all now", "the the", "xq zz yy ww vv uu tt ss", "xq zz yy ww vv uu tt ss rr", "\u6f22\u5b57 only", "a b", "To be, or not to be! that is (the) question asked 'twice'", "no\x01mark the\x02end of words here"]
    rng = random.Random(8)
    texts += [" ".join(rng.choice(["the", "of", "Une", "x1", "y2.", "(z3", "w4", "--"]) for _ in range(rng.randrange(40))) for _ in range(60)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in spotsigs.fingerprints(d).collect():
        assert list(r.sigs) == plain_signatures(texts[r.doc_id]), texts[r.doc_id]


@pytest.mark.parametrize("ids", [list(range(50)), [0, 1, 2, 3, 1 << 62], [i * 10**15 for i in range(-20, 20)], [7], [5, 5, 9], [*range(1000), 10**18]])
def test_next_documents(spark, ids, monkeypatch):
    monkeypatch.setattr(spotsigs, "GROUP", 4)
    d = spark.createDataFrame([(i, f"t{n}") for n, i in enumerate(ids)], "doc_id long, text string").repartition(4)
    got = spotsigs.next_documents(d, ["doc_id"], 3).collect()
    assert sorted(r.doc_id for r in got) == sorted(ids)
    order = sorted(ids, reverse=True)
    assert sorted((r.doc_id, r.next_doc_id) for r in got) == sorted(zip(order, order[1:] + order[:1], strict=True))


def test_spotsigs_pairs(docs):
    prints = spotsigs.fingerprints(docs.filter("doc_id is not null").select("doc_id", "text"))
    sets = {}
    for r in prints.collect():
        key = tuple(r.sigs)
        sets[key] = min(sets.get(key, r.doc_id), r.doc_id)
    want = set()
    for (a, x), (b, y) in itertools.combinations(sets.items(), 2):
        if len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b)):
            want.add((min(x, y), max(x, y)))
    assert {(r.left_id, r.right_id) for r in spotsigs.near_pairs(prints, 0.8).collect()} == want


def test_quality(spark, empty):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    data = []
    for i in range(400):
        w = [word() for _ in range(40)]
        good = i % 4 != 0
        data.append((i, " ".join(w) if good else " ".join(x.upper() + "!!" for x in w), int(good)))
    data += [(1000, None, None), (1001, "", 1)]
    d = spark.createDataFrame([(i, t, "x") for i, t, _ in data], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, q) for i, _, q in data], "doc_id long, quality int")
    model = nbsvm.train(d, labels.filter("doc_id % 5 <> 0"))
    got = {r.doc_id: r.score for r in nbsvm.score(d, model).collect()}
    held = [(got[i], q) for i, _, q in data if i % 5 == 0 and i < 1000]
    assert sum((s >= 0.3) == (q == 1) for s, q in held) / len(held) > 0.97
    assert len(got) == len(data) and all(0 <= s <= 1 for s in got.values()) and got[1000] == got[1001]
    kept = nbsvm.keep(d, model, 0.3)
    assert kept.columns == d.columns and kept.count() == sum(s >= 0.3 for s in got.values())
    none = nbsvm.train(d, labels.limit(0))
    assert nbsvm.score(empty, none).count() == 0 and {r.score for r in nbsvm.score(d, none).collect()} == {0.5}


def test_warc_of_pages_that_share_an_id(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PIECE", 64)
    rows = [(1, "u", "alpha"), (1, "u", "beta"), (2, "v", "beta"), (2, "v", "beta"), (3, "w", "alpha"), (3, "w", None), (1, "u", "alpha"), (9, "z", "x" * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to or 0) for r in warc.dedup_archive(df, f"file://{tmp_path}/w").collect())
    want = [(1, 5, "response", 0), (1, 5, "response", 0), (1, 4, "response", 0), (2, 4, "revisit", 1), (2, 4, "revisit", 1), (3, 5, "revisit", 1), (3, 0, "response", 0), (9, 100_000, "response", 0)]
    assert got == sorted(want)


def test_warc_members_are_read_piece_by_piece(monkeypatch):
    monkeypatch.setattr(warc, "PIECE", 32)
    record = lambda body: f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n".encode()
    bodies = ["", "a" * 5000, "x\r\n\r\ny", "z"]
    packed = lambda raw: (lambda c: c.compress(raw) + c.flush())(zlib.compressobj(9, zlib.DEFLATED, 31))
    one = packed(b"".join(map(record, bodies)))
    each = b"".join(packed(record(b)) for b in bodies)
    for raw in (one, each, one + each):
        assert [b.decode() for _, b in warc._parse(raw)] == bodies * (2 if raw == one + each else 1)
    assert list(warc._parse(b"")) == []


def test_warc_round_trip(spark, tmp_path):
    pages = [(5, "http://a/5", "same\r\n\r\nWARC/1.1"), (2, None, "same\r\n\r\nWARC/1.1"), (3, "u\r\nX: y", None), (4, "v", ""), (9, "é", "é" * 5000), (7, "w", "one")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, refers_to string")
    got = {r.page_id: r for r in warc.dedup_archive(df, f"file://{tmp_path}/w").collect()}
    first = {}
    for i, _, h in sorted(pages):
        first.setdefault(h or "", i)
    for i, _, h in pages:
        raw = (h or "").encode()
        rev = first[h or ""] != i
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if rev else "response", first[h or ""] if rev else None)
    bodies = {r.page_id: r.body for r in warc.read_warc(spark, f"file://{tmp_path}/w").collect()}
    assert bodies[2] == pages[0][2] and bodies[5] == "" and bodies[9] == "é" * 5000
    large = {r.page_id: r.record_type for r in warc.dedup_archive(df, f"file://{tmp_path}/x", 1).collect()}
    assert large[3] == large[4] == "response" and large[5] == "revisit"
    assert warc.dedup_archive(df.limit(0), f"file://{tmp_path}/y").count() == 0


def test_rows_of_the_frequency_table_follow_the_input():
    """Chunks of texts share their rows: a row a bucket and block, not a chunk."""
    from reportlake.llm import rarity

    rng = np.random.default_rng(3)
    chunks = [rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) for _ in range(40)]
    out = list(rarity._packed(lambda _: iter(chunks), rarity.BUCKET_BITS, iter(())))
    assert sum(b.num_rows for b in out) <= 1 << rarity.BUCKET_BITS
    assert sum(len(v) for b in out for v in b.column(1).to_pylist()) == 5 * 40 * 3000
    want = np.sort(np.concatenate(chunks)) >> np.uint64(64 - rarity.BUCKET_BITS - rarity.SENT_BITS)
    got = [int.from_bytes(v[i : i + 5], "little") | k << 40 for b in out for k, v in zip(*(c.to_pylist() for c in b.columns), strict=True) for i in range(0, len(v), 5)]
    assert got == want.tolist()
