"""Token alignment against brute force on small tables with nulls, empties, repeats and clashing columns."""

import hashlib
import json
import random
from collections import Counter
from itertools import product

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reportlake.llm import align, queries, vocab

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n long, key long, pack int, row string, size int, at string, best boolean"


def corpus():
    rng = random.Random(9)
    vocabulary = ["the", "Tokenization", "naïve", "ÉTÉ", "don't", "x1", "日本語", "🙂🙂", "1234567", "foo.bar();", "\tq", "a\nb"]
    make = lambda n, sep=" ": sep.join(rng.choice(vocabulary) for _ in range(n))
    texts = [None, "", " ", "  ", "a  b ", "\n", " x", "x  y  z", "<|endoftext|> </s> <0x41> <unk>", "▁ marked", "a\x00b", "z" * 700, "日本語のテキスト" * 60, "é" * 300, make(1), make(900), make(300, "  "), make(250, ""), make(20, "\n \n")]
    texts += [make(rng.randrange(1, 30)) for _ in range(25)]
    out = [(i * 7 % 50, t, 1, 2, 3, "r", 5, "a", True) for i, t in enumerate(texts)]
    return [*out, out[14], (out[15][0], "the other text", 1, 2, 3, "r", 5, "a", True)]


class Brute:
    def __init__(self):
        self.a = Tokenizer.from_file(vocab.public_path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=vocab.public_path("piece_bpe_32k.model"))
        value = align.byte_values()
        self.bytes_a = {i: bytes(value[c] for c in t) for t, i in json.load(open(vocab.public_path("byte_bpe_50k.json")))["model"]["vocab"].items() if all(c in value for c in t)}

    def bytes_b(self, i):
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()

    def groups(self, text):
        if not text:
            return []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        x, y = [self.bytes_a[i] for i in a], [self.bytes_b(i) for i in b]
        if not b"".join(x) == b"".join(y) == (" " + text).encode():
            return []
        ends_a, ends_b, n = [], [], 0
        for t in x:
            n += len(t)
            ends_a.append(n)
        n = 0
        for t in y:
            n += len(t)
            ends_b.append(n)
        out, i, j = [], 0, 0
        for c in sorted(set(ends_a) & set(ends_b)):
            k, m = ends_a.index(c, i) + 1, ends_b.index(c, j) + 1
            out.append((a[i:k], b[j:m]))
            i, j = k, m
        return out


def expected(texts):
    brute = Brute()
    groups = [(d, brute.groups(t)) for d, t in texts]
    links = [Counter(p for a, b in g for p in product(a, b)) for _, g in groups]
    count = Counter(p for c in links for p in c)
    top = Counter()
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    out = []
    for (d, g), c in zip(groups, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((
            d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()), sum(n for p, n in c.items() if count[p] == top[p[0]]),
            sum(n * count[p] for p, n in c.items()), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out), {(a, b): (n, n == top[a]) for (a, b), n in count.items()}


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def want():
    return expected([r[:2] for r in corpus()])


@pytest.mark.parametrize("width", [1 << 16, 50, 7, 1])
def test_alignment(spark, want, monkeypatch, width):
    docs = spark.createDataFrame([*corpus(), (None, "no key", 1, 2, 3, "r", 5, "a", True)], SCHEMA).repartition(4)
    got, pairs = align.align_documents(docs, width=width)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == want[0]
    assert {(r.a, r.b): (r.n, r.best) for r in pairs.collect()} == want[1]


def test_small_packs_and_caches(spark, want):
    def small(batches):
        align.PACK_PAIRS, align.KEPT, align.BATCH = 40, 25, 100
        yield from align._short((None, None), batches)

    docs = spark.createDataFrame([r[:2] for r in corpus()], "doc_id long, text string").coalesce(1)
    packs = docs.mapInArrow(small, align.SHORT).cache()
    assert packs.count() > 5
    held = packs.select(F.explode(F.arrays_zip("key", "held")).alias("p")).groupBy("p.key").agg(F.sum("p.held").alias("n")).collect()
    assert {(r.key >> 32, r.key & 0xFFFFFFFF): r.n for r in held} == {p: n for p, (n, _) in want[1].items()}


def test_empty_table(spark):
    got, pairs = align.align_documents(spark.createDataFrame([], SCHEMA))
    assert got.isEmpty() and pairs.isEmpty()


@pytest.mark.parametrize("seed", range(10))
def test_fragments_compose_associatively(seed):
    rng = random.Random(seed)
    tokens = lambda: [rng.randrange(9) for _ in range(rng.randrange(3))]
    parts = []
    for at in range(rng.randrange(1, 12)):
        cut = rng.random() < 0.5
        parts.append({"at": at, "cut": cut, "pre_a": tokens(), "pre_b": tokens(), "post_a": tokens() if cut else [], "post_b": tokens() if cut else []})

    def tree(low, high):
        if high - low == 1:
            return align.compose(parts[low:high])
        mid = rng.randrange(low + 1, high)
        left, groups = tree(low, mid)
        right, more = tree(mid, high)
        done, last = align.compose([left, right])
        return done, groups + more + last

    (one, groups), (other, more) = align.compose(parts), tree(0, len(parts))
    same = ["cut", "first", "pre_a", "pre_b", "post_a", "post_b"]
    assert [one[c] for c in same] == [other[c] for c in same]
    assert sorted(groups, key=lambda g: g["at"]) == sorted(more, key=lambda g: g["at"])


def test_query(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op13_token_alignment"](spark, DIR).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == expected(texts)[0]
