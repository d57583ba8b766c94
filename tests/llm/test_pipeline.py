"""Queries and the pipeline on the smallest tables, against brute force where that is short."""

import re
from collections import Counter

import corpus_pipeline
from reportlake.llm import queries
from reportlake.llm.common import stage

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_every_operator_has_a_query():
    assert sorted({int(n[2:].split("_")[0]) for n in queries.QUERIES}) == list(range(1, 11))


def test_queries_return_every_row(spark):
    docs, pages = spark.read.parquet(f"{DIR}/documents.parquet").count(), spark.read.parquet(f"{DIR}/pages.parquet").count()
    for name, f in queries.QUERIES.items():
        n = f(spark, DIR).count()
        if name.startswith("op3_"):
            assert 0 < n < docs
        else:
            assert n == (pages if name.startswith("op10_") else docs), name


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = {}
    for name, f in corpus_pipeline.STAGES:
        before = docs
        docs = stage(f(spark, docs, DIR))
        kept[name] = (before, docs)
        if name != "sharding":
            assert docs.columns == before.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    before, after = kept["quality"]
    left = {r.doc_id for r in after.collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in left for d in good) >= 0.95 * len(good)
    before, after = kept["near_duplicates"]
    sets = {}
    for r in before.collect():
        w = WORD.findall(r.text.lower())
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    left = sorted(r.doc_id for r in after.collect())
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert not any(near(a, b) for i, a in enumerate(left) for b in left[i + 1 :])
    for d in set(sets) - set(left):
        assert any(near(d, x) for x in sets if x != d)
    before, after = kept["decontamination"]
    items = [r.text.lower().split() for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    left = {r.doc_id for r in after.collect()}
    for r in before.collect():
        text = " " + " ".join(r.text.lower().split()) + " "
        assert not (any(" " + " ".join(i) + " " in text for i in items) and r.doc_id in left)
    before, after = kept["source_mixing"]
    assert max(Counter(r.doc_id for r in after.collect()).values()) <= 3
    before, after = kept["sharding"]
    rows = after.collect()
    n = Counter(r.shard for r in rows)
    assert len(rows) == before.count() and max(n.values()) - min(n.get(s, 0) for s in range(40)) <= 1
