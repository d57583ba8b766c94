"""Queries of the training-data operators over the test tables, with their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, ctxmix, jaccard, mixing, nbsvm, packing, phrases, ranked, secrets, sharding, spotsigs, tiling, warc
from .common import read, shared_dir


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document, learnt from six sevenths of them."""
    docs = read(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    scored = ctxmix.score_documents(docs, ~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte", "n_predicted")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document so that sources meet their target weights."""
    return mixing.mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of equal counts, equal texts together."""
    placed = sharding.shard_documents(read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from four fifths of the labelled ones."""
    docs = read(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = nbsvm.train(docs, read(spark, sf_dir, "labels").filter(~held))
    scored = nbsvm.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages with revisit records, read back."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    return warc.dedup_archive(read(spark, sf_dir, "pages"), path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document when recurring 35-word windows are removed."""
    return phrases.remove_repeats(read(spark, sf_dir, "documents"), keep_text=False)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by Jaccard >= 0.85 of their 4-word shingles."""
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"), 4, 85, 100).select("doc_id", "n_shingles", "component_id", "class_id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and benchmark items that they contain."""
    return tiling.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; base kinds counted and hashed, all spans listed."""
    rules = secrets.BASE_RULES + secrets.MORE_RULES
    found = secrets.scan_secrets(read(spark, sf_dir, "documents"), rules)
    n = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    base = secrets.spans_text(F.col("found"), rules, ("assign", "access", "hex"))
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"), secrets.spans_text(F.col("found"), rules).alias("spans"))


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text."""
    found = spotsigs.fingerprint_edits(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", spotsigs.fingerprint_text(F.col("sigs")).alias("fingerprint"),
        spotsigs.fingerprint_text(F.col("edited_sigs")).alias("edited_fingerprint"), "near_edited", "near_next")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranked.rank_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers in every document."""
    return align.align_documents(read(spark, sf_dir, "documents"))[0]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_decontamination": op3_decontamination,
    "op4_secret_scan": op4_secret_scan,
    "op5_lm_score": op5_lm_score,
    "op6_source_mixing": op6_source_mixing,
    "op7_sharding": op7_sharding,
    "op8_spotsigs": op8_spotsigs,
    "op9_quality": op9_quality,
    "op10_warc_revisits": op10_warc_revisits,
    "op11_ranked_search": op11_ranked_search,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_token_alignment": op13_token_alignment,
}

_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"

ORACLE: dict[str, str] = {
    "op11_ranked_search": f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents WHERE doc_id IS NOT NULL),
 held AS (SELECT r, {_TERMS} AS term FROM docs),
 tf AS (SELECT r, term, count(*) AS tf FROM held GROUP BY ALL),
 sizes AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
 total AS (SELECT count(*) AS documents, sum(n)::BIGINT AS terms FROM sizes),
 asked AS (SELECT DISTINCT item_id, {_TERMS} AS term FROM benchmark WHERE item_id IS NOT NULL),
 weights AS (SELECT term, floor(1000 * ln((2 * any_value(documents) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total WHERE term IN (SELECT term FROM asked) GROUP BY term),
 scores AS (
   SELECT item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * documents) // terms))))::BIGINT AS score
   FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN sizes USING (r) JOIN docs USING (r), total GROUP BY item_id, doc_id, r)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
""",
}
