"""From raw documents to sharded training data: filter, deduplicate, decontaminate, mix, shard.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again for the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportlake.llm import jaccard, mixing, nbsvm, sharding, tiling
from reportlake.llm.common import read, stage, word_count

QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier, learnt from four fifths of the labels, scores below 0.3.

    Rows without doc_id go, as no later stage can name them. Null and empty texts are scored as texts without features; repeated rows are judged alike; extra columns stay;
    without labels every score is one half, so all stay. An empty table gives no rows.
    """
    docs = docs.filter("doc_id IS NOT NULL")
    labels = read(spark, sf_dir, "labels").filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return nbsvm.keep(docs, nbsvm.train(docs, labels), QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents linked by Jaccard >= 0.8 of five-word shingles the smallest doc_id stays.

    Null and empty texts are linked with nothing and stay. Rows that share a doc_id are one document: they stay or go together. An empty table gives no rows.
    """
    first = jaccard.jaccard_components(docs, 5, 80, 100).filter("component_id = doc_id").select("doc_id")
    return docs.join(first.hint("merge"), "doc_id", "left_semi")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, in any order of its parts.

    Null and empty texts hold none. Rows that share a doc_id go together. Without benchmark items all stay.
    """
    found = tiling.contaminated(docs, read(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    A null source is a source of its own. Null and empty texts have size 0 and are taken at their source's rate. Of rows that share a doc_id and a size each is taken as often as the
    most taken of them. An empty table gives no rows.
    """
    copies = mixing.mix_sources(docs).filter("copies > 0").groupBy(F.col("doc_id").alias("mixed_id"), F.col("size").alias("mixed_size")).agg(F.max("copies").cast("int").alias("mixed_copies"))
    wanted = docs.alias("d").join(copies, (F.col("d.doc_id") == F.col("mixed_id")) & (word_count(F.col("d.text")) == F.col("mixed_size")))
    return wanted.select(F.explode(F.sequence(F.lit(1), F.col("mixed_copies"))).alias("mixed_number"), "d.*").select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row; counts of shards differ by one at most, equal texts stay together. Null texts count as empty ones, repeated rows are told apart by ``copy``."""
    return sharding.shard_documents(docs).select("doc_id", "copy", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("sharding", shards),
]

#: SQL can't express the classifier, the tiling or the dependent rounding; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
