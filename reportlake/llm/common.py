"""Helpers shared by the training-data operators: table access and lineage cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import shared_folder

#: A word is a run of anything but blank, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``; unset on a cluster it is an error."""
    return shared_folder(spark)


def stage(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder as Parquet and read it back.

    A lost executor then costs a re-read of a file, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows with a key; the others cannot be named in a result and are left out by every operator."""
    return df.filter(F.col(key).isNotNull())


def lower_ascii(text):
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def word_count(text):
    """Number of words; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*parts):
    """A repeatable number in (0, 1) from the hash of the given columns."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def maybe_among(keys: DataFrame, columns: list[str], bits: int = 1 << 20) -> Column:
    """True for rows whose ``columns`` are those of a row of ``keys``, and for few others, by a bitmap of fixed size; at most bits / 64 rows reach the driver."""
    place = F.pmod(F.xxhash64(*columns), F.lit(bits))
    slots = keys.select(F.floor(place / 64).cast("int").alias("slot"), F.pmod(place, F.lit(64)).cast("int").alias("bit"))
    words = [0] * (bits // 64)
    for r in slots.groupBy("slot").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("set")).collect():
        words[r.slot] = r.set
    held = F.from_json(F.lit(str(words)), "array<bigint>")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    return F.get(held, F.floor(place / 64).cast("int")).bitwiseAND(bit) != 0
