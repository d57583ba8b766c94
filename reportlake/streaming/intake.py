"""Incremental intake of reports and running state, with the batch operators inside."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

#: Parts of a sink by hash of doc_id.
PARTS = 64


def intake(spark: SparkSession, source: str, checkpoint: str, schema: str, process: Callable[[DataFrame], DataFrame], sink: str, archive: str | None = None) -> StreamingQuery:
    """Process each new file of ``source`` once: the checkpoint remembers it, and it moves to ``archive`` if given.

    Unchanged content that comes again is dropped before ``process`` by an anti join with what the sink holds in the parts (by hash of doc_id) that the batch meets;
    ``process`` keeps the columns doc_id, content_hash and part. Sink and state survive restarts. Runs until all present files are done.
    """
    reader = spark.readStream.schema(schema).format("parquet")
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    stream = reader.load(source)

    def batch(df: DataFrame, number: int) -> None:
        fresh = df.withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256)).dropDuplicates(["doc_id", "content_hash"])
        fresh = fresh.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int"))
        parts = [r.part for r in fresh.select("part").distinct().collect()]
        try:
            # only the sink's parts that the batch meets, and only their two key columns
            known = df.sparkSession.read.parquet(sink).filter(F.col("part").isin(parts)).select("doc_id", "content_hash")
            fresh = fresh.join(known, ["doc_id", "content_hash"], "left_anti")
        except Exception as e:  # the first batch finds no sink
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
        process(fresh).write.mode("append").partitionBy("part").parquet(sink)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_sightings(stream: DataFrame, ts: str, entity: str, window: str, watermark: str) -> DataFrame:
    """One row for each entity of each time window (``start``), late ones dropped; state is kept until the watermark has passed."""
    seen = stream.withWatermark(ts, watermark).select(F.window(ts, window).alias("w"), F.col(entity))
    return seen.dropDuplicates(["w", entity]).select(F.col("w.start").alias("start"), F.col(entity))


def heartbeats_ready(sightings: DataFrame, entity: str, least: int) -> DataFrame:
    """start, n, ready: exact number of entities of each window among its first sightings, and whether it is enough."""
    return sightings.groupBy("start").agg(F.count(entity).alias("n"), (F.count(entity) >= least).alias("ready"))


def latest_by_key(stream: DataFrame, key: str, value: str, ts: str, terminal: tuple[str, ...] = ()) -> DataFrame:
    """Last value of each key in update mode; the first terminal one stays, whatever comes after it."""
    ended = F.col(value).isin(*terminal) if terminal else F.lit(False)
    end = F.min_by(F.when(ended, F.col(value)), F.when(ended, F.col(ts)))
    return stream.groupBy(key).agg(F.coalesce(end, F.max_by(value, ts)).alias(value), F.coalesce(F.min(F.when(ended, F.col(ts))), F.max(ts)).alias(ts))


def table_run(stream: DataFrame, path: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what is there into a Parquet table at ``path`` and read it; with ``keys`` the last row of each key.

    Rows are written by executors; each batch overwrites its own folder, so a repeated batch changes nothing.
    """
    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    q = stream.writeStream.foreachBatch(batch).outputMode("update" if keys else "append").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = stream.sparkSession.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).parquet(f"{path}/rows")
    if not keys:
        return rows.drop("batch")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
