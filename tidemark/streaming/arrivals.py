"""Incremental arrival: each new file's rows are applied once, by key, to a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.records import upsert

MANIFEST = "bucket int, version long"


def _bucket(key: list[str], buckets: int):
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, snapshot: str, number: int) -> DataFrame:
    """(bucket, version): which version holds each bucket after batch ``number``; at most one row per bucket."""
    return spark.read.schema(MANIFEST).parquet(f"{snapshot}/manifest/{number:08d}")


def current(spark: SparkSession, snapshot: str, schema: str, number: int, buckets: list[int] | None = None) -> DataFrame:
    """The snapshot after batch ``number``, or only some of its buckets."""
    at = manifest(spark, snapshot, number)
    at = at.where(F.col("bucket").isin(buckets)) if buckets is not None else at
    paths = [f"{snapshot}/data/version={r['version']:08d}/bucket={r['bucket']}" for r in at.collect()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def follow(spark: SparkSession, source: str, schema: str, snapshot: str, key: list[str], checkpoint: str, buckets: int = 64):
    """Apply what has arrived in ``source`` (Parquet) to the snapshot; returns when all is applied.

    Rows lie in buckets by a hash of their key.  A batch rewrites the buckets
    that it touches, under its own number, and a manifest that names each
    bucket's version; others stay as they are.  A batch that runs twice writes
    the same, so a failed one is simply run again.  ``buckets`` stays the same
    for a snapshot's life.  Of rows with one key in a batch any one counts.
    """
    stream = spark.readStream.schema(schema).parquet(source)

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(key).withColumn("bucket", _bucket(key, buckets)).persist()
        try:
            touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # at most ``buckets``
            if not touched and not number:
                spark.createDataFrame([], MANIFEST).write.mode("overwrite").parquet(f"{snapshot}/manifest/{number:08d}")
                return
            rows = new.drop("bucket")
            if number:
                rows = upsert(current(spark, snapshot, schema, number - 1, touched), rows, key)
            rows.withColumn("bucket", _bucket(key, buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{snapshot}/data/version={number:08d}")
            now = {r["bucket"]: r["version"] for r in manifest(spark, snapshot, number - 1).collect()} if number else {}
            now |= {b: number for b in touched}
            spark.createDataFrame(sorted(now.items()), MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{snapshot}/manifest/{number:08d}")
        finally:
            new.unpersist()

    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
