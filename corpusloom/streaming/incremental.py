"""Entities kept up to date batch by batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.extraction import importance
from corpusloom.session import cut

ENTITY_COLUMNS = ["entity_key", "name", "canonical_form", "entity_type", "confidence", "occurrences", "importance_score"]


def batch_entities(mentions: DataFrame) -> DataFrame:
    """The resolved entities of one batch of mentions."""
    order = F.struct((-F.coalesce("confidence", F.lit(-1.0))).alias("far"), "chunk_idx", F.coalesce("char_pos", F.lit(-1)).alias("pos"), "name", "canonical_form", "entity_type")
    row = F.struct("name", "canonical_form", "entity_type", "confidence")
    found = mentions.groupBy(F.lower("canonical_form").alias("entity_key")).agg(F.min_by(row, order).alias("e"), F.count("*").alias("occurrences"))
    return found.select("entity_key", "e.*", "occurrences", importance(F.col("occurrences")).alias("importance_score")).select(*ENTITY_COLUMNS)


def merge_entities(kept: DataFrame, batch: DataFrame) -> DataFrame:
    """Kept and new entities as one: occurrences add up, the more confident row stays, the kept one at equal confidence."""
    both = kept.select(*ENTITY_COLUMNS, F.lit(0).alias("_turn")).unionByName(batch.select(*ENTITY_COLUMNS, F.lit(1).alias("_turn")))
    order = F.struct((-F.coalesce("confidence", F.lit(-1.0))).alias("far"), "_turn")
    row = F.struct("name", "canonical_form", "entity_type", "confidence")
    found = both.groupBy("entity_key").agg(F.min_by(row, order).alias("e"), F.sum("occurrences").alias("occurrences"))
    return found.select("entity_key", "e.*", "occurrences", importance(F.col("occurrences")).alias("importance_score")).select(*ENTITY_COLUMNS)


#: Buckets of keys that the kept entities are parted into; a batch rewrites only those that it touches.
BUCKETS = 64


def _bucket() -> Column:
    return F.pmod(F.xxhash64("entity_key"), F.lit(BUCKETS)).cast("int")


def kept_entities(spark: SparkSession, folder: str) -> DataFrame:
    """The entities that a stream keeps under ``folder``: the newest version of each bucket."""
    rows = spark.read.parquet(folder)
    newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))
    return rows.join(F.broadcast(newest), ["bucket", "version"]).select(*ENTITY_COLUMNS)  # BUCKETS rows


def stream_entities(mentions: DataFrame, folder: str, checkpoint: str):
    """Starts a stream that keeps the entities of ``mentions`` under ``folder``.

    Entities lie in buckets by key.  A batch is merged with the last versions of
    the buckets that it touches, which are written as version ``batch + 1``; a
    batch that is run again after a failure writes the same version from the
    same ones before it, so nothing counts twice.  Versions that the batch
    before last left behind are removed, as no batch can need them again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = cut(batch_entities(batch).withColumn("bucket", _bucket()))
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        path = lambda bucket, version: spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/bucket={bucket}/version={version}")
        kept = {b: sorted(int(s.getPath().getName().partition("=")[2]) for s in files.listStatus(path(b, 0).getParent())) for b in touched if files.exists(path(b, 0).getParent())}
        before = {b: [v for v in versions if v <= number] for b, versions in kept.items()}
        paths = [f"{folder}/bucket={b}/version={versions[-1]}" for b, versions in before.items() if versions]
        merged = merge_entities(spark.read.parquet(*paths), new) if paths else new
        merged = cut(merged.select(*ENTITY_COLUMNS).withColumn("bucket", _bucket()))
        out = merged.withColumn("version", F.lit(number + 1)).repartition("bucket")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(folder)
        for b, versions in before.items():
            for old in versions[:-1]:
                files.delete(path(b, old), True)

    return mentions.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
