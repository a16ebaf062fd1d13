"""Incremental loads as streams: what has been done is kept in the checkpoint, what arrives twice is done once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut_lineage
from ..sources.files import exists


def read_stream(spark: SparkSession, folder: str, schema: str | object, *, files_per_batch: int | None = None) -> DataFrame:
    """New Parquet files of a folder, as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def upsert_stream(stream: DataFrame, target: str, checkpoint: str, key: str, order: str, buckets: int = 64):
    """Upserts every batch into a Parquet table of hash buckets; only the buckets that a batch touches are written anew.

    Each batch writes to a folder of its own and then notes which buckets it replaced, so a reader never sees a half-written
    table.  A batch that is repeated after a failure starts from the table before it and writes the same rows again.
    Superseded folders stay until :func:`vacuum`.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        from ..operators.incremental import upsert

        spark = batch.sparkSession
        rows = cut_lineage(batch.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
        touched = [r["_bucket"] for r in rows.select("_bucket").distinct().collect()]
        if not touched:
            return
        paths = [p for b, p in _versions(spark, target, batch_id).items() if b in touched]
        table = spark.read.schema(batch.schema).parquet(*paths) if paths else spark.createDataFrame([], batch.schema)
        merged = upsert(table, rows.drop("_bucket"), key, order).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        merged.write.mode("overwrite").partitionBy("_bucket").parquet(f"{target}/v{batch_id}")
        spark.createDataFrame([(batch_id, b) for b in touched], "batch_id long, bucket int").coalesce(1).write.mode("append").json(f"{target}/versions")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, target: str, before: int | None = None) -> dict[int, str]:
    """Folder of every bucket (as many as there are buckets), as of the last batch or of the one before ``before``."""
    if not exists(spark, f"{target}/versions"):
        return {}
    noted = spark.read.schema("batch_id long, bucket int").json(f"{target}/versions")
    last = noted.where(F.lit(True) if before is None else F.col("batch_id") < before).groupBy("bucket").agg(F.max("batch_id").alias("v")).collect()
    return {r["bucket"]: f"{target}/v{r['v']}/_bucket={r['bucket']}" for r in last}


def current_table(spark: SparkSession, target: str, schema: str | object | None = None) -> DataFrame:
    """The table as of the last finished batch; before the first one an empty table of the given schema."""
    paths = list(_versions(spark, target).values())
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.parquet(*paths)


def vacuum(spark: SparkSession, target: str) -> int:
    """Deletes folders that no bucket points to any more; their number.  Not to be run beside readers of older states."""
    live, gone = set(_versions(spark, target).values()), 0
    root = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for version in fs.listStatus(root):
        name = version.getPath().getName()
        if name.startswith("v") and name[1:].isdigit():
            for part in fs.listStatus(version.getPath()):
                if part.isDirectory() and f"{target}/{name}/{part.getPath().getName()}" not in live:
                    fs.delete(part.getPath(), True)
                    gone += 1
    return gone


def tumbling_counts(events: DataFrame, ts: str, kind: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per window and kind; rows later than the watermark are dropped."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark(ts, late)
    return rows.groupBy(F.window(ts, window).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), kind, "n")
