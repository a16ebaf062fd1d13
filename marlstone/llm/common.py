"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set; Catalyst prunes its columns."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str, per_core: int = 2) -> DataFrame:
    """Spread a scan over the cores when its files give fewer splits than cores.

    Large inputs keep their scan splits, so no shuffle is added where it would hurt.  Only for plans without a
    shuffle: counting the partitions of others would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores * per_core, *keys)
