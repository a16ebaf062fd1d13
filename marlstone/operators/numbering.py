"""Numbers for the rows of a large table without sorting them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut_lineage


def number_rows(df: DataFrame, order: str, out: str, start: int = 1) -> DataFrame:
    """Adds ``out``: consecutive numbers in ``order`` (ties in no defined order, but fixed once written).

    Rows are range-partitioned and written; only the row count of each partition reaches the driver.
    """
    parts = cut_lineage(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    counts = sorted((r["_p"], r["n"]) for r in parts.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect())
    before, offsets = start, []
    for p, n in counts:
        offsets.append((p, before))
        before += n
    table = df.sparkSession.createDataFrame(offsets or [(0, start)], "_p int, _o long")
    w = Window.partitionBy("_p").orderBy("_m")
    return parts.join(table, "_p").withColumn(out, F.row_number().over(w) - 1 + F.col("_o")).drop("_p", "_m", "_o")
