"""A global row number that no single task computes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """`df` with the 1-based place of each row in the order, which should be total.

    Rows are range-partitioned and numbered within their partition; only the partitions' sizes are added up in one place.
    """
    placed = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.withColumn("_within", within).join(before.select("_part", "_before"), "_part").withColumn(name, F.col("_before") + F.col("_within")).drop("_part", "_within", "_before")


def batched(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """`df` with its rank and the number of its batch of `size` rows, from 0."""
    return ranked(df, order).withColumn("batch", F.floor((F.col("rank") - 1) / size))
