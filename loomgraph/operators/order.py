"""Positions in one global order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.session import cut


def positions(df: DataFrame, order: list, name: str = "pos", first: int = 0) -> DataFrame:
    """df and each row's place in the order: rows are sorted by range partitions, and a partition's places begin after all rows
    before it. The order should end with a unique column; of equal rows, any comes first."""
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    x = cut(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    sizes = x.groupBy("__part").agg(F.count("*").alias("__n"))  # one row a partition
    ahead = sizes.select("__part", (F.coalesce(F.sum("__n").over(Window.partitionBy().orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + first).alias("__ahead"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return x.join(ahead, "__part").withColumn(name, (F.col("__ahead") + place).cast("bigint")).drop("__part", "__ahead")
