"""Row numbers over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_path

#: Rows of a task come in these lower bits of Spark's increasing ids, the task's number above them.
_BITS = 33


def numbered(df: DataFrame, *order: str | Column, name: str = "place") -> DataFrame:
    """``df`` with its place (from 1) in the given order: a range sort, written once, and the sizes of its parts added up.

    No task sorts more than its range; only one number a task meets in one place.  Rows equal in the order come in any.
    """
    spark = df.sparkSession
    path = shared_path(spark, "numbered")
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path).withColumn("_part", F.shiftright("_at", _BITS))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << _BITS) - 1)) + 1
    return placed.join(F.broadcast(before), "_part").withColumn(name, place).drop("_at", "_part", "_before")  # a row a task
