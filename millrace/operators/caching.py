"""A cache that outlives a run: a bucketed table of results by key.

``missing`` and ``found`` join on the bucketed key, so only the keys of the run at hand are shuffled to the cache's buckets and
the cache itself is read where it lies.  ``add`` appends what a run has made, bucketed alike; keys that came in the meantime
stay as they are.  A run that fails before its ``add`` is committed leaves the cache as it was.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class TableCache:
    """``key string``, ``value`` columns and ``run`` (who made it) below ``path``; the number of buckets stays with the folder."""

    def __init__(self, spark: SparkSession, path: str, value: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = "cache_" + md5(path.encode()).hexdigest()
        where = path.replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (key STRING, {value}, run STRING) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{where}'")

    def frame(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def missing(self, keyed: DataFrame) -> DataFrame:
        """The rows of ``keyed`` whose key the cache lacks, one for each key."""
        first = keyed.where("key is not null").dropDuplicates(["key"])
        return first.join(self.frame().select("key").hint("merge"), "key", "left_anti")

    def found(self, keyed: DataFrame) -> DataFrame:
        """What the cache has for the keys of ``keyed``, one row for each key."""
        keys = keyed.where("key is not null").select("key").distinct()
        return self.frame().join(keys.hint("merge"), "key", "left_semi")

    def add(self, made: DataFrame, run: str) -> None:
        """Appends ``key`` and values, one row for each key."""
        rows = self.missing(made).withColumn("run", F.lit(run)).select(self.frame().columns)
        rows.repartition(self.buckets, "key").write.format("parquet").mode("append").bucketBy(self.buckets, "key").sortBy("key").saveAsTable(self.name)
