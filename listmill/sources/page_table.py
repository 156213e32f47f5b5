"""Landed pages in buckets by URL key, for runs that look at few of them.

A table holds one page a key, the one with the smallest id.  Rows lie in a folder for each bucket, sorted by key, so
a lookup reads the buckets of its keys and no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listmill.functions.urls import url_key
from listmill.operators.rank import first_per

_ROW = "key string, page_id bigint, url string, html string"


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.hash(key), F.lit(buckets))


class PageTable:
    """The table in ``path``; ``land`` writes one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        done = [n for n in names if n.startswith("buckets=") and self._fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        if not done:
            raise FileNotFoundError(f"No page table in {path}")
        self.root, self.buckets = f"{self.path}/{done[0]}", int(done[0].split("=")[1])
        self._there = {int(s.getPath().getName().split("=")[1]) for s in self._fs.listStatus(jvm.org.apache.hadoop.fs.Path(self.root))
                       if s.getPath().getName().startswith("bucket=")}

    @classmethod
    def land(cls, pages: DataFrame, path: str) -> PageTable:
        """Write the pages (page_id, url, html) as a table.

        Buckets are cut as the shuffle cuts its partitions, so the pages are shuffled once: each task sends
        one page a key, and a bucket is written by one task.
        """
        spark = pages.sparkSession
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = first_per(pages.select(url_key(F.col("url")).alias("key"), "page_id", "url", "html"), ["key"], ["page_id"])
        rows.withColumn("bucket", _bucket(F.col("key"), buckets)).sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(
            f"{path.rstrip('/')}/buckets={buckets}")
        return cls(spark, path)

    def pages(self, keys: DataFrame) -> DataFrame:
        """key, page_id, url, html of the landed pages among ``keys`` (key, without repeats)."""
        wanted = {r.b for r in keys.select(_bucket(F.col("key"), self.buckets).alias("b")).distinct().collect()}  # a row a bucket
        paths = [f"{self.root}/bucket={b}" for b in sorted(wanted & self._there)]
        if not paths:
            return self.spark.createDataFrame([], _ROW)
        return self.spark.read.schema(_ROW).parquet(*paths).join(keys.select("key"), "key", "left_semi")
