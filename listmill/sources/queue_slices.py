"""The review queue in slices of its order, with stored counts: any page is one slice away."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _with_slice(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("slice", T.IntegerType())])


class QueueSlices:
    """Slices in ``path``; ``build`` writes them."""

    def __init__(self, spark: SparkSession, path: str, order: Sequence[str] = ("created_at", "id")):
        self.spark, self.path, self.order = spark, path.rstrip("/"), list(order)
        counts = spark.read.parquet(f"{self.path}/counts").collect()  # a row a slice
        self.counts = sorted((r.slice, r.n) for r in counts)
        self.total = sum(n for _, n in self.counts)

    @classmethod
    def build(cls, df: DataFrame, path: str, order: Sequence[str] = ("created_at", "id")) -> QueueSlices:
        """Write the visible listings, range by range, and then the counts: without them the slices don't count."""
        spark, path = df.sparkSession, path.rstrip("/")
        rows = df.where(F.col("status") != "deleted").repartitionByRange(*order).sortWithinPartitions(*order)
        rows.withColumn("slice", F.spark_partition_id()).write.partitionBy("slice").parquet(f"{path}/slices")
        df.limit(0).write.parquet(f"{path}/columns")  # an empty queue has no slice to tell them
        written = spark.read.schema(_with_slice(df.schema)).parquet(f"{path}/slices")
        written.groupBy("slice").agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/counts")
        return cls(spark, path, order)

    def place(self, index: int) -> tuple[int, int, int] | None:
        """(slice, rows before it, position from 1) of a zero-based index, clamped to the queue; None if it is empty."""
        wanted, before = min(max(index + 1, 1), self.total), 0
        for part, n in self.counts:
            if before < wanted <= before + n:
                return part, before, wanted
            before += n
        return None

    def page(self, index: int) -> DataFrame:
        """The listing at a zero-based index, with its position and the total; reads the one slice that holds it."""
        at = self.place(index)
        schema = self.spark.read.parquet(f"{self.path}/columns").schema
        slices = self.spark.read.schema(_with_slice(schema)).parquet(f"{self.path}/slices")
        part, before, wanted = at or (-1, 0, 0)
        inner = Window.partitionBy("slice").orderBy(*self.order)
        rows = slices.where(F.col("slice") == part).withColumn("position", F.lit(before).cast("bigint") + F.row_number().over(inner))
        return rows.where(F.col("position") == wanted).drop("slice").withColumn("total", F.lit(self.total).cast("bigint"))
