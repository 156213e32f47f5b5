"""Ordered work on groups of any size.

``lag``, ``lead`` and ``row_number`` over a plain window put a whole group into
one task.  Here the rows are range-partitioned by (keys, order) instead, so a
group that holds a third of all rows is spread over many slices.  Windows run
inside a slice; only the slice edges, a handful of rows, are stitched together.

The sliced rows are written to the shared folder once, because the slice
numbers must be the same in both passes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listmill.session import cut_lineage


def _sliced(df: DataFrame, by: Sequence[str]) -> DataFrame:
    parted = df.repartitionByRange(*[F.col(c) for c in by])
    return cut_lineage(parted.withColumn("_slice", F.spark_partition_id()), "slices")


def _neighbor(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], prefix: str,
              back: bool) -> DataFrame:
    rows = _sliced(df, [*keys, *order])
    inner = Window.partitionBy("_slice", *keys).orderBy(*order)
    step = F.lag if back else F.lead
    near = rows.withColumns({
        "_here": step(F.struct(*cols)).over(inner),
        "_edge": step(F.lit(True)).over(inner).isNull(),
    })
    # The last (first) row of every (slice, key) is what the next (previous) slice needs.
    pick = F.max_by if back else F.min_by
    ends = rows.groupBy("_slice", *keys).agg(pick(F.struct(*cols), F.struct(*order)).alias("_end"))
    over = Window.partitionBy(*keys).orderBy("_slice")
    links = ends.select("_slice", *keys, step("_end").over(over).alias("_there"))
    # Joins on the window's own partitioning: no row is shuffled again.
    out = near.join(links, ["_slice", *keys], "left")
    value = F.when(F.col("_edge"), F.col("_there")).otherwise(F.col("_here"))
    return out.withColumn("_near", value).select(*df.columns, *[F.col(f"_near.{c}").alias(f"{prefix}{c}") for c in cols])


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str],
                  prefix: str = "prev_") -> DataFrame:
    """Add the columns of the row before, per key; null at the start.  ``order`` must be unique per key."""
    return _neighbor(df, keys, order, cols, prefix, back=True)


def with_next(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str],
              prefix: str = "next_") -> DataFrame:
    """Add the columns of the row after, per key; null at the end."""
    return _neighbor(df, keys, order, cols, prefix, back=False)


def with_position(df: DataFrame, order: Sequence[str], position: str = "position", total: str = "total") -> DataFrame:
    """Number all rows from 1 in a global order, and add the total."""
    rows = _sliced(df, order)
    sizes = rows.groupBy("_slice").agg(F.count("*").alias("_n"))
    # One row per slice: a few thousand at most, whatever the size of the table.
    upto = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_slice", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"),
                          F.sum("_n").over(Window.partitionBy()).alias(total))
    inner = Window.partitionBy("_slice").orderBy(*order)
    return rows.join(starts, "_slice").select(
        *df.columns, (F.col("_before") + F.row_number().over(inner)).alias(position), total)
