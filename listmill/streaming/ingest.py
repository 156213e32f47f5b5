"""Batches of listings merged into the table as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from listmill.session import work_dir
from listmill.sources.listing_table import ListingTable


def ingest(sdf: DataFrame, table: str, now: Column, order: str = "seq", path: str | None = None,
           prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows, settle_share: float = 0.25) -> DataFrame:
    """Add each micro-batch to the table as a run and return the listings.

    A run is as large as its batch.  Runs are folded level by level, and merged into the rows once they hold more
    than ``settle_share`` of them.  Batches are named by the stream's folder and number: a replayed one is added once.
    """
    spark = sdf.sparkSession
    path = path or work_dir(spark, "ingest-stream")
    listings = ListingTable(spark, table)

    def step(rows: DataFrame, batch: int) -> None:
        listings.upsert(prepare(rows), now, order, name=path, number=batch)
        listings.compact()
        listings.settle_at(settle_share)

    query = (sdf.writeStream.queryName("ingest").foreachBatch(step)
             .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return listings.read()
