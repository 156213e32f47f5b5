"""Run progress: the current record per run, and the records that changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listmill.operators.slices import with_previous
from listmill.session import cut_lineage, work_dir
from listmill.streaming.reviews import latest_per, run_available


def until_finished(df: DataFrame, order: Sequence[str], finished: str = "finished", running: str = "running"
                   ) -> DataFrame:
    """Rows of each run up to and including its first finished record."""
    at = F.struct(*order)
    ends = df.where(F.col(finished) & ~F.col(running)).groupBy("run_id").agg(F.min(at).alias("_end"))
    # Written first: a run with a third of all rows is then a plain skewed join, which Spark splits.
    ends = cut_lineage(ends, "ends")
    return df.join(ends, "run_id", "left").where(F.col("_end").isNull() | (at <= F.col("_end"))).drop("_end")


def change_only(df: DataFrame, payload: Sequence[str], order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Progress records that differ from the one before in the same run.

    Runs of any length are cut into slices, so no task holds a whole run.
    """
    rows = df.withColumn("_body", F.struct(*payload)).withColumn("_is", F.lit(True))
    near = with_previous(rows, ["run_id"], list(order), ["_body", "_is"], prefix="_prev")
    fresh = F.col("_prev_is").isNull() | ~F.col("_body").eqNullSafe(F.col("_prev_body"))
    return near.where(fresh).select(*df.columns)


def progress(df: DataFrame, fields: Sequence[str], order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """The current value of every progress field per run, and the number of records.

    A null field leaves the earlier value in place.  Works on batches and streams.
    """
    at = f"struct({', '.join(order)})"
    return df.groupBy("run_id").agg(
        *[F.expr(f"max_by({c}, {at}) FILTER (WHERE {c} IS NOT NULL)").alias(c) for c in fields],
        F.count("*").alias("records"))


def progress_stream(sdf: DataFrame, fields: Sequence[str], order: Sequence[str] = ("ts", "event_id"),
                    path: str | None = None) -> DataFrame:
    """``progress`` over a stream."""
    path = path or work_dir(sdf.sparkSession, "progress-stream")
    return latest_per(run_available(progress(sdf, fields, order), path, "progress", "update"), ["run_id"])


def change_only_stream(sdf: DataFrame, payload: Sequence[str], order: Sequence[str] = ("ts", "event_id"),
                       path: str | None = None, end: bool = False) -> DataFrame:
    """``change_only`` over a stream whose batches arrive in order.

    With ``end`` a run stops at its first finished record, as in ``until_finished``:
    that record is what is carried over, so later batches add nothing to the run.

    Each batch is handled like a table: the last record per run is carried over
    in the shared folder, named by batch, and put in front of the next batch.  A
    replayed batch reads the same carry and overwrites its own output.
    """
    spark = sdf.sparkSession
    path = path or work_dir(spark, "change-stream")
    schema = sdf.schema
    names = [f.name for f in schema.fields]

    def carried(batch: int) -> DataFrame:
        if batch == 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{path}/carry/batch={batch - 1}")

    def step(rows: DataFrame, batch: int) -> None:
        both = carried(batch).withColumn("_new", F.lit(False)).unionByName(rows.withColumn("_new", F.lit(True)))
        both = until_finished(both, order) if end else both
        change_only(both, payload, order).where("_new").select(*names).write.mode("overwrite").parquet(
            f"{path}/rows/batch={batch}")
        last = both.groupBy("run_id").agg(F.max_by(F.struct(*names), F.struct(*order)).alias("r")).select("r.*")
        last.write.mode("overwrite").parquet(f"{path}/carry/batch={batch}")

    query = (sdf.writeStream.queryName("changes").foreachBatch(step)
             .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/rows").select(*names)
