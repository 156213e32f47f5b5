"""Reviewer actions as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listmill.operators.merge import fold_actions
from listmill.session import work_dir


def run_available(sdf: DataFrame, path: str, name: str, mode: str) -> DataFrame:
    """Run a stream over what has arrived; each batch's rows go to one folder, named by batch.

    Overwriting the batch's own folder makes a replayed batch harmless.
    Returns all rows written, with ``batch``.
    """
    spark = sdf.sparkSession

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    query = (sdf.writeStream.queryName(name).outputMode(mode).foreachBatch(write)
             .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    schema = T.StructType([*sdf.schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{path}/rows")


def latest_per(df: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the newest batch per key."""
    values = [c for c in df.columns if c not in (*keys, "batch")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(*keys, "_v.*")


def review_stream(actions: DataFrame, patch_fields: list[str], path: str | None = None) -> DataFrame:
    """Fold a stream of actions into the net effect per listing.

    The state holds per listing and field the winning (ts, event_id), so late
    and reordered actions give the same answer as one batch.  The result has
    the columns of ``fold_actions``; apply it with ``apply_reviews``.
    """
    folded = fold_actions(actions, patch_fields)
    path = path or work_dir(actions.sparkSession, "review-stream")
    return latest_per(run_available(folded, path, "reviews", "update"), ["id"])
