"""Written intermediate tables, shipping of this package, and Arrow helpers for the corpus operators."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listmill.session import work_dir

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application, as ``--py-files`` would."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    stage = tempfile.mkdtemp(prefix="ship-")
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(stage, "listmill"), "zip", root, "listmill"))
    _SHIPPED.add(app)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: computed once, and safe from lost executors."""
    path = work_dir(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def column_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The text column without nulls, as one contiguous array; null is the empty text."""
    column = batch.column(batch.schema.get_field_index(name))
    if column.null_count:
        column = column.fill_null("")
    return column.cast(pa.large_string())


def text_chunks(column: pa.Array, most: int = 1 << 20, most_rows: int = 4096) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts, of about ``most`` bytes and at most ``most_rows`` rows: first row, end row, bytes, offsets of the texts in them."""
    rows = len(column)
    if not rows:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + rows + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    first = 0
    while first < rows:
        end = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        end = min(rows, first + most_rows, max(end, first + 1))
        yield first, end, data[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]
        first = end


NO_ID = 1 << 62  # ids from here on stand for rows that have none


def id_order(name: str = "doc_id", text: str = "text"):
    """The id for comparisons.  A row without one is a document behind all others; such rows of one text are one document."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID) + F.pmod(F.xxhash64(text), F.lit(NO_ID // 2)))


def without_rows(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't in ``out`` (doc_id, text_hash), with all their columns, whatever their names."""
    same = F.col("d.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.xxhash64("d.text") == F.col("o.text_hash"))
    return docs.alias("d").join(out.select("doc_id", "text_hash").alias("o"), same, "left_anti")
