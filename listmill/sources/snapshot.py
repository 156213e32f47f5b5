"""Versioned listing snapshots and exports.

A snapshot is a folder of versions; a version counts once its ``_SUCCESS`` file
is there, so a failed or half-written version is never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from listmill import vocab as V
from listmill.operators.listing import approved
from listmill.schema import LISTING


def _versions(spark: SparkSession, path: str, complete: bool = True) -> list[str]:
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()]
    return sorted(v for v in names if v.startswith("v=") and (
        not complete or fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{v}/_SUCCESS"))))


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version; an empty listing table where there is none."""
    versions = _versions(spark, path)
    if not versions:
        return spark.createDataFrame([], LISTING)
    rows = spark.read.schema(LISTING).parquet(f"{path}/{versions[-1]}")
    return rows.select(*V.LISTING_FIELDS)


def write_listings(df: DataFrame, path: str, tag: str = "") -> str:
    """Write a new version, laid out by status so that exports read saved rows only.

    A ``tag`` names the batch that made the version; a batch that is replayed
    finds its version complete and writes nothing.
    """
    spark = df.sparkSession
    done = [v for v in _versions(spark, path) if tag and v.endswith(f"-{tag}")]
    if done:
        return done[-1]
    taken = _versions(spark, path, complete=False)
    number = 1 + max((int(v[2:].split("-")[0]) for v in taken), default=0)
    version = f"v={number:010d}" + (f"-{tag}" if tag else "")
    df.select(*V.LISTING_FIELDS).write.partitionBy("status").parquet(f"{path}/{version}")
    return version


def has_version(spark: SparkSession, path: str, tag: str) -> bool:
    return any(v.endswith(f"-{tag}") for v in _versions(spark, path))


def export_rows(df: DataFrame, columns: list[str] = V.LISTING_FIELDS) -> DataFrame:
    """The saved listings, every field in export order."""
    return approved(df).select(*columns)


def export_json(df: DataFrame, path: str) -> None:
    """Saved listings as JSON lines; empty fields are kept, text stays unescaped UTF-8."""
    export_rows(df).write.option("ignoreNullFields", "false").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Saved listings as CSV with a header; quotes are doubled, line breaks are kept inside quotes."""
    export_rows(df, V.CSV_FIELDS).write.options(
        header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
