"""Landed pages: batch and streaming scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listmill.functions.html import anchors, hide
from listmill.functions.text import nonempty, strip_ws
from listmill.functions.urls import board_seed
from listmill.schema import PAGE


def pages(spark: SparkSession, path: str) -> DataFrame:
    """The page corpus: page_id, url, html."""
    return spark.read.schema(PAGE).parquet(path)


def stream_pages(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Pages as they land."""
    return spark.readStream.schema(PAGE).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def board_seeds(df: DataFrame, url: str = "url") -> DataFrame:
    """Trim board URLs, drop blank ones, add a missing scheme; other columns (the input order) stay."""
    return df.withColumn(url, board_seed(nonempty(strip_ws(F.col(url))))).where(F.col(url).isNotNull())


def page_anchors(df: DataFrame) -> DataFrame:
    """One row per anchor with an href, numbered in document order."""
    return df.select("page_id", "url", F.posexplode(anchors(hide(F.col("html")))).alias("pos", "a")).select(
        "page_id", "url", "pos", "a.href", "a.rel", "a.text")
