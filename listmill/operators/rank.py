"""Dedup by URL key, quotas, result order, queue pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listmill.functions.text import contains_any
from listmill.functions.urls import url_key
from listmill.operators.slices import with_position
from listmill.session import cut_lineage

DEDUPED_SOURCES = ["remotive.com", "jobicy.com"]


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key.

    ``row_number() = 1`` plans a group limit before the shuffle: every task
    sends at most one row per key, so a key with a third of all rows is cheap.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def dedup_source(df: DataFrame) -> DataFrame:
    """First item per key within the sources that check for repeats; the others pass through."""
    keyed = df.withColumn("_key", url_key(F.col("url")))
    checked = F.col("source").isin(DEDUPED_SOURCES)
    once = first_per(keyed.where(checked), ["source", "_key"], ["payload_id", "pos"])
    return once.unionByName(keyed.where(~checked)).drop("_key")


def dedup_cross(df: DataFrame, order: Sequence[str] = ("pass", "priority", "payload_id", "pos")) -> DataFrame:
    """First item per URL key over all sources, by pass, source priority and position; blank keys go."""
    keyed = df.withColumn("_key", url_key(F.col("url"))).where("_key <> ''")
    return first_per(keyed, ["_key"], list(order)).drop("_key")


def unseen(df: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows whose URL key is not among the ``url`` values of ``seen``.

    An anti join needs no distinct: both sides are plain shuffles, which the
    adaptive skew join can split.
    """
    keys = seen.select(url_key(F.col("url")).alias("_key"))
    return df.withColumn("_key", url_key(F.col("url"))).join(keys, "_key", "left_anti").drop("_key")


_TREE_WIDTH = 1000  # buckets of tasks, each cut to n rows before the last step


def _tree_top(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """At most ``n`` rows of each of many buckets of tasks."""
    w = Window.partitionBy("_bucket").orderBy(*order)
    return df.withColumn("_bucket", F.spark_partition_id() % _TREE_WIDTH).withColumn(
        "_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_bucket", "_rn")


def top_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in an order; never a global sort.  Pass narrow rows.

    One plan at all sizes: a plain top-k sends ``n`` rows of every task to one task, so buckets of tasks are cut
    first.  Up to Spark's window group limit (1,000 rows by default) tasks cut theirs before the shuffle; for
    a larger ``n`` the buckets are cut behind it.
    """
    return _tree_top(df, order, n).orderBy(*order).limit(n)


def quota(df: DataFrame, n: int, order: Sequence[str] = ("pass", "priority", "payload_id", "pos")) -> DataFrame:
    """The first ``n`` rows in source order."""
    return top_rows(df, order, n)


def first_distinct(df: DataFrame, key: str, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` distinct keys in ``order``: dedup and quota in one.  Pass narrow rows.

    Tasks send one row a key, so a key with a third of all rows is cheap.
    """
    return cut_lineage(top_rows(first_per(df, [key], order), order, n), "winners")


def rank_hits(df: DataFrame, keywords: Sequence[str], tie: Sequence[str] = ("id",)) -> DataFrame:
    """Order rows: keyword in the title first, then by title."""
    low = F.lower("title")
    hit = contains_any(low, [k.lower() for k in keywords]) if keywords else F.lit(True)
    return df.orderBy(F.when(hit, 0).otherwise(1), low, *tie)


def union_sources(*frames: DataFrame, order_from: int = 1) -> DataFrame:
    """Concatenate result sets; each gets its place in the order as ``pass``."""
    out = None
    for i, df in enumerate(frames, order_from):
        placed = df.withColumn("pass", F.lit(i))
        out = placed if out is None else out.unionByName(placed, allowMissingColumns=True)
    return out


def fill_remaining(online: DataFrame, boards: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """Rows of ``online`` first, ``boards`` for what is left of the quota.

    The tier is the first sort column, so this is one ordered limit and needs
    no count of the first part.
    """
    tiers = online.withColumn("tier", F.lit(1)).unionByName(boards.withColumn("tier", F.lit(2)),
                                                            allowMissingColumns=True)
    return top_rows(tiers, ["tier", *order], n)


def caps(n: int) -> dict[str, int]:
    """Caps that grow with the target: pages per board, fetches, links per page, feed pages."""
    target = max(1, int(n or 1))
    feed_pages = max(12, min(40, target + 8))
    return {
        "target": target,
        "max_pages": max(8, min(40, target + 4)),
        "max_fetches": max(120, min(400, target * 20)),
        "link_limit": max(80, min(200, target * 10)),
        "feed_pages": feed_pages,
        "deep_feed_pages": min(50, feed_pages + 15),
    }


def scaled_caps(df: DataFrame, n: str) -> DataFrame:
    """The same caps for a column of targets."""
    t = F.greatest(F.lit(1), F.coalesce(F.col(n).cast("int"), F.lit(1)))

    def between(low: int, high: int, value):
        return F.greatest(F.lit(low), F.least(F.lit(high), value))

    feed_pages = between(12, 40, t + 8)
    return df.select("*", t.alias("target"), between(8, 40, t + 4).alias("max_pages"),
                     between(120, 400, t * 20).alias("max_fetches"), between(80, 200, t * 10).alias("link_limit"),
                     feed_pages.alias("feed_pages"), F.least(F.lit(50), feed_pages + 15).alias("deep_feed_pages"))


def queue_positions(df: DataFrame, order: Sequence[str] = ("created_at", "id")) -> DataFrame:
    """Position and total of every visible listing in the review queue."""
    return with_position(df.where(F.col("status") != "deleted"), list(order))


def queue_page(df: DataFrame, index: int, order: Sequence[str] = ("created_at", "id")) -> DataFrame:
    """The listing at a zero-based index, clamped to the queue."""
    numbered = queue_positions(df, order)
    wanted = F.least(F.greatest(F.lit(index + 1), F.lit(1)), F.col("total"))
    return numbered.where(F.col("position") == wanted)
