"""The keyword search over landed feeds, as one plan."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listmill import vocab as V
from listmill.functions.urls import url_key
from listmill.operators.listing import contract_filter, feed_listing, keyword_filter
from listmill.operators.rank import first_distinct, first_per, rank_hits, top_rows
from listmill.operators.report import failures
from listmill.schema import FAILURE
from listmill.session import cut_lineage
from listmill.sources.feeds import READERS, bad_payloads

ORDER = ["pass", "priority", "payload_id", "pos"]
LOT, GROWTH = 20, 4  # payloads of the first lot for each listing wanted, and how lots grow


@dataclass
class Feed:
    """Landed payloads of one source; later passes only fill what earlier ones left."""

    source: str
    payloads: DataFrame
    turn: int = 1


def feed_items(feeds: Sequence[Feed], keywords: Sequence[str]) -> DataFrame:
    """Contract items that match the keywords, of all feeds, with their place in the order."""
    out = None
    for feed in feeds:
        rows = contract_filter(keyword_filter(READERS[feed.source](feed.payloads), keywords))
        rows = rows.withColumns({"pass": F.lit(feed.turn), "key": url_key(F.col("url"))}).where("key <> ''")
        out = rows if out is None else out.unionByName(rows)
    return out


def _lots(feed: Feed, first: int) -> Iterator[DataFrame]:
    """The payloads of a feed in order of their ids, in lots that grow; only ids are looked at to cut them."""
    place, size = None, first
    while True:
        rest = feed.payloads if place is None else feed.payloads.where(F.col("payload_id") > F.lit(place))
        head = top_rows(rest.select("payload_id"), ["payload_id"], size).agg(F.count("*").alias("n"), F.max("payload_id").alias("last")).first()
        if head["n"] < size:
            yield rest
            return
        yield rest.where((F.col("payload_id") <= F.lit(head["last"])) | F.col("payload_id").isNull())  # nulls come first
        place, size = head["last"], size * GROWTH


def first_items(feeds: Sequence[Feed], keywords: Sequence[str], target: int, first_lot: int | None = None) -> DataFrame:
    """key, source and place of the first ``target`` distinct matching items in (pass, priority, payload, position) order.

    Feeds are read in that order, lot by lot, and reading ends with the lot that fills the quota: all items before its end
    are known by then, and an item behind it comes after ``target`` others, so it can't be among the first.
    """
    columns = ["key", "source", *ORDER]
    found: DataFrame | None = None
    for feed in sorted(feeds, key=lambda f: (f.turn, V.FEED_SOURCES.index(f.source))):
        for lot in _lots(feed, first_lot or LOT * target):
            rows = first_per(feed_items([Feed(feed.source, lot, feed.turn)], keywords).select(*columns), ["key"], ORDER)
            # Fewer than ``target`` keys are known already, so behind twice as many of a lot nothing can win.
            rows = cut_lineage(top_rows(rows, ORDER, 2 * target), "lot")
            found = rows if found is None else found.unionByName(rows)
            won = first_distinct(found, "key", ORDER, target)
            if won.count() >= target:
                return won
    return won


def listings_of(feeds: Sequence[Feed], winners: DataFrame, keywords: Sequence[str], now: Column | None = None) -> DataFrame:
    """The winners' listings, ordered by title hit: only their payloads are read again, parsed whole and enriched."""
    won = []
    # At most MAX_TARGET rows: small enough to broadcast.
    for feed in feeds:
        ids = winners.where((F.col("source") == feed.source) & (F.col("pass") == feed.turn))
        payloads = feed.payloads.join(F.broadcast(ids.select("payload_id").distinct()), "payload_id", "left_semi")
        rows = READERS[feed.source](payloads).withColumn("pass", F.lit(feed.turn))
        won.append(rows.join(F.broadcast(ids.select("payload_id", "pos")), ["payload_id", "pos"], "left_semi"))
    items = won[0]
    for rows in won[1:]:
        items = items.unionByName(rows)
    return rank_hits(feed_listing(items, now), keywords)


def reached(feeds: Sequence[Feed], winners: DataFrame, target: int) -> list[Feed]:
    """The feeds that a search comes to: those up to the one that fills the quota, or all."""
    end = winners.agg(F.count("*").alias("n"), F.max(F.struct("pass", "priority")).alias("last")).first()
    if end["n"] < target:
        return list(feeds)
    return [f for f in feeds if (f.turn, V.FEED_SOURCES.index(f.source) + 1) <= tuple(end["last"])]


def search(feeds: Sequence[Feed], keywords: Sequence[str], n: int, now: Column | None = None) -> DataFrame:
    """The first ``n`` distinct contract listings in source order, then ordered by title hit.

    Keys and positions alone decide which items win, and payloads are read in order until they are found.  Only the payloads of the
    winners (at most ``n``, a request of at most 200) are then read again,
    parsed whole and enriched.
    """
    if not keywords:
        raise ValueError("Add at least one keyword")
    target = max(1, int(n or 1))
    if target > V.MAX_TARGET:
        raise ValueError(f"A run collects at most {V.MAX_TARGET} listings")
    return listings_of(feeds, first_items(feeds, keywords, target), keywords, now)


def search_failures(feeds: Sequence[Feed], keywords: Sequence[str]) -> DataFrame:
    """Payloads that do not parse; without keywords the request itself is the failure."""
    if not keywords:
        spark = feeds[0].payloads.sparkSession
        return spark.createDataFrame([("(keywords)", "Add at least one keyword")], FAILURE)
    return failures(*[bad_payloads(f.payloads, f.source) for f in feeds])
