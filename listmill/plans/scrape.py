"""The board scrape over landed pages: lots of boards, and a frontier of the pages that they reach."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listmill import vocab as V
from listmill.functions import html as H
from listmill.functions.classify import contract_rule
from listmill.functions.text import contains_any, matches_keywords
from listmill.functions.urls import netloc, url_key
from listmill.operators.crawl import crawl_rules, page_links, robots_filter, walk
from listmill.operators.listing import page_fields, page_listing
from listmill.operators.rank import caps, top_rows
from listmill.operators.report import failures
from listmill.session import cut_lineage, work_dir
from listmill.sources.page_table import PageTable
from listmill.sources.pages import board_seeds

ORDER = ["board", "hop", "pos"]
GROWTH = 4  # of the lots in which boards are taken


@dataclass
class Scraped:
    listings: DataFrame
    failures: DataFrame
    fetches: DataFrame


class Frontier:
    """What a run has looked at so far: pages are parsed when a walk or a link reaches their key, each once.

    Parts are written as they come; a round works on the keys that no earlier one has reached.
    """

    def __init__(self, pages: PageTable, keywords: Sequence[str], cap: dict[str, int]):
        self.pages, self.keywords, self.cap = pages, keywords, cap
        self.boards: list[DataFrame] = []  # key, url, links, next_key of pages that walks reached
        self.facts: list[DataFrame] = []   # key, page_id, company, keep, contract of pages behind links
        # Built once: these expressions are long, and every round uses them.
        self._seen = H.hide(F.col("html")).alias("_seen")
        self._ways = [page_links(F.col("url"), F.col("_seen"), cap["link_limit"]).alias("links"),
                      url_key(H.next_page(F.col("url"), F.col("_seen"))).alias("next_key")]

    @staticmethod
    def _new(keys: DataFrame, parts: list[DataFrame]) -> DataFrame:
        for part in parts:
            keys = keys.join(part.select("key"), "key", "left_anti")
        return cut_lineage(keys, "frontier")

    @staticmethod
    def _all(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def walk(self, seeds: DataFrame) -> DataFrame:
        """seed, node, hop of the pages that walks from ``seeds`` (key) visit, landed or not."""
        def ahead(parts: list[DataFrame]) -> DataFrame:
            return self._all(parts).where("next_key <> ''").select(F.col("next_key").alias("key"))

        tried: list[DataFrame] = list(self.boards)
        # A walk of an earlier lot may have ended at its last page, which this one comes by earlier.
        due = self._new((seeds.select("key").union(ahead(self.boards)) if self.boards else seeds.select("key")).distinct(), tried)
        for _ in range(self.cap["max_pages"]):
            if self.boards and due.isEmpty():
                break
            seen = self.pages.pages(due).select("key", "url", self._seen)
            self.boards.append(cut_lineage(seen.select("key", "url", *self._ways), "walked"))
            tried += [self.boards[-1], due]  # pages that haven't landed aren't asked for again
            due = self._new(ahead(self.boards[-1:]).distinct(), tried)
        edges = self._all(self.boards).where("next_key <> '' and next_key <> key").select(
            F.col("key").alias("node"), F.col("next_key").alias("next_node"))
        return walk(seeds.select(F.col("key").alias("node")).distinct(), edges, self.cap["max_pages"])

    def visits(self, boards: DataFrame) -> DataFrame:
        """Every landed page that a board's walk visits, with the links to fetch from it."""
        steps = cut_lineage(self.walk(boards).withColumnRenamed("seed", "key"), "steps")
        visits = boards.join(steps, "key").select("board", "board_url", "node", "hop")
        # A page without links is itself the listing page.
        links = F.when(F.size("links") == 0, F.array("url")).otherwise(F.col("links"))
        return visits.join(self._all(self.boards).withColumnRenamed("key", "node"), "node").select(
            "board", "board_url", "hop", links.alias("links"))

    def behind(self, links: DataFrame) -> DataFrame:
        """The facts of all pages behind links looked at so far, after those behind ``links`` (key) were."""
        due = self._new(links.select("key").distinct(), self.facts)
        parsed = page_fields(self.pages.pages(due), keep=("key", "page_id"))
        keep = (F.col("title") != "") & matches_keywords(F.col("title"), F.col("description"), self.keywords)
        self.facts.append(cut_lineage(parsed.select(
            "key", "page_id", "company", keep.alias("keep"),
            contract_rule(F.col("title"), F.col("description")).isNotNull().alias("contract")), "facts"))
        return self._all(self.facts)


def _end(spent: DataFrame, winners: DataFrame, cap: dict[str, int]):
    """The place at which a run ends: its last accept if it has enough, or the fetch that uses up the budget; None if neither."""
    last = F.max(F.struct(*ORDER)).alias("last")
    won = winners.agg(F.count("*").alias("n"), last).first()
    if won["n"] >= cap["target"]:
        return won["last"]
    fetched = spent.agg(F.count("*").alias("n"), last).first()
    return fetched["last"] if fetched["n"] >= cap["max_fetches"] else None


def _first_lot(cap: dict[str, int]) -> int:
    """Each board costs a fetch at least, so twice as many boards use up any budget."""
    return max(1, cap["max_fetches"] // 2)


def _lots(seeds: DataFrame, first: int) -> Iterator[DataFrame]:
    """The seeds in board order, in lots that grow: by the boards that may be fetched, with the blocked ones between them."""
    place, size = None, first
    while True:
        rest = seeds if place is None else seeds.where(F.col("board") > F.lit(place))
        head = top_rows(rest.where("allowed").select("board"), ["board"], size).agg(F.count("*").alias("n"), F.max("board").alias("last")).first()
        if head["n"] < size:
            yield rest
            return
        yield rest.where(F.col("board") <= F.lit(head["last"]))
        place, size = head["last"], size * GROWTH


def _spent(events: DataFrame, visits: DataFrame, cap: dict[str, int]) -> DataFrame:
    """The fetches of a run, up to its budget."""
    landed = events.where("page_id is not null")
    # Once a key is accepted it is not fetched again.
    first = cut_lineage(landed.where("accept").groupBy("key").agg(F.min(F.struct(*ORDER)).alias("first")), "first")
    due = landed.join(first, "key", "left").where(F.col("first").isNull() | (F.struct(*ORDER) <= F.col("first")))
    page_fetches = visits.select("board", "hop", F.lit(0).alias("pos"), F.lit(None).cast("string").alias("key"),
                                 "board_url", F.lit(None).cast("bigint").alias("page_id"), F.lit(False).alias("accept"))
    fetches = due.select(*page_fetches.columns).unionByName(page_fetches)
    return cut_lineage(top_rows(fetches, ORDER, cap["max_fetches"]), "fetches")


def scrape(boards: DataFrame, pages: DataFrame | PageTable, robots: DataFrame, keywords: Sequence[str], n: int,
           now: Column | None = None) -> Scraped:
    """Walk boards in order, follow job links, keep contract listings until ``n`` are found.

    The run ends with the ``n``-th listing or with its fetch budget; fetches and failures behind that
    place aren't part of it.  ``boards`` has ``board`` (its place in the order) and ``url``; ``pages`` are
    landed pages, best as a page table (other pages are landed as one first).  Fetch and page caps follow the target.

    Boards are taken in lots that grow, until the run has ended.  Each lot's walks and links look up the keys they
    reach, so pages that no board of the lots reaches are neither read nor parsed.  Only the at most ``n`` winners
    are parsed into listings.
    """
    if n > V.MAX_TARGET:  # the caps of a run end there; see caps()
        raise ValueError(f"A run collects at most {V.MAX_TARGET} listings")
    if not isinstance(pages, PageTable):
        pages = PageTable.land(pages, work_dir(pages.sparkSession, "page-table"))
    cap = caps(n)
    rules = crawl_rules(robots)
    seeds = board_seeds(boards).select("board", F.col("url").alias("board_url"))
    seeds = cut_lineage(robots_filter(seeds, rules, "board_url").withColumn("key", url_key(F.col("board_url"))), "seeds")
    frontier = Frontier(pages, keywords, cap)
    all_visits: list[DataFrame] = []
    all_events: list[DataFrame] = []
    for lot in _lots(seeds, _first_lot(cap)):
        visits = cut_lineage(frontier.visits(lot.where("allowed")), "visits")
        links = visits.select("board", "board_url", "hop", F.posexplode("links").alias("pos", "link"))
        links = links.withColumns({"pos": F.col("pos") + 1, "key": url_key(F.col("link"))})
        links = cut_lineage(robots_filter(links, rules, "link").where("allowed"), "links")
        owner = F.lower(F.concat("company", F.lit(" "), netloc(F.col("board_url"))))
        all_visits.append(visits)
        all_events.append(cut_lineage(links.join(frontier.behind(links), "key", "left").select(
            *ORDER, "key", "link", "board_url", "page_id",
            (F.col("keep") & (F.col("contract") | contains_any(owner, V.PLATFORMS))).alias("accept")), "events"))
        events, visits = Frontier._all(all_events), Frontier._all(all_visits)
        spent = _spent(events, visits, cap)
        winners = spent.where("accept").orderBy(*ORDER).limit(cap["target"])
        end = _end(spent, winners, cap)
        if end is not None:
            break

    def reached(*place: Column) -> Column:
        return F.lit(True) if end is None else F.struct(*place) <= F.struct(*[F.lit(end[c]).alias(c) for c in ORDER])

    spent = spent.where(reached(*map(F.col, ORDER)))
    seeds = seeds.where(reached(F.col("board"), F.lit(0).alias("hop"), F.lit(0).alias("pos")))
    events = events.where(reached(*map(F.col, ORDER)))

    # At most max_fetches rows, which the caps hold at 400: small enough to broadcast.
    won = pages.pages(winners.select("key").distinct())
    bodies = won.drop("key").join(F.broadcast(winners.select("page_id", "board_url", *ORDER)), "page_id")
    listings = page_listing(bodies, netloc(F.col("board_url")), now, keep=ORDER)
    failed = failures(
        seeds.where("not allowed").select(F.col("board_url").alias("url"), F.lit("Blocked by robots.txt").alias("error")),
        seeds.where("allowed").join(Frontier._all(frontier.boards).select("key"), "key", "left_anti").select(
            F.col("board_url").alias("url"), F.lit("page has not landed").alias("error")),
        events.where("page_id is null").select(F.col("link").alias("url"), F.lit("page has not landed").alias("error")),
        _without_boards(seeds),
    )
    return Scraped(listings, failed, spent)


def _without_boards(seeds: DataFrame) -> DataFrame:
    """The failure of a run that was given no board."""
    return seeds.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("(boards)").alias("url"), F.lit("No board URLs provided").alias("error"))
