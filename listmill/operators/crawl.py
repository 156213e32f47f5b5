"""Boards, links and crawl rules over landed pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listmill import vocab as V
from listmill.functions import html as H
from listmill.functions import urls as U
from listmill.functions.text import let
from listmill.operators.rank import top_rows
from listmill.session import cut_lineage


def link_facts(base: Column, href: Column) -> Column:
    """URL, key and rule of one link of a page at ``base``."""
    board_host = F.lower(U.netloc(base))

    def facts(u: Column) -> Column:
        host, p = F.lower(U.netloc(u)), F.rtrim(U.path(u), F.lit("/"))
        return F.struct(
            u.alias("url"),
            F.lower(F.concat(U.scheme(u), F.lit("://"), U.netloc(u), p)).alias("key"),
            U.job_link_rule(host, p).alias("rule"),
            U.same_site(board_host, host).alias("same_site"),
        )

    return let(U.resolve_href(base, href), facts)


def page_links(base: Column, visible: Column, limit: int | Column = 80) -> Column:
    """Job links of one page: first link per key in document order, at most ``limit``.

    Done inside the page's row, so finding links costs no shuffle.
    """

    def once(kept: Column) -> Column:
        return let(F.transform(kept, lambda x: x["key"]), lambda keys: F.filter(
            kept, lambda x, i: F.array_position(keys, x["key"]) == i + 1))

    facts = F.transform(H.hrefs(visible), lambda h: link_facts(base, h))
    jobs = F.filter(facts, lambda x: x["url"].isNotNull() & x["rule"].isNotNull() & x["same_site"])
    return F.transform(F.slice(let(jobs, once), 1, limit), lambda x: x["url"])


def job_links(df: DataFrame, limit: int = 80, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row per job link of each page, numbered from 1 in document order."""
    links = df.select(*keep, "url", page_links(F.col("url"), H.hide(F.col("html")), limit).alias("_links"))
    return links.select(*keep, "url", F.posexplode("_links").alias("pos", "link")).withColumn("pos", F.col("pos") + 1)


def next_pages(df: DataFrame) -> DataFrame:
    """The next-page URL of each page that has one."""
    return df.select("page_id", "url", H.next_page(F.col("url"), H.hide(F.col("html"))).alias("next_url")).where(
        "next_url is not null")


# -- crawl rules --------------------------------------------------------------

@dataclass
class CrawlRules:
    """The rules that apply to this crawler: one per origin and prefix, and the prefix lengths per origin."""

    active: DataFrame
    lengths: DataFrame


def crawl_rules(robots: DataFrame) -> CrawlRules:
    """Keep the rules that apply.

    ``robots`` has origin, agent, rule_order, allow and path_prefix.  The first
    agent group that is part of the crawler's token applies, else the ``*`` group.
    """
    agent = F.lower(F.coalesce("agent", F.lit("*")))
    group_rank = F.when(agent == "*", 1).when(F.contains(F.lit(V.AGENT_TOKEN), agent), 0)
    rules = robots.select(
        "origin", "rule_order", agent.alias("agent"), group_rank.alias("grp"),
        # An empty prefix matches every path, and an empty "disallow" allows all of it.
        (F.col("allow") | (F.col("path_prefix") == "")).alias("allow"),
        F.when(F.col("path_prefix") == "*", "").otherwise(F.col("path_prefix")).alias("prefix"),
    ).where("grp is not null")
    chosen = cut_lineage(rules.groupBy("origin").agg(
        F.min_by("agent", F.struct("grp", "rule_order")).alias("agent")), "agents")
    active = cut_lineage(rules.join(chosen, ["origin", "agent"]).groupBy("origin", "prefix").agg(
        F.min(F.struct("rule_order", "allow")).alias("rule")), "rules")
    # At most one entry per possible prefix length, however many rules there are.
    lengths = cut_lineage(active.groupBy("origin").agg(F.collect_set(F.length("prefix")).alias("_lengths")), "lengths")
    return CrawlRules(active, lengths)


def robots_filter(urls: DataFrame, robots: DataFrame | CrawlRules, url: str = "url") -> DataFrame:
    """Add ``allowed`` to rows of URLs: the first rule whose prefix starts the path decides.

    A prefix match becomes an equi-join: the rules of an origin have few
    distinct prefix lengths, and a URL is looked up once per length.  So no
    origin's rules are gathered into one row and no URL meets every rule of its
    origin.  The looked-up tables are written first: then their size is known
    (Spark broadcasts them only below its threshold) and both join sides are
    plain shuffles, which the adaptive skew join splits at a hot origin or URL.
    """
    rules = robots if isinstance(robots, CrawlRules) else crawl_rules(robots)
    tail = F.regexp_extract(F.col(url), r"^[^:/?#]+://[^/?#]*([^#]*)", 1)
    keyed = urls.select(url).distinct().select(
        url, U.origin(F.col(url)).alias("origin"), F.when(tail == "", "/").otherwise(tail).alias("_target"))
    probes = keyed.join(rules.lengths, "origin").select(
        url, "origin", "_target",
        F.explode(F.filter("_lengths", lambda n: n <= F.length("_target"))).alias("_n"))
    verdicts = cut_lineage(
        probes.select(url, "origin", F.substring(F.col("_target"), F.lit(1), F.col("_n")).alias("prefix"))
        .join(rules.active, ["origin", "prefix"])
        .groupBy(url).agg(F.min("rule").alias("_rule"))
        .select(url, F.col("_rule.allow").alias("_allow")), "verdicts")
    return urls.join(verdicts, url, "left").withColumn("allowed", F.coalesce("_allow", F.lit(True))).drop("_allow")


# -- walks --------------------------------------------------------------------

def walk(seeds: DataFrame, edges: DataFrame, max_pages: int) -> DataFrame:
    """Follow next links from each seed for at most ``max_pages`` pages.

    ``seeds`` has ``node``; ``edges`` has ``node`` and ``next_node`` (at most one
    per node).  Returns ``seed``, ``node``, ``hop``; a page counts once per seed.

    Every page has one next page, so jumps compose: jumps of 2^k pages are
    joined with themselves, and log2(max_pages) joins replace max_pages ones.
    Each round is written to the shared folder, so no plan grows and a lost
    executor costs one round at most.
    """
    jumps = edges.select("node", "next_node").where("next_node is not null and node <> next_node")
    paths = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hop"))
    step = 1
    while step < max_pages:
        jumps = cut_lineage(jumps, "jumps")
        if jumps.isEmpty():                    # no walk is longer than this
            break
        ahead = paths.join(jumps, "node").select("seed", F.col("next_node").alias("node"),
                                                 (F.col("hop") + step).alias("hop"))
        paths = cut_lineage(paths.unionByName(ahead.where(F.col("hop") < max_pages)), "paths")
        further = jumps.select(F.col("node").alias("next_node"), F.col("next_node").alias("_far"))
        jumps = jumps.join(further, "next_node").select("node", F.col("_far").alias("next_node"))
        step *= 2
    return paths.groupBy("seed", "node").agg(F.min("hop").alias("hop"))


def page_edges(pages: DataFrame) -> DataFrame:
    """Edges from landed pages to the landed page that their next link names.

    Both ends are URL keys.  A link back to the page itself is no edge.
    """
    return next_pages(pages).select(U.url_key(F.col("url")).alias("node"), U.url_key(F.col("next_url")).alias(
        "next_node")).where("node <> next_node")


def follow_links(boards: DataFrame, pages: DataFrame, limit: int = 80) -> DataFrame:
    """Landed pages behind the job links of board pages; a board page without links stands for itself.

    Returns board_id, pos, and the landed page's key.  Only keys travel: the
    page contents are joined later, once per page.
    """
    links = boards.select(
        F.col("page_id").alias("board_id"), F.col("url").alias("board_url"),
        page_links(F.col("url"), H.hide(F.col("html")), limit).alias("_links"))
    # An empty list turns into the page's own URL, so one pass over the boards is enough.
    targets = F.when(F.size("_links") == 0, F.array("board_url")).otherwise(F.col("_links"))
    out = links.select("board_id", F.posexplode(targets).alias("pos", "link"))
    keys = pages.select(U.url_key(F.col("url")).alias("key"), "page_id")
    first = cut_lineage(keys.groupBy("key").agg(F.min("page_id").alias("landed_id")), "landed")
    return out.select("board_id", (F.col("pos") + 1).alias("pos"), "link", U.url_key(F.col("link")).alias("key")).join(
        first, "key")


def fetch_budget(df: DataFrame, n: int, order: tuple[str, ...] = ("board_id", "pos")) -> DataFrame:
    """The first ``n`` fetches of a run in board order; n is at most 400, so this is a small top-k."""
    return top_rows(df, order, n)
