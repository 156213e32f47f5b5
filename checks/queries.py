"""The registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Names follow the operators.  Every query reads whole tables; lists are joined
to text so that results compare cell by cell.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import inputs as I
from listmill import vocab as V
from listmill.functions import attributes as A
from listmill.functions import html as H
from listmill.functions import pay as P
from listmill.functions import text as T
from listmill.functions import urls as U
from listmill.functions.classify import contract_rule
from listmill.operators import crawl, listing, merge, rank, report
from listmill.operators.keywords import keyword_hits
from listmill.plans.run import run
from listmill.plans.scrape import scrape
from listmill.plans.search import Feed, search
from listmill.schema import EVENT
from listmill.session import work_dir
from listmill.sources import feeds, pages, snapshot
from listmill.sources.listing_table import ListingTable
from listmill.sources.queue_slices import QueueSlices
from listmill.streaming import progress as prog
from listmill.streaming.ingest import ingest
from listmill.streaming.reviews import review_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NOW = "2024-03-03T00:00:00"
KEYWORDS = "Linguistics, ward coordinator; RLHF"
SEARCH_KEYWORDS = "linguistics, ward"
SEARCH_TARGET = 200
SCRAPE_TARGET = 50
RUN_KEYWORDS, RUN_TARGET, RUN_FEEDS = "freelance", 200, ["remoteok.com", "jobicy.com"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def blob_columns(df: DataFrame) -> DataFrame:
    """Listings with the text that the attribute functions read."""
    parts = ["title", "company", "location", "salary", "description"]
    return df.withColumn("blob", T.plain_ws(F.concat_ws("\n", *parts))).withColumn("low", F.lower("blob"))


# -- scans, sources, sinks --------------------------------------------------------

@query
def page_scan(spark, sf):
    return pages.pages(spark, f"{sf}/pages.parquet")


def _feed(spark, sf, source):
    rows = feeds.READERS[source](I.payloads(spark, sf, source))
    return rows.select(F.col("payload_id").alias("listing_id"), "source", "priority", "url", "title", "description",
                       "job_type", F.array_join("tags", "|").alias("tags"), "company", "location", "salary",
                       "posted_date")


@query
def feed_remotive(spark, sf):
    return _feed(spark, sf, "remotive.com")


@query
def feed_remoteok(spark, sf):
    return _feed(spark, sf, "remoteok.com")


@query
def feed_arbeitnow(spark, sf):
    return _feed(spark, sf, "arbeitnow.com")


@query
def feed_jobicy(spark, sf):
    return _feed(spark, sf, "jobicy.com")


@query
def board_seeds(spark, sf):
    return pages.board_seeds(I.table(spark, sf, "pages").selectExpr(*I.split_list(I.TYPED_URLS)))


@query
def write_read_listings(spark, sf):
    path = work_dir(spark, "snapshot")
    snapshot.write_listings(I.state(spark, sf), path)
    return snapshot.read_listings(spark, path)


@query
def export_json(spark, sf):
    path = work_dir(spark, "export")
    snapshot.export_json(I.state(spark, sf), path)
    return spark.read.schema(", ".join(f"{c} string" for c in V.LISTING_FIELDS)).json(path)


@query
def export_csv(spark, sf):
    path = work_dir(spark, "export")
    snapshot.export_csv(I.state(spark, sf), path)
    schema = ", ".join(f"{c} string" for c in V.CSV_FIELDS)
    back = spark.read.schema(schema).csv(path, header=True, escape='"', multiLine=True)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in V.LISTING_FIELDS])


# -- pages -------------------------------------------------------------------------

@query
def clean_ws(spark, sf):
    docs = I.table(spark, sf, "documents").select("doc_id", "text")
    return docs.select("doc_id", T.clean_ws(F.col("text")).alias("text"))


@query
def html_to_text(spark, sf):
    df = I.table(spark, sf, "pages").select("page_id", "html")
    return df.select("page_id", H.html_to_text(F.col("html")).alias("text"))


def _seen(df):
    return df.withColumn("seen", H.hide(F.col("html")))


@query
def html_select(spark, sf):
    v = F.col("seen")
    return _seen(I.board_pages(spark, sf)).select(
        "page_id",
        H.select_text(v, [".job-location"]).alias("by_class"),
        H.select_text(v, ["main", "article"]).alias("by_tag"),
        H.select_text(v, ["#missing", ".ad"]).alias("second"),
        H.select_text(v, ["[class*='location']", "h1"]).alias("by_part"),
        H.select_text(v, ["time[datetime='2024-01-15']"]).alias("by_value"))


@query
def meta_value(spark, sf):
    v = F.col("seen")
    return _seen(I.job_pages(spark, sf)).select(
        "page_id", H.meta_value(v, V.TITLE_META).alias("title"), H.meta_value(v, V.COMPANY_META).alias("site"))


@query
def page_title(spark, sf):
    return _seen(I.job_pages(spark, sf)).select("page_id", H.page_title(F.col("seen")).alias("title"))


@query
def page_company(spark, sf):
    return _seen(I.job_pages(spark, sf)).select(
        "page_id", H.page_company(F.col("seen"), U.netloc(F.col("url"))).alias("company"))


@query
def page_location(spark, sf):
    return _seen(I.board_pages(spark, sf)).select("page_id", H.page_location(F.col("seen")).alias("location"))


@query
def page_description(spark, sf):
    return _seen(I.board_pages(spark, sf)).select(
        "page_id", H.page_description(F.col("seen")).alias("description"), H.page_body(F.col("seen")).alias("body"))


@query
def posted_date(spark, sf):
    return I.listings(spark, sf).select("listing_id", A.posted_date(T.plain_ws(F.col("description"))).alias("posted"))


@query
def page_posted_date(spark, sf):
    fields = listing.page_fields(I.job_pages(spark, sf), keep=("page_id",))
    return fields.select("page_id", T.first_nonempty(A.posted_date(F.col("description")), F.col("_time")).alias("posted"))


@query
def page_listing(spark, sf):
    return listing.page_listing(I.job_pages(spark, sf), now=F.lit(NOW), keep=("page_id",))


@query
def needs_render(spark, sf):
    df = I.table(spark, sf, "pages").select("page_id", "html").selectExpr(*I.split_list(I.THIN_PAGES))
    return _seen(df).select("page_id", H.needs_render(F.col("html"), F.col("seen")).alias("needs_render"))


@query
def extract_anchors(spark, sf):
    return pages.page_anchors(I.board_pages(spark, sf)).drop("url")


def _hrefs(spark, sf):
    """All real links of all pages, and made-up forms that the pages lack."""
    rows = I.table(spark, sf, "pages").select("page_id", "url", "html")
    real = rows.select("page_id", "url", F.explode(H.hrefs(H.hide(F.col("html")))).alias("href"))
    return real.unionByName(rows.selectExpr(*I.split_list(I.LINK_FORMS)))


def _link_facts(spark, sf):
    return _hrefs(spark, sf).select("page_id", "href", crawl.link_facts(F.col("url"), F.col("href")).alias("f"))


@query
def resolve_href(spark, sf):
    return _hrefs(spark, sf).select("page_id", "href", U.resolve_href(F.col("url"), F.col("href")).alias("link"))


@query
def is_job_link(spark, sf):
    return _link_facts(spark, sf).select("page_id", "href", "f.rule")


@query
def same_site(spark, sf):
    return _link_facts(spark, sf).where("f.url is not null").select("page_id", "href", "f.same_site")


@query
def job_links(spark, sf):
    return crawl.job_links(I.board_pages(spark, sf)).select("page_id", "pos", "link")


@query
def job_links_limited(spark, sf):
    """A limit that cuts most pages' links."""
    return crawl.job_links(I.board_pages(spark, sf), limit=2).select("page_id", "pos", "link")


@query
def next_page(spark, sf):
    return crawl.next_pages(I.board_pages(spark, sf)).select("page_id", "next_url")


# -- filters -----------------------------------------------------------------------

@query
def parse_keywords(spark, sf):
    text = F.concat_ws(",", "title", F.lower("title"), "job_type", F.lit(" RLHF; rlhf\n"), "company", F.upper("company"))
    return I.listings(spark, sf).select("listing_id", F.array_join(T.parse_keywords(text), "|").alias("keywords"))


@query
def matches_keywords(spark, sf):
    hit = T.matches_keywords(F.col("title"), F.col("description"), T.split_keywords(KEYWORDS))
    return I.listings(spark, sf).select("listing_id", hit.alias("hit"))


@query
def keyword_table(spark, sf):
    """How many of a table of phrases, the first two words of every document, each listing's title and description hold."""
    phrases = I.table(spark, sf, "documents").select(F.regexp_extract("text", "^[a-zA-Z]+ [a-zA-Z]+", 0).alias("keyword"))
    texts = I.listings(spark, sf).select(F.col("listing_id").alias("id"), F.concat("title", F.lit("\n"), "description").alias("text"))
    return keyword_hits(texts, phrases).groupBy(F.col("id").alias("listing_id")).agg(F.count("*").alias("hits"))


@query
def is_contract(spark, sf):
    rule = contract_rule(F.col("title"), F.col("description"), job_type=F.col("job_type"),
                         tags=F.array("location"), company=F.col("company"), source=F.col("source"))
    return I.listings(spark, sf).select("listing_id", rule.isNotNull().alias("is_contract"), rule.alias("rule"))


@query
def robots_allowed(spark, sf):
    urls = I.listings(spark, sf).select("listing_id", "url")
    return crawl.robots_filter(urls, I.robots(spark, sf)).select("listing_id", "allowed")


@query
def visible_listings(spark, sf):
    return listing.visible(I.state(spark, sf)).select("id", "status")


@query
def approved_listings(spark, sf):
    return listing.approved(I.state(spark, sf)).select("id", "status")


@query
def usable_items(spark, sf):
    return listing.usable_feed_items(I.listings(spark, sf)).select("listing_id", "url")


# -- extraction --------------------------------------------------------------------

@query
def pay_candidates(spark, sf):
    found = P.pay_candidates(F.col("title"), F.col("description"), F.col("salary"))
    return I.listings(spark, sf).select("listing_id", F.explode(found).alias("c")).select(
        "listing_id", "c.score", (-F.col("c.rule_rank")).alias("rule"), (-F.col("c.pos_rank")).alias("pos"), "c.text")


@query
def pay_format(spark, sf):
    return I.listings(spark, sf).select("listing_id", P.pay_format(F.col("salary")).alias("shown"))


@query
def extract_pay(spark, sf):
    best = P.extract_pay(F.col("title"), F.col("description"), F.col("salary"))
    return I.listings(spark, sf).select("listing_id", best.alias("pay"))


@query
def choose_pay(spark, sf):
    mined = I.listings(spark, sf).withColumn("mined", P.extract_pay(F.col("title"), F.col("description"), F.col("salary")))
    chosen = mined.withColumn("chosen", P.choose_pay(F.col("salary"), F.col("mined")))
    return chosen.select("listing_id", "chosen", P.pay_or_raw(F.col("chosen"), F.col("mined"), F.col("salary")).alias("pay"))


@query
def hours_per_week(spark, sf):
    return blob_columns(I.listings(spark, sf)).select("listing_id", A.hours(F.col("blob")).alias("hours"))


@query
def duration(spark, sf):
    return blob_columns(I.listings(spark, sf)).select("listing_id", A.duration(F.col("blob")).alias("duration"))


@query
def work_mode(spark, sf):
    return blob_columns(I.listings(spark, sf)).select(
        "listing_id", A.work_mode(F.col("low")).alias("work_mode"), A.employment_type(F.col("low")).alias("employment_type"))


@query
def salary_compose_minmax(spark, sf):
    return I.table(spark, sf, "part").select("p_partkey", P.compose_salary(
        F.expr("p_size * 12"), F.expr("CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_retailprice END")).alias("salary"))


@query
def salary_compose_annual(spark, sf):
    return I.table(spark, sf, "part").select("p_partkey", P.compose_annual(
        F.expr("p_size * 1000"), F.expr("CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_retailprice END"),
        F.expr("CASE WHEN p_size % 2 = 0 THEN 'eur' ELSE '' END")).alias("salary"))


def _from_low(name, fn):
    def run(spark, sf):
        return blob_columns(I.listings(spark, sf)).select("listing_id", fn(F.col("low")).alias(name))

    run.__name__ = name
    return query(run)


_from_low("domain", A.domain)
_from_low("task_type", A.task_type)
_from_low("languages", A.languages)
_from_low("tools_skills", A.tools)
_from_low("screening", A.screening)


@query
def client_partner(spark, sf):
    return blob_columns(I.listings(spark, sf)).select(
        "listing_id", A.client_partner(F.col("blob")).alias("client_partner"))


@query
def sections(spark, sf):
    rows = I.listings(spark, sf).withColumn("text", T.plain_ws(F.col("description")))
    return rows.select("listing_id", *[A.section(F.col("text"), g).alias(g) for g in V.SECTION_HEADERS])


@query
def feed_listing(spark, sf):
    rows = I.listings(spark, sf).withColumn("posted_date", F.lit(" 2024-01-01  x "))
    return listing.feed_listing(rows, F.lit(NOW), keep=("listing_id",))


# -- joins -------------------------------------------------------------------------

@query
def follow_links(spark, sf):
    return crawl.follow_links(I.board_pages(spark, sf), I.landed_pages(spark, sf)).select(
        "board_id", "pos", "key", "landed_id")


@query
def unseen(spark, sf):
    new = I.batch(spark, sf)
    return rank.unseen(new, I.listings(spark, sf)).select("id", "url")


@query
def upsert_listings(spark, sf):
    return merge.upsert_listings(I.state(spark, sf), I.batch(spark, sf), F.lit(NOW))


@query
def apply_reviews(spark, sf):
    folded = merge.fold_actions(I.review_events(spark, sf), ["pay_rate", "notes"])
    return merge.apply_reviews(I.state(spark, sf), folded)


@query
def unknown_reviews(spark, sf):
    folded = merge.fold_actions(I.review_events(spark, sf), ["pay_rate", "notes"])
    return merge.unknown_reviews(I.state(spark, sf), folded)


@query
def mark_deleted(spark, sf):
    ids = I.review_events(spark, sf).where("action = 'delete'")
    return merge.mark_deleted(I.state(spark, sf), ids, F.lit(NOW)).select("id", "status", "updated_at")


def _table(spark, sf):
    table = ListingTable(spark, work_dir(spark, "table"))
    table.load(I.state(spark, sf))
    return table


@query
def bucketed_upsert(spark, sf):
    """The upsert in a bucketed table: a run that is merged into the buckets it touches."""
    table = _table(spark, sf)
    table.upsert(I.batch(spark, sf), F.lit(NOW))
    table.settle()
    return table.read()


@query
def merge_on_read(spark, sf):
    """The same batch in three runs that are folded and merged when the table is read."""
    table = _table(spark, sf)
    table.fan = 2
    place = F.pmod(F.xxhash64(merge.merge_key()), F.lit(3))
    for i in range(3):
        table.upsert(I.batch(spark, sf).where(place == i), F.lit(NOW))
        table.compact()
    return table.read()


@query
def bucketed_reviews(spark, sf):
    table = _table(spark, sf)
    table.review(merge.fold_actions(I.review_events(spark, sf), ["pay_rate", "notes"]))
    table.settle()
    return table.read()


@query
def bucketed_delete(spark, sf):
    table = _table(spark, sf)
    table.delete(I.review_events(spark, sf).where("action = 'delete'"), NOW)
    table.settle()
    return table.read().select("id", "status", "updated_at")


@query
def bucketed_lookup(spark, sf):
    return _table(spark, sf).lookup(I.review_events(spark, sf)).select("id", "title", "status")


@query
def lookup(spark, sf):
    return merge.lookup(I.state(spark, sf), I.review_events(spark, sf)).select("id", "title", "status")


# -- dedup, ranking, limits --------------------------------------------------------

@query
def url_key(spark, sf):
    return I.listings(spark, sf).select("listing_id", U.url_key(F.col("url")).alias("url_key"))


def _feed_rows(spark, sf, source):
    return feeds.READERS[source](I.payloads(spark, sf, source))


def _all_feeds(spark, sf):
    out = None
    for source in V.FEED_SOURCES:
        rows = _feed_rows(spark, sf, source).withColumn("pass", F.lit(1))
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def dedup_source(spark, sf):
    rows = rank.dedup_source(_all_feeds(spark, sf).select("source", "payload_id", "pos", "url"))
    return rows.select("source", F.col("payload_id").alias("listing_id"), "url")


@query
def dedup_cross(spark, sf):
    rows = rank.dedup_cross(_all_feeds(spark, sf).select("pass", "priority", "source", "payload_id", "pos", "url"))
    return rows.select("source", F.col("payload_id").alias("listing_id"), "url")


@query
def quota(spark, sf):
    rows = _all_feeds(spark, sf).select("pass", "priority", "source", "payload_id", "pos", "url")
    return rank.quota(rows, 150).select("source", F.col("payload_id").alias("listing_id"), "url")


@query
def first_distinct(spark, sf):
    rows = _all_feeds(spark, sf).withColumn("key", U.url_key(F.col("url"))).where("key <> ''").select(
        "key", "source", "pass", "priority", "payload_id", "pos")
    return rank.first_distinct(rows, "key", ["pass", "priority", "payload_id", "pos"], 200).select(
        "key", "source", F.col("payload_id").alias("listing_id"))


@query
def rank_title_hit(spark, sf):
    rows = I.listings(spark, sf).select("listing_id", "title")
    return rank.rank_hits(rows, T.split_keywords(KEYWORDS), tie=("listing_id",))


def _search(spark, sf):
    found = [Feed(s, I.payloads(spark, sf, s)) for s in V.FEED_SOURCES]
    return search(found, T.split_keywords(SEARCH_KEYWORDS), SEARCH_TARGET, F.lit(NOW))


@query
def search_feeds(spark, sf):
    return _search(spark, sf)


@query
def fill_remaining(spark, sf):
    order = ["source", "listing_id"]
    online = rank.dedup_cross(I.listings(spark, sf).withColumn("contract", contract_rule(
        F.col("title"), F.col("description"), company=F.col("company"))).where("contract = 'platform'"),
        order).select(*order, "url")
    boards = _seen(I.board_pages(spark, sf)).select(
        U.netloc(F.col("url")).alias("source"), F.col("page_id").alias("listing_id"), "url")
    return rank.fill_remaining(online, boards, 200, order)


@query
def board_walk(spark, sf):
    from listmill.operators.slices import with_next

    nodes = I.table(spark, sf, "pages").select(F.col("page_id").alias("node"), U.netloc(F.col("url")).alias("host"))
    edges = with_next(nodes, ["host"], ["node"], ["node"])
    seeds = nodes.groupBy("host").agg(F.min("node").alias("node")).select("node")
    return crawl.walk(seeds, edges, 8)


@query
def scaled_caps(spark, sf):
    return rank.scaled_caps(I.table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 5 - 3).alias("n")), "n")


@query
def fetch_budget(spark, sf):
    links = crawl.job_links(I.board_pages(spark, sf)).select(F.col("page_id").alias("board_id"), "pos", "link")
    return crawl.fetch_budget(links, 400)


def _boards(spark, sf):
    """Boards and the rules of their sites."""
    boards = I.board_pages(spark, sf).select(F.col("page_id").alias("board"), "url")
    rules = I.table(spark, sf, "pages").select(
        U.origin(F.col("url")).alias("origin"), F.col("page_id").alias("rule_order"), F.lit("*").alias("agent"),
        (F.col("page_id") % 3 != 0).alias("allow"), F.expr("'/' || substr(regexp_extract(url, '//[^/]+/([^?#]*)', 1), 1, 2)").alias("path_prefix"))
    return boards, rules


def _scrape(spark, sf):
    boards, rules = _boards(spark, sf)
    return scrape(boards, I.landed_pages(spark, sf), rules, [], SCRAPE_TARGET, F.lit(NOW))


@query
def board_scrape(spark, sf):
    return _scrape(spark, sf).listings


@query
def scrape_fetches(spark, sf):
    return _scrape(spark, sf).fetches.select("board", "hop", "pos", "key", "accept")


@query
def scrape_failures(spark, sf):
    return _scrape(spark, sf).failures


def _run(spark, sf):
    """Feeds, some of whose payloads are broken, then boards for the rest."""
    found = [Feed(s, I.payloads(spark, sf, s).withColumn("payload", F.when(F.col("payload_id") % 97 == 0, F.lit("{")).otherwise(F.col("payload"))))
             for s in RUN_FEEDS]
    boards, rules = _boards(spark, sf)
    return run(spark, "both", T.split_keywords(RUN_KEYWORDS), RUN_TARGET, found, boards, I.landed_pages(spark, sf), rules, F.lit(NOW))


@query
def run_both(spark, sf):
    return _run(spark, sf).listings.drop("seq")


@query
def run_both_failures(spark, sf):
    return _run(spark, sf).failures


@query
def run_both_outcome(spark, sf):
    return _run(spark, sf).outcome


@query
def run_both_progress(spark, sf):
    return _run(spark, sf).progress


@query
def queue_page(spark, sf):
    return rank.queue_page(I.state(spark, sf).select("id", "title", "status", "created_at"), 57)


@query
def queue_slice_page(spark, sf):
    """The same page from stored slices: their counts say which one holds it."""
    rows = I.state(spark, sf).select("id", "title", "status", "created_at")
    return QueueSlices.build(rows, work_dir(spark, "queue")).page(57)


@query
def queue_positions(spark, sf):
    return rank.queue_positions(I.state(spark, sf).select("id", "status", "created_at"))


# -- aggregates --------------------------------------------------------------------

@query
def status_counts(spark, sf):
    folded = merge.fold_actions(I.review_events(spark, sf), ["pay_rate"])
    return report.status_counts(merge.apply_reviews(I.state(spark, sf).select("id", "pay_rate", "status", "updated_at"), folded))


def _runs(spark, sf):
    rows = I.listings(spark, sf).select(F.col("source").alias("run_id"), "url", "title")
    key = U.url_key(F.col("url"))
    sources = rows.select("run_id").distinct()
    # some runs collect nothing and fail nowhere
    runs = sources.union(sources.select(F.concat("run_id", F.lit(":none")))).withColumn("target", F.lit(250).cast("bigint"))
    return report.run_outcome(runs, rows.where(key != ""), rows.where(key == ""))


@query
def run_outcome(spark, sf):
    return _runs(spark, sf)


@query
def failures(spark, sf):
    rows = I.listings(spark, sf).select("listing_id", "url")
    blank = rows.where("url = ''").select(F.format_string("listing:%d", "listing_id").alias("url"),
                                          F.lit("no url").alias("error"))
    broken = I.payloads(spark, sf, "remotive.com").withColumn(
        "payload", F.when(F.col("payload_id") % 10 == 0, F.lit('{"jobs":')).otherwise(F.col("payload")))
    return report.failures(blank, feeds.bad_payloads(broken, "remotive.com"))


@query
def failure_panel(spark, sf):
    runs = prog.progress(I.progress_events(spark, sf), ["message", "collected", "finished", "running"])
    panel = runs.select(
        "run_id", F.expr("CASE WHEN run_id % 5 = 0 THEN 'Request refused' END").alias("request_error"),
        F.expr("CASE WHEN run_id % 3 = 0 THEN 'Short run' ELSE '' END").alias("error"), "message", "collected",
        (F.col("run_id") % 2).alias("failed"), F.lit(True).alias("finished"), F.lit(False).alias("running"))
    return report.failure_panel(panel)


@query
def progress_pct(spark, sf):
    runs = prog.progress(I.progress_events(spark, sf), ["collected"])
    return runs.select("run_id", report.progress_pct(F.col("collected"), F.col("run_id") % 8).alias("pct"))


@query
def preview_line(spark, sf):
    return I.state(spark, sf).select("id", report.preview_line().alias("preview"))


# -- sets --------------------------------------------------------------------------

@query
def union_sources(spark, sf):
    first = I.listings(spark, sf).select("listing_id", "source", "url")
    second = I.batch(spark, sf).select(F.col("seq").alias("listing_id"), F.col("source_board").alias("source"), "url")
    return rank.union_sources(first, second)


@query
def clear_queue(spark, sf):
    return merge.clear_queue(I.state(spark, sf)).select("id", "status")


# -- streams -----------------------------------------------------------------------

def _event_stream(spark, sf):
    return spark.readStream.schema(EVENT).parquet(f"{sf}/events*.parquet")


@query
def review_events_stream(spark, sf):
    actions = _event_stream(spark, sf).selectExpr(*I.split_list(I.REVIEW_EVENTS))
    return merge.apply_reviews(I.state(spark, sf), review_stream(actions, ["pay_rate", "notes"]))


PROGRESS_FIELDS = ["message", "collected", "finished", "running"]


@query
def change_only(spark, sf):
    return prog.change_only(I.progress_events(spark, sf), ["message", "collected"]).select(
        "run_id", "event_id", "message", "collected")


@query
def change_only_until_finished(spark, sf):
    rows = prog.until_finished(I.progress_events(spark, sf), ["ts", "event_id"])
    return prog.change_only(rows, ["message", "collected"]).select("run_id", "event_id", "message", "collected")


@query
def change_only_stream(spark, sf):
    stream = _event_stream(spark, sf).selectExpr(*I.split_list(I.PROGRESS_EVENTS))
    return prog.change_only_stream(stream, ["message", "collected"]).select("run_id", "event_id", "message", "collected")


@query
def change_only_until_finished_stream(spark, sf):
    stream = _event_stream(spark, sf).selectExpr(*I.split_list(I.PROGRESS_EVENTS))
    return prog.change_only_stream(stream, ["message", "collected"], end=True).select("run_id", "event_id", "message", "collected")


@query
def progress_upsert(spark, sf):
    return prog.progress(I.progress_events(spark, sf), PROGRESS_FIELDS)


@query
def progress_upsert_stream(spark, sf):
    stream = _event_stream(spark, sf).selectExpr(*I.split_list(I.PROGRESS_EVENTS))
    return prog.progress_stream(stream, PROGRESS_FIELDS)


@query
def ingest_stream(spark, sf):
    path = work_dir(spark, "ingested")
    ListingTable(spark, path).load(I.state(spark, sf))
    arriving = spark.readStream.schema("doc_id bigint, text string").parquet(f"{sf}/documents*.parquet")
    rows = arriving.selectExpr(*I.split_list(I.LISTINGS)).selectExpr(*I.split_list(I.BATCH))
    return ingest(rows, path, F.lit(NOW))
