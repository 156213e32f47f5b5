"""The board scrape: lots of boards, a frontier of reached pages, and what ends a run."""

import tempfile

import pytest
from pyspark.sql import functions as F

from listmill.plans import scrape as S
from listmill.sources.page_table import PageTable


def page(title="", links=(), nxt="", text=""):
    anchors = "".join(f'<a href="{u}">x</a>' for u in links) + (f'<a href="{nxt}">Next</a>' if nxt else "")
    return f"<html><head><title>{title}</title></head><body><h1>{title}</h1><article>{text}</article>{anchors}</body></html>"


def site():
    """Ten boards: some with a second and third page, some blocked or not landed; a shared listing; pages that nothing reaches."""
    pages, boards = {}, []
    for b in range(10):
        root = f"https://b{b}.example"
        boards.append((b, f"{root}/jobs"))
        if b == 7:
            continue
        second = f"{root}/jobs?page=2" if b % 2 == 0 else ""
        pages[f"{root}/jobs"] = page("Board", [f"{root}/jobs/{i}" for i in range(3)] + [f"{root}/jobs/gone"], second)
        if second:
            pages[second] = page("Board", [f"{root}/jobs/{i}" for i in range(2, 6)], f"{root}/jobs?page=3" if b == 4 else second)
        if b == 4:
            pages[f"{root}/jobs?page=3"] = page("Board", [f"{root}/jobs/9"], f"{root}/jobs")
        for i in [0, 1, 2, 3, 4, 5, 9]:
            role = "Contract annotator role" if (b + i) % 3 == 0 else "Permanent cook"
            pages[f"{root}/jobs/{i}"] = page(f"Job {b}-{i}", (), "", role)
    pages |= {f"https://far.example/jobs/{i}": page(f"Far {i}", [f"https://far.example/jobs/{i + 1}"], f"https://far.example/jobs/{i + 1}", "Contract annotator") for i in range(40)}
    pages["https://b0.example/jobs/0/"] = page("A later copy", (), "", "Contract annotator")
    robots = [("https://b3.example", 0, "*", False, "/")]
    return boards, list(pages.items()), robots


def frames(spark):
    boards, pages, robots = site()
    return (spark.createDataFrame(boards, "board long, url string"),
            spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string"),
            spark.createDataFrame(robots, "origin string, rule_order long, agent string, allow boolean, path_prefix string"))


def said(run):
    return [sorted(map(repr, df.collect())) for df in (run.listings, run.failures, run.fetches)]


def scraped(spark, n, **given):
    boards, pages, robots = frames(spark)
    return S.scrape(given.get("boards", boards), given.get("pages", pages), robots, ["annotator"], n, F.lit("now"))


def test_lots_of_any_size_give_the_same_run(spark, monkeypatch):
    whole = said(scraped(spark, 6))
    monkeypatch.setattr(S, "_first_lot", lambda cap: 2)
    assert said(scraped(spark, 6)) == whole


def test_a_run_takes_contract_listings_in_board_order(spark):
    run = scraped(spark, 5)
    got = [(r.board, r.title) for r in run.listings.orderBy(*S.ORDER).collect()]
    want = [(b, f"Job {b}-{i}") for b in range(10) if b not in (3, 7) for i in ([0, 1, 2, 3, 4, 5] if b % 2 == 0 else [0, 1, 2]) + [9] * (b == 4) if (b + i) % 3 == 0]
    assert got == want[:5]
    last = want[4][0]
    failed = {(r.url, r.error) for r in run.failures.collect()}
    gone = {(f"https://b{b}.example/jobs/gone", "page has not landed") for b in range(last)}
    assert failed >= gone and all("b7" not in u for u, _ in failed)
    every = scraped(spark, 200)
    assert [(r.board, r.title) for r in every.listings.orderBy(*S.ORDER).collect()] == want
    failed = {(r.url, r.error) for r in every.failures.collect()}
    assert ("https://b3.example/jobs", "Blocked by robots.txt") in failed and ("https://b7.example/jobs", "page has not landed") in failed


def test_only_reached_pages_are_parsed(spark, monkeypatch):
    parsed = []
    plain = S.page_fields
    monkeypatch.setattr(S, "page_fields", lambda df, **given: parsed.append(df) or plain(df, **given))
    monkeypatch.setattr(S, "_first_lot", lambda cap: 2)
    scraped(spark, 2)
    urls = {r.url for df in parsed for r in df.select("url").collect()}
    assert urls and not any("far.example" in u for u in urls) and all(u.startswith(("https://b0.", "https://b1.")) for u in urls)
    plan = parsed[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_a_walk_goes_on_where_one_of_an_earlier_lot_ended(spark, monkeypatch):
    links = {i: page("Board", [f"https://c.example/jobs/{i}"], f"https://c.example/list/{i + 1}") for i in range(14)}
    pages = [(i, f"https://c.example/list/{i}", h) for i, h in links.items()] + [(100 + i, f"https://c.example/jobs/{i}", page(f"Job {i}", (), "", "Contract annotator")) for i in range(14)]
    pages = spark.createDataFrame(pages, "page_id long, url string, html string")
    boards = spark.createDataFrame([(0, "https://c.example/list/0"), (1, "https://c.example/list/5")], "board long, url string")
    monkeypatch.setattr(S, "caps", lambda n: {"target": 200, "max_pages": 6, "max_fetches": 100, "link_limit": 80})
    monkeypatch.setattr(S, "_first_lot", lambda cap: 1)
    run = scraped(spark, 200, boards=boards, pages=pages)
    assert sorted(r.title for r in run.listings.collect()) == sorted(f"Job {i}" for i in range(11))


def test_a_run_without_boards_says_so(spark):
    none = spark.createDataFrame([(1, "  "), (2, None)], "board long, url string")
    run = scraped(spark, 5, boards=none)
    assert [tuple(r) for r in run.failures.collect()] == [("(boards)", "No board URLs provided")]
    assert run.listings.count() == 0 and run.fetches.count() == 0


def test_a_page_table_reads_the_buckets_of_its_keys(spark):
    _, pages, _ = frames(spark)
    table = PageTable.land(pages, tempfile.mkdtemp(prefix="run-") + "/p")
    keys = spark.createDataFrame([("https://b0.example/jobs/0",), ("https://none.example",)], "key string")
    got = table.pages(keys)
    assert [(r.url, "later" in r.html) for r in got.collect()] == [("https://b0.example/jobs/0", False)]
    assert len({f.split("/bucket=")[1].split("/")[0] for f in got.inputFiles()}) <= 2
    with pytest.raises(FileNotFoundError):
        PageTable(spark, tempfile.mkdtemp(prefix="run-"))
