"""The combined run: feeds, boards for the rest, one outcome, and going on after a cut."""

import tempfile

import pytest
from pyspark.sql import functions as F

from listmill.plans import run as R
from listmill.plans.search import Feed
from listmill.sources.listing_table import ListingTable
from tests.test_scrape import frames
from tests.test_search import payloads


def parts(spark):
    boards, pages, robots = frames(spark)
    broken = spark.createDataFrame([(99, "{")], "payload_id long, payload string")
    feeds = [Feed("remotive.com", payloads(spark, 8, 4).union(broken))]
    return dict(feeds=feeds, boards=boards, pages=pages, robots=robots, now=F.lit("now"))


def fresh():
    return tempfile.mkdtemp(prefix="run-") + "/run"


def test_boards_fill_what_feeds_leave_and_a_cut_run_goes_on(spark, monkeypatch):
    given, path = parts(spark), fresh()
    table = ListingTable(spark, fresh(), buckets=2)
    plain, asked = R.scrape, []

    def cut(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(R, "scrape", cut)
    with pytest.raises(RuntimeError):
        R.run(spark, "both", ["annotator"], 5, table=table, path=path, **given)
    online = table.read().count()
    assert online > 0 and all(r.title.startswith("Annotator") for r in table.read().collect())

    def again(*args):
        raise AssertionError("feeds were searched twice")

    monkeypatch.setattr(R, "first_items", again)
    monkeypatch.setattr(R, "scrape", lambda *args: asked.append(args[4]) or plain(*args))
    ran = R.run(spark, "both", ["annotator"], 5, table=table, path=path, **given)
    rows = ran.listings.orderBy(F.desc("stage"), "seq").collect()
    assert asked == [5 - online] and len(rows) == 5
    assert [r.stage for r in rows] == ["feeds"] * online + ["boards"] * (5 - online)
    assert [r.title for r in rows[online:]] == ["Job 0-0", "Job 0-3", "Job 1-2", "Job 2-1"][: 5 - online]
    assert table.read().count() == 5
    failed = {(r.stage, r.url) for r in ran.failures.collect()}
    assert ("feeds", "remotive.com:99") in failed and ("boards", "https://b0.example/jobs/gone") in failed
    end = ran.outcome.first()
    assert (end.collected, end.failed, end.target, end.zero, end.short) == (5, len(failed), 5, False, False)
    assert end.message == "Done. Collected 5 / 5 matching contract jobs." and end.error == f"Finished with {len(failed)} source warning(s)."
    steps = ran.progress.orderBy("step").collect()
    assert [s.message for s in steps] == ["Starting…", f"Online found {online}. Scraping boards for {5 - online} more…", end.message]
    assert [(s.running, s.finished) for s in steps] == [(True, False), (True, False), (False, True)]
    with pytest.raises(ValueError, match="something else"):
        R.run(spark, "both", ["annotator"], 6, path=path, **given)


def test_full_feeds_leave_the_boards_alone(spark, monkeypatch):
    given = parts(spark)
    monkeypatch.setattr(R, "scrape", lambda *args: pytest.fail("boards were walked"))
    later = Feed("jobicy.com", spark.createDataFrame([(1, "{")], "payload_id long, payload string"))
    ran = R.run(spark, "both", ["annotator"], 1, **{**given, "feeds": [*given["feeds"], later]})
    assert [r.stage for r in ran.listings.collect()] == ["feeds"]
    assert [r.url for r in ran.failures.collect()] == ["remotive.com:99"]  # the later feed was not come to
    assert ran.progress.count() == 2


def test_requests_that_cannot_run_change_nothing(spark):
    given = parts(spark)
    table = ListingTable(spark, fresh(), buckets=2)
    blank = spark.createDataFrame([(1, " ")], "board long, url string")
    for mode, words, boards, said in [("both", [], given["boards"], "keyword"), ("online", [], None, "keyword"), ("both", ["a"], blank, "board URL"),
                                      ("urls", [], None, "board URL"), ("none", ["a"], None, "one of")]:
        with pytest.raises(ValueError, match=said):
            R.run(spark, mode, words, 3, table=table, **{**given, "boards": boards})
    assert table.version() == ListingTable(spark, fresh(), buckets=2).version()
