"""The feed search ends early and still gives what a whole scan gives."""

import json

from pyspark.sql import functions as F

from listmill.operators.rank import first_distinct
from listmill.plans import search as S


def payloads(spark, n, hit, offset=0):
    """Remotive payloads of one item each; every ``hit``-th one matches, and every other match repeats an earlier URL."""
    rows = []
    for i in range(n):
        match = i % hit == 0
        url = f"https://x.example/{(i // 2 * 2 if i % (2 * hit) else i) + offset}"
        rows.append((i, json.dumps({"jobs": [{"url": url, "title": f"Annotator {i}" if match else f"Cook {i}", "description": "Contract work", "job_type": "contract",
                                              "company_name": "Co", "candidate_required_location": "", "tags": [], "salary": "", "publication_date": ""}]})))
    return spark.createDataFrame(rows, "payload_id long, payload string")


def whole(feeds, n):
    rows = S.feed_items(feeds, ["annotator"]).select("key", "source", *S.ORDER)
    return sorted(map(tuple, first_distinct(rows, "key", S.ORDER, n).collect()))


def test_early_end_equals_a_whole_scan(spark, monkeypatch):
    read = []
    plain = S.feed_items
    feeds = [S.Feed("remotive.com", payloads(spark, 40, 40), 2), S.Feed("remotive.com", payloads(spark, 400, 4))]
    cases = {n: whole(feeds, n) for n in (1, 10, 60, 200)}
    monkeypatch.setattr(S, "feed_items", lambda feeds, words: read.append(feeds[0].payloads) or plain(feeds, words))
    for n, want in cases.items():
        read.clear()
        got = sorted(map(tuple, S.first_items(feeds, ["annotator"], n, 16).collect()))
        assert got == want
        if n == 10:
            assert sum(df.count() for df in read) <= 16 + 64 + 256
    assert len(cases[200]) < 200 and len(cases[60]) == 60


def test_search_parses_no_more_than_it_needs(spark, monkeypatch):
    read = []
    plain = S.feed_items
    monkeypatch.setattr(S, "feed_items", lambda feeds, words: read.append(feeds[0].payloads.count()) or plain(feeds, words))
    got = S.search([S.Feed("remotive.com", payloads(spark, 3000, 2))], ["annotator"], 20, F.lit("now"))
    assert got.count() == 20 and sum(read) == S.LOT * 20
