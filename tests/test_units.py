"""Cases worked out by hand from the rules."""

import pytest
from pyspark.sql import functions as F

from listmill import vocab as V
from listmill.functions import attributes as A
from listmill.functions import html as H
from listmill.functions import pay as P
from listmill.functions import text as T
from listmill.functions import urls as U
from listmill.functions.classify import contract_rule
from listmill.operators.crawl import link_facts
from listmill.operators.rank import caps


def values(spark, inputs, fn):
    """fn over one string column; results in input order."""
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(inputs)], "i int, s string")
    return [r.x for r in rows.select("i", fn(F.col("s")).alias("x")).orderBy("i").collect()]


def check(spark, cases, fn):
    assert dict(zip(cases, values(spark, list(cases), fn))) == cases


def test_pay_format(spark):
    check(spark, {
        "$45 - $60 per hour": "$45-$60/hr",
        "$60-45/hr": "$45-$60/hr",
        "$45.50/hr": "$45.5/hr",
        "$50,000/hr": "$50,000/yr",
        "50": "$50/hr",
        "$10": "$10",
        "2500": "$0-$250",
        "EUR 50,000-60,000/yr": "$50,000-$60,000/yr",
        "Competitive": "",
        "": "",
        "US$ 1,234.50 per year": "$1,234/yr",
        "$30 to $30 hourly": "$30/hr",
    }, P.pay_format)


def test_extract_pay(spark):
    check(spark, {
        "We raised $50,000,000 in funding": "",
        "$80,000 per year. Rate: $40/hr": "$40/hr",
        "USD 90,000 to 100,000": "$90,000-$100,000/yr",
        "40–60/hr": "$40-$60/hr",
        "pay of $2024": "$202/hr",
        "no figures": "",
        "compensation is $35": "$35/hr",
        "70-75 USD/hr": "$70-$75/hr",
        "rates: $25 an hour " + "x " * 400 + "$90/hour": "$25/hr",
    }, lambda c: P.extract_pay(c))


def test_pay_on_long_texts_is_the_same_as_on_all_candidates(spark):
    filler = "lorem ipsum dolor sit amet " * 40
    texts = [f"{filler}$40/hr{filler}", f"$40/hr{filler}rate $45/hr", f"{filler}{filler}", f"{filler}salary $90,000{filler}",
             f"users {filler}$70 per hour", f"raised 12 {filler} USD 55 per hour for models"]
    rows = spark.createDataFrame([(t,) for t in texts], "s string")
    best = F.array_max(P.pay_candidates(F.col("s")))
    both = rows.select(P.extract_pay(F.col("s")).alias("fast"),
                       F.when(best["score"] >= V.MIN_PAY_SCORE, best["text"]).otherwise("").alias("full")).collect()
    assert [r.fast for r in both] == [r.full for r in both]
    assert both[0].fast == "$40/hr"


def test_compose(spark):
    rows = spark.createDataFrame([("40", "40"), ("40", "50"), ("70000", "95000"), ("0", "300"), ("600", ""), ("x", "5"),
                                  (None, None)], "lo string, hi string")
    out = rows.select(P.compose_salary(F.col("lo"), F.col("hi")).alias("m"),
                      P.compose_annual(F.col("lo"), F.col("hi"), F.lit("eur")).alias("a")).collect()
    assert [r.m for r in out] == ["$40/hr", "$40-$50/hr", "$70,000-$95,000/yr", "$300/hr", "$600/yr", "", ""]
    assert [r.a for r in out] == ["EUR 40/yr", "EUR 40-EUR 50/yr", "EUR 70,000-EUR 95,000/yr", "EUR 300/yr", "EUR 600/yr",
                                  "", ""]


@pytest.mark.parametrize("args, rule", [
    (dict(company="Surgery Partners"), "platform"),
    (dict(job_type="Part-time"), "token"),
    (dict(job_type="full time contract"), "phrase"),
    (dict(title="Annotator", text="full-time permanent"), None),
    (dict(title="Annotator", text="full-time\npermanent"), "labeling"),
    (dict(title="Annotator", text="permanent, full time"), None),
    (dict(title="A temp job"), "word"),
    (dict(title="Temperature nurse"), None),
    (dict(title="tempé"), None),
    (dict(title="They contracted flu"), "phrase"),
    (dict(tags=["Gig"]), "token"),
    (dict(), None),
])
def test_contract_rule(spark, args, rule):
    col = {k: F.lit(args.get(k, "")) for k in ("title", "text", "job_type", "company", "source")}
    tags = F.array(*[F.lit(t) for t in args.get("tags", [])]).cast("array<string>")
    assert spark.range(1).select(contract_rule(**col, tags=tags).alias("r")).first().r == rule


def test_attributes(spark):
    check(spark, {"statistics tutor": "", "proof based work": "Mathematics", "life science and law": "Biology / life sciences",
                  "lawn": ""}, lambda c: A.domain(c))
    check(spark, {"15 to 30 hours per week": "15 to 30 hours per week", "up to 20 hrs/week": "up to 20 hrs/week",
                  "10 hours": "", "10-12 hours": "10-12 hours"}, A.hours)
    check(spark, {"Contract duration: six weeks. x": "Contract duration: six weeks", "3 – 6 months": "3 – 6 months",
                  "open ended": "open ended", "none": ""}, A.duration)
    check(spark, {"hybrid, async": "async remote", "hybrid": "hybrid", "office": "remote"}, lambda c: A.work_mode(c))
    check(spark, {"rlhf annotators evaluate prompts, ocr": "RLHF, Data labeling / annotation, Model evaluation, OCR / extraction QA",
                  "preference\nranking": "", "preference of ranking": "Preference ranking"}, lambda c: A.task_type(c))
    check(spark, {"english": "English", "fluent in english": "English + additional (see description)", "fluent in x": ""},
          lambda c: A.languages(c))
    check(spark, {"We partner with a leading frontier AI lab in town. x": "leading frontier AI lab in town",
                  "for OpenAI": "OpenAI", "for us": ""}, A.client_partner)
    check(spark, {"update: 12 Jan 2024!": "12 Jan 2024", "Posted : May 3, 2024": "May 3, 2024", "published 2024-01-02": "2024-01-02"},
          A.posted_date)


def test_sections(spark):
    text = "Intro\nWhat you’ll do:\n label items\nNice to have\nLaTeX\n"
    row = spark.createDataFrame([(text,)], "t string").select(
        *[A.section(F.col("t"), g).alias(g) for g in V.SECTION_HEADERS]).first()
    assert row.responsibilities == "label items"
    assert row.preferred == "LaTeX"
    assert row.requirements == ""


def test_text(spark):
    check(spark, {" a \n b": "a b", "\x1fx\x85": "x", "": ""}, T.clean_ws)
    assert values(spark, ["RLHF, rlhf;x\n", " , "], T.parse_keywords) == [["RLHF", "x"], []]
    assert T.split_keywords("RLHF, rlhf;x\n") == ["RLHF", "x"]
    check(spark, {"HTTPS://A.example/Jobs/1//": "https://a.example/jobs/1", "": ""}, U.url_key)


def test_html(spark):
    page = ("<html><head><title>T &amp; x</title><meta name='og:title' content='N'><meta property='og:title' content=' A&eacute; b '>"
            "</head><body><!-- <p>c</p> --><script>var a='</p>'</script><div class='x company y'>Co<div>in</div>ner</div>tail"
            "<a href='/jobs/1'>Next</a> a < b &#8364;&#x41;&nbsp; &foo; <img class='location'><p data-qa=\"a>b\">q</p></body>")
    row = spark.createDataFrame([(page,)], "h string").withColumn("v", H.hide(F.col("h"))).select(
        H.visible_text(F.col("v")).alias("text"), H.page_title(F.col("v")).alias("title"),
        H.select_text(F.col("v"), [".company"]).alias("company"), H.page_location(F.col("v")).alias("location"),
        H.next_page(F.lit("http://a.b/c/d?q"), F.col("v")).alias("next"),
        H.select_text(F.col("v"), [".none", "title"]).alias("second"), H.host_company(F.lit("www.cheap-pills.x")).alias("host"),
    ).first()
    assert row.text == "T & x Co in ner tail Next a < b €A  &foo; q".replace("A  &", "A\xa0 &")
    assert row.title == "Aé b"
    assert row.company == "Co in ner"
    assert row.location == ""
    assert row.next == "http://a.b/jobs/1"
    assert row.second == "T & x"
    assert row.host == "Cheap-Pills"


def test_meta_property_hides_name(spark):
    page = "<meta property='k'><meta name='k' content='n'><meta name='z' content='last'>"
    assert values(spark, [page], lambda c: H.meta_value(c, ["k", "z"])) == ["last"]


@pytest.mark.parametrize("href, link", [
    ("e", "http://a.b/c/e"), ("/e", "http://a.b/e"), ("../e", "http://a.b/e"), ("./e", "http://a.b/c/e"),
    ("?z", "http://a.b/c/d?z"), ("//h/x", "http://h/x"), ("#q", None), ("mailto:x", None), ("", None),
    ("ftp://x/y", None), ("..", "http://a.b/"), ("/a/./b/../c?x#y", "http://a.b/a/c?x#y"),
])
def test_resolve_href(spark, href, link):
    row = spark.range(1).select(U.resolve_href(F.lit("http://a.b/c/d?q#f"), F.lit(href)).alias("x")).first()
    assert row.x == link


@pytest.mark.parametrize("link, rule", [
    ("http://x.example/jobs", 7), ("https://jobs.lever.co/acme", None), ("https://jobs.lever.co/acme/1", 2),
    ("https://boards.greenhouse.io/a/jobs/1", 1), ("http://x.example/career", None), ("http://x.example/Careers/a", 6),
    ("http://x.example/openings", 7), ("http://x.example/vacancies", None),
])
def test_job_link(spark, link, rule):
    row = spark.range(1).select(link_facts(F.lit("http://x.example/"), F.lit(link)).alias("f")).first()
    assert row.f.rule == rule


def test_caps():
    assert caps(10) == {"target": 10, "max_pages": 14, "max_fetches": 200, "link_limit": 100, "feed_pages": 18,
                        "deep_feed_pages": 33}
    assert caps(0)["target"] == 1 and caps(200)["max_fetches"] == 400
