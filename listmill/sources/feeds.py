"""JSON feed payloads as listing rows.

Each reader takes rows of ``payload_id`` and ``payload`` (one API response as
text) and returns one row per item with the columns of ``FEED_COLUMNS``.
Missing fields are "" or a default.  No reader shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listmill import vocab as V
from listmill.functions.html import html_to_text
from listmill.functions.pay import compose_annual, compose_salary
from listmill.functions.text import first_nonempty
from listmill.functions.urls import url_key

FEED_COLUMNS = ["source", "priority", "payload_id", "pos", "url", "title", "description", "job_type", "tags",
                "company", "location", "salary", "posted_date"]

REMOTIVE = ("struct<jobs:array<struct<url:string,title:string,description:string,job_type:string,"
            "company_name:string,candidate_required_location:string,salary:string,publication_date:string>>>")
REMOTEOK = ("array<struct<id:string,position:string,title:string,description:string,tags:array<string>,"
            "company:string,salary_min:string,salary_max:string,location:string,url:string,apply_url:string,"
            "date:string>>")
# job_types is a list or a scalar, so its raw text is read.
ARBEITNOW = ("struct<data:array<struct<title:string,description:string,tags:array<string>,job_types:string,"
             "company_name:string,location:string,city:string,url:string,created_at:string>>>")
JOBICY = ("struct<jobs:array<struct<url:string,jobTitle:string,jobDescription:string,jobExcerpt:string,"
          "jobType:string,jobLevel:string,companyName:string,annualSalaryMin:string,annualSalaryMax:string,"
          "salaryCurrency:string,jobGeo:string,pubDate:string>>>")


def _items(df: DataFrame, items: Column) -> DataFrame:
    return df.select("payload_id", F.posexplode(items).alias("pos", "i"))


def _rows(df: DataFrame, source: str, **cols: Column) -> DataFrame:
    no_tags = F.array().cast("array<string>")
    given = {"tags": no_tags, "job_type": F.lit(""), "salary": F.lit(""), **cols}
    fixed = {"source": F.lit(source), "priority": F.lit(V.FEED_SOURCES.index(source) + 1),
             "payload_id": F.col("payload_id"), "pos": F.col("pos")}
    return df.select(*[{**fixed, **given}[c].alias(c) for c in FEED_COLUMNS])


def _text(*names: str) -> Column:
    return first_nonempty(*[F.col(f"i.{n}") for n in names])


def _tags(name: str) -> Column:
    return F.coalesce(F.array_compact(F.col(f"i.{name}")), F.array().cast("array<string>"))


def read_remotive(df: DataFrame) -> DataFrame:
    rows = _rows(
        _items(df, F.from_json("payload", REMOTIVE)["jobs"]), "remotive.com",
        url=_text("url"), title=_text("title"), description=html_to_text(_text("description")),
        job_type=_text("job_type"), company=_text("company_name"),
        location=first_nonempty(_text("candidate_required_location"), F.lit("Remote")),
        salary=_text("salary"), posted_date=_text("publication_date"))
    return rows.where(url_key(F.col("url")) != "")


def read_remoteok(df: DataFrame) -> DataFrame:
    """The first element is a notice; items without id are dropped."""
    parsed = F.from_json("payload", REMOTEOK)
    items = _items(df, F.when(F.size(parsed) > 1, F.slice(parsed, 2, F.greatest(F.size(parsed) - 1, F.lit(1)))))
    return _rows(
        items.where(~F.coalesce(F.col("i.id"), F.lit("")).isin("", "0", "false")), "remoteok.com",
        url=_text("url", "apply_url"), title=_text("position", "title"),
        description=html_to_text(_text("description")), tags=_tags("tags"), company=_text("company"),
        location=first_nonempty(_text("location"), F.lit("Remote")),
        salary=compose_salary(F.col("i.salary_min"), F.col("i.salary_max")), posted_date=_text("date"))


def read_arbeitnow(df: DataFrame) -> DataFrame:
    raw = _text("job_types")
    types = F.when(raw.startswith("["), F.array_compact(F.from_json(raw, "array<string>"))).when(
        raw != "", F.array(raw)).otherwise(F.array().cast("array<string>"))
    return _rows(
        _items(df, F.from_json("payload", ARBEITNOW)["data"]), "arbeitnow.com",
        url=_text("url"), title=_text("title"), description=html_to_text(_text("description")),
        tags=F.concat(_tags("tags"), types), company=_text("company_name"), location=_text("location", "city"),
        posted_date=_text("created_at"))


def read_jobicy(df: DataFrame) -> DataFrame:
    rows = _rows(
        _items(df, F.from_json("payload", JOBICY)["jobs"]), "jobicy.com",
        url=_text("url"), title=_text("jobTitle"),
        description=html_to_text(_text("jobDescription", "jobExcerpt")), job_type=_text("jobType", "jobLevel"),
        company=_text("companyName"), location=first_nonempty(_text("jobGeo"), F.lit("Remote")),
        salary=compose_annual(F.col("i.annualSalaryMin"), F.col("i.annualSalaryMax"), _text("salaryCurrency")),
        posted_date=_text("pubDate"))
    return rows.where(url_key(F.col("url")) != "")


READERS = {"remotive.com": read_remotive, "remoteok.com": read_remoteok, "arbeitnow.com": read_arbeitnow,
           "jobicy.com": read_jobicy}


def bad_payloads(df: DataFrame, source: str) -> DataFrame:
    """A failure row per payload that is no JSON; an answer without the list is an empty one."""
    return df.where(F.try_parse_json("payload").isNull()).select(
        F.concat(F.lit(source + ":"), F.col("payload_id").cast("string")).alias("url"),
        F.lit("payload does not parse").alias("error"))
