"""Listing rows: assembly from feed items and pages, filters, ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listmill import vocab as V
from listmill.functions import html as H
from listmill.functions.attributes import posted_date, with_attributes
from listmill.functions.classify import contract_rule
from listmill.functions.pay import extract_pay, pay_or_raw
from listmill.functions.text import clean_ws, first_nonempty, let, matches_keywords, nonempty
from listmill.functions.urls import netloc, url_key


def now_iso() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def listing_id(url: Column, source: Column, title: Column, description: Column) -> Column:
    """A repeatable id: hash of the URL key, or of the content where there is no URL."""
    content = F.concat_ws("\n", source, title, description)
    return F.sha2(F.coalesce(nonempty(url_key(url)), content), 256)


def _assemble(df: DataFrame, pay: Column, posted: Column, source: Column, now: Column | None,
              keep: Sequence[str]) -> DataFrame:
    now = now_iso() if now is None else now
    cut = {c: F.substring(clean_ws(F.col(c)), 1, V.MAX_CHARS[c]) for c in ("title", "company", "location",
                                                                          "description")}
    cols = {
        **{c: F.col(c) for c in V.LISTING_FIELDS if c in df.columns},
        **cut,
        "id": listing_id(F.col("url"), source, F.col("title"), F.col("description")),
        "source_board": source,
        "posted_date": posted,
        "salary": pay,
        "pay_rate": pay,
        "notes": F.lit(""),
        "status": F.lit("unreviewed"),
        "created_at": now,
        "updated_at": now,
    }
    return df.select(*keep, *[cols[c].alias(c) for c in V.LISTING_FIELDS])


def feed_listing(df: DataFrame, now: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Full listings from feed items: mined attributes, defaults, truncation."""
    rich = with_attributes(df)
    rich = rich.withColumn("_pay", pay_or_raw(F.col("_chosen"), F.col("_mined"), F.col("salary")))
    posted = F.substring(clean_ws(F.col("posted_date")), 1, V.MAX_CHARS["posted_date"])
    return _assemble(rich, F.col("_pay"), posted, F.col("source"), now, keep)


def page_fields(df: DataFrame, keep: Sequence[str] = (), extra: dict[str, Column] | None = None) -> DataFrame:
    """Title, company, location, description and date text of pages (url, html).

    ``extra`` columns may use ``_seen``, the page without comments and scripts.
    """
    seen = df.select(*keep, "url", H.hide(F.col("html")).alias("_seen"))
    seen = seen.withColumn("_main", H.select_text(F.col("_seen"), V.DESCRIPTION_SELECTORS))
    v, main = F.col("_seen"), F.col("_main")
    return seen.select(
        *keep, "url",
        H.page_title(v).alias("title"),
        H.page_company(v, netloc(F.col("url"))).alias("company"),
        H.page_location(v).alias("location"),
        F.when(main != "", main).otherwise(H.page_body(v)).alias("description"),
        F.when(main != "", H.time_tag(v)).otherwise(let(H.without_chrome(v), H.time_tag)).alias("_time"),
        *[c.alias(name) for name, c in (extra or {}).items()],
    )


def listing_from_fields(df: DataFrame, source: Column | None = None, now: Column | None = None,
                        keep: Sequence[str] = ()) -> DataFrame:
    """Full listings from the columns of ``page_fields``."""
    mined = df.withColumn("salary", extract_pay(F.col("title"), F.col("description")))
    rich = with_attributes(mined)
    pay = F.substring(first_nonempty(F.col("_chosen"), F.col("salary")), 1, V.MAX_CHARS["pay_rate"])
    rich = rich.withColumn("_pay", pay)
    posted = F.substring(first_nonempty(posted_date(F.col("description")), F.col("_time")), 1,
                         V.MAX_CHARS["posted_date"])
    board = netloc(F.col("url")) if source is None else first_nonempty(source, netloc(F.col("url")))
    return _assemble(rich, F.col("_pay"), posted, board, now, keep)


def page_listing(df: DataFrame, source: Column | None = None, now: Column | None = None,
                 keep: Sequence[str] = ()) -> DataFrame:
    """Full listings from landed pages."""
    kept = keep if source is None else (*keep, "_source")
    rows = df if source is None else df.withColumn("_source", source)
    return listing_from_fields(page_fields(rows, kept), None if source is None else F.col("_source"), now, keep)


# -- filters ------------------------------------------------------------------

def visible(df: DataFrame) -> DataFrame:
    """Listings that are not deleted."""
    return df.where(F.col("status") != "deleted")


def approved(df: DataFrame) -> DataFrame:
    """Listings that a reviewer saved."""
    return df.where(F.col("status") == "saved")


def usable_pages(df: DataFrame) -> DataFrame:
    return df.where(F.col("title") != "")


def usable_feed_items(df: DataFrame) -> DataFrame:
    return df.where(url_key(F.col("url")) != "")


def keyword_filter(df: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Feed items whose title, description or tags hold any of the keywords."""
    if not keywords:
        return df
    text = F.concat_ws("\n", F.col("description"), F.array_join("tags", " "))
    return df.where(matches_keywords(F.col("title"), text, keywords))


def contract_filter(df: DataFrame) -> DataFrame:
    """Feed items that are contract work."""
    return df.where(contract_rule(
        F.col("title"), F.col("description"), job_type=F.col("job_type"), tags=F.col("tags"),
        company=F.col("company"), source=F.col("source")).isNotNull())
