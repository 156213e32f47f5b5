"""Inputs of the registered queries, derived from the given tables.

Each input is a select list that reads the same in Spark and DuckDB, over a
whole table.  Spark uses it with ``selectExpr``; the SQL checks put it into a
CTE.  The rendered values stand for what feeds, boards and reviewers deliver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession



def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- listings: parsed feed items, from documents --------------------------------

LISTINGS = """
doc_id AS listing_id
CASE WHEN doc_id % 10 = 9 THEN 'https://board' || CAST((doc_id-4) % 4 AS STRING) || '.example.com/JOBS/' || CAST(doc_id-4 AS STRING) || '/'
     WHEN doc_id % 50 = 7 THEN ''
     ELSE 'https://board' || CAST(doc_id % 4 AS STRING) || '.example.com/jobs/' || CAST(doc_id AS STRING) END AS url
'feed' || CAST(doc_id % 4 AS STRING) AS source
CASE WHEN doc_id % 40 = 3 THEN 'Outlier Labs' WHEN doc_id % 40 = 13 THEN 'Happen Media' ELSE 'Company ' || CAST(doc_id % 17 AS STRING) END AS company
CASE doc_id % 8 WHEN 0 THEN 'Biology Annotator' WHEN 1 THEN 'Python Evaluator (RLHF)' WHEN 2 THEN 'Legal Consultant'
     WHEN 3 THEN 'Ward Coordinator' WHEN 4 THEN 'Software Engineer' WHEN 5 THEN 'Math Prompt Writer'
     WHEN 6 THEN 'Office Manager' ELSE 'Linguistics Data Label Lead' END AS title
CASE doc_id % 3 WHEN 0 THEN 'Worldwide' WHEN 1 THEN '' ELSE 'US only' END AS location
CASE doc_id % 5 WHEN 0 THEN 'contract' WHEN 1 THEN 'full_time' WHEN 2 THEN 'Part-time' WHEN 3 THEN 'freelance' ELSE '' END AS job_type
CASE doc_id % 7 WHEN 0 THEN '$' || CAST(30 + doc_id % 40 AS STRING) || '/hr' WHEN 1 THEN '$70,000-$95,000/yr' WHEN 2 THEN 'Competitive' ELSE '' END AS salary
CASE doc_id % 4 WHEN 0 THEN 'Responsibilities:' || chr(10) || 'label items and review' || chr(10) || 'Requirements:' || chr(10) || 'Python, LaTeX, resume' || chr(10) ELSE '' END
  || CASE doc_id % 9 WHEN 0 THEN 'Pay: $' || CAST(20 + doc_id % 50 AS STRING) || '-' || CAST(30 + doc_id % 50 AS STRING) || '/hr. '
       WHEN 1 THEN '$' || CAST(20 + doc_id % 60 AS STRING) || ' per hour. ' WHEN 2 THEN '40-60 USD/hr. ' WHEN 3 THEN 'Salary $90,000-$120,000 per year. '
       WHEN 4 THEN 'We raised $50,000,000 in funding. ' WHEN 5 THEN 'Launch $2024 now. ' WHEN 6 THEN 'The rate is $35 flat. '
       WHEN 7 THEN 'Rate: USD 40 to 55 per hour, or $80,000/year. ' ELSE '' END
  || CASE doc_id % 6 WHEN 0 THEN 'Remote. 15-30 hours per week. ' WHEN 1 THEN 'Hybrid, up to 20 hrs/week. ' WHEN 2 THEN 'Async, rolling basis, fluent in English. '
       WHEN 3 THEN 'Temporary, 3-6 months. ' WHEN 4 THEN 'Full-time permanent role. ' ELSE 'Contract duration: six weeks starting now. ' END
  || CASE doc_id % 20 WHEN 5 THEN 'Posted: 2024-01-15. ' WHEN 6 THEN 'You will partner with a leading AI lab on evaluation. ' ELSE '' END
  || text AS description
"""


def split_list(text: str) -> list[str]:
    """The expressions of a select list; continuation lines are indented."""
    items: list[str] = []
    for line in text.strip("\n").split("\n"):
        if line.startswith(" "):
            items[-1] += "\n" + line
        else:
            items.append(line)
    return items


def select(text: str, source: str) -> str:
    return f"SELECT {', '.join(split_list(text))} FROM {source}"


def listings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text").selectExpr(*split_list(LISTINGS))


# -- feed items: what each source delivers ---------------------------------------

# Every feed carries all listings; a third of the URLs are shared between feeds.
FEED_ITEMS = """
listing_id
'{source}' AS feed
CASE WHEN url = '' OR listing_id % 3 = 0 THEN url ELSE url || '?s={source}' END AS url
title
'<p>' || replace(replace(description, '&', '&amp;'), '<', '&lt;') || '</p><p>Apply &amp; join</p>' AS html
description
job_type
company
location
salary
CASE listing_id % 6 WHEN 0 THEN CAST(30 + listing_id % 40 AS STRING) WHEN 1 THEN '70000' WHEN 2 THEN '1234.5' WHEN 3 THEN 'n/a' ELSE '' END AS low
CASE listing_id % 5 WHEN 0 THEN CAST(30 + listing_id % 40 AS STRING) WHEN 1 THEN '95000' WHEN 2 THEN '250' ELSE '0' END AS high
CASE listing_id % 4 WHEN 0 THEN 'eur' WHEN 1 THEN 'USD' WHEN 2 THEN 'us$' ELSE '' END AS currency
'2024-01-' || CAST(10 + listing_id % 20 AS STRING) AS posted
"""


def feed_items(spark: SparkSession, sf: str, source: str) -> DataFrame:
    return listings(spark, sf).selectExpr(*split_list(FEED_ITEMS.format(source=source)))


# JSON of one API response per listing, as Spark SQL.
PAYLOADS = {
    "remotive.com": """concat('{"jobs":[', to_json(named_struct('url', url, 'title', title, 'description', html,
        'job_type', job_type, 'company_name', company, 'candidate_required_location', location, 'salary', salary,
        'publication_date', posted)), ']}')""",
    "remoteok.com": """concat('[{"legal":"notice"},', to_json(named_struct(
        'id', CASE WHEN listing_id % 13 = 6 THEN NULL ELSE listing_id END,
        'position', CASE WHEN listing_id % 2 = 0 THEN title ELSE '' END, 'title', title, 'description', html,
        'tags', array(job_type, lower(title)), 'company', company, 'salary_min', low, 'salary_max', high,
        'location', location, 'url', CASE WHEN listing_id % 2 = 0 THEN url END, 'apply_url', url, 'date', posted)), ']')""",
    "arbeitnow.com": """concat('{"data":[', rtrim('}', to_json(named_struct('title', title, 'description', html,
        'tags', array(lower(company)), 'company_name', company, 'location', location, 'city', 'Berlin', 'url', url,
        'created_at', listing_id))), CASE WHEN listing_id % 2 = 0 THEN concat(',"job_types":["', job_type, '"]')
        ELSE concat(',"job_types":"', job_type, '"') END, '}]}')""",
    "jobicy.com": """concat('{"jobs":[', to_json(named_struct('url', url, 'jobTitle', title,
        'jobDescription', CASE WHEN listing_id % 2 = 0 THEN html ELSE '' END, 'jobExcerpt', html,
        'jobType', CASE WHEN listing_id % 2 = 0 THEN job_type ELSE '' END, 'jobLevel', job_type,
        'companyName', company, 'annualSalaryMin', low, 'annualSalaryMax', high, 'salaryCurrency', currency,
        'jobGeo', location, 'pubDate', posted)), ']}')""",
}


def payloads(spark: SparkSession, sf: str, source: str) -> DataFrame:
    return feed_items(spark, sf, source).selectExpr("listing_id AS payload_id", f"{PAYLOADS[source]} AS payload")


# -- pages ------------------------------------------------------------------------

BOARD_PAGES = """
page_id
url
replace(replace(replace(html, 'href="/', CASE page_id % 3 WHEN 0 THEN 'href="/jobs/' WHEN 1 THEN 'href="/careers/' ELSE 'href="/' END),
    '</footer>', CASE page_id % 2 WHEN 0 THEN '<a href="?page=2">Next</a></footer>' ELSE '</footer>' END),
    '<article>', CASE page_id % 5 WHEN 0 THEN '<article><div class="job-location">Worldwide</div><time datetime="2024-01-15">x</time>' ELSE '<article>' END) AS html
"""

# Listing pages: board pages with meta tags, company, pay and contract text.
JOB_PAGES = """
page_id
url
replace(replace(html, '<head>', '<head>' || CASE page_id % 4 WHEN 0 THEN '<meta property="og:title" content="Evaluator &amp; Tutor ' || CAST(page_id AS STRING) || '">'
    WHEN 1 THEN '<meta name="twitter:title" content="  Prompt   Writer ' || CAST(page_id AS STRING) || ' "/><meta property="og:site_name" content="Acme">' ELSE '' END),
    '<article>', '<article>' || CASE page_id % 6 WHEN 0 THEN '<p>Contract role at $' || CAST(20 + page_id % 60 AS STRING) || '/hr, remote.</p>'
    WHEN 1 THEN '<p>Published: 15 Jan 2024 </p><p>Freelance, USD 40-55 per hour.</p>' WHEN 2 THEN '<p>Data labeling and OCR in English.</p>' ELSE '' END) AS html
"""

# Board URLs as a user types them.
TYPED_URLS = """
page_id
CASE page_id % 4 WHEN 0 THEN '  ' || url || ' ' WHEN 1 THEN replace(replace(url, 'https://', ''), 'http://', '') WHEN 2 THEN url
     ELSE CASE page_id % 8 WHEN 3 THEN '   ' ELSE url END END AS url
"""

# Pages that look empty, script-driven, or have an application root.
THIN_PAGES = """
page_id
CASE page_id % 5 WHEN 0 THEN '<html><body><div id="root"></div>' || html WHEN 1 THEN '<p>Loading</p><script src="a.js"></script>'
     WHEN 2 THEN replace(replace(html, '<a href', '<b data'), '</body>', repeat('<script>x()</script>', 9)) ELSE html END AS html
"""

# Landed listing pages at the first link of each page, and second pages behind "Next".
FIRST_LINK_PAGES = """
page_id + 1000000 AS page_id
regexp_extract(url, '(https?://[^/]+)', 1) || regexp_extract(html, 'href="(/[^"]+)"', 1) AS url
html
"""
SECOND_PAGES = """
page_id + 2000000 AS page_id
regexp_extract(url, '([^?#]+)', 1) || '?page=2' AS url
replace(html, 'href="/jobs/', 'href="/jobs/p2-') AS html
"""

# Links with absolute, relative and known-board forms, from page anchors.
LINK_FORMS = """
page_id
url
CASE page_id % 11 WHEN 0 THEN 'https://boards.greenhouse.io/acme/jobs/' || CAST(page_id AS STRING) WHEN 1 THEN 'https://jobs.lever.co/acme'
     WHEN 2 THEN 'https://jobs.lever.co/acme/' || CAST(page_id AS STRING) || '/' WHEN 3 THEN '//jobs.ashbyhq.com/acme/jobs/1?x=2'
     WHEN 4 THEN 'https://apply.workable.com/acme/j/ABC/' WHEN 5 THEN 'https://work.mercor.com/jobs/' || CAST(page_id AS STRING)
     WHEN 6 THEN '/Careers/team/lead' WHEN 7 THEN 'position-' || CAST(page_id AS STRING) WHEN 8 THEN '../jobs'
     WHEN 9 THEN 'https://other.example.org/openings/1' ELSE 'mailto:a@b.example' END AS href
"""


def board_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").selectExpr(*split_list(BOARD_PAGES))


def job_pages(spark: SparkSession, sf: str) -> DataFrame:
    return board_pages(spark, sf).selectExpr(*split_list(JOB_PAGES))


def landed_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Board pages, the listing pages they link to, and their second pages."""
    job = job_pages(spark, sf)
    return job.unionByName(job.selectExpr(*split_list(FIRST_LINK_PAGES))).unionByName(
        job.selectExpr(*split_list(SECOND_PAGES)))


# -- rules, reviews, progress -------------------------------------------------------

ROBOTS = """
'https://board' || CAST(n_nationkey % 4 AS STRING) || '.example.com' AS origin
CAST(n_nationkey AS BIGINT) AS rule_order
CASE n_regionkey WHEN 0 THEN 'mozilla' ELSE '*' END AS agent
n_nationkey % 2 = 0 AS allow
'/jobs/' || CAST(n_nationkey AS STRING) AS path_prefix
"""

REVIEW_EVENTS = """
event_id
ts
'job-' || CAST(user_id AS STRING) AS id
CASE event_type WHEN 'purchase' THEN 'save' WHEN 'error' THEN 'delete' WHEN 'click' THEN 'patch' ELSE 'view' END AS action
CASE WHEN event_type IN ('purchase','click') THEN '$' || CAST(CAST(floor(value) AS BIGINT) AS STRING) || '/hr' END AS pay_rate
CASE WHEN event_type = 'click' THEN props END AS notes
"""

PROGRESS_EVENTS = """
event_id
ts
user_id AS run_id
CASE event_type WHEN 'view' THEN 'Fetching' WHEN 'click' THEN 'Fetching' WHEN 'signup' THEN 'Collected' ELSE event_type END AS message
CAST(floor(value / 20) AS BIGINT) AS collected
event_type = 'purchase' AND value > 60 AS finished
event_type <> 'purchase' AS running
"""

# A listing table and a later batch, both from all listings.
STATE = """
'job-' || CAST(listing_id AS STRING) AS id
title
company
'' AS client_partner
location
url
source AS source_board
'' AS posted_date
'contract' AS employment_type
salary AS pay_rate
salary
'' AS hours_per_week
'' AS duration
'remote' AS work_mode
'' AS languages
CASE listing_id % 8 WHEN 0 THEN 'Legal' ELSE '' END AS domain
'' AS task_type
'' AS responsibilities
'' AS requirements
'' AS preferred
'' AS tools_skills
'' AS screening
description
'' AS notes
CASE listing_id % 7 WHEN 0 THEN 'saved' WHEN 1 THEN 'deleted' ELSE 'unreviewed' END AS status
'2024-01-01T00:00:00' AS created_at
'2024-01-01T00:00:00' AS updated_at
"""

BATCH = """
listing_id AS seq
'new-' || CAST(listing_id AS STRING) AS id
CASE listing_id % 4 WHEN 1 THEN '' ELSE title || ' II' END AS title
company
CASE listing_id % 6 WHEN 2 THEN 'OpenAI' ELSE '' END AS client_partner
CASE listing_id % 3 WHEN 2 THEN '' ELSE location END AS location
CASE WHEN listing_id % 5 = 3 AND url <> '' THEN url || '/v2' ELSE url END AS url
source AS source_board
CASE listing_id % 2 WHEN 0 THEN '2024-02-01' ELSE '' END AS posted_date
job_type AS employment_type
salary AS pay_rate
salary
'' AS hours_per_week
'' AS duration
'hybrid' AS work_mode
'' AS languages
'' AS domain
'' AS task_type
'' AS responsibilities
'' AS requirements
'' AS preferred
'' AS tools_skills
'' AS screening
description
'' AS notes
'unreviewed' AS status
'2024-02-02T00:00:00' AS created_at
'2024-02-02T00:00:00' AS updated_at
"""


def robots(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").selectExpr(*split_list(ROBOTS))


def review_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(*split_list(REVIEW_EVENTS))


def progress_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(*split_list(PROGRESS_EVENTS))


def state(spark: SparkSession, sf: str) -> DataFrame:
    """One listing per URL key (the first), blank URLs kept."""
    from listmill.operators.merge import merge_key
    from listmill.operators.rank import first_per
    from pyspark.sql import functions as F

    rows = listings(spark, sf).selectExpr("listing_id", *split_list(STATE)).withColumn("_key", merge_key())
    return first_per(rows, ["_key"], ["listing_id"]).drop("_key", "listing_id").select(
        *[F.col(e.split(" AS ")[-1]) for e in split_list(STATE)])


def batch(spark: SparkSession, sf: str) -> DataFrame:
    return listings(spark, sf).selectExpr(*split_list(BATCH))
