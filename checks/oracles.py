"""DuckDB SQL for the registered queries, on the same tables."""

from __future__ import annotations

from checks import inputs as I
from checks import sql as S
from checks.queries import KEYWORDS, NOW, RUN_FEEDS, RUN_KEYWORDS, RUN_TARGET, SCRAPE_TARGET, SEARCH_KEYWORDS, SEARCH_TARGET
from checks.sql import BATCH, BOARD_PAGES, JOB_PAGES, LISTINGS, PROGRESS, REVIEWS, ROBOTS, STATE, with_
from listmill import vocab as V
from listmill.functions.text import split_keywords
from listmill.operators.rank import caps

FIELDS = ", ".join(V.LISTING_FIELDS)
SEEN = ("seen", f"SELECT page_id, url, html, {S.hide('html')} AS v FROM board_pages")
JOB_SEEN = ("seen", f"SELECT page_id, url, html, {S.hide('html')} AS v FROM job_pages")
BOARDS = [BOARD_PAGES, SEEN]
JOBS = [BOARD_PAGES, JOB_PAGES, JOB_SEEN]
BLOB = [LISTINGS, ("b", f"SELECT *, {S.blob()} AS blob, lower({S.blob()}) AS low FROM listings")]
SRC = ("src", "SELECT listing_id AS k, * FROM listings")
PAY = [LISTINGS, SRC, *S.pay_ctes("src", ["title", "description", "salary"], "pay")]

# -- feeds -------------------------------------------------------------------------

NUM = "CASE WHEN {c} = '' THEN 0 ELSE TRY_CAST({c} AS DOUBLE) END"


def _compose(low: str, high: str, body: str) -> str:
    return S.let(f"{{'lo': {low}, 'hi': {high}}}", "z", (
        "CASE WHEN z.lo IS NULL OR z.hi IS NULL OR (z.lo = 0 AND z.hi = 0) THEN '' " + body + " END"))


def _int(x: str) -> str:
    return f"CAST(trunc({x}) AS BIGINT)"


def compose_minmax(low: str, high: str) -> str:
    one = f"(CASE WHEN z.lo <> 0 THEN {_int('z.lo')} ELSE {_int('z.hi')} END)"
    return _compose(low, high, f"""WHEN z.lo <> 0 AND z.hi <> 0 AND greatest(z.lo, z.hi) <= 500 THEN
        '$' || {_int('z.lo')} || CASE WHEN z.lo <> z.hi THEN '-$' || {_int('z.hi')} ELSE '' END || '/hr'
        WHEN z.lo <> 0 AND z.hi <> 0 THEN '$' || format('{{:,}}', {_int('z.lo')}) || '-$' || format('{{:,}}', {_int('z.hi')}) || '/yr'
        WHEN {one} <= 500 THEN '$' || {one} || '/hr' ELSE '$' || format('{{:,}}', {one}) || '/yr'""")


def compose_annual(low: str, high: str, currency: str) -> str:
    code = f"upper(CASE WHEN {currency} = '' THEN 'USD' ELSE {currency} END)"
    prefix = f"(CASE WHEN {code} IN ('USD', 'US$') THEN '$' ELSE {code} || ' ' END)"
    one = f"(CASE WHEN z.lo <> 0 THEN {_int('z.lo')} ELSE {_int('z.hi')} END)"
    return _compose(low, high, f"""WHEN z.lo <> 0 AND z.hi <> 0 AND z.lo <> z.hi THEN {prefix} || format('{{:,}}', {_int('z.lo')})
        || '-' || {prefix} || format('{{:,}}', {_int('z.hi')}) || '/yr' ELSE {prefix} || format('{{:,}}', {one}) || '/yr'""")


def feed(source: str) -> str:
    """Rows of one feed after parsing, with tags as a list."""
    text = f"{S.strip('description')} || ' Apply & join'"
    remote = "CASE WHEN location = '' THEN 'Remote' ELSE location END"
    num = [NUM.format(c=c) for c in ("low", "high")]
    cols = {
        "remotive.com": ("job_type", "CAST([] AS VARCHAR[])", remote, "salary", "posted"),
        "remoteok.com": ("''", "[job_type, lower(title)]", remote, compose_minmax(*num), "posted"),
        "arbeitnow.com": ("''", "CASE WHEN listing_id % 2 = 0 OR job_type <> '' THEN [lower(company), job_type] "
                                "ELSE [lower(company)] END",
                          "CASE WHEN location = '' THEN 'Berlin' ELSE location END", "''", "CAST(listing_id AS VARCHAR)"),
        "jobicy.com": ("job_type", "CAST([] AS VARCHAR[])", remote, compose_annual(*num, "currency"), "posted"),
    }[source]
    keep = {"remotive.com": "url <> ''", "jobicy.com": "url <> ''", "arbeitnow.com": "true",
            "remoteok.com": "listing_id % 13 <> 6"}[source]
    if source == "remoteok.com":
        keep += " AND listing_id <> 0"
    items = I.select(I.FEED_ITEMS.format(source=source), "listings")
    job_type, tags, location, salary, posted = cols
    return f"""SELECT listing_id, '{source}' AS source, {V.FEED_SOURCES.index(source) + 1} AS priority, url, title,
        {text} AS description, {job_type} AS job_type, {tags} AS tags, company, {location} AS location,
        {salary} AS salary, {posted} AS posted_date FROM ({items}) WHERE {keep}"""


def feed_check(source: str) -> str:
    return with_([LISTINGS, ("f", feed(source))],
                 "SELECT * REPLACE (array_to_string(tags, '|') AS tags) FROM f")


FEEDS = [LISTINGS, ("feeds", " UNION ALL ".join(feed(s) for s in V.FEED_SOURCES))]


# -- listings of pages and feeds ------------------------------------------------------

def page_listing_ctes(seen: str, out: str, source: str = "url_host") -> list[tuple[str, str]]:
    time = """regexp_extract(v, '<time datetime="([^"]*)"', 1)"""
    return [
        (f"{out}_f", f"""SELECT page_id, url, {S.page_title('v')} AS title, {S.page_company('v', 'url')} AS company,
            {S.page_location('v')} AS location, {S.page_description('v')} AS description, {time} AS time_text,
            {S.netloc('url')} AS url_host FROM {seen}"""),
        (f"{out}_k", f"SELECT page_id AS k, * FROM {out}_f"),
        *S.pay_ctes(f"{out}_k", ["title", "description"], f"{out}_m"),
        (f"{out}_s", f"SELECT f.*, m.pay AS salary FROM {out}_k f JOIN {out}_m m ON f.k = m.k"),
        *S.enrich_ctes(f"{out}_s", f"{out}_e"),
        (out, f"""SELECT page_id, {S.listing_columns(
            "substr(CASE WHEN chosen <> '' THEN chosen ELSE salary END, 1, 120)",
            f"substr({S.first(S.posted('description'), S.clean('time_text'))}, 1, 120)", source, NOW)} FROM {out}_e"""),
    ]


FEED_PAY = f"substr({S.clean(S.first('chosen', 'mined', S.clean('salary')))}, 1, 120)"


# -- merge ------------------------------------------------------------------------------

def upsert(state: str, batch: str) -> list[tuple[str, str]]:
    k = f"CASE WHEN {S.key('url')} = '' THEN id ELSE {S.key('url')} END"
    last = ", ".join(f"coalesce(arg_max({c}, seq) FILTER (WHERE {c} <> ''), '') AS {c}" for c in V.REFRESHED_FIELDS)
    kept = [c for c in V.LISTING_FIELDS if c not in V.REFRESHED_FIELDS]
    one = ", ".join(f"arg_min({c}, seq) AS {c}" for c in kept)

    def field(c: str) -> str:
        merge = "s.id IS NOT NULL AND n.id IS NOT NULL AND s.status NOT IN ('saved', 'deleted')"
        if c == "updated_at":
            return f"CASE WHEN {merge} THEN '{NOW}' ELSE coalesce(s.{c}, n.{c}) END AS {c}"
        if c in V.REFRESHED_FIELDS:
            return f"CASE WHEN {merge} AND n.{c} <> '' THEN n.{c} ELSE coalesce(s.{c}, n.{c}) END AS {c}"
        return f"coalesce(s.{c}, n.{c}) AS {c}"

    return [
        ("old_k", f"SELECT {k} AS mk, * FROM {state}"),
        ("new_k", f"SELECT mk, {last}, {one} FROM (SELECT {k} AS mk, * FROM {batch}) GROUP BY mk"),
        ("merged", f"SELECT {', '.join(field(c) for c in V.LISTING_FIELDS)} FROM old_k s FULL JOIN new_k n ON s.mk = n.mk"),
    ]


FOLDED = ("folded", """SELECT id,
    arg_max(CASE action WHEN 'delete' THEN 'deleted' ELSE 'saved' END, {'t': ts, 'e': event_id}) AS new_status,
    max(ts) AS last_ts,
    arg_max(pay_rate, {'t': ts, 'e': event_id}) FILTER (WHERE action <> 'delete' AND pay_rate IS NOT NULL) AS new_pay,
    arg_max(notes, {'t': ts, 'e': event_id}) FILTER (WHERE action <> 'delete' AND notes IS NOT NULL) AS new_notes
    FROM review_events WHERE action IN ('save', 'patch', 'delete') GROUP BY id""")
REVIEWED = ("reviewed", """SELECT s.* REPLACE (coalesce(new_pay, pay_rate) AS pay_rate, coalesce(new_notes, notes) AS notes,
    coalesce(new_status, status) AS status,
    coalesce(strftime(last_ts, '%Y-%m-%dT%H:%M:%S.%f'), updated_at) AS updated_at)
    FROM state s LEFT JOIN folded f ON s.id = f.id""")

LAST = ", ".join(f"arg_max({c}, {{'t': ts, 'e': event_id}}) AS {c}" for c in ("message", "collected", "finished", "running"))
RUNS = ("runs", f"SELECT run_id, {LAST}, count(*) AS records FROM progress GROUP BY run_id")


def changes(source: str) -> str:
    return f"""SELECT run_id, event_id, message, collected FROM {source}
        WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id) QUALIFY lag(event_id) OVER w IS NULL
        OR message IS DISTINCT FROM lag(message) OVER w OR collected IS DISTINCT FROM lag(collected) OVER w"""


def _hits(kws: list[str]) -> str:
    return S.any_of("lower(title)", [k.lower() for k in kws])


# -- scrape ------------------------------------------------------------------------------

def scrape_ctes(cap: dict, keep: str = "true") -> list[tuple[str, str]]:
    """``cap`` has the caps as numbers or scalar subqueries, ``keep`` the keyword test on title and description."""
    target = cap["target"]
    platform = S.any_of(f"lower(company || ' ' || {S.netloc('e.board_url')})", V.PLATFORMS)

    def allowed(url: str) -> str:
        return f"""coalesce((SELECT arg_min(allow, rule_order) FROM rules r WHERE r.origin = {S.origin(url)}
            AND starts_with(coalesce(nullif(regexp_extract({url}, '^[^:/?#]+://[^/?#]*([^#]*)', 1), ''), '/'), r.prefix)), true)"""

    return [
        BOARD_PAGES, JOB_PAGES,
        ("landed_all", f"""SELECT * FROM job_pages UNION ALL {I.select(I.FIRST_LINK_PAGES, 'job_pages')}
            UNION ALL {I.select(I.SECOND_PAGES, 'job_pages')}"""),
        ("landed", f"SELECT *, {S.key('url')} AS key FROM landed_all QUALIFY row_number() OVER (PARTITION BY {S.key('url')} ORDER BY page_id) = 1"),
        ("rules", f"""SELECT {S.origin('url')} AS origin, page_id AS rule_order, page_id % 3 <> 0 AS allow,
            '/' || substr(regexp_extract(url, '//[^/]+/([^?#]*)', 1), 1, 2) AS prefix FROM pages"""),
        ("boards", f"SELECT page_id AS board, url AS board_url, {S.key('url')} AS key, {allowed('url')} AS allowed FROM board_pages"),
        ("landed_seen", f"SELECT page_id, url, key, {S.hide('html')} AS v FROM landed"),
        ("edges", f"SELECT key AS node, {S.key(S.next_page('v', 'url'))} AS next_node FROM landed_seen"),
        ("RECURSIVE walk", f"""SELECT DISTINCT key AS seed, key AS node, 0 AS hop FROM boards WHERE allowed
            UNION ALL SELECT w.seed, e.next_node, w.hop + 1 FROM walk w JOIN edges e ON w.node = e.node
            WHERE e.next_node IS NOT NULL AND e.next_node <> e.node AND w.hop + 1 < {cap['max_pages']}"""),
        ("steps", "SELECT seed, node, min(hop) AS hop FROM walk GROUP BY seed, node"),
        *S.link_ctes("landed", "page_links", cap["link_limit"]),
        ("targets", """SELECT l.key AS node, coalesce(k.pos, 1) AS pos, coalesce(k.link, l.url) AS link
            FROM landed l LEFT JOIN page_links k ON l.page_id = k.page_id"""),
        ("visits", """SELECT b.board, b.board_url, s.node, s.hop FROM boards b JOIN steps s ON b.key = s.seed
            JOIN landed l ON l.key = s.node WHERE b.allowed"""),
        ("links", f"""SELECT * FROM (SELECT v.board, v.board_url, v.hop, t.pos, t.link, {S.key('t.link')} AS key,
            {allowed('t.link')} AS ok FROM visits v JOIN targets t ON v.node = t.node) WHERE ok"""),
        ("facts", f"""SELECT key, page_id, title, {S.page_company('v', 'url')} AS company,
            {S.contract_rule('title', 'description')} IS NOT NULL AS contract, {keep} AS keep FROM (
            SELECT key, page_id, url, v, {S.page_title('v')} AS title, {S.page_description('v')} AS description FROM landed_seen)"""),
        ("events", f"""SELECT e.board, e.hop, e.pos, e.key, e.link, e.board_url, f.page_id,
            f.title <> '' AND f.keep AND (f.contract OR {platform}) AS accept FROM links e LEFT JOIN facts f ON e.key = f.key"""),
        ("firsts", """SELECT key, min({'b': board, 'h': hop, 'p': pos}) AS f FROM events WHERE accept GROUP BY key"""),
        ("fetches", f"""SELECT board, hop, pos, key, accept, page_id, board_url FROM (
            SELECT e.board, e.hop, e.pos, e.key, e.accept, e.page_id, e.board_url FROM events e LEFT JOIN firsts x ON e.key = x.key
            WHERE e.page_id IS NOT NULL AND (x.f IS NULL OR {{'b': e.board, 'h': e.hop, 'p': e.pos}} <= x.f)
            UNION ALL SELECT board, hop, 0, NULL, false, NULL, board_url FROM visits)
            ORDER BY board, hop, pos LIMIT {cap['max_fetches']}"""),
        ("finish", f"""SELECT CASE WHEN count(*) FILTER (accept) >= {target}
            THEN (SELECT {{'b': board, 'h': hop, 'p': pos}} FROM fetches WHERE accept ORDER BY board, hop, pos LIMIT 1 OFFSET ({target} - 1))
            WHEN count(*) >= {cap['max_fetches']} THEN max({{'b': board, 'h': hop, 'p': pos}}) END AS e FROM fetches"""),
    ]


def won_ctes(scraped: list[tuple[str, str]], target: int | str) -> list[tuple[str, str]]:
    return [*scraped,
            ("won", f"SELECT * FROM fetches WHERE accept ORDER BY board, hop, pos LIMIT {target}"),
            ("won_seen", f"SELECT w.board * 1000000 + w.hop * 10000 + w.pos AS page_id, l.url, {S.hide('l.html')} AS v FROM won w JOIN landed_all l ON w.page_id = l.page_id"),
            ("won_host", f"SELECT board * 1000000 + hop * 10000 + pos AS page_id, board, hop, pos, {S.netloc('board_url')} AS host FROM won")]


SCRAPE = scrape_ctes(caps(SCRAPE_TARGET))
WON = won_ctes(SCRAPE, SCRAPE_TARGET)
FAILED = """SELECT board_url AS url, 'Blocked by robots.txt' AS error FROM boards, finish
        WHERE NOT allowed AND (e IS NULL OR {'b': board, 'h': 0, 'p': 0} <= e)
        UNION ALL SELECT board_url, 'page has not landed' FROM boards, finish
        WHERE allowed AND key NOT IN (SELECT key FROM landed) AND (e IS NULL OR {'b': board, 'h': 0, 'p': 0} <= e)
        UNION ALL SELECT link, 'page has not landed' FROM events, finish
        WHERE page_id IS NULL AND (e IS NULL OR {'b': board, 'h': hop, 'p': pos} <= e)"""


def search_ctes(keywords: str, target: int, feeds: str = "feeds") -> list[tuple[str, str]]:
    """CTE ``win``: the first items in source order, with their place ``k``."""
    kws = [k.lower() for k in split_keywords(keywords)]
    text = "lower(title || chr(10) || description || chr(10) || array_to_string(tags, ' '))"
    rule = S.contract_rule("title", "description", "job_type", "tags", "company", "source")
    return [*FEEDS, ("win", f"""SELECT row_number() OVER (ORDER BY priority, listing_id) AS k, * FROM (
        SELECT * FROM {feeds} WHERE url <> '' AND {S.any_of(text, kws)} AND {rule} IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY {S.key('url')} ORDER BY priority, listing_id) = 1)
        ORDER BY priority, listing_id LIMIT {target}""")]


FEED_LISTING = S.listing_columns(FEED_PAY, f"substr({S.clean('posted_date')}, 1, 120)", "source", NOW)


def search_sql() -> str:
    return with_([*search_ctes(SEARCH_KEYWORDS, SEARCH_TARGET), *S.enrich_ctes("win", "rich")], f"SELECT {FEED_LISTING} FROM rich")


def run_ctes() -> list[tuple[str, str]]:
    """CTEs of a run over feeds and then boards: run_rows, run_failed and run_counts."""
    names = ", ".join(f"'{s}'" for s in RUN_FEEDS)
    asked = f"(SELECT * FROM feeds WHERE source IN ({names}) AND listing_id % 97 <> 0)"
    places = " UNION ALL ".join(f"SELECT listing_id, '{s}' AS source, {V.FEED_SOURCES.index(s) + 1} AS priority FROM ({I.select(I.FEED_ITEMS.format(source=s), 'listings')})"
                                for s in RUN_FEEDS)
    limits = caps(RUN_TARGET)
    cap = {k: f"(SELECT {k} FROM cap)" for k in limits}
    low = "lower(title || chr(10) || description)"
    boards = scrape_ctes(cap, S.any_of(low, [k.lower() for k in split_keywords(RUN_KEYWORDS)]))
    fields = ", ".join("h.host AS source_board" if c == "source_board" else f"p.{c}" for c in V.LISTING_FIELDS)
    return [
        *search_ctes(RUN_KEYWORDS, RUN_TARGET, asked), *S.enrich_ctes("win", "rich"),
        ("online", f"SELECT {FEED_LISTING} FROM rich"),
        ("cap", f"""SELECT *, greatest(8, least(40, target + 4)) AS max_pages, greatest(120, least(400, 20 * target)) AS max_fetches,
            greatest(80, least(200, 10 * target)) AS link_limit FROM (SELECT {RUN_TARGET} - count(*) AS target FROM win)"""),
        *won_ctes(boards, cap["target"]), *page_listing_ctes("won_seen", "pl", "url_host"),
        ("run_rows", f"""SELECT 'feeds' AS stage, {FIELDS} FROM online
            UNION ALL SELECT 'boards', {fields} FROM pl p JOIN won_host h ON p.page_id = h.page_id WHERE {cap['target']} > 0"""),
        ("run_failed", f"""SELECT 'feeds' AS stage, source || ':' || listing_id AS url, 'payload does not parse' AS error FROM ({places})
            WHERE listing_id % 97 = 0 AND ({cap['target']} > 0 OR priority <= (SELECT max(priority) FROM win))
            UNION ALL SELECT 'boards', url, error FROM ({FAILED}) WHERE {cap['target']} > 0"""),
        ("run_counts", f"SELECT (SELECT count(*) FROM run_rows) AS collected, (SELECT count(*) FROM run_failed) AS failed, {RUN_TARGET} AS target"),
        ("run_end", f"SELECT *, CASE WHEN zero OR short THEN error ELSE {DONE} END AS message FROM (SELECT *, {OUTCOME} FROM run_counts)"),
    ]


OUTCOME = """collected = 0 AS zero, collected < target AS short, CASE WHEN collected = 0 AND failed > 0 THEN
        'Search failed — no contract jobs collected (' || failed || ' source error(s)).'
        WHEN collected = 0 THEN 'No matching contract jobs found. Try different keywords or board URLs.'
        WHEN collected < target THEN 'Only found ' || collected || ' of ' || target ||
        ' requested. Sources exhausted — try more boards, broader keywords, or Both mode.'
        WHEN failed > 0 THEN 'Finished with ' || failed || ' source warning(s).' END AS error"""
DONE = "'Done. Collected ' || collected || ' / ' || target || ' matching contract jobs.'"
RUN = run_ctes()


def low_check(name: str, fn) -> str:
    return with_(BLOB, f"SELECT listing_id, {fn('low')} AS {name} FROM b")


LINKS = [("lv", f"SELECT page_id, url, {S.hide('html')} AS v FROM pages"),
         ("la", rf"""SELECT page_id, url, {S.strip(S.unescape('h'))} AS href FROM (SELECT page_id, url,
            unnest(regexp_extract_all(v, '(?i)<a\s[^>]*href="([^"]*)"[^>]*>', 1)) AS h FROM lv)"""),
         ("l", I.select(I.LINK_FORMS, "pages") + " UNION ALL SELECT page_id, url, href FROM la"),
         ("r", f"SELECT *, {S.resolve('url', 'href')} AS link FROM l"),
         ("f", f"SELECT *, lower({S.netloc('link')}) AS host, rtrim({S.path('link')}, '/') AS p FROM r")]

SINGLE_KEYWORDS = """concat_ws(',', title, lower(title), job_type, ' RLHF; rlhf' || chr(10), company, upper(company))"""

ORACLES: dict[str, str] = {
    "page_scan": "SELECT page_id, url, html FROM pages",
    "feed_remotive": feed_check("remotive.com"),
    "feed_remoteok": feed_check("remoteok.com"),
    "feed_arbeitnow": feed_check("arbeitnow.com"),
    "feed_jobicy": feed_check("jobicy.com"),
    "board_seeds": with_([("t", I.select(I.TYPED_URLS, "pages"))], """SELECT page_id,
        CASE WHEN trim(url) LIKE 'http://%' OR trim(url) LIKE 'https://%' THEN trim(url) ELSE 'https://' || trim(url) END AS url
        FROM t WHERE trim(url) <> ''"""),
    "write_read_listings": with_(STATE, f"SELECT {FIELDS} FROM state"),
    "export_json": with_(STATE, f"SELECT {FIELDS} FROM state WHERE status = 'saved'"),
    "export_csv": with_(STATE, f"SELECT {FIELDS} FROM state WHERE status = 'saved'"),
    "clean_ws": f"SELECT doc_id, {S.clean('text')} AS text FROM documents",
    "html_to_text": f"SELECT page_id, {S.text_of(S.hide('html'))} AS text FROM pages",
    "html_select": with_(BOARDS, f"""SELECT page_id, {S.div_text('v', 'job-location')} AS by_class,
        {S.tag_text('v', 'article')} AS by_tag, {S.div_text('v', 'ad')} AS second,
        {S.first(S.div_text('v', 'job-location'), S.tag_text('v', 'h1'))} AS by_part,
        {S.tag_text('v', 'time')} AS by_value FROM seen"""),
    "meta_value": with_(JOBS, f"""SELECT page_id, {S.first(S.meta('v', 'og:title'), S.meta('v', 'twitter:title'))} AS title,
        {S.meta('v', 'og:site_name')} AS site FROM seen"""),
    "page_title": with_(JOBS, f"SELECT page_id, {S.page_title('v')} AS title FROM seen"),
    "page_company": with_(JOBS, f"SELECT page_id, {S.page_company('v', 'url')} AS company FROM seen"),
    "page_location": with_(BOARDS, f"SELECT page_id, {S.page_location('v')} AS location FROM seen"),
    "page_description": with_(BOARDS, f"SELECT page_id, {S.page_description('v')} AS description, {S.body_text('v')} AS body FROM seen"),
    "posted_date": with_([LISTINGS], f"SELECT listing_id, {S.posted(S.plain('description'))} AS posted FROM listings"),
    "page_posted_date": with_(JOBS, f"""SELECT page_id, {S.first(S.posted(S.page_description('v')),
        S.clean('''regexp_extract(v, '<time datetime="([^"]*)"', 1)'''))} AS posted FROM seen"""),
    "page_listing": with_([*JOBS, *page_listing_ctes("seen", "pl")], "SELECT * FROM pl"),
    "needs_render": with_([("t", I.select(I.THIN_PAGES, "pages")), ("s", f"SELECT page_id, html, {S.hide('html')} AS v FROM t")],
        rf"""SELECT page_id, length({S.clean(S.text_of('v'))}) < 200
        OR (len(regexp_extract_all(v, '(?i)<a\s[^>]*href=')) < 5 AND len(regexp_extract_all(html, '(?i)<script[\s/>]')) > 8)
        OR (contains(v, 'id="root"') AND length({S.clean(S.text_of("regexp_extract(v, '(?s)<div id=.root.>(.*?)</div>', 1)"))}) < 80)
        AS needs_render FROM s"""),
    "extract_anchors": with_(BOARDS, rf"""SELECT page_id, ix - 1 AS pos, {S.unescape('href')} AS href, '' AS rel,
        {S.clean(S.text_of('body'))} AS text FROM (SELECT page_id,
        unnest(regexp_extract_all(v, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>', 1)) AS href,
        unnest(regexp_extract_all(v, '(?is)<a\s[^>]*href="[^"]*"[^>]*>(.*?)(?:</a\s*>|$)', 1)) AS body,
        unnest(range(1, len(regexp_extract_all(v, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>', 1)) + 1)) AS ix FROM seen)"""),
    "resolve_href": with_(LINKS, "SELECT page_id, href, link FROM f"),
    "is_job_link": with_(LINKS, f"SELECT page_id, href, CASE WHEN link IS NOT NULL THEN {S.job_rule('host', 'p')} END AS rule FROM f"),
    "same_site": with_(LINKS, f"""SELECT page_id, href, {S.same_site(f"lower({S.netloc('url')})", 'host')} AS same_site FROM f
        WHERE link IS NOT NULL"""),
    "job_links": with_([BOARD_PAGES, *S.link_ctes("board_pages", "k", 80)], "SELECT page_id, pos, link FROM k"),
    "job_links_limited": with_([BOARD_PAGES, *S.link_ctes("board_pages", "k", 2)], "SELECT page_id, pos, link FROM k"),
    "next_page": with_(BOARDS, f"SELECT page_id, {S.next_page('v', 'url')} AS next_url FROM seen WHERE contains(v, '>Next</a>')"),
    "parse_keywords": with_([LISTINGS, ("p", rf"""SELECT listing_id, unnest(string_split_regex(x, '[,;\n]+')) AS w,
        unnest(range(1, len(string_split_regex(x, '[,;\n]+')) + 1)) AS ix FROM (SELECT listing_id, {SINGLE_KEYWORDS} AS x FROM listings)"""),
        ("d", """SELECT listing_id, trim(w) AS w, ix FROM p WHERE trim(w) <> ''
        QUALIFY row_number() OVER (PARTITION BY listing_id, lower(trim(w)) ORDER BY ix) = 1""")],
        "SELECT listing_id, string_agg(w, '|' ORDER BY ix) AS keywords FROM d GROUP BY listing_id"),
    "matches_keywords": with_([LISTINGS], f"""SELECT listing_id,
        {S.any_of("lower(title || chr(10) || description)", [k.lower() for k in split_keywords(KEYWORDS)])} AS hit FROM listings"""),
    "keyword_table": with_([LISTINGS, ("phrases", """SELECT DISTINCT lower(regexp_extract(text, '^[a-zA-Z]+ [a-zA-Z]+', 0)) AS keyword FROM documents
        WHERE text IS NOT NULL AND trim(regexp_extract(text, '^[a-zA-Z]+ [a-zA-Z]+', 0)) <> ''""")],
        """SELECT listing_id, count(*) AS hits FROM listings, phrases WHERE contains(lower(title || chr(10) || description), keyword) GROUP BY listing_id"""),
    "is_contract": with_([LISTINGS, ("c", f"""SELECT listing_id, {S.contract_rule('title', 'description', 'job_type', '[location]',
        'company', 'source')} AS rule FROM listings""")], "SELECT listing_id, rule IS NOT NULL AS is_contract, rule FROM c"),
    "robots_allowed": with_([LISTINGS, ROBOTS,
        ("pick", """SELECT origin, CASE WHEN bool_or(agent = 'mozilla') THEN 'mozilla' ELSE '*' END AS agent FROM robots GROUP BY origin"""),
        ("act", "SELECT r.* FROM robots r JOIN pick p ON r.origin = p.origin AND r.agent = p.agent"),
        ("hit", f"""SELECT l.listing_id, arg_min(a.allow, a.rule_order) AS allow FROM listings l JOIN act a
        ON {S.origin('l.url')} = a.origin AND starts_with({S.path('l.url')}, a.path_prefix) GROUP BY l.listing_id""")],
        "SELECT l.listing_id, coalesce(h.allow, true) AS allowed FROM listings l LEFT JOIN hit h ON l.listing_id = h.listing_id"),
    "visible_listings": with_(STATE, "SELECT id, status FROM state WHERE status <> 'deleted'"),
    "approved_listings": with_(STATE, "SELECT id, status FROM state WHERE status = 'saved'"),
    "usable_items": with_([LISTINGS], "SELECT listing_id, url FROM listings WHERE rtrim(url, '/') <> ''"),
    "pay_candidates": with_(PAY, "SELECT k AS listing_id, score, rule, pos, text FROM pay_c WHERE text <> ''"),
    "pay_format": with_([LISTINGS], f"SELECT listing_id, {S.pay_format('salary')} AS shown FROM listings"),
    "extract_pay": with_(PAY, "SELECT k AS listing_id, pay FROM pay"),
    "choose_pay": with_([*PAY, ("m", f"""SELECT s.listing_id, s.salary, p.pay AS mined, {S.choose_pay('s.salary', 'p.pay')} AS chosen
        FROM src s JOIN pay p ON s.k = p.k""")], f"SELECT listing_id, chosen, {FEED_PAY} AS pay FROM m"),
    "hours_per_week": with_(BLOB, f"SELECT listing_id, {S.hours('blob')} AS hours FROM b"),
    "duration": with_(BLOB, f"SELECT listing_id, {S.duration('blob')} AS duration FROM b"),
    "work_mode": with_(BLOB, f"SELECT listing_id, {S.work_mode('low')} AS work_mode, {S.employment('low')} AS employment_type FROM b"),
    "salary_compose_minmax": f"""SELECT p_partkey, {compose_minmax('CAST(p_size * 12 AS DOUBLE)',
        'CAST(CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_retailprice END AS DOUBLE)')} AS salary FROM part""",
    "salary_compose_annual": f"""SELECT p_partkey, {compose_annual('CAST(p_size * 1000 AS DOUBLE)',
        'CAST(CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_retailprice END AS DOUBLE)',
        "CASE WHEN p_size % 2 = 0 THEN 'eur' ELSE '' END")} AS salary FROM part""",
    "domain": low_check("domain", S.domain),
    "task_type": low_check("task_type", S.task_type),
    "languages": low_check("languages", S.languages),
    "tools_skills": low_check("tools_skills", S.tools),
    "screening": low_check("screening", S.screening),
    "client_partner": with_(BLOB, f"SELECT listing_id, {S.client('blob')} AS client_partner FROM b"),
    "sections": with_([LISTINGS, ("p", f"SELECT listing_id, {S.plain('description')} AS t FROM listings")],
        f"SELECT listing_id, {', '.join(f'{S.section(chr(116), g)} AS {g}' for g in V.SECTION_HEADERS)} FROM p"),
    "feed_listing": with_([LISTINGS, SRC, *S.enrich_ctes("src", "rich")],
        f"SELECT listing_id, {S.listing_columns(FEED_PAY, S.q('2024-01-01 x'), 'source', NOW)} FROM rich"),
    "follow_links": with_([*SCRAPE[:4], *S.link_ctes("board_pages", "k", 80), ("t", """SELECT b.page_id AS board_id,
        coalesce(k.pos, 1) AS pos, coalesce(k.link, b.url) AS link FROM board_pages b LEFT JOIN k ON b.page_id = k.page_id""")],
        f"SELECT board_id, pos, l.key, l.page_id AS landed_id FROM t JOIN landed l ON {S.key('t.link')} = l.key"),
    "unseen": with_([LISTINGS, BATCH], f"""SELECT id, url FROM batch WHERE {S.key('url')} NOT IN (SELECT {S.key('url')} FROM listings)"""),
    "upsert_listings": with_([*STATE, BATCH, *upsert("state", "batch")], "SELECT * FROM merged"),
    "apply_reviews": with_([*STATE, REVIEWS, FOLDED, REVIEWED], "SELECT * FROM reviewed"),
    "unknown_reviews": with_([*STATE, REVIEWS], """SELECT DISTINCT id AS url, 'Job not found' AS error FROM review_events
        WHERE action <> 'view' AND id NOT IN (SELECT id FROM state)"""),
    "mark_deleted": with_([*STATE, REVIEWS, ("d", "SELECT DISTINCT id FROM review_events WHERE action = 'delete'")],
        f"""SELECT s.id, CASE WHEN d.id IS NOT NULL THEN 'deleted' ELSE status END AS status,
        CASE WHEN d.id IS NOT NULL THEN '{NOW}' ELSE updated_at END AS updated_at FROM state s LEFT JOIN d ON s.id = d.id"""),
    "lookup": with_([*STATE, REVIEWS], """SELECT id, title, status FROM state WHERE status <> 'deleted'
        AND id IN (SELECT id FROM review_events)"""),
    "url_key": with_([LISTINGS], f"SELECT listing_id, {S.key('url')} AS url_key FROM listings"),
    "dedup_source": with_(FEEDS, f"""SELECT source, listing_id, url FROM feeds QUALIFY source NOT IN ('remotive.com', 'jobicy.com')
        OR row_number() OVER (PARTITION BY source, {S.key('url')} ORDER BY listing_id) = 1"""),
    "dedup_cross": with_(FEEDS, f"""SELECT source, listing_id, url FROM feeds WHERE url <> ''
        QUALIFY row_number() OVER (PARTITION BY {S.key('url')} ORDER BY priority, listing_id) = 1"""),
    "quota": with_(FEEDS, "SELECT source, listing_id, url FROM feeds ORDER BY priority, listing_id LIMIT 150"),
    "first_distinct": with_(FEEDS, f"""SELECT {S.key('url')} AS key, source, listing_id FROM (SELECT * FROM feeds WHERE url <> ''
        QUALIFY row_number() OVER (PARTITION BY {S.key('url')} ORDER BY priority, listing_id) = 1)
        ORDER BY priority, listing_id LIMIT 200"""),
    "rank_title_hit": with_([LISTINGS], f"""SELECT listing_id, title FROM listings
        ORDER BY CASE WHEN {_hits(split_keywords(KEYWORDS))} THEN 0 ELSE 1 END, lower(title), listing_id"""),
    "search_feeds": search_sql(),
    "fill_remaining": with_([LISTINGS, *BOARDS, ("u", f"""SELECT 1 AS tier, source, listing_id, url FROM (
        SELECT * FROM listings WHERE {S.any_of("lower(company)", V.PLATFORMS)} AND url <> ''
        QUALIFY row_number() OVER (PARTITION BY {S.key('url')} ORDER BY source, listing_id) = 1)
        UNION ALL SELECT 2, {S.netloc('url')}, page_id, url FROM seen""")],
        "SELECT tier, source, listing_id, url FROM u ORDER BY tier, source, listing_id LIMIT 200"),
    "board_walk": with_([("n", f"SELECT page_id AS node, {S.netloc('url')} AS host FROM pages"),
        ("e", "SELECT node, host, lead(node) OVER (PARTITION BY host ORDER BY node) AS nxt FROM n"),
        ("RECURSIVE w", """SELECT min(node) AS seed, min(node) AS node, 0 AS hop FROM n GROUP BY host
        UNION ALL SELECT w.seed, e.nxt, w.hop + 1 FROM w JOIN e ON w.node = e.node WHERE e.nxt IS NOT NULL AND w.hop < 7""")],
        "SELECT seed, node, hop FROM w"),
    "scaled_caps": """SELECT p_partkey, n, t AS target, greatest(8, least(40, t + 4)) AS max_pages,
        greatest(120, least(400, 20 * t)) AS max_fetches, greatest(80, least(200, 10 * t)) AS link_limit,
        greatest(12, least(40, t + 8)) AS feed_pages, least(50, greatest(12, least(40, t + 8)) + 15) AS deep_feed_pages
        FROM (SELECT p_partkey, p_size * 5 - 3 AS n, greatest(1, p_size * 5 - 3) AS t FROM part)""",
    "fetch_budget": with_([BOARD_PAGES, *S.link_ctes("board_pages", "k", 80)],
        "SELECT page_id AS board_id, pos, link FROM k ORDER BY page_id, pos LIMIT 400"),
    "board_scrape": with_([*WON, *page_listing_ctes("won_seen", "pl", "url_host")],
        f"""SELECT h.board, h.hop, h.pos, {', '.join('h.host AS source_board' if c == 'source_board' else f'p.{c}' for c in V.LISTING_FIELDS)}
        FROM pl p JOIN won_host h ON p.page_id = h.page_id"""),
    "scrape_fetches": with_(SCRAPE, """SELECT board, hop, pos, key, accept FROM fetches, finish
        WHERE e IS NULL OR {'b': board, 'h': hop, 'p': pos} <= e"""),
    "scrape_failures": with_(SCRAPE, FAILED),
    "run_both": with_(RUN, "SELECT * FROM run_rows"),
    "run_both_failures": with_(RUN, "SELECT * FROM run_failed"),
    "run_both_outcome": with_(RUN, "SELECT * FROM run_end"),
    "run_both_progress": with_(RUN, f"""SELECT 0 AS step, 'Starting…' AS message, 0 AS collected, 0 AS failed, {RUN_TARGET} AS target,
        true AS running, false AS finished, CAST(NULL AS VARCHAR) AS error
        UNION ALL SELECT 1, 'Online found ' || ({RUN_TARGET} - c.target) || '. Scraping boards for ' || c.target || ' more…', {RUN_TARGET} - c.target,
        (SELECT count(*) FROM run_failed WHERE stage = 'feeds'), {RUN_TARGET}, true, false, NULL FROM cap c WHERE c.target > 0
        UNION ALL SELECT CASE WHEN c.target > 0 THEN 2 ELSE 1 END, message, collected, failed, r.target, false, true, error FROM run_end r, cap c"""),
    "queue_page": with_([*STATE, ("v", """SELECT id, title, status, created_at, row_number() OVER (ORDER BY created_at, id) AS position,
        count(*) OVER () AS total FROM state WHERE status <> 'deleted'""")], "SELECT * FROM v WHERE position = least(58, total)"),
    "queue_positions": with_(STATE, """SELECT id, status, created_at, row_number() OVER (ORDER BY created_at, id) AS position,
        count(*) OVER () AS total FROM state WHERE status <> 'deleted'"""),
    "status_counts": with_([*STATE, REVIEWS, FOLDED, REVIEWED], """SELECT count(*) FILTER (status = 'saved') AS approved,
        count(*) FILTER (status <> 'deleted') AS visible FROM reviewed"""),
    "run_outcome": with_([LISTINGS, ("g", """SELECT source AS run_id, count(*) FILTER (url <> '') AS collected,
        count(*) FILTER (url = '') AS failed, 250 AS target FROM listings GROUP BY source
        UNION ALL SELECT DISTINCT source || ':none', 0, 0, 250 FROM listings"""), ("o", f"""SELECT *, {OUTCOME} FROM g""")],
        f"SELECT *, CASE WHEN zero OR short THEN error ELSE {DONE} END AS message FROM o"),
    "failures": with_([LISTINGS], f"""SELECT 'listing:' || listing_id AS url, 'no url' AS error FROM listings WHERE url = ''
        UNION ALL SELECT 'remotive.com:' || listing_id, 'payload does not parse' FROM listings WHERE listing_id % 10 = 0"""),
    "failure_panel": with_([PROGRESS, RUNS, ("p", """SELECT run_id, CASE WHEN run_id % 5 = 0 THEN 'Request refused' END AS request_error,
        CASE WHEN run_id % 3 = 0 THEN 'Short run' ELSE '' END AS error, message, collected, run_id % 2 AS failed,
        true AS finished, false AS running FROM runs"""), ("s", """SELECT *, request_error IS NOT NULL OR error <> '' OR collected = 0
        OR failed > 0 AS shown FROM p""")], """SELECT *, CASE WHEN NOT shown THEN NULL WHEN request_error IS NOT NULL THEN 'Request failed'
        WHEN error <> '' THEN 'Collection failed' WHEN collected = 0 THEN 'No contract jobs found' ELSE 'Some sources failed' END AS title,
        CASE WHEN shown THEN coalesce(request_error, nullif(error, ''), nullif(message, ''), 'Nothing matched as contract roles.') END AS detail FROM s"""),
    "progress_pct": with_([PROGRESS, RUNS], """SELECT run_id, CASE WHEN run_id % 8 = 0 THEN 0.0
        ELSE least(CAST(100 AS DOUBLE), CAST(100 AS DOUBLE) * collected / (run_id % 8)) END AS pct FROM runs"""),
    "preview_line": with_(STATE, """SELECT id, concat_ws(' · ', nullif(company, ''), nullif(domain, ''), nullif(task_type, ''),
        CASE WHEN pay_rate <> '' THEN pay_rate WHEN salary <> '' THEN salary END, nullif(hours_per_week, ''), nullif(work_mode, ''),
        nullif(location, '')) AS preview FROM state"""),
    "union_sources": with_([LISTINGS, BATCH], """SELECT listing_id, source, url, 1 AS pass FROM listings
        UNION ALL SELECT seq, source_board, url, 2 FROM batch"""),
    "clear_queue": with_(STATE, "SELECT id, status FROM state WHERE status = 'saved'"),
    "review_events_stream": with_([*STATE, REVIEWS, FOLDED, REVIEWED], "SELECT * FROM reviewed"),
    "change_only": with_([PROGRESS], changes("progress")),
    **dict.fromkeys(["change_only_until_finished", "change_only_until_finished_stream"], with_([PROGRESS, ("u", """SELECT * FROM progress
        QUALIFY coalesce(sum(CASE WHEN finished AND NOT running THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0""")], changes("u"))),
    "change_only_stream": with_([PROGRESS], changes("progress")),
    "progress_upsert": with_([PROGRESS, RUNS], "SELECT * FROM runs"),
    "progress_upsert_stream": with_([PROGRESS, RUNS], "SELECT * FROM runs"),
    "ingest_stream": with_([*STATE, BATCH, *upsert("state", "batch")], "SELECT * FROM merged"),
}
# The bucketed table answers as the plain operators do.
for _name, _same in [("bucketed_upsert", "upsert_listings"), ("merge_on_read", "upsert_listings"), ("bucketed_reviews", "apply_reviews"),
                     ("bucketed_delete", "mark_deleted"), ("bucketed_lookup", "lookup"), ("queue_slice_page", "queue_page")]:
    ORACLES[_name] = ORACLES[_same]
