"""Small builders of DuckDB SQL text for the checks: text, pay, HTML and attribute rules.

Written from the rules, not from the Spark expressions: candidates become rows
and windows here, where Spark folds arrays in the row.
"""

from __future__ import annotations

from checks import inputs as I
from listmill import vocab as V

NW = r"[^\p{L}\p{N}_]"
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
ODD = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def let(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{SPACE}+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def plain(x: str) -> str:
    return f"regexp_replace({x}, '{ODD}', ' ', 'g')"


def word(x: str, alternatives: str) -> str:
    return f"regexp_matches({x}, {q(f'(^|{NW})(?:{alternatives})({NW}|$)')})"


def any_of(x: str, literals: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(t)})" for t in literals) + ")"


def key(x: str) -> str:
    return f"lower(rtrim({x}, '/'))"


def with_(ctes: list[tuple[str, str]], body: str) -> str:
    recursive = "RECURSIVE " if any(n.startswith("RECURSIVE ") for n, _ in ctes) else ""
    text = ",\n".join(f"{n.removeprefix('RECURSIVE ')} AS ({s})" for n, s in ctes)
    return f"WITH {recursive}{text}\n{body}"


LISTINGS = ("listings", I.select(I.LISTINGS, "documents"))
BOARD_PAGES = ("board_pages", I.select(I.BOARD_PAGES, "pages"))
JOB_PAGES = ("job_pages", I.select(I.JOB_PAGES, "board_pages"))
ROBOTS = ("robots", I.select(I.ROBOTS, "nation"))
REVIEWS = ("review_events", I.select(I.REVIEW_EVENTS, "events"))
PROGRESS = ("progress", I.select(I.PROGRESS_EVENTS, "events"))
STATE = [LISTINGS, ("state_rows", f"SELECT listing_id, {', '.join(I.split_list(I.STATE))} FROM listings"),
         ("state", f"""SELECT * EXCLUDE (listing_id) FROM state_rows QUALIFY row_number() OVER (
             PARTITION BY CASE WHEN {key('url')} = '' THEN id ELSE {key('url')} END ORDER BY listing_id) = 1""")]
BATCH = ("batch", I.select(I.BATCH, "listings"))


# -- pay --------------------------------------------------------------------------

HOUR = "(?i)" + V.HOURLY_PATTERN
YEAR = "(?i)" + V.YEARLY_PATTERN


def amount(v: str) -> str:
    return (f"CASE WHEN {v} >= 1000 THEN '$' || format('{{:,}}', CAST(round_even({v}, 0) AS BIGINT)) "
            f"WHEN {v} = floor({v}) THEN '$' || CAST(CAST({v} AS BIGINT) AS VARCHAR) "
            f"ELSE '$' || rtrim(rtrim(printf('%.2f', {v}), '0'), '.') END")


def pay_format(raw: str) -> str:
    tidy = f"replace({clean(raw)}, 'US$', 'USD')"
    for p, r in ((r"\s*-\s*", "-"), (r"(?i)\s+to\s+", "-"), (r"\$\s+", "$")):
        tidy = f"regexp_replace({tidy}, {q(p)}, {q(r)}, 'g')"
    numbers = (f"list_transform(list_slice(regexp_extract_all(t, {q(V.NUMBER_PATTERN)}), 1, 2), "
               "lambda n: CAST(replace(n, ',', '') AS DOUBLE))")
    hour, year = f"regexp_matches(t, {q(HOUR)})", f"regexp_matches(t, {q(YEAR)})"
    unit = (f"CASE WHEN {hour} AND list_max(v) > 500 THEN '/yr' WHEN {hour} THEN '/hr' "
            f"WHEN NOT {year} AND list_min(v) >= 15 AND list_max(v) <= 400 THEN '/hr' "
            f"WHEN {year} OR list_max(v) >= 1000 THEN '/yr' ELSE '' END")
    shown = (f"CASE WHEN len(v) = 0 THEN '' ELSE (CASE WHEN list_min(v) <> list_max(v) "
             f"THEN {amount('list_min(v)')} || '-' || {amount('list_max(v)')} ELSE {amount('v[1]')} END) || {unit} END")
    return let(tidy, "t", let(numbers, "v", shown))


def pay_text(cols: list[str]) -> str:
    joined = "concat_ws(' ', " + ", ".join(f"nullif({c}, '')" for c in cols) + ")"
    return f"regexp_replace(replace(replace(replace({joined}, '–', '-'), '—', '-'), '／', '/'), '{SPACE}+', ' ', 'g')"


def pay_ctes(source: str, cols: list[str], out: str) -> list[tuple[str, str]]:
    """CTEs ``out``_c (all candidates) and ``out`` (k, pay: the best that counts)."""
    found = " UNION ALL ".join(
        f"""SELECT k, t, {i} AS rule, {base} AS base, unnest(regexp_extract_all(t, {q('(?i)' + p)}, 0)) AS whole,
        unnest(regexp_extract_all(t, {q('(?i)' + p)}, 1)) AS raw,
        unnest(string_split_regex(t, {q('(?i)' + p)})) AS gap,
        unnest(range(1, len(string_split_regex(t, {q('(?i)' + p)})) + 1)) AS ix FROM {out}_t"""
        for i, (base, p) in enumerate(V.PAY_PATTERNS, 1))
    not_pay = r"founded|employees?|headcount|funding|raised|valuation|users?|models?"
    annual = "regexp_matches(raw || ' ' || ctx, " + q("(?i)" + V.ANNUAL_CONTEXT_PATTERN) + ")"
    year_like = q(rf"\$?\s?20[1-3]\d({NW}|$)")
    return [
        (f"{out}_t", f"SELECT k, {pay_text(cols)} AS t FROM {source}"),
        (f"{out}_h", found),
        (f"{out}_p", f"""SELECT * EXCLUDE (raw), {clean('raw')} AS raw,
            sum(length(gap)) OVER w + coalesce(sum(length(whole)) OVER (PARTITION BY k, rule ORDER BY ix
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
            FROM {out}_h WINDOW w AS (PARTITION BY k, rule ORDER BY ix)"""),
        (f"{out}_x", f"""SELECT *, lower(substr(t, CAST(greatest(pos - 40, 0) + 1 AS BIGINT),
            CAST(pos + length(whole) + 40 - greatest(pos - 40, 0) AS BIGINT))) AS ctx
            FROM {out}_p WHERE whole IS NOT NULL AND raw <> ''"""),
        (f"{out}_c", f"""SELECT k, rule, CAST(pos AS BIGINT) AS pos, {pay_format('raw')} AS text, base
            + CASE WHEN regexp_matches(raw, {q(HOUR)}) THEN 25 ELSE 0 END
            + CASE WHEN {word('ctx', 'pay|rate|compensation|wage|earning|hourly')} THEN 15 ELSE 0 END
            - CASE WHEN {annual} THEN 10 ELSE 0 END
            - CASE WHEN {word('ctx', not_pay)} THEN 50 ELSE 0 END
            - CASE WHEN regexp_matches(raw, {year_like}) THEN 80 ELSE 0 END AS score FROM {out}_x"""),
        (out, f"""SELECT s.k, CASE WHEN b.score >= 30 THEN substr(b.text, 1, 120) ELSE '' END AS pay FROM {source} s
            LEFT JOIN (SELECT * FROM {out}_c WHERE text <> '' QUALIFY row_number() OVER (
                PARTITION BY k ORDER BY score DESC, length(text), rule, pos) = 1) b ON s.k = b.k"""),
    ]


def choose_pay(salary: str, mined: str) -> str:
    return let(pay_format(salary), "s", f"""substr(CASE WHEN s = '' THEN {mined} WHEN {mined} = '' THEN s
        WHEN contains({mined}, '/hr') AND NOT contains(s, '/hr') THEN {mined} WHEN contains(s, '/hr') THEN s
        WHEN length(s) >= length({mined}) THEN s ELSE {mined} END, 1, 120)""")


# -- contract ---------------------------------------------------------------------

def contract_rule(title: str, text: str, job_type: str = "''", tags: str = "[]", company: str = "''",
                  source: str = "''") -> str:
    types = (f"replace(replace(lower({job_type}), '-', '_'), ' ', '_') || ' ' || array_to_string(list_transform("
             f"CAST({tags} AS VARCHAR[]), lambda g: replace(replace(lower(g), '-', '_'), ' ', '_')), ' ')")
    low = (f"lower({title} || chr(10) || {text} || chr(10) || {job_type} || chr(10) || "
           f"coalesce(array_to_string(CAST({tags} AS VARCHAR[]), ' '), ''))")
    token_list = "[" + ", ".join(q(t) for t in V.TYPE_TOKENS) + "]"
    full = r"full[- ]?time"
    gap = rf"({NW}.*)?{NW}"
    gap = gap.replace("_]", r"_\n]")
    edge, end = f"(^|{NW})", f"({NW}|$)"
    veto = (f"(regexp_matches(b, {q(f'{edge}{full}{gap}permanent{end}')}) OR "
            f"regexp_matches(b, {q(f'{edge}permanent{gap}{full}{end}')}))")
    rest = (f"CASE WHEN {any_of('b', V.CONTRACT_PHRASES)} THEN 'phrase' WHEN {word('b', 'temp|gig')} THEN 'word' "
            f"WHEN {any_of('b', V.LABELING_TERMS)} AND NOT {veto} THEN 'labeling' END")
    owner = f"lower({company} || ' ' || {source})"
    return (f"CASE WHEN {any_of(owner, V.PLATFORMS)} THEN 'platform' "
            f"WHEN list_has_any(string_split_regex({types}, '[^a-z0-9_+]+'), {token_list}) THEN 'token' "
            f"ELSE {let(low, 'b', rest)} END")


# -- attributes -------------------------------------------------------------------

def blob(title="title", company="company", location="location", salary="salary", description="description") -> str:
    return plain(f"concat_ws(chr(10), {title}, {company}, {location}, {salary}, {description})")


def _find(x: str, pattern: str, limit: int, group: int = 1) -> str:
    return f"substr({clean(f'regexp_extract({x}, {q(pattern)}, {group})')}, 1, {limit})"


def hours(x: str) -> str:
    return _find(x, "(?i)" + V.HOURS_PATTERN, 80)


def duration(x: str) -> str:
    return _find(x, "(?i)" + V.DURATION_PATTERN, 120)


def client(x: str) -> str:
    return _find(x, "(?i)" + V.CLIENT_PATTERN, 200)


def posted(x: str) -> str:
    return clean(f"regexp_extract({x}, {q('(?i)' + V.POSTED_PATTERN)}, 2)")


def work_mode(low: str) -> str:
    return (f"CASE WHEN {word(low, 'async|asynchronous')} THEN 'async remote' WHEN {word(low, 'hybrid')} THEN 'hybrid' "
            "ELSE 'remote' END")


def employment(low: str) -> str:
    return (f"CASE WHEN {word(low, 'freelance')} THEN 'freelance' WHEN {word(low, 'temporary|temp')} THEN 'temporary' "
            "ELSE 'contract' END")


DOMAIN_WORDS = [
    ("Biology / life sciences", "biology|biomedical|life[- ]science|molecular"),
    ("Mathematics", "math|mathematics|statistic|proof[- ]based"),
    ("STEM", "physics|chemistry|stem"),
    ("Coding / engineering", "software|coding|programming|python|javascript"),
    ("Legal", "legal|law|attorney"),
    ("Medical / healthcare", "medical|clinical|healthcare|physician"),
    ("Finance / economics", "finance|accounting|economics"),
    ("Language / NLP", "linguistic|linguistics|nlp|language"),
]


def domain(low: str) -> str:
    return "CASE " + " ".join(f"WHEN {word(low, w)} THEN {q(d)}" for d, w in DOMAIN_WORDS) + " ELSE '' END"


def labels(tests: list[tuple[str, str]], limit: int) -> str:
    items = ", ".join(f"CASE WHEN {cond} THEN {q(name)} END" for name, cond in tests)
    return f"array_to_string(list_slice(list_filter([{items}], lambda x: x IS NOT NULL), 1, {limit}), ', ')"


def task_type(low: str) -> str:
    line_gap = rf"([^\p{{L}}\p{{N}}_\n].*)?[^\p{{L}}\p{{N}}_\n]"
    return labels([
        ("RLHF", f"({word(low, 'rlhf')} OR contains({low}, 'reinforcement learning from human feedback'))"),
        ("Preference ranking", f"(regexp_matches({low}, {q(f'(^|{NW})preference{line_gap}(rank|rating|label)')}) "
                               f"OR contains({low}, 'pairwise comparison'))"),
        ("Data labeling / annotation", f"({word(low, 'labeling|labelling')} OR regexp_matches({low}, {q(f'(^|{NW})annotat')}))"),
        ("Model evaluation", f"(regexp_matches({low}, {q(f'(^|{NW})evaluat(?:e|ion)')}) OR contains({low}, 'model eval') "
                             f"OR contains({low}, 'model response'))"),
        ("Red teaming", f"regexp_matches({low}, {q(f'(^|{NW})red[- ]?team')})"),
        ("OCR / extraction QA", word(low, "ocr")),
        ("Prompt writing", word(low, "prompt|prompts|prompting")),
        ("Content moderation", word(low, "content moderation")),
    ], 4)


def tools(low: str) -> str:
    return labels([(t, word(low, t.lower())) for t in ("LaTeX", "Python", "Jupyter", "SQL", "MATLAB", "Excel")], 6)


def screening(low: str) -> str:
    return labels([("AI interview", word(low, "ai interview")),
                   ("Screening / assessment", word(low, "screening|assessment|qualification")),
                   ("Resume / profile", word(low, "resume|cv"))], 3)


def languages(low: str) -> str:
    return (f"CASE WHEN NOT {word(low, 'english')} THEN '' WHEN {word(low, 'bilingual|fluent in')} "
            "THEN 'English + additional (see description)' ELSE 'English' END")


def section(text: str, group: str) -> str:
    tries = []
    for header in V.SECTION_HEADERS[group]:
        rest = rf"regexp_extract({text}, {q(rf'(?is)(?:^|\n)\s*{header}\s*[:\n]+(.+)$')}, 1)"
        after = q(r"(?is)\n\s*[A-Z][A-Za-z /&-]{2,40}\s*[:\n].*$")
        cut = f"substr(r, 1, 1) || regexp_replace(substr(r, 2), {after}, '')"
        tries.append(let(rest, "r", f"CASE WHEN r <> '' THEN substr({clean(cut)}, 1, 900) END"))
    return f"coalesce({', '.join(tries)}, '')"


def enrich_ctes(source: str, out: str) -> list[tuple[str, str]]:
    """CTE ``out``: the source's columns and all mined attributes; ``source`` has a unique k."""
    return [
        *pay_ctes(source, ["title", "description", "salary"], f"{out}_pay"),
        (f"{out}_b", f"SELECT *, lower(blob) AS low FROM (SELECT s.*, p.pay AS mined, {blob()} AS blob, "
                     f"{plain('description')} AS plain FROM {source} s JOIN {out}_pay p ON s.k = p.k)"),
        (out, f"""SELECT *, {choose_pay('salary', 'mined')} AS chosen, {hours('blob')} AS hours_per_week,
            {duration('blob')} AS duration, {client('blob')} AS client_partner, {work_mode('low')} AS work_mode,
            {employment('low')} AS employment_type, {domain('low')} AS domain, {task_type('low')} AS task_type,
            {tools('low')} AS tools_skills, {screening('low')} AS screening, {languages('low')} AS languages,
            {', '.join(f"{section('plain', g)} AS {g}" for g in V.SECTION_HEADERS)} FROM {out}_b"""),
    ]


def listing_columns(pay: str, posted_text: str, source: str, now: str) -> str:
    hash_key = f"CASE WHEN {key('url')} <> '' THEN {key('url')} ELSE concat_ws(chr(10), {source}, title, description) END"
    given = {
        "id": f"sha256({hash_key})", "title": f"substr({clean('title')}, 1, 300)",
        "company": f"substr({clean('company')}, 1, 200)", "location": f"substr({clean('location')}, 1, 200)",
        "description": f"substr({clean('description')}, 1, 5000)", "source_board": source,
        "posted_date": posted_text, "salary": pay, "pay_rate": pay, "notes": "''", "status": "'unreviewed'",
        "created_at": q(now), "updated_at": q(now),
    }
    return ", ".join(f"{given.get(c, c)} AS {c}" for c in V.LISTING_FIELDS)


# -- HTML --------------------------------------------------------------------------

TAG = r"<[a-zA-Z/!?][^>]*>"


def hide(html: str) -> str:
    return (rf"regexp_replace({html}, '(?is)<!--.*?(?:-->|$)|<script[\s/>].*?(?:</script\s*>|$)|"
            rf"<style[\s/>].*?(?:</style\s*>|$)', '<br>', 'g')")


def unescape(x: str) -> str:
    for name, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("nbsp", " "), ("amp", "&")):
        x = f"replace({x}, '&{name};', {q(char)})"
    return x


def text_of(v: str) -> str:
    nodes = f"list_transform(string_split_regex({v}, {q(TAG)}), lambda n: {strip(unescape('n'))})"
    return f"array_to_string(list_filter({nodes}, lambda n: n <> ''), ' ')"


def inside(v: str, tag: str) -> str:
    return rf"regexp_extract({v}, '(?s)<{tag}(?:\s[^>]*)?>(.*?)(?:</{tag}\s*>|$)', 1)"


def tag_text(v: str, tag: str) -> str:
    return clean(text_of(inside(v, tag)))


def div_text(v: str, class_: str) -> str:
    inner = rf"""regexp_extract({v}, '(?s)<div class="{class_}">(.*?)(?:</div\s*>|$)', 1)"""
    return clean(text_of(inner))


def body_text(v: str) -> str:
    chrome = (rf"regexp_replace({v}, '(?is)<noscript[\s/>].*?(?:</noscript\s*>|$)|<nav[\s/>].*?(?:</nav\s*>|$)|"
              rf"<footer[\s/>].*?(?:</footer\s*>|$)', '<br>', 'g')")
    return f"substr({clean(text_of(chrome))}, 1, 4000)"


def first(*xs: str) -> str:
    return f"coalesce({', '.join(f'nullif({x}, {q(str())})' for x in xs)}, '')"


def meta(v: str, name: str) -> str:
    content = f"""regexp_extract({v}, '<meta (?:property|name)="{name}" content="([^"]*)"', 1)"""
    return clean(unescape(content))


def page_title(v: str) -> str:
    return first(meta(v, "og:title"), meta(v, "twitter:title"), tag_text(v, "h1"), tag_text(v, "title"))


def netloc(u: str) -> str:
    return f"regexp_extract({u}, '^[^:/?#]+://([^/?#]*)', 1)"


def origin(u: str) -> str:
    return f"regexp_extract({u}, '^([^:/?#]+://[^/?#]*)', 1)"


def path(u: str) -> str:
    return f"regexp_replace(regexp_extract({u}, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', '')"


def page_company(v: str, u: str) -> str:
    label = f"split_part(replace({netloc(u)}, 'www.', ''), '.', 1)"
    runs = rf"regexp_extract_all({label}, '\p{{L}}+|[^\p{{L}}]+')"
    titled = f"array_to_string(list_transform({runs}, lambda r: upper(substr(r, 1, 1)) || lower(substr(r, 2))), '')"
    return first(meta(v, "og:site_name"), titled)


def page_location(v: str) -> str:
    return div_text(v, "job-location")


def page_description(v: str) -> str:
    return first(tag_text(v, "article"), tag_text(v, "main"), body_text(v))


def resolve(base: str, href: str) -> str:
    bare = f"regexp_extract({base}, '^([^?#]*)', 1)"
    folder = (f"CASE WHEN regexp_extract(substr({bare}, length({origin(base)}) + 1), '^(.*/)', 1) = '' THEN '/' "
              f"ELSE regexp_extract(substr({bare}, length({origin(base)}) + 1), '^(.*/)', 1) END")
    up = f"CASE WHEN {folder} = '/' THEN '/' ELSE regexp_replace({folder}, '[^/]+/$', '') END"
    return (f"CASE WHEN {href} = '' OR {href} LIKE '#%' OR {href} LIKE 'mailto:%' OR {href} LIKE 'javascript:%' THEN NULL "
            f"WHEN regexp_matches({href}, '^https?:') THEN {href} WHEN regexp_matches({href}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN NULL "
            f"WHEN {href} LIKE '//%' THEN split_part({base}, ':', 1) || ':' || {href} "
            f"WHEN {href} LIKE '?%' THEN {bare} || {href} WHEN {href} LIKE '/%' THEN {origin(base)} || {href} "
            f"WHEN {href} LIKE '../%' THEN {origin(base)} || {up} || substr({href}, 4) "
            f"ELSE {origin(base)} || {folder} || {href} END")


def job_rule(host: str, p: str) -> str:
    parts = f"len(list_filter(string_split({p}, '/'), lambda x: x <> ''))"
    return rf"""CASE WHEN contains({host}, 'greenhouse.io') AND contains({p}, '/jobs/') THEN 1
        WHEN contains({host}, 'lever.co') THEN (CASE WHEN {parts} >= 2 THEN 2 END)
        WHEN contains({host}, 'ashbyhq.com') AND contains({p}, '/jobs/') THEN 3
        WHEN contains({host}, 'workable.com') AND (contains({p}, '/j/') OR contains({p}, '/jobs/')) THEN 4
        WHEN contains({host}, 'mercor.com') AND contains({p}, '/jobs/') AND len(string_split({p}, '/')) > 2 THEN 5
        WHEN regexp_matches({p}, '(?i)/(jobs?|careers?|positions?|openings?|vacancies)/.+') THEN 6
        WHEN regexp_matches({p}, '(?i)/(job|position|opening)[_-]?[\p{{L}}\p{{N}}_]+') THEN 7 END"""


def same_site(a: str, b: str) -> str:
    return f"(contains({b}, {a}) OR contains({a}, {b}) OR {any_of(b, V.KNOWN_BOARDS)})"


def link_ctes(pages: str, out: str, limit: int) -> list[tuple[str, str]]:
    """CTE ``out``: page_id, url, pos, link: job links per page, first per key, at most ``limit``."""
    return [
        (f"{out}_v", f"SELECT page_id, url, {hide('html')} AS v FROM {pages}"),
        (f"{out}_a", f"""SELECT page_id, url, {strip(unescape('h'))} AS href, ix FROM (SELECT page_id, url,
            unnest(regexp_extract_all(v, '(?i)<a\\s[^>]*href="([^"]*)"[^>]*>', 1)) AS h,
            unnest(range(1, len(regexp_extract_all(v, '(?i)<a\\s[^>]*href="([^"]*)"[^>]*>', 1)) + 1)) AS ix FROM {out}_v)"""),
        (f"{out}_r", f"SELECT page_id, url, ix, {resolve('url', 'href')} AS link FROM {out}_a"),
        (f"{out}_k", f"""SELECT *, rtrim({path('link')}, '/') AS p, lower({netloc('link')}) AS host FROM {out}_r
            WHERE link IS NOT NULL"""),
        (f"{out}_j", f"""SELECT * FROM {out}_k WHERE {job_rule('host', 'p')} IS NOT NULL
            AND {same_site(f'lower({netloc("url")})', 'host')}
            QUALIFY row_number() OVER (PARTITION BY page_id, lower({origin('link')} || p) ORDER BY ix) = 1"""),
        (out, f"""SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY ix) AS pos, link
            FROM {out}_j QUALIFY pos <= {limit}"""),
    ]


NEXT = """CASE WHEN contains({v}, '>Next</a>') THEN regexp_extract({u}, '^([^?#]*)', 1) || '?page=2' END"""


def next_page(v: str, u: str) -> str:
    return NEXT.format(v=v, u=u)
