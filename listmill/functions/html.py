"""HTML text, tags, attributes and simple selectors as column expressions.

Pages are handled in their own row: no token explosion, no shuffle, no Python.
``visible`` is a page without comments, scripts and styles (``hide``); the other
functions take that form.
"""

from __future__ import annotations

import re
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from listmill import vocab as V
from listmill.functions.text import (
    clean_ws, clean_ws_sql, first_found, let, literal, over, sql_let, strip_ws, strip_ws_sql,
)
from listmill.functions.urls import urljoin

# One tag; quoted attribute values may hold '>'.  Possessive, so that no tag can
# make the matcher backtrack or recurse deeply.
TAG = r"""<(?:[a-zA-Z/!?](?:[^"'>]++|"[^"]*+"|'[^']*+')*+|[a-zA-Z/!?][^>]*+)>"""
_ENTITY = r"&(?:#\d+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;)"
_NAME = r"[a-zA-Z][^\s/>]*"
_VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
# The character entities of HTML 4, from the standard library.
_ENTITY_CODES = {**name2codepoint, "apos": 39}


def _without(html: Column, tags: list[str], comments: bool) -> Column:
    alternatives = [r"<!--.*?(?:-->|\z)"] if comments else []
    alternatives += [rf"<{t}(?=[\s/>]).*?(?:</{t}\s*>|\z)" for t in tags]
    return F.regexp_replace(html, "(?is)" + "|".join(alternatives), "<br>")


def hide(html: Column) -> Column:
    """The page without comments, scripts, styles and templates; they still split text."""
    return _without(F.coalesce(html, F.lit("")), ["script", "style", "template"], comments=True)


def _decode(entity: str) -> str:
    # The codes are one string, searched by name: small in the plan, and rarely read.
    codes = literal("," + ",".join(f"{n}={c}" for n, c in _ENTITY_CODES.items()))
    value = sql_let(f"substring_index({codes}, concat(',', b, '='), -1)", "k",
                    "IF(k RLIKE '^[0-9]', substring_index(k, ',', 1), NULL)")
    named = f"IF(b RLIKE '^[a-zA-Z][a-zA-Z0-9]+$', {value}, NULL)"
    code = (f"CASE WHEN {entity} RLIKE '^&#[xX]' THEN conv(substring(b, 2, 8), 16, 10) "
            f"WHEN startswith({entity}, '&#') THEN substring(b, 1, 10) ELSE {named} END")
    shown = (f"CASE WHEN n IS NULL THEN {entity} WHEN n BETWEEN 1 AND 1114111 "
             "THEN decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32') ELSE '\\ufffd' END")
    return sql_let(f"regexp_extract({entity}, '^&#?([^;]+)', 1)", "b",
                   sql_let(f"try_cast({code} AS bigint)", "n", shown))


def _unescape(c: str) -> str:
    found = literal(_ENTITY)
    return (f"CASE WHEN contains({c}, '&') THEN array_join(zip_with(split({c}, {found}, -1), "
            f"transform(regexp_extract_all({c}, {found}, 0), e -> {_decode('e')}), "
            f"(p, d) -> concat(p, coalesce(d, ''))), '') ELSE {c} END")


def _visible_text(v: str) -> str:
    node = f"CASE WHEN t <> '' THEN {strip_ws_sql(_unescape('t'))} END"
    return f"array_join(filter(transform(split({v}, {literal(TAG)}, -1), t -> {node}), t -> t <> ''), ' ')"


def unescape(c: Column) -> Column:
    """Replace character references; unknown names stay as they are."""
    return over(c, "u", _unescape("u"))


def visible_text(visible: Column) -> Column:
    """All text nodes, each trimmed, blank ones dropped, joined by one blank."""
    return over(visible, "v", _visible_text("v"))


def html_to_text(html: Column) -> Column:
    """Plain text of an HTML fragment."""
    return let(F.coalesce(html, F.lit("")),
               lambda h: F.when(h.rlike("[<&]"), visible_text(hide(h))).otherwise(strip_ws(h)))


def count_tags(visible: Column, name: str) -> Column:
    return F.regexp_count(visible, F.lit(rf"(?i)<{name}(?=[\s/>])"))


def _attribute(tag: str, name: str) -> str:
    pattern = literal(rf"""(?i)\s{re.escape(name)}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
    parts = ", ".join(f"regexp_extract({tag}, {pattern}, {i})" for i in (1, 2, 3))
    return sql_let(f"concat({parts})", "a", _unescape("a"))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of an opening tag, or "" where it is missing."""
    return over(tag, "g", _attribute("g", name))


# -- selectors ----------------------------------------------------------------

def _value_test(op: str, value: str) -> str:
    v = re.escape(value)
    if op == "~=":                                   # one of the blank-separated words
        return rf"""(?:"(?:[^"]*\s)?{v}(?:\s[^"]*)?"|'(?:[^']*\s)?{v}(?:\s[^']*)?'|{v}(?=[\s>]))"""
    if op == "*=":                                   # anywhere in the value
        return rf"""(?:"[^"]*{v}[^"]*"|'[^']*{v}[^']*'|[^\s"'>]*{v}[^\s"'>]*)"""
    return rf"""(?:"{v}"|'{v}'|{v}(?=[\s>]))"""


def open_tag(selector: str) -> tuple[str, str]:
    """Regex of the opening tags that a simple selector matches, and a regex they must hold.

    Selectors: ``tag``, ``.class``, ``#id``, ``[attr]``, ``[attr='v']``,
    ``[attr*='v']``, each with an optional tag name in front.
    """
    tag, dot, hash_, attr, op, value = re.fullmatch(
        r"""([\w-]*)(?:\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:(\*?=)['"]?([^'"\]]*)['"]?)?\])?""", selector).groups()
    name = f"(?i:{tag})" if tag else _NAME
    if dot or hash_:
        attr, op, value = ("class", "~=", dot) if dot else ("id", "=", hash_)
    if not attr:
        return rf"<{name}(?=[\s/>])[^>]*>", f"(?i:<{tag})"
    test = rf"\s*=\s*{_value_test(op, value)}" if op else r"(?=[\s=/>])"
    return rf"<{name}(?:\s[^>]*?)?\s(?i:{attr}){test}[^>]*>", re.escape(value) if value else f"(?i:{attr})"


def _inner(rest: str, name: str) -> str:
    """Markup up to the close tag that ends element ``name``; ``rest`` starts after its open tag."""
    escaped = f"regexp_replace({name}, {literal(r'([^a-zA-Z0-9_-])')}, {literal(chr(92) * 2 + '$1')})"
    edge = f"concat('(?i)<(/?)', {escaped}, {literal(r'(?=[\s/>])[^>]*>')})"
    # The element spans the pieces before the mark at which the depth falls to zero.
    step = ("(acc, mark) -> CASE WHEN acc.depth = 0 THEN acc ELSE named_struct("
            "'depth', acc.depth + IF(mark = '/', -1, 1), 'seen', acc.seen + 1) END")
    span = (f"aggregate(regexp_extract_all({rest}, edge, 1), named_struct('depth', 1, 'seen', 0), {step}, "
            "acc -> IF(acc.depth = 0, acc.seen, NULL))")
    body = f"IF(n IS NULL, {rest}, array_join(slice(split({rest}, edge, -1), 1, n), '<br>'))"
    return sql_let(edge, "edge", sql_let(span, "n", body))


def _element_html(v: str, selector: str) -> str:
    tests = [open_tag(one.strip()) for one in selector.split(",")]
    pattern = literal("|".join(p for p, _ in tests))
    guard = literal("|".join(g for _, g in tests))
    void = ", ".join(literal(t) for t in _VOID)
    rest = f"substring({v}, instr({v}, tag) + length(tag))"
    name = f"regexp_extract(tag, {literal(f'^<({_NAME})')}, 1)"
    cut = (f"CASE WHEN tag = '' THEN NULL WHEN lower({name}) IN ({void}) THEN '' "
           f"ELSE {sql_let(rest, 'rest', sql_let(name, 'name', _inner('rest', 'name')))} END")
    return f"CASE WHEN {v} RLIKE {guard} THEN {sql_let(f'regexp_extract({v}, {pattern}, 0)', 'tag', cut)} END"


def element_html(visible: Column, selector: str) -> Column:
    """Markup inside the first element a selector matches; null where there is none.

    A comma separates alternatives; the first match in document order counts.
    """
    return over(visible, "v", _element_html("v", selector))


def select_text(visible: Column, selectors: list[str]) -> Column:
    """Clean text of the first selector whose first element has any; "" where none has.

    Later selectors are only tried where the earlier ones found nothing.
    """
    turns = " ".join(f"WHEN {i} THEN {_element_html('v', s)}" for i, s in enumerate(selectors, 1))
    text = sql_let(f"CASE i {turns} END", "inside", f"IF(inside IS NULL, '', {clean_ws_sql(_visible_text('inside'))})")
    return over(visible, "v", (
        f"aggregate(sequence(1, {len(selectors)}), '', (found, i) -> IF(found = '', {text}, found))"))


def meta_value(visible: Column, keys: list[str]) -> Column:
    """Content of the first meta tag with one of the keys, by property before name.

    A property tag hides a name tag of the same key; empty content moves on to
    the next key; content of blanks only ends the search.
    """

    def content(key: str) -> str:
        def tag(attr: str) -> str:
            found = rf"""<(?i:meta)(?:\s[^>]*?)?\s(?i:{attr})\s*=\s*{_value_test("=", key)}[^>]*>"""
            return f"regexp_extract(v, {literal(found)}, 0)"

        first = sql_let(tag("property"), "x", f"IF(x = '', {tag('name')}, x)")
        value = sql_let(sql_let(first, "g", _attribute("g", "content")), "c", f"IF(c = '', NULL, {clean_ws_sql('c')})")
        return f"CASE WHEN contains(v, {literal(key)}) THEN {value} END"

    return over(visible, "v", f"coalesce({', '.join(content(k) for k in keys)}, '')")


_ANCHOR = r"(?i)<a(?=[\s/>])[^>]*>"


def anchors(visible: Column) -> Column:
    """Links in document order as structs of href, rel and text; anchors without href are left out."""
    body = r"(?is)^(.*?)(?:</a\s*>|\z)"
    text = sql_let(f"regexp_extract(rest, {literal(body)}, 1)", "inside", clean_ws_sql(_visible_text("inside")))
    link = (f"named_struct('href', {_attribute('g', 'href')}, 'rel', {_attribute('g', 'rel')}, 'text', {text})")
    has_href = literal(r"(?i)\shref\s*=")
    pairs = (f"zip_with(tags, slice(split(v, {literal(_ANCHOR)}, -1), 2, greatest(size(tags), 1)), "
             f"(g, rest) -> IF(g RLIKE {has_href}, {link}, NULL))")
    tags = f"regexp_extract_all(v, {literal(_ANCHOR)}, 0)"
    return over(visible, "v", sql_let(tags, "tags", f"filter({pairs}, x -> x IS NOT NULL)"))


def hrefs(visible: Column) -> Column:
    """Only the trimmed href values, in document order."""
    tags = f"filter(regexp_extract_all(v, {literal(_ANCHOR)}, 0), g -> g RLIKE {literal(r'(?i)\shref\s*=')})"
    return over(visible, "v", f"transform({tags}, g -> {strip_ws_sql(_attribute('g', 'href'))})")


# -- fields of a page ---------------------------------------------------------

def page_title(visible: Column) -> Column:
    return first_found(meta_value(visible, V.TITLE_META), select_text(visible, V.TITLE_SELECTORS))


def host_company(host: Column) -> Column:
    """First host label after removing ``www.``, each run of letters capitalised."""
    label = F.element_at(F.split(F.replace(host, F.lit("www."), F.lit("")), r"\."), 1)
    runs = F.regexp_extract_all(label, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def page_company(visible: Column, host: Column) -> Column:
    return first_found(meta_value(visible, V.COMPANY_META), select_text(visible, V.COMPANY_SELECTORS),
                       host_company(host))


def page_location(visible: Column) -> Column:
    return select_text(visible, V.LOCATION_SELECTORS)


def page_description(visible: Column) -> Column:
    """Text of the description element, else of the page without its chrome."""
    return first_found(select_text(visible, V.DESCRIPTION_SELECTORS), page_body(visible))


def without_chrome(visible: Column) -> Column:
    """The page without navigation, footer and other parts that are not content."""
    return _without(visible, V.CHROME_TAGS, comments=False)


def page_body(visible: Column) -> Column:
    return F.substring(clean_ws(visible_text(without_chrome(visible))), 1, V.MAX_CHARS["page_text"])


def time_tag(visible: Column) -> Column:
    """The first time element's datetime attribute, else its text."""
    tag = F.regexp_extract(visible, r"(?i)<time(?=[\s/>])[^>]*>", 0)
    return F.when(visible.rlike(r"(?i)<time(?=[\s/>])"),
                  clean_ws(first_found(attribute(tag, "datetime"), visible_text(element_html(visible, "time"))))
                  ).otherwise("")


def needs_render(html: Column, visible: Column) -> Column:
    """True where a page looks empty until a browser runs its scripts."""
    root = element_html(visible, V.APP_ROOT_SELECTOR)
    empty_root = let(root, lambda r: r.isNotNull() & (F.length(clean_ws(visible_text(r))) < V.MIN_ROOT_TEXT))
    few_links = (F.size(hrefs(visible)) < V.MIN_ANCHORS) & (count_tags(html, "script") > V.MAX_SCRIPTS)
    return (
        (F.length(clean_ws(visible_text(visible))) < V.MIN_PAGE_TEXT)
        | few_links
        | empty_root
    )


def next_page(base: Column, visible: Column) -> Column:
    """Absolute URL of the first anchor that reads like a next link; null where there is none."""
    hit = F.filter(anchors(visible), lambda a: F.lower(a["text"]).isin(V.NEXT_LABELS) | F.array_contains(
        F.split(a["rel"], r"\s+"), "next"))
    return F.when(visible.rlike("(?i)next|older|→|›"),
                  let(F.get(hit, 0), lambda a: F.when(a.isNotNull(), urljoin(base, a["href"]))))

