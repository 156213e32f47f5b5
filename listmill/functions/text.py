"""Column functions for whitespace, words and unions of literals.

All of them are built-in Catalyst expressions: no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, as a regex class body and as a list of characters.
# Java's \s is ASCII only, so the class is spelled out.
WS_BODY = r"\s\x1c-\x1f\x85\p{Z}"
WS = f"[{WS_BODY}]"
_ODD_POINTS = [0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F,
               0x3000]
_ODD_WS = "".join(map(chr, _ODD_POINTS))
_ODD_WS_CLASS = r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WS_CHARS = "\t\n\x0b\x0c\r " + _ODD_WS

# A run of white space that is not one plain blank.  Single blanks, nearly all
# of them, are not touched.
_ODD_RUN = r"[\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# Printable ASCII fails at the first test, before the wide classes are tried.
WS_RUN = f"(?![!-~])(?:{_ODD_RUN}{WS}*| (?![!-~]){WS}+)"

_WORD = r"[\p{L}\p{N}_]"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def unicode_regex(pattern: str) -> str:
    """Java form of a pattern whose ``\\b`` and ``\\w`` are meant in Unicode.

    Newer JDKs treat ``\\b`` as ASCII, so the boundary is written out.  ``(?d)``
    makes ``\\n`` the only character that ``.`` does not match.
    """
    return "(?d)" + pattern.replace(r"\b", _BOUNDARY).replace(r"\w", _WORD)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def literal(s: str) -> str:
    """A SQL string literal."""
    body = "".join(c if c >= " " and c not in "\\'" and ord(c) < 127 else
                   ("\\" + c if c in "\\'" else f"\\u{ord(c):04x}") for c in s)
    return f"'{body}'"


def sql_let(value: str, name: str, body: str) -> str:
    """``let`` in SQL text: ``body`` may use ``name`` for the value."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def over(value: Column, name: str, body: str) -> Column:
    """SQL text over a column that the text calls ``name``.

    Long expressions are written as SQL text: the driver builds them in one
    call instead of one call per node.
    """
    return F.element_at(F.call_function("transform", F.array(value), F.expr(f"{name} -> {body}")), 1)


def clean_ws_sql(c: str) -> str:
    return f"coalesce(trim(regexp_replace({c}, {literal(WS_RUN)}, ' ')), '')"


def strip_ws_sql(c: str) -> str:
    return f"trim(BOTH {literal(WS_CHARS)} FROM {c})"


def nonempty(c: Column) -> Column:
    """The value, or null where it is empty; the value is evaluated once."""
    return over(c, "x", "nullif(x, '')")


def first_nonempty(*cols: Column) -> Column:
    """The first value that is neither null nor empty, else "".  Evaluates all of them."""
    filled = F.call_function("filter", F.array(*cols), F.expr("x -> x <> ''"))
    return F.coalesce(F.get(filled, 0), F.lit(""))


def first_found(*cols: Column) -> Column:
    """The same, but a value is only computed where those before it are empty."""
    return F.coalesce(*[nonempty(c) for c in cols], F.lit(""))


def clean_ws(c: Column) -> Column:
    """Runs of Unicode white space become one blank; ends are trimmed; null is ""."""
    return F.coalesce(F.trim(F.regexp_replace(c, WS_RUN, " ")), F.lit(""))


def strip_ws(c: Column) -> Column:
    """Cut Unicode white space at both ends."""
    return F.trim(c, F.lit(WS_CHARS))


def plain_ws(c: Column) -> Column:
    """Turn non-ASCII white space into blanks so that ``\\s`` sees all of it."""
    return F.when(c.rlike(f"(?![ -~]){_ODD_WS_CLASS}"), F.translate(c, _ODD_WS, " " * len(_ODD_WS))).otherwise(c)


def contains_any_sql(c: str, literals: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {literal(x)})" for x in literals) + ")"


def contains_any(c: Column, literals: Iterable[str]) -> Column:
    """True where any literal is a substring: byte search, no regex."""
    return over(c, "x", contains_any_sql("x", literals))


def has_rule_sql(low: str, rule: tuple[str, str, Sequence[str]]) -> str:
    """True where the rule's pattern occurs in lower-cased text.

    The literals are a cheap guard: the regex only runs on rows that hold one.
    """
    _, pattern, literals = rule
    return f"({contains_any_sql(low, literals)} AND {low} RLIKE {literal(unicode_regex(pattern))})"


def first_label_sql(low: str, rules, default: str) -> str:
    """Label of the first rule that holds (CASE WHEN stops there)."""
    cases = " ".join(f"WHEN {has_rule_sql(low, r)} THEN {literal(r[0])}" for r in rules)
    return f"CASE {cases} ELSE {literal(default)} END"


def all_labels_sql(low: str, rules, limit: int) -> str:
    """Labels of all rules that hold, in rule order, joined by ", "; at most ``limit``."""
    hits = ", ".join(f"IF({has_rule_sql(low, r)}, {literal(r[0])}, NULL)" for r in rules)
    return f"array_join(slice(array_compact(array({hits})), 1, {limit}), ', ')"


def parse_keywords(c: Column) -> Column:
    """Split keyword text on commas, semicolons and newlines; first spelling of each wins."""
    words = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[,;\n]+"), strip_ws), lambda w: w != "")
    return F.aggregate(
        words,
        F.array().cast("array<string>"),
        lambda kept, w: F.when(F.exists(kept, lambda k: F.lower(k) == F.lower(w)), kept)
        .otherwise(F.concat(kept, F.array(w))),
    )


def split_keywords(text: str | None) -> list[str]:
    """The same rule for a query argument given as plain text."""
    kept: dict[str, str] = {}
    for piece in (text or "").replace(";", ",").replace("\n", ",").split(","):
        if piece.strip():
            kept.setdefault(piece.strip().lower(), piece.strip())
    return list(kept.values())


def matches_keywords(title: Column, text: Column, keywords: Sequence[str] | Column) -> Column:
    """True where any keyword is in title or text, ignoring case; no keywords means true."""
    blob = F.lower(F.concat(title, F.lit("\n"), text))
    if isinstance(keywords, Column):
        return let(blob, lambda b: (F.size(keywords) == 0) | F.exists(keywords, lambda k: F.contains(b, F.lower(k))))
    return contains_any(blob, [k.lower() for k in keywords]) if keywords else F.lit(True)
