"""Listing attributes mined from text: hours, duration, mode, domain, tasks, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listmill import vocab as V
from listmill.functions.pay import choose_pay, extract_pay
from listmill.functions.text import (
    all_labels_sql, clean_ws_sql, contains_any_sql, first_label_sql, has_rule_sql, literal, over, plain_ws, sql_let,
    unicode_regex,
)

# Each attribute is SQL text over names: ``blob`` is text with plain white
# space, ``low`` its lower-cased form.


def _find(c: str, pattern: str, group: int, limit: int) -> str:
    found = f"regexp_extract({c}, {literal('(?iu)' + unicode_regex(pattern))}, {group})"
    return f"substring({clean_ws_sql(found)}, 1, {limit})"


def _hours(blob: str) -> str:
    guard = literal(r"(?iu)[0-9]\s*h(?:ou)?r")
    return f"IF({blob} RLIKE {guard}, {_find(blob, V.HOURS_PATTERN, 1, V.MAX_CHARS['hours_per_week'])}, '')"


def _duration(low: str, blob: str) -> str:
    words = contains_any_sql(low, ["length", "duration", "week", "month", "rolling", "ended"])
    return f"IF({words}, {_find(blob, V.DURATION_PATTERN, 1, V.MAX_CHARS['duration'])}, '')"


def _client(low: str, blob: str) -> str:
    return (f"IF({contains_any_sql(low, V.CLIENT_HINTS)}, "
            f"{_find(blob, V.CLIENT_PATTERN, 1, V.MAX_CHARS['client_partner'])}, '')")


def _tools(low: str) -> str:
    return f"substring({all_labels_sql(low, V.TOOLS, len(V.TOOLS))}, 1, {V.MAX_CHARS['tools_skills']})"


def _screening(low: str) -> str:
    return f"substring({all_labels_sql(low, V.SCREENING, len(V.SCREENING))}, 1, {V.MAX_CHARS['screening']})"


def _languages(low: str) -> str:
    return (f"CASE WHEN NOT {has_rule_sql(low, V.ENGLISH)} THEN '' WHEN {has_rule_sql(low, V.BILINGUAL)} "
            f"THEN {literal(V.BILINGUAL[0])} ELSE {literal(V.ENGLISH[0])} END")


def _section(low: str, text: str, group: str) -> str:
    def under(header: str) -> str:
        pattern = (rf"(?isu)(?:\A|\n)\s*{header}\s*[:\n]+(.+?)"
                   rf"(?=\n\s*(?:[A-Z][A-Za-z /&-]{{2,40}})\s*[:\n]|\z)")
        found = f"regexp_extract({text}, {literal(pattern)}, 1)"
        cut = f"IF(x = '', NULL, substring({clean_ws_sql('x')}, 1, {V.MAX_CHARS['section']}))"
        # Headers that the text lacks are not searched.
        return f"IF(contains({low}, {literal(header.split('.?')[-1].lower())}), {sql_let(found, 'x', cut)}, NULL)"

    return f"coalesce({', '.join(under(h) for h in V.SECTION_HEADERS[group])}, '')"


def hours(blob: Column) -> Column:
    """The first hours phrase."""
    return over(blob, "b", _hours("b"))


def duration(blob: Column) -> Column:
    """Project length, a range of weeks or months, rolling basis or open-ended."""
    return over(blob, "b", _duration("lower(b)", "b"))


def client_partner(blob: Column) -> Column:
    """The partner lab that the text names."""
    return over(blob, "b", _client("lower(b)", "b"))


def work_mode(low: Column) -> Column:
    return over(low, "t", first_label_sql("t", V.WORK_MODES, "remote"))


def employment_type(low: Column) -> Column:
    return over(low, "t", first_label_sql("t", V.EMPLOYMENT_TYPES, "contract"))


def domain(low: Column) -> Column:
    return over(low, "t", first_label_sql("t", V.DOMAINS, ""))


def task_type(low: Column) -> Column:
    return over(low, "t", all_labels_sql("t", V.TASK_TYPES, V.MAX_TASK_TYPES))


def tools(low: Column) -> Column:
    return over(low, "t", _tools("t"))


def screening(low: Column) -> Column:
    return over(low, "t", _screening("t"))


def languages(low: Column) -> Column:
    return over(low, "t", _languages("t"))


def section(text: Column, group: str) -> Column:
    """Text under the first header of the group, up to the next header-like line."""
    return over(text, "d", _section("lower(d)", "d", group))


def posted_date(text: Column) -> Column:
    """The date text after the word posted, date or published."""
    found = f"regexp_extract(d, {literal('(?iu)' + unicode_regex(V.POSTED_PATTERN))}, 2)"
    return over(text, "d", f"IF({contains_any_sql('lower(d)', ['posted', 'date', 'published'])}, "
                           f"{clean_ws_sql(found)}, '')")


def with_attributes(df: DataFrame) -> DataFrame:
    """Add all mined attributes to rows of title, company, location, salary and description.

    The blob and its lower-cased form are computed once per row and shared.
    Everything is in-row: this adds no shuffle.
    """
    parts = [F.col(c) for c in ("title", "company", "location", "salary", "description")]
    blob, low, text = "_blob", "_low", "_text"
    rules = {
        "hours_per_week": _hours(blob),
        "duration": _duration(low, blob),
        "work_mode": first_label_sql(low, V.WORK_MODES, "remote"),
        "employment_type": first_label_sql(low, V.EMPLOYMENT_TYPES, "contract"),
        "domain": first_label_sql(low, V.DOMAINS, ""),
        "task_type": all_labels_sql(low, V.TASK_TYPES, V.MAX_TASK_TYPES),
        "languages": _languages(low),
        "client_partner": _client(low, blob),
        "tools_skills": _tools(low),
        "screening": _screening(low),
        **{g: _section(low, text, g) for g in V.SECTION_HEADERS},
    }
    return (
        df.withColumns({
            "_blob": plain_ws(F.concat_ws("\n", *parts)),
            "_text": plain_ws(F.col("description")),
            "_mined": extract_pay(F.col("title"), F.col("description"), F.col("salary")),
        })
        .withColumn("_low", F.lower("_blob"))
        .withColumns({"_chosen": choose_pay(F.col("salary"), F.col("_mined")),
                      **{name: F.expr(sql) for name, sql in rules.items()}})
        .drop("_blob", "_low", "_text")
    )
