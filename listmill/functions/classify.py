"""The contract classifier."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listmill import vocab as V
from listmill.functions.text import contains_any, contains_any_sql, literal, over, unicode_regex


def _token(c: Column) -> Column:
    """A job type as one token: dashes and blanks become underscores."""
    return F.translate(F.lower(F.coalesce(c, F.lit(""))), "- ", "__")


def contract_rule(
    title: Column,
    text: Column,
    job_type: Column | None = None,
    tags: Column | None = None,
    company: Column | None = None,
    source: Column | None = None,
) -> Column:
    """Name of the first rule that makes a listing contract work, or null.

    platform: a platform name in company or source;
    token: a contract token among job type and tags;
    phrase: a contract phrase anywhere in the text;
    word: a short contract word;
    labeling: a labeling role, unless one line says full-time and permanent.
    """
    blank = F.lit("")
    job_type = blank if job_type is None else F.coalesce(job_type, blank)
    tags = F.array().cast("array<string>") if tags is None else tags
    owner = F.lower(F.concat(blank if company is None else company, F.lit(" "), blank if source is None else source))
    types = F.concat_ws(" ", F.concat(F.array(_token(job_type)), F.transform(tags, _token)))
    short = rf"\b(?:{'|'.join(V.CONTRACT_WORDS)})\b"
    token_set = F.expr(f"array({', '.join(literal(t) for t in V.TYPE_TOKENS)})")

    low_rules = (
        f"CASE WHEN {contains_any_sql('b', V.CONTRACT_PHRASES)} THEN 'phrase' "
        f"WHEN {contains_any_sql('b', V.CONTRACT_WORDS)} AND b RLIKE {literal(unicode_regex(short))} THEN 'word' "
        f"WHEN {contains_any_sql('b', V.LABELING_TERMS)} AND NOT (contains(b, 'permanent') "
        f"AND b RLIKE {literal(unicode_regex(V.PERMANENT_PATTERN))}) THEN 'labeling' END")
    blob = F.concat_ws("\n", title, text, job_type, F.concat_ws(" ", tags))
    return (
        F.when(contains_any(owner, V.PLATFORMS), "platform")
        .when(F.arrays_overlap(F.split(types, "[^a-z0-9_+]+"), token_set), "token")
        .otherwise(over(F.lower(blob), "b", low_rules))
    )
