"""Pay mining: find pay figures in free text, score them, and show the best one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listmill import vocab as V
from listmill.functions.text import (
    WS_RUN, clean_ws, clean_ws_sql, contains_any_sql, first_nonempty, let, literal, nonempty, over, sql_let, unicode_regex,
)


def pay_text(*cols: Column) -> Column:
    """Non-empty inputs joined by a blank, dashes and slashes unified, white space collapsed."""
    joined = F.concat_ws(" ", *[nonempty(c) for c in cols])
    return over(joined, "j", (
        f"regexp_replace(IF({contains_any_sql('j', '–—／')}, translate(j, '–—／', '--/'), j), {literal(WS_RUN)}, ' ')"))


# Digit-free stretches longer than twice this many characters lose their middle.
# Every character of a match is within 30 characters of one of its digits and
# the context adds 40, so no match and no context reaches the cut.
_REACH = 120


def _near_digits(t: str) -> str:
    stretch = rf"(?:^|(?<=[0-9]))([^0-9]{{{_REACH}}})[^0-9]+([^0-9]{{{_REACH}}})"
    return f"regexp_replace({t}, {literal(stretch)}, {literal('$1' + chr(0) + '$2')})"


def _rx(pattern: str) -> str:
    return literal("(?iu)" + unicode_regex(pattern))


def _guard(t: str, number: int) -> str:
    """A cheap test without which pay pattern ``number`` cannot match."""
    if number in (1, 4, 6):
        return f"contains({t}, '$')"
    if number in (2, 3, 7):
        return f"{t} RLIKE {literal(r'(?i)US(?:D|[$])')}"
    return rf"{t} RLIKE {literal(r'(?iu)[0-9]\s*(?:/\s*h|per\s*hour)')}"


_HIT = "struct<base:int,rule:int,pos:int,raw:string,ctx:string>"


def _hits(t: str, number: int, base: int, pattern: str) -> str:
    """All matches of one pattern as structs of base score, rule, position, text and context."""
    regex, pad = _rx(pattern), V.PAY_CONTEXT_CHARS
    # The text between the matches has one piece more than there are matches;
    # the last pair has a null match.
    matches = (f"zip_with(regexp_extract_all({t}, {regex}, 0), regexp_extract_all({t}, {regex}, 1), "
               "(w0, r0) -> named_struct('whole', w0, 'raw', r0))")
    steps = (f"zip_with(split({t}, {regex}, -1), {matches}, "
             "(gap, m) -> named_struct('gap', length(gap), 'whole', m.whole, 'raw', m.raw))")
    start = "(acc.pos + s.gap)"
    size = "coalesce(length(s.whole), 0)"
    left = f"greatest({start} - {pad}, 0)"
    ctx = f"lower(substring({t}, {left} + 1, {start} + {size} + {pad} - {left}))"
    hit = (f"named_struct('base', {base}, 'rule', {number}, 'pos', {start}, 'raw', {clean_ws_sql('s.raw')}, "
           f"'ctx', {ctx})")
    step = (f"(acc, s) -> named_struct('pos', {start} + {size}, 'found', "
            f"IF(s.whole IS NULL, acc.found, concat(acc.found, array({hit}))))")
    none = f"cast(array() AS array<{_HIT}>)"
    walked = f"aggregate({steps}, named_struct('pos', 0, 'found', {none}), {step}, acc -> acc.found)"
    return f"CASE WHEN {_guard(t, number)} THEN {walked} ELSE {none} END"


def _score(hit: str) -> str:
    raw, ctx = f"{hit}.raw", f"{hit}.ctx"
    rules = [
        (raw, V.HOURLY_PATTERN, V.SCORE_HOURLY),
        (ctx, V.PAY_WORD_PATTERN, V.SCORE_PAY_WORD),
        (f"concat({raw}, ' ', {ctx})", V.ANNUAL_CONTEXT_PATTERN, V.SCORE_ANNUAL),
        (ctx, V.NOT_PAY_PATTERN, V.SCORE_NOT_PAY),
        (raw, V.YEAR_LIKE_PATTERN, V.SCORE_YEAR_LIKE),
    ]
    return " + ".join([f"{hit}.base", *[f"IF({c} RLIKE {_rx(p)}, {n}, 0)" for c, p, n in rules]])


def _amount(v: str) -> str:
    cents = f"regexp_replace(regexp_replace(format_number({v}, 2), '0+$', ''), '[.]$', '')"
    return (f"concat('$', CASE WHEN {v} >= 1000 THEN format_number({v}, 0) "
            f"WHEN abs({v} - floor({v})) < 1e-6 THEN cast(floor({v}) AS string) ELSE {cents} END)")


def _pay_format(c: str) -> str:
    tidy = f"replace({clean_ws_sql(c)}, 'US$', 'USD')"
    for pattern, put in ((r"\s*-\s*", "-"), (r"(?i)\s+to\s+", "-"), (r"[$]\s+", r"\$")):
        tidy = f"regexp_replace({tidy}, {literal(pattern)}, {literal(put)})"
    numbers = f"slice(regexp_extract_all(t, {literal(V.NUMBER_PATTERN)}, 0), 1, 2)"
    parsed = (f"named_struct('v', transform({numbers}, n -> cast(replace(n, ',', '') AS double)), "
              f"'hour', t RLIKE {_rx(V.HOURLY_PATTERN)}, 'year', t RLIKE {_rx(V.YEARLY_PATTERN)})")
    low, high = V.UNITLESS_HOURLY_RANGE
    unit = (f"CASE WHEN p.hour AND exists(p.v, x -> x > {V.HOURLY_CEILING}) THEN '/yr' WHEN p.hour THEN '/hr' "
            f"WHEN NOT p.year AND forall(p.v, x -> x BETWEEN {low} AND {high}) THEN '/hr' "
            f"WHEN p.year OR exists(p.v, x -> x >= {V.YEARLY_FLOOR}) THEN '/yr' ELSE '' END")
    both = "sort_array(p.v)"
    span = (f"IF(array_size(array_distinct(p.v)) = 2, concat({_amount(f'{both}[0]')}, '-', {_amount(f'{both}[1]')}), "
            f"{_amount('p.v[0]')})")
    shown = f"IF(size(p.v) = 0, '', concat({span}, {unit}))"
    digits = literal("[0-9]")
    return sql_let(tidy, "t", f"IF(t RLIKE {digits}, {sql_let(parsed, 'p', shown)}, '')")


def _candidates(text: Column) -> Column:
    hits = ", ".join(_hits("w", i, base, p) for i, (base, p) in enumerate(V.PAY_PATTERNS, 1))
    scored = sql_let(_pay_format("h.raw"), "shown", (
        f"named_struct('score', {_score('h')}, 'shortness', -length(shown), 'rule_rank', -h.rule, "
        "'pos_rank', -h.pos, 'text', shown)"))
    return over(text, "w", f"filter(transform(filter(concat({hits}), h -> h.raw <> ''), h -> {scored}), "
                           "c -> c.text <> '')")


def pay_candidates(*cols: Column) -> Column:
    """Every pay figure found, as structs ordered so that the greatest is the best.

    Best: highest score, then shortest text, then rule order, then position.
    """
    return _candidates(pay_text(*cols))


def extract_pay(*cols: Column) -> Column:
    """The best pay figure in the texts, or "" when none scores high enough.

    The patterns only see the neighbourhood of digits, which is most of the
    cost on long texts; order and contexts of the candidates stay the same.
    """
    # Every pattern needs a dollar sign or a unit next to digits; most text has neither.
    worth = literal(r"(?i)[$]|USD|[0-9]\s*(?:/|per)")
    text = over(pay_text(*cols), "p", f"IF(p RLIKE {worth}, {_near_digits('p')}, '')")
    return over(F.array_max(_candidates(text)), "best", (
        f"IF(best.score >= {V.MIN_PAY_SCORE}, substring(best.text, 1, {V.MAX_CHARS['pay_rate']}), '')"))


def pay_format(c: Column) -> Column:
    """One display form for a pay text: ``$low-$high/hr``, ``$n/yr``, ``$n``, or ""."""
    return over(c, "raw", _pay_format("raw"))


def choose_pay(salary: Column, mined: Column) -> Column:
    """Pick between the source's salary field and the mined figure."""

    def pick(structured: Column) -> Column:
        return (
            F.when((structured == "") | (mined == ""), F.concat(structured, mined))
            .when(mined.contains("/hr") & ~structured.contains("/hr"), mined)
            .when(structured.contains("/hr"), structured)
            .when(F.length(structured) >= F.length(mined), structured)
            .otherwise(mined)
        )

    return let(pay_format(F.coalesce(salary, F.lit(""))),
               lambda s: F.substring(pick(s), 1, V.MAX_CHARS["pay_rate"]))


def pay_or_raw(chosen: Column, mined: Column, salary: Column) -> Column:
    """The chosen pay, else the mined figure, else the source's text."""
    return F.substring(clean_ws(first_nonempty(chosen, mined, clean_ws(salary))), 1, V.MAX_CHARS["pay_rate"])


def _whole(v: Column) -> Column:
    return v.cast("bigint")


def _numbers(low: Column, high: Column, show) -> Column:
    """Read both bounds as numbers (missing is 0; one bad value voids both) and show them."""

    def num(c: Column) -> Column:
        given = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(given == "", F.lit(0.0)).otherwise(given.try_cast("double"))

    def voided(p: Column) -> Column:
        return F.when(p["lo"].isNull() | p["hi"].isNull() | ((p["lo"] == 0) & (p["hi"] == 0)), "").otherwise(
            show(p["lo"], p["hi"]))

    return let(F.struct(num(low).alias("lo"), num(high).alias("hi")), voided)


def compose_salary(low: Column, high: Column) -> Column:
    """``$a-$b/hr`` when both bounds are small, ``/yr`` otherwise; one bound alone is shown alone."""

    def show(lo: Column, hi: Column) -> Column:
        one = F.when(lo != 0, _whole(lo)).otherwise(_whole(hi))
        both = (lo != 0) & (hi != 0)
        return (
            F.when(both & (F.greatest(lo, hi) <= V.HOURLY_CEILING) & (lo == hi), F.format_string("$%d/hr", _whole(lo)))
            .when(both & (F.greatest(lo, hi) <= V.HOURLY_CEILING),
                  F.format_string("$%d-$%d/hr", _whole(lo), _whole(hi)))
            .when(both, F.format_string("$%,d-$%,d/yr", _whole(lo), _whole(hi)))
            .when(one <= V.HOURLY_CEILING, F.format_string("$%d/hr", one))
            .otherwise(F.format_string("$%,d/yr", one))
        )

    return _numbers(low, high, show)


def compose_annual(low: Column, high: Column, currency: Column) -> Column:
    """Annual salary text with a currency prefix."""
    code = F.upper(first_nonempty(currency, F.lit("USD")))
    prefix = F.when(code.isin("USD", "US$"), "$").otherwise(F.concat(code, F.lit(" ")))

    def show(lo: Column, hi: Column) -> Column:
        one = F.when(lo != 0, _whole(lo)).otherwise(_whole(hi))
        return F.when(
            (lo != 0) & (hi != 0) & (lo != hi),
            F.concat(prefix, F.format_number(_whole(lo), 0), F.lit("-"), prefix, F.format_number(_whole(hi), 0),
                     F.lit("/yr")),
        ).otherwise(F.concat(prefix, F.format_number(one, 0), F.lit("/yr")))

    return _numbers(low, high, show)
