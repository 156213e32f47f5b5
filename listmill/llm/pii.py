"""Personal data: candidate spans, judged by boosted trees; all of it in DataFrame functions.

Fixed rules find e-mail addresses, IP addresses, card numbers and phone numbers with their
checks; these spans always stay.  Beside them, generators of high recall propose further
spans, which may overlap: number runs, key-like strings, spelled-out addresses.  Features of
a candidate's form and of the text around it go into gradient-boosted trees.  They are fitted
on the candidates of all documents: equal ones are counted, and the counts are weights.  Edges lie between all values of a feature,
or at its percentiles over all examples, and the trees split on which edges a value is beyond, so that nothing is
left for them to find in a sample; a candidate is a positive example if the fixed rules confirm it or if it is the quoted value
of a credential.  Half of the examples, by hash, are fitted without the context, so that
the form counts too.  Thresholds are calibrated for each kind on examples held out: the lowest
score from which on at least ``precision`` of the held-out examples are positive.  A kind
for which no score reaches that adds nothing.  Of overlapping candidates the one of the
highest score stays; none overlaps a span of the fixed rules.

The fitted trees become nested CASE expressions, so scoring is part of the row's projection:
no shuffle and no Python.  Positions come from the gaps between matches; patterns are
possessive and anchored, so long texts cost neither stack nor quadratic time in one match.

Nulls: a null text is the empty text.  Repeated rows get the same result each.  Without
examples of both classes nothing is added.  An empty table gives an empty result.
Of candidates with equal scores the longer one stays, then the first, then the kind listed first.  Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listmill.llm.shared import written

KINDS = ["email", "ip", "card", "phone", "id", "secret"]
SPAN = "array<struct<s:string,start:int,end:int>>"
LOCAL, LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: The base rules, each equal to its plain form, with anchors that keep long texts linear.
BASE_PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[{LABEL}]++(?:\.[{LABEL}]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){13,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
GENERATORS = {  # kind -> pattern
    "id": r"[0-9](?<![0-9A-Za-z][0-9])(?:[ .-]?[0-9]){6,18}(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]{0,64}[0-9])[A-Za-z0-9_/+-]{16,}",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{2,63}){1,4}",
}
TRIGGERS = {"email": "@", "phone": "+"}
CREDENTIAL = r"(?i)(?:token|secret|key|passw|pwd|auth|credential|bearer)[a-z_]{0,8}[\"']? ?[=:] ?[\"']?$"
CONTACT = r"(?i)(?:mail|contact|tel|phone|call|fax|mobil|ssn|passport|account|card|iban)[^\n]{0,12}$"
AROUND = 32
FEATURES = ["length", "digits", "letters", "uppers", "marks", "distinct", "hex", "luhn", "groups", "credential", "contact",
            "quoted", "assigned", "word_before", "word_after", "is_id", "is_secret", "is_email"]
CONTEXT = {"credential", "contact", "quoted", "assigned", "word_before", "word_after"}


def let(value: Column, use) -> Column:
    """``use(value)`` with the value made once, also where ``use`` needs it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def spans_of(text: Column, pattern: str) -> Column:
    """All matches with their places: the gaps between them tell where they are."""
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))

    def places(z: Column) -> Column:
        steps = F.transform(z["m"], lambda s, i: F.struct(s.alias("s"), F.length(z["g"][i]).alias("gap"), F.length(s).alias("n")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
        return F.aggregate(steps, start, lambda a, e: F.struct(
            (a["at"] + e["gap"] + e["n"]).alias("at"),
            F.concat(a["out"], F.array(F.struct(e["s"].alias("s"), (a["at"] + e["gap"]).alias("start"), (a["at"] + e["gap"] + e["n"]).alias("end")))).alias("out")),
            lambda a: a["out"])

    return let(parts, places)


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    values = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(values, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def part_fits(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))


CHECKS = {
    "email": lambda s: F.lit(True),
    "ip": lambda s: F.forall(F.split(s, r"\."), part_fits),
    "card": lambda s: luhn(digits_of(s)),
    "phone": lambda s: F.length(digits_of(s)).between(10, 15),
}


def checked(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: CHECKS[kind](x["s"]))


def of_kind(spans: Column, number: int) -> Column:
    return F.filter(spans, lambda x: x["kind"] == number)


def placed(spans: Column, number: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(number).alias("kind"), x["end"].alias("end")))


def base_spans(text: Column) -> dict[str, Column]:
    none = F.array().cast(SPAN)
    out = {}
    for kind, pattern in BASE_PATTERNS.items():
        worth = F.contains(text, F.lit(TRIGGERS[kind])) if kind in TRIGGERS else F.rlike(text, F.lit(pattern))
        out[kind] = F.when(worth, checked(spans_of(text, pattern), kind)).otherwise(none)
    return out


def with_base(docs: DataFrame) -> DataFrame:
    """docs with text (never null) and ``base``: the checked spans (start, end, kind number), by start, then kind."""
    text = docs.withColumn("text", F.coalesce("text", F.lit("")))
    found = base_spans(F.col("text"))
    every = F.concat(*[placed(found[k], n) for n, k in enumerate(BASE_PATTERNS)])
    return text.withColumn("base", F.array_sort(every))


def proposed(spans: Column, number: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["start"].alias("start"), x["end"].alias("end"), F.lit(number).alias("kind")))


def with_candidates(docs: DataFrame) -> DataFrame:
    """docs with ``candidates``: (kind, start, end, features) of all generators; those over base spans too."""
    text = F.col("text")
    has_digit = F.rlike(text, F.lit("[0-9]"))
    none = F.array().cast("array<struct<s:string,start:int,end:int,kind:int>>")
    parts = []
    for kind, pattern in GENERATORS.items():
        worth = F.rlike(text, F.lit(r"\((?:at)\)|\[at\]")) if kind == "email" else has_digit
        parts.append(F.when(worth, proposed(spans_of(text, pattern), KINDS.index(kind))).otherwise(none))
    return docs.withColumn("found", F.concat(*parts)).withColumn(
        "candidates", let(F.col("base"), lambda base: F.transform("found", lambda c: features(c, text, base)))).drop("found")


def features(c: Column, text: Column, base: Column) -> Column:
    s, start, end = c["s"], c["start"], c["end"]
    left = F.substring(text, F.greatest(start - AROUND, F.lit(0)) + 1, F.least(start, F.lit(AROUND)))
    right = F.substring(text, end + 1, F.lit(4))

    def count(chars: str) -> Column:
        return F.length(F.regexp_replace(s, f"[^{chars}]", "")).cast("double")

    def flag(x: Column) -> Column:
        return x.cast("int").cast("double")

    digits = digits_of(s)
    made = {
        "length": F.length(s).cast("double"), "digits": count("0-9"), "letters": count("A-Za-z"), "uppers": count("A-Z"),
        "marks": F.length(F.regexp_replace(s, "[A-Za-z0-9]", "")).cast("double"),
        "distinct": F.size(F.array_distinct(F.transform(F.sequence(F.lit(1), F.least(F.length(s), F.lit(64))), lambda i: F.substring(s, i, F.lit(1))))).cast("double"),
        "hex": flag(F.rlike(s, F.lit("^[0-9a-fA-F]+$"))),
        "luhn": flag(F.length(digits).between(14, 19) & luhn(F.when(digits == "", "0").otherwise(digits))),
        "groups": F.size(F.split(s, "[ .-]")).cast("double"),
        "credential": flag(F.rlike(left, F.lit(CREDENTIAL))), "contact": flag(F.rlike(left, F.lit(CONTACT))),
        "quoted": flag(F.rlike(left, F.lit("[\"']$")) & F.rlike(right, F.lit("^[\"']"))), "assigned": flag(F.rlike(left, F.lit("[=:] ?[\"']?$"))),
        "word_before": flag(F.rlike(left, F.lit(r"\p{L} $"))), "word_after": flag(F.rlike(right, F.lit(r"^ \p{L}"))),
        "is_id": flag(c["kind"] == KINDS.index("id")), "is_secret": flag(c["kind"] == KINDS.index("secret")), "is_email": flag(c["kind"] == KINDS.index("email")),
    }
    inside = F.exists(base, lambda b: (b["start"] <= start) & (b["end"] >= end))
    over = F.exists(base, lambda b: (b["start"] < end) & (b["end"] > start))
    named = (made["credential"] == 1) & (made["quoted"] == 1) & (c["kind"] == KINDS.index("secret"))
    return F.struct(start.alias("start"), end.alias("end"), c["kind"].alias("kind"), over.alias("over"), (inside | named).alias("positive"),
                    *[made[f].alias(f) for f in FEATURES])


def tree_sql(lines: list[str], within) -> str:
    """One printed tree as nested CASE expressions."""
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return f"{float(line.split(':')[1])!r}D"
    feature, value = re.fullmatch(r"If \(feature (\d+) in \{([01])\.0\}\)", line).groups()
    first = tree_sql(lines, within)
    lines.pop(0)  # Else
    second = tree_sql(lines, within)
    low, high = (first, second) if value == "0" else (second, first)
    return f"CASE WHEN {within(int(feature))} THEN {low} ELSE {high} END"


def trees_sql(printed: str, within) -> str:
    """The margin of printed gradient-boosted trees as a SQL expression; ``within`` has the test that a value isn't beyond an edge."""
    parts = re.split(r"\n\s*Tree \d+ \(weight ([-0-9.eE]+)\):\n", printed)[1:]
    return " + ".join(f"{float(w)!r}D * ({tree_sql([x for x in body.split(chr(10)) if x.strip()], within)})" for w, body in zip(parts[::2], parts[1::2]))


def examples(docs: DataFrame) -> DataFrame:
    """(label, kind, part, features, n): the candidates of all documents, counted; part 0 and 1 are fitted, 0 without the context, 2 is held out."""
    every = with_candidates(with_base(docs.select("doc_id", "text")))
    # The outer form: for the other one the plan makes all candidates a second time, to tell whether there are any.
    rows = every.select("doc_id", F.explode_outer("candidates").alias("c")).filter("c IS NOT NULL")
    part = F.least(F.pmod(F.xxhash64("doc_id", "c.start", "c.end"), F.lit(4)), F.lit(2))
    rows = rows.select(F.col("c.positive").cast("double").alias("label"), F.col("c.kind").alias("kind"), part.alias("part"), "c")
    made = [F.when((F.col("part") == 0) & F.lit(f in CONTEXT), 0.0).otherwise(F.col(f"c.{f}")).alias(f) for f in FEATURES]
    return rows.select("label", "kind", "part", *made).groupBy("label", "kind", "part", *FEATURES).agg(F.count("*").alias("n"))


def edges_of(rows: DataFrame, bins: int = 32) -> list[tuple[str, float]]:
    """(feature, edge): between all values of a feature with at most ``bins`` of them, else its percentiles over the examples (features, n)."""
    long = rows.select("n", F.explode(F.create_map(*[x for f in FEATURES for x in (F.lit(f), F.col(f))])).alias("feature", "value"))
    counts = written(long.groupBy("feature", "value").agg(F.sum("n").alias("n")), "values")
    cuts = F.percentile("value", F.array(*[F.lit(k / bins) for k in range(1, bins)]), F.col("n"))
    stats = {r.feature: r for r in counts.groupBy("feature").agg(F.count("*").alias("values"), F.max("value").alias("most"), cuts.alias("cuts")).collect()}
    few = [f for f, r in stats.items() if r.values <= bins]
    values = {f: [] for f in few}
    for r in counts.filter(F.col("feature").isin(few)).orderBy("value").collect():  # at most bins a feature
        values[r.feature].append(r.value)
    out = []
    for f in FEATURES:
        if f in values:
            out += [(f, (a + b) / 2) for a, b in zip(values[f], values[f][1:])]
        elif f in stats:
            out += [(f, x) for x in sorted(set(stats[f].cuts)) if x < stats[f].most]
    return out


def fit(docs: DataFrame, precision: float = 0.95, trees: int = 20, depth: int = 3) -> tuple[str, dict[int, float]] | None:
    """(margin as SQL over a candidate ``c``, least margin of each kind), or None without examples of both classes."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = written(examples(docs), "candidates")
    train = rows.filter("part < 2")
    if train.select("label").distinct().count() < 2:
        return None
    edges = edges_of(train)
    own = {f: [x for g, x in edges if g == f] for f in FEATURES}
    beyond = [sum([(F.col(f) > x).cast("int") for x in own[f]], F.lit(0)).alias(f) for f in FEATURES]
    binned = written(train.select("label", "n", *beyond).groupBy("label", *FEATURES).agg(F.sum("n").cast("double").alias("n")), "binned")
    flags = [(F.col(f) > own[f].index(x)).cast("double").alias(f"_{i}", metadata={"ml_attr": {"type": "binary"}}) for i, (f, x) in enumerate(edges)]
    assembled = VectorAssembler(inputCols=[f"_{i}" for i in range(len(edges))], outputCol="features").transform(binned.select("label", "n", *flags))
    model = GBTClassifier(featuresCol="features", weightCol="n", maxIter=trees, maxDepth=depth, seed=11).fit(assembled.select("label", "n", "features"))
    printed = model.toDebugString

    def margin(prefix: str) -> str:
        return trees_sql(printed, lambda i: f"{prefix}{edges[i][0]} <= {edges[i][1]!r}D")

    held = rows.filter("part = 2").select("kind", "label", "n", F.expr(margin("")).alias("margin"))
    # margins take few values: a bounded number of leaves a tree; counts of them, not the rows, are gathered
    counts = held.groupBy("kind", F.round("margin", 6).alias("margin")).agg(F.sum("n").alias("n"), F.sum(F.col("label") * F.col("n")).alias("good")).collect()
    least = {}
    for kind in {r.kind for r in counts}:
        n = good = 0
        for r in sorted((r for r in counts if r.kind == kind), key=lambda r: -r.margin):
            n, good = n + r.n, good + r.good
            if good >= precision * n:
                least[kind] = r.margin
    return margin("c."), {k: v for k, v in least.items() if math.isfinite(v)}


def find_personal_data(docs: DataFrame, precision: float = 0.95) -> DataFrame:
    """doc_id, text, n_email, n_ip, n_card, n_phone (base spans), base, added: arrays of (start, kind number, end)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fitted = fit(docs, precision)
    out = with_base(docs)
    kind = "array<struct<start:int,kind:int,end:int>>"
    if fitted is None or not fitted[1]:
        added = F.array().cast(kind)
    else:
        margin, least = fitted
        out = with_candidates(out)
        scored = F.expr(f"transform(filter(candidates, c -> NOT c.over), c -> named_struct('start', c.start, 'kind', c.kind, 'end', c.end, 'margin', round({margin}, 6)))")
        passed = F.filter(scored, lambda c: _any([(c["kind"] == k) & (c["margin"] >= v) for k, v in sorted(least.items())]))

        def order(x: Column) -> Column:
            return F.struct(x["margin"], x["end"] - x["start"], -x["start"], -x["kind"])

        def best(every: Column) -> Column:
            return F.filter(every, lambda c: ~F.exists(every, lambda d: (d["start"] < c["end"]) & (d["end"] > c["start"]) & (order(d) > order(c))))

        added = F.array_sort(F.transform(let(passed, best), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))).cast(kind)
    counts = [F.size(of_kind(F.col("base"), n)).cast("long").alias(f"n_{k}") for n, k in enumerate(BASE_PATTERNS)]
    return out.select("doc_id", "text", *counts, "base", added.alias("added"))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(found: DataFrame) -> DataFrame:
    """doc_id, redacted: the text with every span replaced by its kind in brackets; the first of overlapping spans counts."""
    names = F.array(*[F.lit(k.upper()) for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col("text")
    body = F.aggregate(F.array_sort(F.concat("base", "added")), start, lambda a, x: F.when(x["start"] < a["at"], a).otherwise(F.struct(
        x["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit("["), F.get(names, x["kind"]), F.lit("]")).alias("out"))),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return found.select("doc_id", body.alias("redacted"))


def span_digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", *[f"n_{k}" for k in BASE_PATTERNS], F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
                        spans_text(F.array_sort(F.concat("base", "added"))).alias("spans"))
