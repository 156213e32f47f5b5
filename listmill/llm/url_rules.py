"""URL filters: fixed host and path rules, and association rules mined from labels.

Fixed rules name a host (with all its subdomains) and the start of a path; the longest one
that fits decides.  All other URLs are judged by rules that Spark's FP-growth mines: the
tokens of a labelled URL (scheme, host labels, domain, path segments, query keys) are its
items, with one more if it is labelled bad.  A rule's antecedent is a set of tokens, its
consequent that label; rules need a support and a confidence, and a rule that another
with fewer of its tokens and at least its confidence covers is pruned.  Rules are matched by an
inverted index: each is listed under its rarest token alone, distinct token sets are
looked up by their tokens, and the rule's other tokens are then tested.  A URL that some
rule fits is blocked.

Nulls: a null URL, or one without ``://``, has an empty host and path, no tokens, no rule and is
allowed.  A label without an id labels nothing; labels of one id that disagree count as bad.
Repeated rows get the same result each.  Without labels no rules are mined.  An empty table
gives an empty result.  Of rules that fit equally well the one that sorts last counts.  Only page_id, url, id and bad are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listmill.llm.shared import written

PARTS = r"(?s)^(?:.*?)://([^/?#]*)([^?#]*)"
QUERY = r"(?s)^[^?#]*\?([^#]*)"
BAD = "label=bad"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_SUPPORT, MIN_ROWS, MIN_CONFIDENCE = 0.002, 20, 0.5


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of (verdict, host, path) rules that fits; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a URL, sorted; digits in path segments are one kind of token."""
    text = F.coalesce(url, F.lit(""))
    none = F.array().cast("array<string>")
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    domain = F.when(n >= 2, F.array(F.concat(F.lit("domain="), F.array_join(F.slice(labels, n - 1, F.lit(2)), ".")))).otherwise(none)
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path="), F.regexp_replace(x, "[0-9]+", "0")))
    keys = F.transform(F.filter(F.split(F.regexp_extract(text, QUERY, 1), "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query="), F.split(x, "=", 2)[0]))
    scheme = F.array(F.concat(F.lit("scheme="), F.translate(F.regexp_extract(text, r"(?s)^(.*?)://", 1), UPPER, UPPER.lower())))
    every = F.concat(scheme, F.transform(labels, lambda x: F.concat(F.lit("host="), x)), domain, segments, keys)
    return F.when(F.contains(text, F.lit("://")), F.array_sort(F.array_distinct(every))).otherwise(none)


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(antecedent, confidence, support, rarest) from all rows of (tokens, bad)."""
    from pyspark.ml.fpm import FPGrowth

    spark = labelled.sparkSession
    items = written(labelled.select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items")), "items")
    n = items.count()
    if n < min_rows:
        return spark.createDataFrame([], "antecedent array<string>, confidence double, support double, rarest string")
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, min_rows / n), minConfidence=min_confidence).fit(items)
    frequent = written(model.freqItemsets, "frequent")
    single = frequent.filter("size(items) = 1").select(F.col("items")[0].alias("token"), "freq")
    sets = frequent.select(F.array_sort("items").alias("items"), "freq")
    # confidence of a set of tokens for the label: the frequency with it over that without it
    both = sets.filter(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_sort(F.array_remove("items", BAD)).alias("antecedent"), F.col("freq").alias("bad"))
    rules = written(both.join(sets, F.col("antecedent") == F.col("items")).select(
        "antecedent", (F.col("bad") / F.col("freq")).alias("confidence"), (F.col("bad") / F.lit(n)).alias("support")).filter(F.col("confidence") >= min_confidence), "rules")
    # prune what a rule with fewer tokens covers, looked up under each token of the wider rule
    tokens = rules.select("antecedent", "confidence", F.explode("antecedent").alias("token"))
    lowest = rules.select(F.col("antecedent").alias("small"), F.col("confidence").alias("least"), F.element_at("antecedent", 1).alias("token"))
    covered = tokens.join(lowest, "token").filter(
        (F.size("small") < F.size("antecedent")) & (F.size(F.array_except("small", "antecedent")) == 0) & (F.col("least") >= F.col("confidence"))).select("antecedent").distinct()
    rules = written(rules.join(covered, "antecedent", "left_anti"), "rules")
    counted = rules.select("antecedent", "confidence", "support", F.explode("antecedent").alias("token")).join(single, "token")
    return written(counted.groupBy("antecedent", "confidence", "support").agg(F.min(F.struct("freq", "token"))["token"].alias("rarest")), "rules")


def match_rules(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, best): the best rule (confidence, support, antecedent) of each distinct token set that some rule fits."""
    looked_up = token_sets.select("tokens", F.explode("tokens").alias("rarest"))
    fits = F.size(F.array_except("antecedent", "tokens")) == 0
    return looked_up.join(rules, "rarest").filter(fits).groupBy("tokens").agg(F.max(F.struct("confidence", "support", "antecedent")).alias("best"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], min_support: float = MIN_SUPPORT,
               min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict, mined_rule (tokens), confidence.  ``labels``: (id, bad)."""
    url = F.col("url")
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url").withColumn("host", host_of(url)).withColumn("path", path_of(url))
    parsed = parsed.withColumn("tokens", url_tokens(url, F.col("host"), F.col("path"))).drop("url")
    known = labels.filter("id IS NOT NULL").groupBy("id").agg(F.max(F.coalesce("bad", F.lit(False))).alias("bad"))
    labelled = parsed.join(known, F.col("page_id") == F.col("id")).select("tokens", "bad")
    mined = mine_rules(labelled, min_support, min_rows, min_confidence)
    best = written(match_rules(parsed.select("tokens").distinct(), mined), "matched")
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    return parsed.join(best, "tokens", "left").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("best").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.array_join("best.antecedent", " ").alias("mined_rule"), F.col("best.confidence").alias("confidence"))
