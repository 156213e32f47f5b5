"""Mixing sources to target weights by weighted fair queueing.

Every document of every epoch waits in its source's queue in shuffled order.  Its
virtual finish time is the source's running total of words divided by the source's
target; all queues are served in the order of that time, and the mix ends where the
total budget is used up.  Only ids, sources and sizes are moved, never texts.

Running totals are made in two levels: rows are dealt into small slices of the order
(by the shuffle key within a source, by finish time over all), the slice totals are
summed up, and each slice runs on from its total.  So one source may hold any share
of the rows, and no task holds a source.

Nulls: a null text has size 0; a null source is a source of its own, last in order.
A null id is an id like any other.  Rows that are the same in id, source and size wait
as one and get the same numbers.  Documents of size 0 are never taken.
A very long text is a document of its size, taken whole or not at all; equal finish times go by source, epoch, shuffle key and id.
An empty table gives an empty result.  ``mix_sources`` reads doc_id, text and source; ``mixed_documents`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listmill.llm.shared import column_name, written

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], share: float, epochs: int) -> DataFrame:
    """One row a source: source, source_size, weight, target.

    A target is the smaller of ``epochs`` times the source's size and level times weight, where the
    one level spends the budget, ``share`` of all sizes.  That is where sharing the excess again by
    weight, until no target is above its limit, ends.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    by_need = Window.orderBy("_need", F.col("source").asc_nulls_last())
    limit = F.col("source_size") * F.lit(float(epochs))
    ranked = (
        sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int")))
        .withColumn("_need", limit / F.col("weight"))
        .withColumn("_budget", F.sum("source_size").over(Window.partitionBy()) * F.lit(share))
        # sources that need a lower level are full; the level shares what they leave by the other weights
        .withColumn("_full", F.coalesce(F.sum(limit).over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_open", F.sum("weight").over(by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_budget") - F.col("_full")) / F.col("_open"))
    )
    level = F.max(F.when(F.col("_level") <= F.col("_need"), F.col("_level"))).over(Window.partitionBy())
    return ranked.withColumn("_at", level).select(
        "source", "source_size", "weight",
        F.coalesce(F.least(limit, F.col("_at") * F.col("weight")), limit).alias("target"))


def running_total(df: DataFrame, group: list[str], slice_key: Column, order: list[Column], value: str, out: str) -> DataFrame:
    """``df`` with the running total of ``value`` in the order of (slice_key, order) within ``group``."""
    cut = df.withColumn("_slice", slice_key)
    totals = cut.groupBy(*group, "_slice").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    names = [F.col(f"b.{c}").alias(f"_{c}") for c in group]
    totals = totals.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0))).alias("b").select(
        *names, F.col("b._slice").alias("_at"), "_before")
    within = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = cut.withColumn("_within", F.sum(value).over(within))
    same = F.col("_slice") == F.col("_at")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    drop = ["_slice", "_within", "_at", "_before", *[f"_{c}" for c in group]]
    return summed.join(totals, same).withColumn(out, F.col("_before") + F.col("_within")).drop(*drop)


def mix_sources(docs: DataFrame, weights: list[float], share: float = 1.5, epochs: int = 2, seed: int = 17) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted).

    ``weights`` are dealt to the sources in code point order, again and again.  No document is taken more than
    ``epochs`` times.  The level of the targets and the shuffle are fixed, so reruns agree.
    """
    size = docs.select(F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"))
    sizes = written(size.groupBy("doc_id", "source", "size").agg(F.count("*").alias("_rows")), "mix-sizes")
    weighed = sizes.withColumn("_words", F.col("size") * F.col("_rows"))
    targets = written(source_targets(weighed.select("source", F.col("_words").alias("size")), weights, share, epochs), "mix-targets")
    slices = math.isqrt(max(1, sizes.count()))  # as many slices as rows in each

    # the shuffle: a fixed 31-bit key of id and source
    key = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source")), F.lit(1 << 31))
    queue = (
        weighed.withColumn("_key", key)
        .withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    )
    place = (F.col("_epoch") * F.lit(slices) + F.floor(F.col("_key") * F.lit(slices) / F.lit(1 << 31))).cast("long")
    queued = running_total(queue, ["source"], place, [F.col("_key"), F.col("doc_id"), F.col("size")], "_words", "_sum")
    at = targets.select(F.col("source").alias("_of"), "source_size", "target")
    timed = queued.join(at, F.col("source").eqNullSafe(F.col("_of"))).drop("_of").withColumn(
        "_finish", F.when(F.col("target") > 0, F.col("_sum") / F.col("target")).otherwise(F.lit(0.0)))
    timed = written(timed, "mix-queue")
    # the global order: by finish time, ties by source, epoch and id
    order = [F.col("_finish"), F.col("source").asc_nulls_last(), F.col("_epoch"), F.col("_key"), F.col("doc_id"), F.col("size")]
    served = running_total(timed, [], F.floor(F.col("_finish") * F.lit(slices * epochs)).cast("long"), order, "_words", "_all")
    budget = (targets.agg(F.sum("source_size")).first()[0] or 0) * share
    taken = served.withColumn("_in", F.when(F.col("_all") <= F.lit(budget), F.col("size")).otherwise(F.lit(0)))
    out = taken.groupBy("doc_id", "source", "size", "_rows", "source_size", "target").agg(F.sum("_in").alias("taken"))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int")))).select(
        "doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: list[float], share: float = 1.5, epochs: int = 2, seed: int = 17) -> DataFrame:
    """The rows of the mix with all their columns; a document that is taken twice is there twice."""
    plan = mix_sources(docs, weights, share, epochs, seed).filter("taken > 0").select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_of"), F.col("size").alias("_words"),
        (F.col("taken") / F.col("size")).cast("int").alias("_times")).distinct()
    same = (F.col("d.doc_id").eqNullSafe(F.col("p._id")) & F.col("d.source").eqNullSafe(F.col("p._of"))
            & (word_count(F.col("d.text")) == F.col("p._words")))
    copy = column_name(docs, "_copy")
    return docs.alias("d").join(plan.alias("p"), same).select(
        *[F.col(f"d.`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("p._times"))).alias(copy)).select(*[F.col(f"`{c}`") for c in docs.columns])
