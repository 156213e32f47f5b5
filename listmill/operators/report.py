"""Counts, run outcomes, failure panels and preview lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listmill.functions.text import nonempty


def status_counts(df: DataFrame) -> DataFrame:
    """Approved and visible listings."""
    return df.agg(F.count_if(F.col("status") == "saved").alias("approved"),
                  F.count_if(F.col("status") != "deleted").alias("visible"))


def failures(*frames: DataFrame) -> DataFrame:
    """Failures of all sources as one table of url and error; a run's list is rows, never one cell."""
    out = frames[0].select("url", "error")
    for df in frames[1:]:
        out = out.unionByName(df.select("url", "error"))
    return out


def failure_counts(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("failed"))


def outcome_columns(got: Column, failed: Column, target: Column) -> dict[str, Column]:
    """Error and message of a run that collected ``got`` of ``target`` with ``failed`` failures."""
    zero, short = got == 0, got < target
    error = (
        F.when(zero & (failed > 0), F.format_string(
            "Search failed — no contract jobs collected (%d source error(s)).", failed))
        .when(zero, "No matching contract jobs found. Try different keywords or board URLs.")
        .when(short, F.format_string(
            "Only found %d of %d requested. Sources exhausted — try more boards, broader keywords, or Both mode.",
            got, target))
        .when(failed > 0, F.format_string("Finished with %d source warning(s).", failed))
    )
    done = F.format_string("Done. Collected %d / %d matching contract jobs.", got, target)
    return {"zero": zero, "short": short, "error": error, "message": F.when(zero | short, error).otherwise(done)}


def run_outcome(runs: DataFrame, rows: DataFrame, failed: DataFrame, by: str = "run_id") -> DataFrame:
    """One row for each of ``runs`` (run_id, target): collected, failed, error text and message.

    A run that collected nothing and failed nowhere has an outcome too.
    """
    got = rows.groupBy(by).agg(F.count("*").alias("collected"))
    bad = failed.groupBy(by).agg(F.count("*").alias("failed"))
    counts = runs.select(by, "target").join(got, by, "left").join(bad, by, "left").select(
        by, F.coalesce("collected", F.lit(0)).alias("collected"), F.coalesce("failed", F.lit(0)).alias("failed"),
        F.col("target").cast("bigint").alias("target"))
    return counts.select("*", *[v.alias(k) for k, v in outcome_columns(
        F.col("collected"), F.col("failed"), F.col("target")).items()])


def failure_panel(runs: DataFrame) -> DataFrame:
    """Title, detail and visibility of the failure panel per run.

    ``runs`` has request_error, error, message, collected, failed, finished, running.
    """
    request, error = nonempty(F.col("request_error")), nonempty(F.col("error"))
    empty = F.col("finished") & ~F.col("running") & (F.coalesce("collected", F.lit(0)) == 0)
    title = (F.when(request.isNotNull(), "Request failed").when(error.isNotNull(), "Collection failed")
             .when(empty, "No contract jobs found").otherwise("Some sources failed"))
    detail = F.coalesce(request, error, nonempty(F.col("message")), F.lit("Nothing matched as contract roles."))
    shown = request.isNotNull() | error.isNotNull() | empty | (F.col("failed") > 0)
    return runs.select("*", shown.alias("shown"), F.when(shown, title).alias("title"),
                       F.when(shown, detail).alias("detail"))


def progress_pct(collected: Column, target: Column) -> Column:
    """Share of the target reached, 0 to 100; 0 without a target."""
    return F.when(F.coalesce(target, F.lit(0)) == 0, F.lit(0.0)).otherwise(
        F.least(F.lit(100.0), 100.0 * F.coalesce(collected, F.lit(0)) / target))


def preview_line() -> Column:
    """Company, domain, task, pay, hours, mode and location, where they are set."""
    pay = F.coalesce(nonempty(F.col("pay_rate")), nonempty(F.col("salary")))
    parts = [nonempty(F.col("company")), nonempty(F.col("domain")), nonempty(F.col("task_type")), pay,
             nonempty(F.col("hours_per_week")), nonempty(F.col("work_mode")), nonempty(F.col("location"))]
    return F.concat_ws(" · ", *parts)
