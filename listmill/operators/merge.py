"""Merging batches and reviewer actions into the listing table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listmill import vocab as V
from listmill.functions.text import nonempty
from listmill.functions.urls import url_key
from listmill.session import cut_lineage

_FIRST_KEPT = [c for c in V.LISTING_FIELDS if c not in V.REFRESHED_FIELDS]


def merge_key() -> Column:
    """URL key, or the id where there is no URL."""
    return F.coalesce(nonempty(url_key(F.col("url"))), F.col("id"))


def fold_batch(batch: DataFrame, order: str = "seq") -> DataFrame:
    """One row per key: per field the last non-empty value; id, url, notes and dates of the first row.

    The aggregates combine before the shuffle, so many versions of one key
    leave each task as one row.
    """
    refreshed = [
        F.coalesce(F.expr(f"max_by({c}, {order}) FILTER (WHERE {c} <> '')"), F.lit("")).alias(c)
        for c in V.REFRESHED_FIELDS]
    kept = [F.expr(f"min_by({c}, {order})").alias(c) for c in _FIRST_KEPT]
    return batch.withColumn("_key", merge_key()).groupBy("_key").agg(*refreshed, *kept)


def upsert_listings(state: DataFrame, batch: DataFrame, now: Column, order: str = "seq") -> DataFrame:
    """Merge a batch into the snapshot.

    Saved and deleted listings never change.  Unreviewed ones take the batch's
    non-empty values field by field.  New keys are added.

    The folded batch is written first, so its size is known: a small batch is
    broadcast and the snapshot, with its long texts, is not shuffled at all.
    """
    return upsert_folded(state, cut_lineage(fold_batch(batch, order).withColumn("_now", now), "batch"))


def upsert_folded(state: DataFrame, new: DataFrame) -> DataFrame:
    """Merge rows of ``fold_batch`` or ``fold_runs``, with the time of the change in ``_now``, into the snapshot."""
    old = state.select(*V.LISTING_FIELDS)
    # Which listing each key refreshes: the newest, where an edited URL made two listings share a key.
    keys = old.select(merge_key().alias("_key"), "id", "created_at").join(new.select("_key"), "_key")
    hits = cut_lineage(keys.groupBy("_key").agg(
        F.max_by("id", F.struct("created_at", "id")).alias("_id")), "hits")
    changes = cut_lineage(new.join(hits, "_key"), "changes")
    refreshed = {c: F.col(c).alias(f"_{c}") for c in V.REFRESHED_FIELDS}
    joined = old.join(changes.select(F.col("_id").alias("id"), "_now", *refreshed.values()), "id", "left")
    refresh = F.col("_title").isNotNull() & ~F.col("status").isin(V.FROZEN_STATUSES)

    def field(c: str) -> Column:
        if c == "updated_at":
            return F.when(refresh, F.col("_now")).otherwise(F.col(c))
        if c in V.REFRESHED_FIELDS:
            return F.when(refresh & (F.col(f"_{c}") != ""), F.col(f"_{c}")).otherwise(F.col(c))
        return F.col(c)

    added = new.join(hits, "_key", "left_anti")
    if "_runs" in new.columns:
        added = added.select(*[_inserted(c).alias(c) for c in V.LISTING_FIELDS])
    return joined.select(*[field(c).alias(c) for c in V.LISTING_FIELDS]).unionByName(added.select(*V.LISTING_FIELDS))


def _inserted(c: str) -> Column:
    """A field of a listing that several runs add and refresh: from its second run on it is a refresh, unless the first one froze it."""
    value = F.when(F.col("_runs") > 1, F.col("_now")).otherwise(F.col(c)) if c == "updated_at" else F.col(c)
    return F.when(F.col("_frozen").isNotNull(), F.col(f"_frozen.{c}")).otherwise(value)


def fold_runs(runs: DataFrame) -> DataFrame:
    """Several folded batches as one: the rows of ``fold_batch`` with ``_seq`` (the batch's place), ``_now``, ``_runs`` and ``_frozen``.

    One row per key, as merging them one after the other gives: per field the last non-empty value, the
    other fields of the first.  If the key is new and its first batch brings it in a frozen status, later batches don't
    change it: ``_frozen`` keeps that first row.  Batches folded before may be folded again.
    """
    refreshed = [F.coalesce(F.expr(f"max_by({c}, _seq) FILTER (WHERE {c} <> '')"), F.lit("")).alias(c) for c in V.REFRESHED_FIELDS]
    kept = [F.expr(f"min_by({c}, _seq)").alias(c) for c in _FIRST_KEPT]
    own = F.coalesce("_frozen", F.when(F.col("status").isin(V.FROZEN_STATUSES), F.struct(*V.LISTING_FIELDS)))
    return runs.withColumn("_own", own).groupBy("_key").agg(
        *refreshed, *kept, F.max_by("_now", "_seq").alias("_now"), F.sum("_runs").alias("_runs"), F.min_by("_own", "_seq").alias("_frozen"))


# -- reviews ------------------------------------------------------------------

def fold_actions(actions: DataFrame, patch_fields: list[str]) -> DataFrame:
    """The net effect of all actions per listing id, in (ts, event_id) order.

    ``actions`` has id, ts, event_id, action (save, patch, delete; others change
    nothing) and nullable patch columns; null means "not set".  An action with a
    status that there isn't changes nothing; see ``bad_reviews``.  Aggregates
    combine before the shuffle, so one listing may hold any share of the rows.
    """
    if "status" in patch_fields:
        actions = actions.where(F.col("status").isNull() | F.col("status").isin(V.STATUSES))
    at = F.struct("ts", "event_id")
    given = F.col("status") if "status" in patch_fields else F.lit(None).cast("string")
    status = F.when(F.col("action") == "delete", "deleted").when(F.col("action") == "save", "saved").otherwise(
        F.coalesce(given, F.lit("saved")))
    steps = actions.where(F.col("action").isin("save", "patch", "delete")).withColumns({
        "_at": at, "_status": status, "_edit": F.col("action") != "delete"})
    fields = [c for c in patch_fields if c != "status"]
    return steps.groupBy("id").agg(
        F.max_by("_status", "_at").alias("_status"),
        F.max("ts").alias("_ts"),
        *[F.expr(f"max_by({c}, _at) FILTER (WHERE _edit AND {c} IS NOT NULL)").alias(f"_{c}") for c in fields])


def fold_patches(runs: DataFrame) -> DataFrame:
    """Several results of ``fold_actions``, with their place in ``_seq``, as one: per field the last value that is set."""
    fields = [c for c in runs.columns if c not in ("id", "_seq")]
    return runs.groupBy("id").agg(*[F.expr(f"max_by({c}, _seq) FILTER (WHERE {c} IS NOT NULL)").alias(c) for c in fields])


def bad_reviews(actions: DataFrame) -> DataFrame:
    """A failure row per listing id and unknown status of its actions."""
    return actions.where(~F.col("status").isin(V.STATUSES)).select(
        F.col("id").alias("url"), F.concat(F.lit("Unknown status: "), "status").alias("error")).distinct()


def apply_reviews(state: DataFrame, folded: DataFrame) -> DataFrame:
    """Listings after the folded actions; ``updated_at`` is the time of the last one.

    The actions are written first, so that their size decides how they join.
    """
    folded = cut_lineage(folded, "actions")
    names = [c[1:] for c in folded.columns if c not in ("id", "_status", "_ts")]
    stamp = F.date_format("_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    joined = state.join(folded, "id", "left")
    changes = {c: F.coalesce(f"_{c}", c) for c in names}
    changes["status"] = F.coalesce("_status", "status")
    changes["updated_at"] = F.coalesce(stamp, "updated_at")
    return joined.select(*[changes.get(c, F.col(c)).alias(c) for c in state.columns])


def unknown_reviews(state: DataFrame, folded: DataFrame) -> DataFrame:
    """A failure row per reviewed id that is not in the listing table."""
    return folded.join(state.select("id"), "id", "left_anti").select(
        F.col("id").alias("url"), F.lit("Job not found").alias("error"))


def mark_deleted(state: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Set the status of the given ids to deleted."""
    hit = cut_lineage(ids.select("id", F.lit(True).alias("_hit")).distinct(), "deleted")
    out = state.join(hit, "id", "left")
    return out.withColumns({
        "status": F.when(F.col("_hit"), "deleted").otherwise(F.col("status")),
        "updated_at": F.when(F.col("_hit"), now).otherwise(F.col("updated_at")),
    }).select(*state.columns)


def lookup(df: DataFrame, ids: DataFrame | list[str]) -> DataFrame:
    """Listings by id; deleted ones are hidden."""
    shown = df.where(F.col("status") != "deleted")
    if isinstance(ids, list):
        return shown.where(F.col("id").isin(ids))
    return shown.join(ids.select("id"), "id", "left_semi")


def clear_queue(df: DataFrame) -> DataFrame:
    """What a new run or a reset keeps: the saved listings."""
    return df.where(F.col("status") == "saved")
