"""The listing table in key buckets, with runs of changes in front of it.

Rows lie in buckets by the hash of their merge key (URL key, or id without URL); an index, in buckets of its own,
says in which bucket an id lies.  Changes arrive as runs and are merged when the table is read:

    upsert   a folded batch of listings                 review   folded reviewer actions
    delete   ids whose status becomes deleted           drop     tombstones of ids
    clear    a tombstone of everything that isn't saved

A run is as large as its batch, whatever the size of the table.  ``compact`` folds runs of one level into one of
the next, so a row is rewritten once a level.  ``settle`` merges the runs into the rows: it reads and writes the buckets that
they touch and no others; all other buckets keep their files.

A manifest lists the folders that make up a version: one row a bucket and run.  A version counts once the manifest's
``_SUCCESS`` file is there; that is the switch.  A change that started from a version that is no longer the newest is
refused.  Named changes (a stream and its batch number) are applied once.  ``vacuum`` drops versions that no reader holds.

All jobs write new folders and none changes a written one, so a lost executor or driver leaves the newest version as it was.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listmill import vocab as V
from listmill.operators import merge
from listmill.session import cut_lineage

BUCKETS = 64
_KINDS = ("upsert", "review", "delete", "drop", "clear")
FAN = 4  # runs of a level that are folded into one of the next

_MANIFEST = "kind string, bucket int, seq bigint, level int, rows bigint, path string"


class Entry(NamedTuple):
    """A line of a manifest: rows or ids of a bucket, a run, the number of buckets, or the last change of a name."""

    kind: str
    bucket: int | None
    seq: int
    level: int
    rows: int
    path: str


class Conflict(RuntimeError):
    """Another change was made meanwhile; read the table and make the change again."""


class ListingTable:
    """The table in ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, fan: int = FAN):
        self.spark, self.path, self.fan = spark, path.rstrip("/"), fan
        self.buckets = next((e.seq for e in self.entries() if e.kind == "buckets"), buckets)

    # -- files and versions ----------------------------------------------------------

    def _fs(self):
        jvm = self.spark._jvm
        return jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _names(self, *parts: str) -> list[str]:
        fs, root = self._fs(), self._at(*parts)
        return sorted(s.getPath().getName() for s in fs.listStatus(root)) if fs.exists(root) else []

    def versions(self) -> list[int]:
        """The complete versions."""
        fs = self._fs()
        return [int(n[2:]) for n in self._names("manifests") if n.startswith("m=") and fs.exists(self._at("manifests", n, "_SUCCESS"))]

    def version(self) -> int:
        return max(self.versions(), default=0)

    def entries(self, version: int | None = None) -> list[Entry]:
        """The manifest of a version: a row a bucket, run and name."""
        version = self.version() if version is None else version
        if not version:
            return []
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifests/m={version:010d}").collect()
        return sorted((Entry(*r) for r in rows), key=lambda e: (e.kind, e.seq, e.bucket or 0, e.path))

    def _commit(self, entries: Sequence[Entry], base: int) -> int:
        """Make ``entries`` the newest version."""
        if self.version() != base:
            raise Conflict(f"The table changed from version {base} to {self.version()}")
        number = 1 + max([base, *(int(n[2:]) for n in self._names("manifests") if n.startswith("m="))])
        named = [e for e in entries if e.kind != "buckets"] + [Entry("buckets", None, self.buckets, 0, 0, "")]
        self.spark.createDataFrame(named, _MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifests/m={number:010d}")
        return number

    def _folder(self, base: int, kind: str) -> str:
        return f"data/v={base + 1:010d}-{kind}-{uuid.uuid4().hex[:12]}"

    # -- buckets ---------------------------------------------------------------------

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _write_buckets(self, df: DataFrame, base: int, kind: str, order: Sequence[str]) -> list[Entry]:
        """Write rows with ``bucket`` into a folder for each bucket."""
        folder = self._folder(base, kind)
        df.repartition("bucket").sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        if not any(n.startswith("bucket=") for n in self._names(folder)):
            return []
        counts = self.spark.read.parquet(f"{self.path}/{folder}").groupBy("bucket").count().collect()  # a row a bucket
        return [Entry(kind, r["bucket"], 0, 0, r["count"], f"{folder}/bucket={r['bucket']}") for r in counts]

    def _read_buckets(self, entries: Sequence[Entry], kind: str, schema: str, buckets: set[int] | None = None) -> DataFrame:
        """Rows of a kind with their ``bucket``; only the folders of the wanted buckets are read."""
        paths = [e.path for e in entries if e.kind == kind and (buckets is None or e.bucket in buckets)]
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, bucket int")
        folders: dict[str, list[str]] = {}
        for p in paths:
            folders.setdefault(p.rpartition("/")[0], []).append(p)
        parts = [self.spark.read.schema(f"{schema}, bucket int").option("basePath", f"{self.path}/{f}").parquet(*[f"{self.path}/{p}" for p in own])
                 for f, own in folders.items()]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _base_rows(self, entries: Sequence[Entry], buckets: set[int] | None = None) -> DataFrame:
        return self._read_buckets(entries, "rows", ", ".join(f"{c} string" for c in V.LISTING_FIELDS), buckets)

    def _of_ids(self, entries: Sequence[Entry], ids: DataFrame) -> set[int]:
        """The buckets in which the ids lie: only their buckets of the index are read."""
        wanted = {r.b for r in ids.select(self.bucket(F.col("id")).alias("b")).distinct().collect()}  # a row a bucket
        index = self._read_buckets(entries, "ids", "id string, row_bucket int", wanted)
        return {r.row_bucket for r in index.join(ids.select("id"), "id", "left_semi").select("row_bucket").distinct().collect()}

    # -- runs ------------------------------------------------------------------------

    def _read_run(self, run: Entry) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/{run.path}")
        return rows.withColumn("_seq", F.lit(run.seq).cast("bigint"))

    def _runs(self, entries: Sequence[Entry]) -> list[Entry]:
        return sorted((e for e in entries if e.kind in _KINDS), key=lambda e: e.seq)

    def _folded(self, runs: Sequence[Entry]) -> DataFrame:
        """Neighbouring runs of one kind as one."""
        out = self._read_run(runs[0])
        for run in runs[1:]:
            out = out.unionByName(self._read_run(run), allowMissingColumns=True)
        if runs[0].kind == "upsert":
            return out.drop("_seq") if len(runs) == 1 else merge.fold_runs(out)
        if runs[0].kind == "review":
            return out.drop("_seq") if len(runs) == 1 else merge.fold_patches(out)
        if runs[0].kind == "delete":
            return out.groupBy("id").agg(F.max_by("_now", "_seq").alias("_now"))
        return out.select("id").distinct()

    def _applied(self, rows: DataFrame, runs: Sequence[Entry]) -> DataFrame:
        """The listings after the runs, one kind after the other."""
        at = 0
        rows = rows.select(*V.LISTING_FIELDS)
        while at < len(runs):
            end = at + 1
            while end < len(runs) and runs[end].kind == runs[at].kind:
                end += 1
            kind, own = runs[at].kind, runs[at:end]
            if kind == "upsert":
                rows = merge.upsert_folded(rows, self._folded(own))
            elif kind == "review":
                rows = merge.apply_reviews(rows, self._folded(own))
            elif kind == "delete":
                hit = cut_lineage(self._folded(own), "deleted")
                rows = rows.join(hit, "id", "left").withColumns({
                    "status": F.when(F.col("_now").isNotNull(), "deleted").otherwise(F.col("status")), "updated_at": F.coalesce("_now", "updated_at")})
            elif kind == "drop":
                rows = rows.join(self._folded(own), "id", "left_anti")
            else:
                rows = merge.clear_queue(rows)
            rows = rows.select(*V.LISTING_FIELDS)
            at = end
        return rows

    def _append(self, kind: str, run: DataFrame | None, name: str, number: int) -> int:
        """Add a run; a change that was made before, by its name and number, is not made again."""
        base = self.version()
        entries = self.entries(base)
        last = next((e.seq for e in entries if e.kind == "name" and e.path == name), -1)
        if name and number <= last:
            return base
        path, rows = "", 0
        if run is not None:
            path = self._folder(base, kind)
            run.write.parquet(f"{self.path}/{path}")
            rows = self.spark.read.schema(run.schema).parquet(f"{self.path}/{path}").count()
        seq = 1 + max((e.seq for e in entries if e.kind in (*_KINDS, "settled")), default=0)
        kept = [e for e in entries if not (e.kind == "name" and e.path == name)]
        more = [Entry("name", None, number, 0, 0, name)] if name else []
        return self._commit([*kept, *more, Entry(kind, None, seq, 0, rows, path)], base)

    # -- reading and changing ----------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        """The listings of a version, the newest one by default."""
        entries = self.entries(version)
        return self._applied(self._base_rows(entries), self._runs(entries))

    def load(self, listings: DataFrame) -> int:
        """Make ``listings`` the whole table."""
        base = self.version()
        rows = listings.select(*V.LISTING_FIELDS).withColumn("bucket", self.bucket(merge.merge_key()))
        written = self._write_buckets(rows, base, "rows", ["status", "id"])
        names = [e for e in self.entries(base) if e.kind == "name"]
        ids = self._base_rows(written).select("id", F.col("bucket").alias("row_bucket")).withColumn("bucket", self.bucket(F.col("id")))
        return self._commit([*names, *written, *self._write_buckets(ids, base, "ids", ["id"])], base)

    def upsert(self, batch: DataFrame, now: Column, order: str = "seq", name: str = "", number: int = 0) -> int:
        """Add a batch of listings."""
        run = merge.fold_batch(batch, order).withColumns({
            "_now": now.cast("string"), "_runs": F.lit(1).cast("bigint"), "_frozen": F.when(F.col("status").isin(V.FROZEN_STATUSES), F.struct(*V.LISTING_FIELDS))})
        return self._append("upsert", run.withColumn("bucket", self.bucket(F.col("_key"))), name, number)

    def review(self, folded: DataFrame, name: str = "", number: int = 0) -> int:
        """Add the result of ``fold_actions``."""
        return self._append("review", folded, name, number)

    def delete(self, ids: DataFrame, now: str, name: str = "", number: int = 0) -> int:
        """Set the status of the ids to deleted at the time ``now``."""
        return self._append("delete", ids.select("id").distinct().withColumn("_now", F.lit(now)), name, number)

    def drop(self, ids: DataFrame, name: str = "", number: int = 0) -> int:
        """Add tombstones: the listings of the ids are no longer in the table."""
        return self._append("drop", ids.select("id").distinct(), name, number)

    def clear(self, name: str = "", number: int = 0) -> int:
        """Keep saved listings only."""
        return self._append("clear", None, name, number)

    def compact(self) -> int:
        """Fold runs of one kind and level that follow each other into one of the next level, ``fan`` at a time."""
        base = self.version()
        entries = self.entries(base)
        runs = self._runs(entries)
        for at in range(len(runs) - self.fan + 1):
            own = runs[at:at + self.fan]
            if len({(r.kind, r.level) for r in own}) > 1 or own[0].kind == "clear":
                continue
            path = self._folder(base, own[0].kind)
            folded = self._folded(own)
            if own[0].kind == "upsert":
                folded = folded.withColumn("bucket", self.bucket(F.col("_key")))
            folded.write.parquet(f"{self.path}/{path}")
            rows = self.spark.read.schema(folded.schema).parquet(f"{self.path}/{path}").count()
            one = Entry(own[0].kind, None, own[-1].seq, own[0].level + 1, rows, path)
            self._commit([e for e in entries if e not in own] + [one], base)
            return self.compact()  # at most log(runs) deep
        return base

    def settle(self) -> int:
        """Merge all runs into the buckets that they touch; the others keep their files."""
        base = self.version()
        entries = self.entries(base)
        runs = self._runs(entries)
        if not runs:
            return base
        touched: set[int] = set()
        for run in runs:
            if run.kind == "clear":
                touched |= {e.bucket for e in entries if e.kind == "rows"}
            elif run.kind == "upsert":
                touched |= {r.bucket for r in self._read_run(run).select("bucket").distinct().collect()}  # a row a bucket
            else:
                touched |= self._of_ids(entries, self._read_run(run))
        before = self._base_rows(entries, touched)
        after = self._applied(before, runs).withColumn("bucket", self.bucket(merge.merge_key()))
        written = self._write_buckets(after, base, "rows", ["status", "id"])
        # A patched URL may have moved a listing into a bucket that isn't rewritten: it is then added to that one.
        rows = [e for e in entries if e.kind == "rows" and e.bucket not in touched] + written
        index = self._moved(entries, before, self._base_rows(written), base)
        rest = [e for e in entries if e.kind == "name"]
        return self._commit([*rest, *rows, *index, Entry("settled", None, runs[-1].seq, 0, 0, "")], base)

    def settle_at(self, share: float) -> int:
        """Settle once the runs hold more than a share of the table's rows, so that reading stays about as costly as the table."""
        entries = self.entries()
        held = sum(e.rows for e in self._runs(entries))
        return self.settle() if held > share * sum(e.rows for e in entries if e.kind == "rows") else self.version()

    def _moved(self, entries: Sequence[Entry], before: DataFrame, after: DataFrame, base: int) -> list[Entry]:
        """The index after rows were rewritten: only buckets with an id that is new, gone or moved are written."""
        old, new = (df.select("id", F.col("bucket").alias("row_bucket")) for df in (before, after))
        gone, come = old.exceptAll(new), new.exceptAll(old)
        changed = cut_lineage(gone.withColumn("come", F.lit(False)).unionByName(come.withColumn("come", F.lit(True))), "moved-ids")
        touched = {r.b for r in changed.select(self.bucket(F.col("id")).alias("b")).distinct().collect()}  # a row a bucket
        kept = self._read_buckets(entries, "ids", "id string, row_bucket int", touched).select("id", "row_bucket").join(changed.select("id"), "id", "left_anti")
        index = kept.unionByName(changed.where("come").select("id", "row_bucket")).withColumn("bucket", self.bucket(F.col("id")))
        written = self._write_buckets(index, base, "ids", ["id"]) if touched else []
        return [e for e in entries if e.kind == "ids" and e.bucket not in touched] + written

    def lookup(self, ids: DataFrame) -> DataFrame:
        """Listings by id, deleted ones hidden; of a settled table only the buckets that hold them are read."""
        entries = self.entries()
        runs = self._runs(entries)
        rows = self._applied(self._base_rows(entries), runs) if runs else self._base_rows(entries, self._of_ids(entries, ids)).select(*V.LISTING_FIELDS)
        return merge.lookup(rows, ids)

    # -- readers and old versions --------------------------------------------------------

    @contextmanager
    def pinned(self, version: int | None = None) -> Iterator[int]:
        """Hold a version while it is read: ``vacuum`` leaves it alone."""
        version = self.version() if version is None else version
        pin = self._at("pins", f"{version:010d}-{int(time.time())}-{uuid.uuid4().hex}")
        fs = self._fs()
        fs.create(pin).close()
        try:
            yield version
        finally:
            fs.delete(pin, False)

    def vacuum(self, keep: int = 2, pin_seconds: int = 86_400) -> list[str]:
        """Drop all but the newest ``keep`` versions and those that are pinned, and the folders that only they need.

        A pin older than ``pin_seconds`` was left by a reader that died.  Returns the folders dropped.
        """
        fs, now = self._fs(), time.time()
        pins = [n.split("-") for n in self._names("pins")]
        held = {int(p[0]) for p in pins if now - int(p[1]) <= pin_seconds}
        versions = self.versions()
        kept = set(versions[-keep:]) | (held & set(versions))
        if not kept:
            return []
        needed = {e.path.split("/bucket=")[0] for v in kept for e in self.entries(v) if e.path}
        gone = [f"manifests/m={v:010d}" for v in versions if v not in kept]
        newest = versions[-1]
        # Folders of a change that is still being made bear a later number than any version.
        gone += [f"data/{n}" for n in self._names("data") if f"data/{n}" not in needed and int(n[2:12]) <= newest]
        for name in gone:
            fs.delete(self._at(name), True)
        return gone

