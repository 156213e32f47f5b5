"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches of rising id.  A batch's line keys are hashed (128 bits) and
folded to one row a key, with the smallest id that holds it; the fold combines in the
tasks, so a line that a third of all documents share is no burden.  The folded keys are
anti-joined with all runs written so far, and what is new is written as a sorted run of
level 0, together with its owner.  Runs are tables bucketed and sorted by the hash, so
neither they nor the folded batch are shuffled again to be joined.  ``fanout`` runs of
a level are compacted into one of the next level; there are log(batches) runs.

A line stays if its key is short or owned by its document.  For that the keys that a
document owns are brought together with its text once, in a join on the id.

Nulls: a null or empty text is one empty line; a row with a null id is a document behind
all others, one with other such rows of its text.  Rows with the same id are one document to the owner rule.  Lines are kept with
their bytes unchanged.  An empty table gives an empty result.
Very long texts are split whole, line by line; equal lines of one document are one key.  Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listmill.llm.shared import id_order, partitions, ship, text_column, written

STRIP = b" \t\n\x0b\x0c\r"
MIN_POINTS = 10
KEY = ["h1", "h2"]


def line_key(line: bytes, min_points: int = MIN_POINTS) -> bytes | None:
    """The key of a line: stripped, A-Z lower-cased; None below ``min_points`` code points."""
    key = line.strip(STRIP).lower()  # bytes.lower() changes A-Z alone
    if len(key) < min_points or (len(key) < 4 * min_points and len(key.decode("utf-8", "replace")) < min_points):
        return None
    return key


def key_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def line_keys(docs: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """(h1, h2, doc): the distinct long line keys of every text."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for start in range(0, len(ids), 256):
                h1, h2, doc = [], [], []
                texts = text_column(batch.slice(start, 256)).cast(pa.large_binary())
                for i, text in zip(ids[start:start + 256], texts):
                    found = {k for line in text.as_py().split(b"\n") if (k := line_key(line, min_points))}
                    for k in found:
                        x = key_hash(k)
                        h1.append(int.from_bytes(x[:8], "big", signed=True))
                        h2.append(int.from_bytes(x[8:], "big", signed=True))
                        doc.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(doc, pa.int64())], [*KEY, "doc"])

    ship(docs.sparkSession)
    return docs.select(id_order().alias("doc"), "text").mapInArrow(keys, "h1 bigint, h2 bigint, doc bigint")


class LineRuns:
    """The runs of line hashes: (level, table), each bucketed and sorted by hash, with the owner of every key."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = 4):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or partitions(spark)
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.runs: list[tuple[int, str]] = []
        self.count = 0

    def write_run(self, keys: DataFrame, level: int) -> None:
        name = f"{self.name}_{self.count}"
        self.count += 1
        keys.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        self.runs.append((level, name))

    def add(self, keys: DataFrame) -> None:
        """Fold a batch's (h1, h2, doc), anti-join it with the runs and add what is new as a run; compact full levels.

        The fold leaves the keys dealt by hash as the buckets are, so the run is written without another shuffle.
        """
        fresh = keys.groupBy(*KEY).agg(F.min("doc").alias("doc"))
        for _, run in self.runs:
            fresh = fresh.join(self.spark.table(run).select(*KEY).hint("merge"), KEY, "left_anti")
        self.write_run(fresh, 0)
        self.compact()

    def compact(self) -> None:
        level = 0
        while len(full := [name for at, name in self.runs if at == level]) >= self.fanout:
            self.runs = [(at, name) for at, name in self.runs if at != level]
            self.write_run(self.union(full).repartition(self.buckets, *KEY), level + 1)
            self.drop(full)
            level += 1

    def union(self, names: list[str]) -> DataFrame:
        out = self.spark.table(names[0])
        for name in names[1:]:
            out = out.unionByName(self.spark.table(name))
        return out

    def owners(self) -> DataFrame:
        """(h1, h2, doc) of every key of all runs."""
        return self.union([name for _, name in self.runs])

    def drop(self, names: list[str] | None = None) -> None:
        """Drop runs and their files; all of them if none are named."""
        for name in names if names is not None else [name for _, name in self.runs]:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def owned_keys(owners: DataFrame) -> DataFrame:
    """(doc, own): the keys that each document owns; no more than it has lines."""
    return owners.groupBy("doc").agg(F.collect_list(F.struct(*KEY)).alias("own"))


def drop_seen_lines(docs: DataFrame, owned: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256, kept_text: every text with the lines that it owns, and the short ones."""
    joined = docs.select("doc_id", "text", id_order().alias("doc")).join(owned, "doc", "left").select("doc_id", "text", "own")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                own = part.column(2)
                pairs = np.stack([own.values.field(k).to_numpy() for k in (0, 1)], axis=1).astype(">i8").tobytes()
                where = own.offsets.to_pylist()
                n_lines, n_dropped, digests, bodies = [], [], [], []
                for text, a, b in zip(text_column(part).cast(pa.large_binary()), where, where[1:]):
                    mine = {pairs[16 * i:16 * i + 16] for i in range(a, b)}
                    lines = text.as_py().split(b"\n")
                    kept = [x for x in lines if (k := line_key(x, min_points)) is None or key_hash(k) in mine]
                    body = b"\n".join(kept)
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(kept))
                    digests.append(hashlib.sha256(body).hexdigest())
                    bodies.append(body.decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digests, pa.string()), pa.array(bodies, pa.string())],
                    ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text"])

    ship(docs.sparkSession)
    return joined.mapInArrow(rebuild, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string, kept_text string")


def dedup_lines(docs: DataFrame, batches: int = 4, fanout: int = 2, min_points: int = MIN_POINTS) -> DataFrame:
    """``docs`` in ``batches`` of rising id through the runs; see :func:`drop_seen_lines` for the result."""
    spark = docs.sparkSession
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    runs = LineRuns(spark, fanout=fanout)
    cuts = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], F.lit(10_000))).first()[0] if batches > 1 else None
    edges = [None, *sorted(set(cuts or [])), None]
    for low, high in zip(edges, edges[1:]):
        part = docs if low is None else docs.filter((F.col("doc_id") > low) | F.col("doc_id").isNull())
        runs.add(line_keys(part if high is None else part.filter(F.col("doc_id") <= high), min_points))  # no id: in the last batch
    owned = written(owned_keys(runs.owners()), "owned-lines")
    runs.drop()
    return drop_seen_lines(docs, owned, min_points)
