"""WARC replicas and their Merkle fixity audit.

Pages are written as WARC/1.0 resource records, in shards of records ordered by id; a shard
is one compressed file.  An audit reads each replica's files, hashes every record (with its
place and byte range in the uncompressed file), and builds a tree: a node is the hash of the
hashes of ``FANOUT`` nodes in a row, each of which covers an ordered range of offsets, up to one
node a shard, and on over the shards to one root.  Roots are compared first; where they differ,
the audit descends level by level, joining only children of nodes that differ, down to the
records, which are then told apart by their id.

Nulls: a null id is written as ``null`` and lies in shard 0; a null URL or page is empty.
Repeated ids are told apart by their order in the shard.  Line ends in a URL are percent-encoded.
An empty table gives no files, equal roots and an empty result.  Extra columns aren't written.
A shard holds the ids of one remainder, so its size follows the ids; a file is read by one
task, as a stream of its records.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from listmill.llm.shared import partitions, ship, written
from listmill.session import work_dir

FANOUT = 16
RECORDS_PER_FILE = 1024
END = "\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
LEAF = "shard int, place bigint, id string, again bigint, first_byte bigint, n_bytes bigint, digest string"
_LENGTH = re.compile(rb"\r\ncontent-length: *([0-9]+)", re.IGNORECASE)
_ID = re.compile(rb"\r\nwarc-record-id: *<urn:page:([^>]*)>", re.IGNORECASE)


def record_text(page_id: Column, url: Column, html: Column) -> Column:
    """A page as a WARC record, without the line ends behind it."""
    body = F.coalesce(html, F.lit(""))
    uri = F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Date: " + DATE + "\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")),
        F.lit(">\r\nWARC-Target-URI: "), uri, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(END), body)


def shard_count(pages: DataFrame, per_file: int = RECORDS_PER_FILE) -> int:
    return max(1, math.ceil(pages.count() / per_file))


def write_replicas(records: DataFrame, copies: dict[str, Column], path: str) -> None:
    """Write (shard, page_id, record, ...) as one file a shard below ``path/replica=<name>``, in the order of page_id, then record.

    ``copies`` has each replica's record by its name.  Rows are shuffled once; the copies are made behind the shuffle.
    """
    dealt = records.repartition(partitions(records.sparkSession), "shard")
    made = F.explode(F.array(*[F.struct(F.lit(name).alias("replica"), text.alias("record")) for name, text in copies.items()]))
    (dealt.select("shard", "page_id", made.alias("copy")).select("copy.replica", "shard", "page_id", "copy.record")
     .sortWithinPartitions("replica", "shard", "page_id", "record").select("replica", "shard", "record")
     .write.partitionBy("replica", "shard").option("lineSep", END).option("compression", "gzip").text(path))


def page_records(pages: DataFrame, shards: int) -> DataFrame:
    """shard, page_id, record, and whether the page has a body."""
    return pages.select(F.coalesce(F.pmod(F.col("page_id"), F.lit(shards)), F.lit(0)).cast("int").alias("shard"), "page_id",
                        record_text(F.col("page_id"), F.col("url"), F.col("html")).alias("record"), (F.octet_length(F.coalesce("html", F.lit(""))) > 0).alias("full"))


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[str, int, bytes]]:
    """(id, offset, record bytes with the line ends behind it) of all records; a broken header or a cut record ends the file."""
    at = 0
    while True:
        head = bytearray()
        while not head.endswith(END.encode()):
            line = stream.readline()
            if not line:
                break
            head += line
        if not head:
            return
        length, name = _LENGTH.search(head), _ID.search(head)
        body = stream.read(int(length[1]) + len(END)) if length else stream.read()
        yield name[1].decode("utf-8", "replace") if name else "", at, bytes(head) + body
        at += len(head) + len(body)


def record_leaves(spark: SparkSession, path: str) -> DataFrame:
    """The records of a replica: shard, place, id, again (which of several of that id), first_byte, n_bytes, digest."""
    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen: Counter[str] = Counter()
                rows = []
                for place, (name, at, record) in enumerate(parse_records(gzip.open(io.BytesIO(content.as_py())))):
                    rows.append((shard, place, name, seen[name], at, len(record), hashlib.sha256(record).hexdigest()))
                    seen[name] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], LEAF.replace(",", "").split()[::2])

    ship(spark)
    try:
        files = spark.read.format("binaryFile").load(path)
        files = files.select(F.regexp_extract("path", r"shard=(\d+)/", 1).cast("int").alias("shard"), "content")
    except AnalysisException:  # an empty replica has no files
        return spark.createDataFrame([], LEAF)
    return files.mapInArrow(leaves, LEAF)


def upper_level(nodes: DataFrame, group: list[str], fanout: int = FANOUT) -> DataFrame:
    """Nodes (group, place, digest) over ``fanout`` nodes in a row each."""
    rows = nodes.groupBy(*group, F.floor(F.col("place") / fanout).alias("place")).agg(F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("below"))
    return rows.select(*group, "place", F.sha2(F.concat_ws("", F.col("below.digest")), 256).alias("digest"))


class Tree:
    """A replica's levels, each a written table: ``inner`` from records to one node a shard, ``outer`` from shards to the root."""

    def __init__(self, leaves: DataFrame, inner: int | None = None, outer: int | None = None, fanout: int = FANOUT):
        self.inner, self.outer = [written(leaves, "leaves")], []
        most, shards = self.inner[0].agg(F.max("place"), F.max("shard")).first()
        self.depths = (self.depth((most or 0) + 1, fanout), self.depth((shards or 0) + 1, fanout))
        for _ in range(inner if inner is not None else self.depths[0]):
            self.inner.append(written(upper_level(self.inner[-1].select("shard", "place", "digest"), ["shard"], fanout), "nodes"))
        level = self.inner[-1].select(F.col("shard").cast("long").alias("place"), "digest")
        for _ in range(outer if outer is not None else self.depths[1]):
            level = written(upper_level(level, [], fanout), "nodes")
            self.outer.append(level)

    @staticmethod
    def depth(n: int, fanout: int) -> int:
        levels = 1
        while fanout**levels < n:
            levels += 1
        return levels

    def root(self) -> str | None:
        row = self.outer[-1].first()
        return row.digest if row else None


def differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of nodes that are in one of the two alone, or have different hashes."""
    left, right = a.select(*keys, F.col("digest").alias("_a")), b.select(*keys, F.col("digest").alias("_b"))
    return left.join(right, keys, "full").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys)


def below(nodes: DataFrame, parents: DataFrame, keys: list[str], fanout: int) -> DataFrame:
    """The children of ``parents``."""
    up = parents.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = F.floor(F.col("place") / fanout) == F.col("_place")
    for k in keys[:-1]:
        same = same & (F.col(k) == F.col(f"_{k}"))
    return nodes.join(up, same, "left_semi")


def compare_replicas(spark: SparkSession, first: str, second: str, fanout: int = FANOUT) -> DataFrame:
    """The records that differ: shard, id, status (changed, missing, extra), first_byte and n_bytes (in the first, else the second), digest_a, digest_b."""
    leaves = record_leaves(spark, first), record_leaves(spark, second)
    a = Tree(leaves[0], fanout=fanout)
    b = Tree(leaves[1], *a.depths, fanout=fanout)
    if b.depths != a.depths and max(b.depths) > 0:  # of different heights: the taller one sets the shape
        shape = max(a.depths[0], b.depths[0]), max(a.depths[1], b.depths[1])
        a, b = Tree(a.inner[0], *shape, fanout=fanout), Tree(b.inner[0], *shape, fanout=fanout)
    bad = None
    if a.root() != b.root():
        for x, y in zip(a.outer[::-1], b.outer[::-1]):
            bad = written(differing(x, y, ["place"]) if bad is None else differing(below(x, bad, ["place"], fanout), below(y, bad, ["place"], fanout), ["place"]), "bad")
        tops = [t.inner[-1].select(F.col("shard").cast("long").alias("place"), "digest") for t in (a, b)]
        bad = written(differing(*[below(t, bad, ["place"], fanout) for t in tops], ["place"]).select(F.col("place").cast("int").alias("shard"), F.lit(0).cast("long").alias("place")), "bad")
        for x, y in zip(a.inner[-2:0:-1], b.inner[-2:0:-1]):
            bad = written(differing(*[below(t, bad, ["shard", "place"], fanout) for t in (x, y)], ["shard", "place"]), "bad")
    if bad is None:
        bad = spark.createDataFrame([], "shard int, place bigint")
    left, right = (below(t.inner[0], bad, ["shard", "place"], fanout).select("shard", "id", "again", F.struct("first_byte", "n_bytes", "digest").alias(name))
                   for t, name in ((a, "a"), (b, "b")))
    # a lost record shifts those behind it: what has only moved is the same by id
    pairs = left.join(right, ["shard", "id", "again"], "full").filter(~F.col("a.digest").eqNullSafe(F.col("b.digest")))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("changed")
    one = F.coalesce("a", "b")
    return pairs.select("shard", "id", status.alias("status"), one["first_byte"].alias("first_byte"), one["n_bytes"].alias("n_bytes"),
                        F.col("a.digest").alias("digest_a"), F.col("b.digest").alias("digest_b"))


def audit_pages(pages: DataFrame, damage: Column, per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """Write ``pages`` as two replicas, the second with the record's last byte of pages where ``damage`` holds replaced, and audit them."""
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    records = page_records(pages, shard_count(pages, per_file)).withColumn("broken", F.coalesce(damage, F.lit(False)) & F.col("full"))
    text = F.col("record")
    last = F.when(F.right(text, F.lit(1)) == "#", "%").otherwise("#")
    copies = {"a": text, "b": F.when(F.col("broken"), F.concat(F.substring(text, F.lit(1), F.length(text) - 1), last)).otherwise(text)}
    path = work_dir(spark, "warc")
    write_replicas(records, copies, path)
    return compare_replicas(spark, f"{path}/replica=a", f"{path}/replica=b")
