"""Near-duplicate documents by HyperMinHash.

A document is its set of word shingles.  Each of its buckets holds the smallest hash
that falls into it, stored as 16 bits: 6 for the count of leading zeros and 10 of the
mantissa.  An empty bucket borrows from a fixed list of other buckets, so short texts
have full sketches too.  Bands of compressed registers give candidates; a Jaccard
estimate from all registers, corrected for registers that agree by accident, drops
most false ones; the rest is confirmed on the full shingle sets.  Sets of fewer than
``SHORT`` shingles fill few buckets of their own, so one shingle may be lent to many:
they are not estimated, but confirmed whenever their sizes allow it.  Above, the
margins are wider the fewer buckets a set fills.

The number of registers in a band is the largest at which a pair at the threshold shares
no band with a probability of at most ``MISS``.

Groups.  Documents with equal sets are one node from the start, so copies cost nothing.
In each band's group all members are held against one hub, the smallest id; groups are
never expanded into pairs.  Linked members are one component and need no more pairs.
Members of a group that are in another component than the hub are then held against
all others of the group that are in another component, in blocks of bounded size.  They bring their full sets along,
so what passes the estimate is confirmed on the spot, and a block gives out the links that join
components only.  So no pair that shares a band is left out, and rows grow with the members and not with their pairs.
Hubs are split by the number of their members; confirming streams sorted rows and holds one
hub's set at a time.

Only documents that share a band are read again: their registers and texts are taken
out once and serve all later steps.  Joins of tables that grow with the documents are
merge joins at every size.

Nulls: a null, empty or white-space text has no shingles, is linked with nothing and kept.
A row with a null id is a document behind all others, one with other such rows of its text, and
gives a null component unless it is linked to a real id.  Rows with the same id are one document.  Repeated rows are all
returned with the same result.  Very long texts are sets of all their shingles; a pair at exactly the threshold is linked.  An
empty table gives an empty result.  Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listmill.llm.components import components
from listmill.llm.shared import NO_ID, column_name, id_order, partitions, ship, text_chunks, text_column, written
from listmill.llm.words import LOWER, mix, shingle_hashes, word_hashes

REGISTERS = 320
MISS = 1e-5
MARGIN = 0.15  # of the estimate below the threshold: over 7 standard deviations of 320 registers
LEFT_OVER_MARGIN = 0.09  # the same for pairs between a group's components: over 4 of them
ZERO_BITS, MANTISSA_BITS = 6, 10
BORROWS = 48
SHORT = 50  # shingles below which there is no estimate
_EMPTY = np.uint64(2**64 - 1)
_DOC_BITS = 12  # texts in a chunk, in the upper bits of sort keys
_LENDERS = (mix(np.arange(REGISTERS * BORROWS, dtype=np.uint64)) % np.uint64(REGISTERS)).astype(np.int64).reshape(BORROWS, REGISTERS)


def band_rows(similarity: float, registers: int = REGISTERS, miss: float = MISS) -> int:
    """Registers in a band."""
    fits = [r for r in range(1, 17) if (1 - similarity**r) ** (registers // r) <= miss]
    return max(fits, default=1)


def distinct_shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (52 bits, sorted) of each text, and the offsets of the texts in them."""
    words, first = word_hashes(LOWER[data], offsets)
    shingles, begin = shingle_hashes(words, first, k)
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(begin))
    key = np.sort((owner << np.uint64(64 - _DOC_BITS)) | (shingles >> np.uint64(_DOC_BITS)))
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    where = np.searchsorted(key, np.arange(len(offsets), dtype=np.uint64) << np.uint64(64 - _DOC_BITS))
    return key & np.uint64((1 << (64 - _DOC_BITS)) - 1), where


def compress(smallest: np.ndarray) -> np.ndarray:
    """Registers of 64-bit minima: leading zeros, then the bits behind the first one."""
    zeros = np.zeros(smallest.shape, np.uint64)
    rest = smallest.copy()
    for step in (32, 16, 8, 4, 2, 1):
        small = rest < (np.uint64(1) << np.uint64(64 - step))
        zeros += np.where(small, np.uint64(step), np.uint64(0))
        rest = np.where(small, rest << np.uint64(step), rest)
    mantissa = (rest << np.uint64(1)) >> np.uint64(64 - MANTISSA_BITS)
    return ((zeros << np.uint64(MANTISSA_BITS)) | mantissa).astype(np.uint16)


def sketches(shingles: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The registers of each text that has shingles, one row each."""
    n = len(where) - 1
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(where))
    h = mix(shingles + np.uint64(0x632BE59BD9B4E019))
    bucket = ((h >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
    value = mix(h ^ np.uint64(0xD6E8FEB86659FD93))
    smallest = np.full(n * REGISTERS, _EMPTY)
    np.minimum.at(smallest, owner * REGISTERS + bucket.astype(np.int64), value)
    smallest = smallest.reshape(n, REGISTERS)
    full = smallest.copy()
    for lender in _LENDERS:
        rows = np.flatnonzero((full == _EMPTY).any(axis=1))
        if not len(rows):
            break
        part = full[rows]
        full[rows] = np.where(part == _EMPTY, smallest[rows][:, lender], part)
    rows = np.flatnonzero((full == _EMPTY).any(axis=1) & (smallest != _EMPTY).any(axis=1))
    if len(rows):  # what no lender could fill is taken from the next bucket that has a value
        twice = np.tile(smallest[rows], 2)
        at = np.where(twice != _EMPTY, np.arange(2 * REGISTERS), 4 * REGISTERS)
        at = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :REGISTERS] % REGISTERS
        part = full[rows]
        full[rows] = np.where(part == _EMPTY, np.take_along_axis(smallest[rows], at, axis=1), part)
    return compress(full)


def accidental(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The chance that registers of different minima agree, for sets of n and m shingles."""
    level = 2.0 ** -np.arange(1 << ZERO_BITS)

    def cells(count):  # how the minimum of a bucket's share of the set falls on the counts of leading zeros
        share = np.maximum(count / REGISTERS, 1.0)[:, None]
        upper = np.exp(share * np.log1p(-np.minimum(level, 1 - 1e-12)))
        lower = np.exp(share * np.log1p(-level / 2))
        return lower - upper

    return (cells(np.asarray(n, float)) * cells(np.asarray(m, float))).sum(axis=1) / 2**MANTISSA_BITS


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard from the number of equal registers, without the share that agrees by accident."""
    c = accidental(n, m)
    return np.clip((equal / REGISTERS - c) / (1 - c), 0, 1)


def may_link(equal: np.ndarray, n: np.ndarray, m: np.ndarray, similarity: float, margin: float) -> np.ndarray:
    """Whether pairs of sets of n and m shingles with so many equal registers have to be held against each other in full."""
    small, large = np.minimum(n, m), np.maximum(n, m)
    filled = REGISTERS * -np.expm1(-small / REGISTERS)  # buckets with a value of their own, on average
    near = estimate(equal, n, m) >= similarity - margin * np.sqrt(REGISTERS / np.maximum(filled, 1.0))
    return ((small < SHORT) | near) & (small >= similarity * large)  # sets of more unequal sizes can't be linked


def sketch_documents(docs: DataFrame, k: int) -> DataFrame:
    """doc, n (distinct shingles), s1 and s2 (hash of the set), registers (binary)."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_chunks(text_column(batch), most_rows=(1 << _DOC_BITS) - 1):
                shingles, where = distinct_shingles(data, offsets, k)
                sums = []
                for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                    total = np.zeros(len(shingles) + 1, np.uint64)
                    np.cumsum(mix(shingles ^ np.uint64(salt)), out=total[1:])
                    sums.append(mix(total[where[1:]] - total[where[:-1]]).view(np.int64))
                rows = sketches(shingles, where).astype(">u2")
                size = REGISTERS * 2
                binary = pa.Array.from_buffers(pa.binary(size), b - a, [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.diff(where).astype(np.int64)), *map(pa.array, sums), binary],
                                                 ["doc", "n", "s1", "s2", "registers"])

    ship(docs.sparkSession)
    return docs.select(id_order().alias("doc"), "text").mapInArrow(sketch, "doc bigint, n bigint, s1 bigint, s2 bigint, registers binary")


def register_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u2").astype(np.uint16).reshape(-1, REGISTERS)


def band_members(nodes: DataFrame, rows: int) -> DataFrame:
    """(band, band_no, doc): one row for each band of each node."""
    count, width = REGISTERS // rows, 2 * rows
    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("registers", i * width + 1, width)) for i in range(count)])
    return nodes.select(F.posexplode(bands).alias("band_no", "band"), "doc").select("band", "band_no", "doc")


def passing_pairs(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) that pass the estimate."""
    def side(name: str) -> DataFrame:
        return nodes.select(F.col("doc").alias(name), F.col("n").alias(f"n_{name}"), F.col("registers").alias(f"r_{name}"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                equal = (register_rows(part.column(4)) == register_rows(part.column(5))).sum(axis=1)
                keep = may_link(equal, part.column(2).to_numpy(), part.column(3).to_numpy(), similarity, MARGIN)
                yield part.select([0, 1]).filter(pa.array(keep))

    joined = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").select("a", "b", "n_a", "n_b", "r_a", "r_b")
    return joined.mapInArrow(compare, "a bigint, b bigint").distinct()


def text_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The full set of 64-bit shingle hashes of each text."""
    for _, _, data, offsets in text_chunks(texts):
        words, first = word_hashes(LOWER[data], offsets)
        shingles, begin = shingle_hashes(words, first, k)
        for a, b in zip(begin[:-1], begin[1:]):
            yield np.unique(shingles[a:b])


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int, most: int = 256) -> DataFrame:
    """The (a, b), of ``docs`` (doc, text), with 100 * intersection >= percent * union on the full sets.

    The members of a hub ``a`` are dealt to parts of about ``most``; each part gets the hub's text once, sorted before its members.
    Hubs and members meet the texts in one join, so the texts are dealt once.
    """
    pairs = written(pairs, "pairs")
    parts = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / most).cast("int").alias("parts")), "hub-parts")
    salted = written(pairs.join(parts.hint("merge"), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt")), "salted-pairs")
    members = salted.select("a", "salt", F.lit(1).alias("role"), "b")
    hubs = salted.select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("b")).distinct()
    rows = members.unionByName(hubs).join(docs.hint("merge"), F.col("b") == F.col("doc")).select("a", "salt", "role", "b", "text").repartition(partitions(docs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", "role")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_sets = None, []
        for batch in batches:
            a, b, role = batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(2).to_pylist()
            out: list[tuple[int, int]] = []
            for i, own in enumerate(text_sets(text_column(batch), k)):
                if role[i] == 0:
                    # several rows of one id: any of its texts may be linked
                    hub_sets = [*hub_sets, own] if hub == a[i] else [own]
                    hub = a[i]
                    continue
                for other in hub_sets:
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    if both and 100 * both >= percent * (len(own) + len(other) - both):
                        out.append((a[i], b[i]))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    return rows.mapInArrow(confirm, "a bigint, b bigint").distinct()


def full_members(texts: DataFrame, k: int) -> DataFrame:
    """doc, n, registers and shingles (the full sorted set, as 64-bit integers) of ``texts`` (doc, text); equal sets of a document are there once."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = text_column(batch)
            for a, b, data, offsets in text_chunks(column, most_rows=(1 << _DOC_BITS) - 1):
                shingles, where = distinct_shingles(data, offsets, k)
                binary = pa.Array.from_buffers(pa.binary(REGISTERS * 2), b - a, [None, pa.py_buffer(sketches(shingles, where).astype(">u2").tobytes())]).cast(pa.binary())
                full = list(text_sets(column.slice(a, b - a), k))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.diff(where).astype(np.int64)), binary, pa.array([s.tobytes() for s in full], pa.binary())],
                                                 ["doc", "n", "registers", "shingles"])

    return texts.select("doc", "text").mapInArrow(sketch, "doc bigint, n bigint, registers binary, shingles binary").dropDuplicates(["doc", "n", "registers"])


def left_over_links(groups: DataFrame, texts: DataFrame, labels: DataFrame, rows: int, similarity: float, k: int, percent: int, room: int = 1 << 25) -> DataFrame:
    """(a, b): links between members of a band group that are in different components; one of them is in another than the hub's.

    Members outside the hub's component are dealt to blocks of about ``room`` bytes, and each block meets the group's members
    block by block.  A member brings its full set along, so what passes the estimate is confirmed where it is found, and pairs never leave
    a cell: it gives out the links that join components, fewer than it has members.  A pair is looked at in the first band that it shares.
    """
    count = REGISTERS // rows
    own = groups.join(labels, F.col("doc") == F.col("node"), "left").select("band", "band_no", "doc", "hub", F.coalesce("component", "doc").alias("part"))
    hubs = labels.select(F.col("node").alias("_node"), F.col("component").alias("_part"))
    marked = written(own.join(hubs, F.col("hub") == F.col("_node"), "left").select(
        "band", "band_no", "doc", "part", (F.col("part") != F.coalesce("_part", "hub")).alias("minor")), "marked")
    open_bands = written(marked.groupBy("band").agg(F.max("minor").alias("open")).filter("open").select("band"), "open-bands")
    marked = written(marked.join(open_bands.hint("merge"), "band", "left_semi"), "left-over")
    wanted = written(marked.select("doc").distinct(), "left-over-docs")
    members = written(full_members(texts.join(wanted.hint("merge"), "doc", "left_semi"), k), "left-over-members")
    weight = (8 * F.col("n") + 2 * REGISTERS + 100).cast("long")
    weighed = marked.join(members.select("doc", "n").hint("merge"), "doc").groupBy("band").agg(F.sum(weight).alias("w"), F.sum(F.when(F.col("minor"), weight)).alias("m"))
    sizes = written(weighed.select("band", F.ceil(F.col("w") / room).cast("int").alias("blocks"), F.ceil(F.col("m") / room).cast("int").alias("minor_blocks")), "left-over-sizes")
    known = marked.join(sizes, "band").join(members.hint("merge"), "doc")
    slot = F.pmod(F.xxhash64("doc", F.lit(7)), F.col("blocks"))
    minor_slot = F.pmod(F.xxhash64("doc", F.lit(11)), F.col("minor_blocks"))
    columns = ["band", "i", "j", "role", "doc", "n", "part", "band_no", "registers", "shingles"]
    left = known.filter("minor").withColumn("i", minor_slot).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = known.withColumn("j", slot).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("minor_blocks") - 1)))
    cells = left.withColumn("role", F.lit(0)).select(*columns).union(right.withColumn("role", F.lit(1)).select(*columns))
    cells = cells.repartition(partitions(texts.sparkSession), "band", "i", "j").sortWithinPartitions("band", "i", "j", "role")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(8))))
            registers, sets = register_rows(batch.column(8)), batch.column(9)
            found: list[tuple[int, int]] = []
            for row, (band, i, j, role, doc, n, part, band_no) in enumerate(keys):
                if (band, i, j) != cell:
                    cell, held = (band, i, j), Cell(count, rows, similarity, percent)
                shingles = np.frombuffer(sets[row].as_py(), np.uint64)
                if role == 0:
                    held.hold(doc, n, part, registers[row], shingles)
                else:
                    found += held.links(doc, n, part, registers[row], shingles, band_no)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return cells.mapInArrow(compare, "a bigint, b bigint").distinct()


class Cell:
    """Members of a block that others of their group are held against; links that join nothing new aren't given out."""

    def __init__(self, bands: int, rows: int, similarity: float, percent: int):
        self.bands, self.rows, self.similarity, self.percent = bands, rows, similarity, percent
        self.members: list[tuple] = []
        self.stack = None
        self.above: dict[int, int] = {}  # of components that were joined here

    def hold(self, *member) -> None:
        self.members.append(member)
        self.stack = None

    def top(self, part: int) -> int:
        while (up := self.above.get(part, part)) != part:
            self.above[part] = self.above.get(up, up)
            part = up
        return part

    def links(self, doc: int, n: int, part: int, registers: np.ndarray, shingles: np.ndarray, band_no: int) -> list[tuple[int, int]]:
        if not self.members:
            return []
        if self.stack is None:
            self.n, self.part = (np.array([m[c] for m in self.members]) for c in (1, 2))
            self.stack = np.stack([m[3] for m in self.members])
        same = self.stack == registers
        shared = same[:, :self.bands * self.rows].reshape(len(same), self.bands, self.rows).all(axis=2)
        keep = (shared.argmax(axis=1) == band_no) & (self.part != part)
        if keep.any():
            keep[keep] = may_link(same[keep].sum(axis=1), self.n[keep], np.full(keep.sum(), n), self.similarity, LEFT_OVER_MARGIN)
        out = []
        for at in np.flatnonzero(keep).tolist():
            other, _, other_part, _, other_set = self.members[at]
            a, b = self.top(part), self.top(other_part)
            if a == b:
                continue
            small, large = (shingles, other_set) if len(shingles) <= len(other_set) else (other_set, shingles)
            if not len(small):
                continue
            place = np.minimum(np.searchsorted(large, small), len(large) - 1)
            both = int((large[place] == small).sum())
            if 100 * both >= self.percent * (len(small) + len(large) - both):
                self.above[a] = b
                out.append((min(doc, other), max(doc, other)))
        return out


def grouped(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row a document: doc, n_shingles, component, by the ids that stand in for missing ones.

    Documents are linked with 100 * intersection >= percent * union of their sets of k-word shingles, or the
    whole sequence if it has fewer words.  component_id is the smallest id that can be reached; it is kept.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, similarity = band_rows(percent / 100), percent / 100
    sketch = written(sketch_documents(docs, k), "sketches")
    sets = written(sketch.filter("n > 0").groupBy("s1", "s2").agg(F.min("doc").alias("first")), "sets")
    nodes = written(sketch.join(sets.hint("merge"), (F.col("doc") == F.col("first")) & (sketch["s1"] == sets["s1"]) & (sketch["s2"] == sets["s2"]))
                    .select("doc", "n", "registers"), "nodes")
    hubs = written(band_members(nodes, rows).groupBy("band").agg(F.min("doc").alias("hub"), F.max("doc").alias("_last"))
                   .filter("_last > hub").select("band", "hub"), "bands")
    groups = written(band_members(nodes, rows).join(hubs.hint("merge"), "band").select("band", "band_no", "hub", "doc"), "groups")
    grouped_docs = written(groups.select("doc").distinct(), "grouped-docs")
    nodes = written(nodes.join(grouped_docs.hint("merge"), "doc", "left_semi"), "grouped-nodes")
    texts = written(docs.select(id_order().alias("doc"), "text").join(grouped_docs.hint("merge"), "doc", "left_semi"), "grouped-texts")

    stars = groups.filter("doc <> hub").select(F.col("hub").alias("a"), F.col("doc").alias("b")).distinct()
    links = written(confirmed(passing_pairs(stars, nodes, similarity), texts, k, percent), "links")
    labels = components(links)
    more = written(left_over_links(groups, texts, labels, rows, similarity, k, percent), "links")
    if not more.isEmpty():
        labels = components(links.union(more))

    first = sketch.filter("n > 0").select("doc", "n", "s1", "s2").join(sets, ["s1", "s2"]).select("doc", "n", "first")
    found = written(first.unionByName(sketch.filter("n = 0").select("doc", "n", F.col("doc").alias("first"))), "firsts")
    return found.join(labels, F.col("first") == F.col("node"), "left").select(
        "doc", F.col("n").alias("n_shingles"), F.coalesce("component", "first").alias("component"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept; see :func:`grouped`."""
    def real(c: str):
        return F.when(F.col(c) < NO_ID, F.col(c))

    return grouped(docs, k, percent).select(
        real("doc").alias("doc_id"), "n_shingles", real("component").alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"))


def first_documents(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its group, with all their columns.

    Of several rows of one document the one with the smallest hash of its text stays.
    """
    kept = written(grouped(docs, k, percent).filter("doc = component").select("doc").distinct(), "kept")
    key, place = column_name(docs, "_document"), column_name(docs, "_place")
    rows = docs.withColumn(key, id_order()).alias("d").join(kept.alias("k"), F.col(f"d.{key}") == F.col("k.doc"), "left_semi")
    first = Window.partitionBy(key).orderBy(F.xxhash64("text"))
    return rows.withColumn(place, F.row_number().over(first)).filter(F.col(place) == 1).drop(key, place)
