"""Benchmark decontamination by SimHash over item-sized windows.

Items and documents are sequences of 5-word shingles (A-Z lower-cased, punctuation at the
ends of words left out).  Items fall into size classes.  Every document is cut into windows
of each class's size, at every ``stride``-th shingle of that size, and every item into windows of its
class's size at as many offsets in a row, so a copy of the item, wherever it stands, has a
document window with the same shingles as one of the item's.  A window's fingerprint is 64
bits, each the sign of a sum over its shingles, from prefix sums.

Fingerprints meet in an index of ``BLOCKS`` blocks of bits.  Two that differ in fewer bits than there are blocks agree
in a whole block, and two that differ in fewer than twice as many differ by one bit at most in some block, whose
neighbours the items' side holds too.  So all fingerprints within the radius are found, none by chance.

A copy at the least similarity may be further away than that as a whole.  But each break in it (a changed,
lost, added or moved word) costs four shingles or more, so it has few, and between two of them
a long run is untouched (``least_run``).  Items therefore are also cut into overlapping part windows, at all their
offsets and so long that such a run holds a whole part window of the documents; parts are looked up within
``PART_RADIUS`` bits.  The bound needs breaks whose own shingles are not in the item: texts that say
one phrase over and over may have more of them.

What is found is aligned with its item and verified by the exact similarity of the multisets
of shingles, sum of smaller over sum of larger counts, at every start up to an item's length
away.  The best one is kept, the first of equal ones.

The benchmark is the query set: it is read by each task in blocks of ``ITEM_BLOCK`` items, one
index a block, and never joined with the documents as a whole.  Documents are read once a block.

Nulls: a null text matches nothing; items with fewer than five words match nothing, as one
shingle would be their all.  Repeated items are found under each id, repeated rows under each row.
Very long texts are searched whole.  An empty table gives an empty result.  ``clean_documents`` keeps all columns; others read doc_id, item_id and text.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listmill.llm.shared import ship, text_chunks, text_column, without_rows, written
from listmill.llm.words import LOWER, mix, shingle_hashes, span_hashes, word_spans

SHINGLE, SIMILARITY = 5, 0.8
BLOCKS, BLOCK_BITS = 4, 16
RADIUS, PART_RADIUS = 2 * BLOCKS - 1, BLOCKS - 1
GROWTH = 1.25  # from one size class to the next
PART_SIZES = (1, 2, 3, 4, 6, 9, 13, 18, 25)
ITEM_BLOCK = 20_000
#: Marks that are no part of a word's key when they stand at its ends.
MARKS = np.zeros(256, bool)
MARKS[list(b".,;:!?\"'()[]{}<>*#%$&|-_`~/\\+=")] = True


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes in text order, and for each text the index of its first one; short texts have none."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    while len(starts):  # words lose marks at their ends, but keep one byte
        trim = MARKS[data[starts]] & (ends - starts > 1)
        if not trim.any():
            break
        starts = starts + trim
    while len(starts):
        trim = MARKS[data[ends - 1]] & (ends - starts > 1)
        if not trim.any():
            break
        ends = ends - trim
    bare = MARKS[data[starts]] & (ends - starts == 1) if len(starts) else np.zeros(0, bool)
    kept = np.concatenate(([0], np.cumsum(~bare)))
    words = span_hashes(data, starts[~bare], ends[~bare])
    first = kept[first]
    n = np.diff(first)
    grams, begin = shingle_hashes(words, first, SHINGLE)
    whole = np.repeat(n >= SHINGLE, np.diff(begin))
    return grams[whole], np.concatenate(([0], np.cumsum(np.maximum(n - SHINGLE + 1, 0))))


def stride(size: int) -> int:
    """Shingles from one of a document's windows to the next."""
    return max(1, size // 4)


def part_stride(size: int) -> int:
    return max(1, size - 1)


def size_class(n: int) -> int:
    """The largest class whose windows fit into n shingles at all offsets; 0 if there is none."""
    size, best = 1.0, 0
    while int(size) + stride(int(size)) - 1 <= n:
        best = int(size)
        size = max(size * GROWTH, int(size) + 1)
    return best


def part_size(n: int, similarity: float) -> int:
    """The largest part window of which every long run of a copy of ``n`` shingles holds a whole one."""
    run = least_run(n, similarity)
    return max((w for w in PART_SIZES if w + part_stride(w) - 1 <= run), default=1)


def least_run(n: int, similarity: float) -> int:
    """Shingles in the longest untouched run of any copy of an item of ``n`` shingles with that similarity.

    A window with f foreign shingles has at least ``similarity * (n + f)`` of the item's, in at most f / 4 + 1 runs.
    """
    most = int(n * (1 - similarity) / (1 + similarity) + 1e-9)
    return min(math.ceil(math.ceil(similarity * (n + f) - 1e-9) / (f // (SHINGLE - 1) + 1)) for f in range(most + 1))


def bit_sums(grams: np.ndarray, widest: int) -> np.ndarray:
    """Prefix counts of the bits, one row more than there are shingles; differences over up to ``widest`` shingles are exact, as counts wrap around."""
    kind = np.uint8 if widest < 1 << 8 else np.uint16 if widest < 1 << 16 else np.uint32
    bits = np.unpackbits(grams.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.zeros((len(grams) + 1, 64), kind)
    np.cumsum(bits, axis=0, dtype=kind, out=sums[1:])
    return sums


def fingerprints(sums: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The fingerprints of the windows of ``size`` shingles that begin at ``at``: the bits that more than half of them have."""
    return np.packbits(sums[at + size] - sums[at] > size // 2, axis=1).view("<u8").reshape(-1)


def grid(n: np.ndarray, first: np.ndarray, size: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of the windows of ``size`` shingles at every ``step``-th shingle of texts of ``n``."""
    count = np.where(n >= size, (n - size) // step + 1, 0)
    where = np.cumsum(count) - count
    text = np.repeat(np.arange(len(n)), count)
    return text, first[:-1][text] + step * (np.arange(len(text)) - where[text])


class Index:
    """Fingerprints of one size class by blocks; ``find`` gives all pairs within the radius.

    With ``neighbours`` it also holds the values that differ by one bit in a block, and the radius is twice as wide.
    """

    def __init__(self, prints: np.ndarray, owners: np.ndarray, neighbours: bool = True):
        self.prints, self.owners, self.radius = prints, owners, RADIUS if neighbours else PART_RADIUS
        self.tables = []
        off = np.concatenate(([0], 1 << np.arange(BLOCK_BITS if neighbours else 0))).astype(np.uint64)
        for block in range(BLOCKS):
            own = (prints >> np.uint64(block * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)
            near = (own[:, None] ^ off[None, :]).ravel().astype(np.int64)
            order = np.argsort(near, kind="stable")
            starts = np.searchsorted(near[order], np.arange((1 << BLOCK_BITS) + 1))
            self.tables.append((starts.astype(np.int32), np.repeat(np.arange(len(prints)), len(off))[order]))

    def find(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``prints``, places in the index) of all pairs within the radius."""
        found = []
        for block, (starts, entries) in enumerate(self.tables):
            value = ((prints >> np.uint64(block * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)
            count = starts[value + 1] - starts[value]
            hit = np.flatnonzero(count)
            if not len(hit):
                continue
            many = count[hit]
            left = np.repeat(hit, many)
            inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            right = entries[np.repeat(starts[value[hit]], many) + inner]
            near = np.bitwise_count(prints[left] ^ self.prints[right]) <= self.radius
            found.append(left[near] * len(self.prints) + right[near])
        pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        return pairs // max(1, len(self.prints)), pairs % max(1, len(self.prints))


class Benchmark:
    """A block of items with their indexes, one for each size class."""

    def __init__(self, ids: list[int], texts: list[str], similarity: float = SIMILARITY):
        column = pa.array([t or "" for t in texts], pa.large_string())
        self.items: list[tuple[int, np.ndarray, np.ndarray]] = []  # id, distinct shingles, counts
        self.sizes: list[int] = []
        self.least = similarity
        classes: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # fingerprint, item, offset
        parts: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        row = 0
        for a, b, data, offsets in text_chunks(column):
            grams, first = shingles(data, offsets)
            sums = bit_sums(grams, int(np.diff(first).max(initial=1)))
            for k in range(b - a):
                own = grams[first[k]:first[k + 1]]
                if len(own):
                    size = size_class(len(own))
                    last = len(own) - size - stride(size) + 1
                    at = first[k] + np.array(sorted({base + i for base in (0, last // 2, last) for i in range(stride(size))}))
                    classes[size] += [(int(x), len(self.items), int(p - first[k])) for x, p in zip(fingerprints(sums, at, size), at)]
                    part = part_size(len(own), similarity)
                    at = first[k] + np.arange(len(own) - part + 1)
                    parts[part] += [(int(x), len(self.items), int(p - first[k])) for x, p in zip(fingerprints(sums, at, part), at)]
                    self.items.append((ids[row], *np.unique(own, return_counts=True)))
                    self.sizes.append(len(own))
                row += 1

        def indexed(rows: list[tuple[int, int, int]], neighbours: bool) -> Index:
            return Index(np.array([r[0] for r in rows], np.uint64), np.array([r[1:] for r in rows], np.int64), neighbours)

        self.indexes = [(size, stride(size), indexed(rows, True)) for size, rows in sorted(classes.items())]
        self.widest = max([1, *classes])
        self.indexes += [(size, part_stride(size), indexed(rows, False)) for size, rows in sorted(parts.items())]

    def candidates(self, sums: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(text, item, start of the item in the joined shingles) of all windows within the radius, each once."""
        n, out = np.diff(first), []
        for size, step, index in self.indexes:
            text, at = grid(n, first, size, step)
            for lot in range(0, len(at), 1 << 15):
                left, right = index.find(fingerprints(sums, at[lot:lot + (1 << 15)], size))
                if len(left):
                    out.append(np.stack([text[lot + left], index.owners[right, 0], at[lot + left] - index.owners[right, 1]], axis=1))
        return np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 3), np.int64)

    def verify(self, item: int, start: int, grams: np.ndarray, low: int, high: int) -> tuple[float, int]:
        """The best similarity at a start up to the item's length from ``start`` within the text [low, high), and the first such start."""
        _, own, counts = self.items[item]
        size, best = self.sizes[item], (0.0, start)
        begin, end = max(low, start - size), min(high, start + 2 * size)
        part = grams[begin:end]
        place = np.minimum(np.searchsorted(own, part), len(own) - 1)
        place = np.where(own[place] == part, place, -1)
        if np.count_nonzero(place >= 0) < self.least * size:  # no window can have as many of the item's shingles as it needs
            return best
        place = place.tolist()
        left, both = counts.tolist(), 0
        a = b = begin
        for at in range(start - size, start + size + 1):
            while b < min(end, at + size):
                k = place[b - begin]
                if k >= 0:
                    both += left[k] > 0
                    left[k] -= 1
                b += 1
            while a < min(b, at):
                k = place[a - begin]
                if k >= 0:
                    left[k] += 1
                    both -= left[k] > 0
                a += 1
            if a < b:
                value = both / (size + b - a - both)
                if value > best[0]:
                    best = value, a
        return best


_HELD: dict[tuple[str, float], Benchmark] = {}


def held_benchmark(shared: Broadcast, similarity: float) -> Benchmark:
    """The index of a broadcast block; a worker builds it once and keeps the last one."""
    key = (shared.value[2], similarity)
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Benchmark(*shared.value[:2], similarity)
    return _HELD[key]


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, text_hash, similarity, first_shingle): the best place of each item in each document that holds it.

    Similarity is of the multisets of five-word shingles of the item and of a window of its size.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    schema = "doc_id bigint, item_id bigint, text_hash bigint, similarity double, first_shingle bigint"
    out = None
    for items in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast((*items, uuid.uuid4().hex))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            bench = held_benchmark(shared, similarity)
            for batch in batches:
                for a, _, data, offsets in text_chunks(text_column(batch), 1 << 18):
                    grams, first = shingles(data, offsets)
                    best: dict[tuple[int, int], tuple[float, int]] = {}
                    for text, item, start in bench.candidates(bit_sums(grams, bench.widest), first).tolist():
                        value, at = bench.verify(item, start, grams, int(first[text]), int(first[text + 1]))
                        at -= int(first[text])
                        known = best.get((text, item), (0.0, 0))
                        if value >= similarity and (value > known[0] or value == known[0] and at < known[1]):
                            best[text, item] = value, at
                    if best:
                        rows = pa.array([a + t for t, _ in best])
                        part = batch.take(rows)
                        yield pa.RecordBatch.from_arrays(
                            [part.column(0), pa.array([bench.items[i][0] for _, i in best], pa.int64()), part.column(1),
                             pa.array([v for v, _ in best.values()], pa.float64()), pa.array([p for _, p in best.values()], pa.int64())],
                            ["doc_id", "item_id", "text_hash", "similarity", "first_shingle"])

        part = docs.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def item_blocks(benchmark: DataFrame, size: int = ITEM_BLOCK) -> Iterator[tuple[list[int], list[str]]]:
    """The query set, block by block: never more than ``size`` items at once on the driver."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text").toLocalIterator()
    ids, texts = [], []
    for item, text in rows:
        ids.append(item)
        texts.append(text)
        if len(ids) == size:
            yield ids, texts
            ids, texts = [], []
    if ids:
        yield ids, texts


def clean_documents(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    leaks = written(matches(docs, benchmark, similarity).select("doc_id", "text_hash").distinct(), "leaks")
    return without_rows(docs, leaks)
