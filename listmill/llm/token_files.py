"""Token ids in Parquet: list columns, dictionary or delta encoding, small row groups, page indexes.

Texts are range-partitioned and sorted by id, encoded in place, and written once with
their position in the slice.  Metadata columns are delta encoded and the ids are
dictionary encoded, so a reader of lengths or of a few ids touches few pages: row
groups and pages are small, and Spark's writer adds column and offset indexes.

Encoding follows the tokenizer file: its pre-tokenizer is applied to whole batches as
array operations with character classes taken from the library, and every distinct
piece is encoded once by the library's model; a worker remembers pieces it has seen
(up to ``REMEMBERED``, then it starts anew).  Texts with a special token's string go
through the library whole.

Nulls: a null text is the empty text, which is the end id alone; a null id comes last.
Repeated rows are encoded one by one, in the order of their texts.  An empty table
gives an empty result.  Very long texts are encoded whole.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listmill.llm.shared import id_order, partitions, ship, text_chunks, text_column
from listmill.llm.words import span_hashes
from listmill.session import work_dir

WS, LETTER, NUMBER, OTHER = 0, 1, 2, 3
REMEMBERED = 1 << 22
#: The pre-tokenizer's contractions.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
FILE_OPTIONS = {
    "compression": "zstd",
    "parquet.block.size": str(8 << 20),
    "parquet.page.size": str(64 << 10),
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false",  # delta encoding for ids of documents, lengths and positions
    "parquet.enable.dictionary#ids.list.element": "true",
}
SCHEMA = "slice int, doc_id bigint, first bigint, n_tokens bigint, ids array<int>"


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def character_classes(path: str) -> np.ndarray:
    """The class of every code point, as the tokenizer's own pre-tokenizer sees it."""
    import regex

    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    every = "".join(map(chr, points))
    classes = np.full(0x110000, OTHER, np.uint8)
    split = _tokenizer(path).pre_tokenizer.pre_tokenize_str
    for kind, pattern, probe in ((WS, r"\s", None), (LETTER, r"\p{L}", "A"), (NUMBER, r"\p{N}", "1")):
        chars = "".join(regex.findall(pattern, every))
        if probe is None:
            classes[[ord(c) for c in chars]] = kind
            continue
        # runs in which the library sees one class; a run whose first character doesn't join the probe is of another
        for _, (a, b) in split(chars):
            if len(split(probe + chars[a] + probe)) == 1:
                classes[[ord(c) for c in chars[a:b]]] = kind
    return classes


def piece_starts(points: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the pre-tokenizer's pieces begin in the joined texts; ``first`` has where texts begin and the end."""
    n = len(points)
    kind = classes[points]
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    solid = kind != WS
    start = begins[:-1].copy()
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    start |= change
    # the last white space before other text stands alone, or joins that text if it is a space
    before = np.flatnonzero(solid[1:] & ~solid[:-1] & ~begins[1:-1])
    start[before] = True
    start[before[points[before] == 0x20] + 1] = False
    # contractions at the start of a piece
    marks = np.flatnonzero(start & (points == 0x27))
    if len(marks):
        ends = first[np.searchsorted(first, marks, "right")]
        for mark, end in zip(marks.tolist(), ends.tolist()):
            tail = "".join(map(chr, points[mark:min(mark + 3, end)].tolist()))
            found = next((c for c in CONTRACTIONS if tail.startswith(c)), None)
            if found and start[mark]:
                start[mark + 1] = False
                if mark + len(found) < end:
                    start[mark + len(found)] = True
    return np.flatnonzero(start)


class Encoder:
    """Encodes batches of texts; remembers the ids of pieces."""

    def __init__(self, path: str, classes: np.ndarray):
        self.tokenizer, self.classes = _tokenizer(path), classes
        spec = json.loads(self.tokenizer.to_str())
        self.specials = [t["content"] for t in spec["added_tokens"]]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.visible = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.forget()

    def forget(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.at = np.empty(0, np.int64)
        self.size = np.empty(0, np.int32)
        self.ids = np.empty(0, np.int32)

    def learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        tokenize, visible = self.tokenizer.model.tokenize, self.visible
        ids = [[t.id for t in tokenize(p.encode().decode("latin1").translate(visible))] for p in pieces]
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        at = len(self.ids) + np.cumsum(size, dtype=np.int64) - size
        flat = np.fromiter((i for x in ids for i in x), np.int32, int(size.sum()))
        self.ids = np.concatenate((self.ids, flat))
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = (np.insert(a, place, b) for a, b in ((self.keys, keys), (self.at, at), (self.size, size)))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has."""
        text = data.tobytes().decode("utf-8", "replace")
        lead = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
        first = lead[offsets]
        if not text:
            return np.empty(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        if len(text) != first[-1] or any(s in text for s in self.specials):
            return self.encode_whole(data, offsets)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts = piece_starts(points, first, self.classes)
        ends = np.append(starts[1:], len(points))
        keys, sample, inverse = np.unique(span_hashes(points, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > REMEMBERED:
            self.forget()
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            known = self.keys[np.minimum(place, len(self.keys) - 1)] == keys
        new = np.flatnonzero(~known)
        if len(new):
            at = sample[new]
            self.learn(keys[new], [text[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            place = np.searchsorted(self.keys, keys)
        size, at = self.size[place][inverse], self.at[place][inverse]
        total = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        ids = self.ids[np.repeat(at - total[:-1], size) + np.arange(total[-1])]
        return ids, np.diff(total[np.searchsorted(starts, first)])

    def encode_whole(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
        ids = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.int32, int(size.sum())), size


@functools.cache
def _encoder(path: str, classes: bytes) -> Encoder:
    return Encoder(path, np.frombuffer(classes, np.uint8))


def with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with the end id behind each text, and the offsets of the texts in them."""
    offsets = np.concatenate(([0], np.cumsum(sizes + 1)))
    out = np.empty(offsets[-1], np.int32)
    last = np.zeros(len(out), bool)
    last[offsets[1:] - 1] = True
    out[last] = end_id
    out[~last] = ids
    return out, offsets


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, options: dict[str, str] | None = None) -> None:
    """Write (slice, doc_id, first, n_tokens, ids) in ascending id order; ``first`` counts the ids before it in its slice."""
    spark = docs.sparkSession
    ship(spark)
    classes = spark.sparkContext.broadcast(character_classes(tokenizer).tobytes())  # one byte a code point

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = _encoder(tokenizer, classes.value), 0
        for batch in batches:
            column = text_column(batch)
            for a, b, data, offsets in text_chunks(column):
                ids, where = with_end(*encoder.encode(data, offsets), end_id)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], batch.column(1)[a:b], pa.array(before + where[:-1]), pa.array(np.diff(where)),
                     pa.ListArray.from_arrays(pa.array(where.astype(np.int32)), pa.array(ids))],
                    ["slice", "doc_id", "first", "n_tokens", "ids"])
                before += int(where[-1])

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
        .repartitionByRange(partitions(spark), id_order(), F.xxhash64("text"))
        .sortWithinPartitions(id_order(), F.xxhash64("text"), "text")
        .select(F.spark_partition_id().alias("slice"), "doc_id", "text")
    )
    ordered.mapInArrow(encode, SCHEMA).write.options(**(FILE_OPTIONS | (options or {}))).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def token_starts(tokens: DataFrame) -> DataFrame:
    """slice, before: the ids of all slices before it.  Reads two narrow columns; one row a slice."""
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return tokens.groupBy("slice").agg(F.sum("n_tokens").alias("_ids")).select(
        "slice", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("before"))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, from the files."""
    ship(spark)
    tokens = read_token_files(spark, path)

    def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            where = np.asarray(lists.offsets) - lists.offsets[0].as_py() if len(lists) else np.zeros(1, int)
            view = memoryview(flat.tobytes())
            sums = [zlib.crc32(view[4 * a:4 * b]) for a, b in zip(where[:-1].tolist(), where[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(where).astype(np.int64)), pa.array(sums, pa.int64())],
                                             ["slice", "doc_id", "first", "n_tokens", "ids_crc32"])

    rows = tokens.select("slice", "doc_id", "first", "ids").mapInArrow(
        checksums, "slice int, doc_id bigint, first bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(token_starts(tokens), "slice").select(
        "doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the token files of ``docs`` below the shared folder and return their index, read from them."""
    path = work_dir(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer, end_id)
    return token_index(docs.sparkSession, path)
