"""Quality rules: n-gram perplexity under a model of the document's language.

Byte 5-gram models with modified Kneser-Ney smoothing are counted over all distinct texts of
each language (see :mod:`listmill.llm.ngrams`), one over each half of them by the hash of the text.  A text is scored by the
model of the other half, which has not counted it; so what occurs once is not taken for what the language looks like.
The models are whole.  Spark looks up each distinct n-gram of a half in the other half's model; tasks hold the log
probabilities of the ``held`` most frequent ones, and the others of each distinct text are joined with theirs.
A document's score is its mean loss per byte, the log of its perplexity.  Each language has its own band: from the quartiles of all its
distinct texts, so that copies don't set it, ``width`` times the distance between them to both sides, and further out for
short texts, whose mean loss varies more, by ``short`` over the root of the length.
Below the band is text that repeats itself, above it what isn't running text of the
language; both are rejected, as is what fails the fixed rules on words.

Texts that occur once are counted where they lie.  Only texts that may occur again are dealt by their content: those
whose hash hits a filter of fixed size, made from the hashes that occur twice or more.

Very long texts are scored whole.  A loss at the very edge of the band is inside.
Nulls: a null text has no words and fails the rules; a null language is a language of its
own.  Documents with an empty text have no loss.  Repeated rows get the same result each.
An empty table gives an empty result.  Only doc_id, text and lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listmill.llm import ngrams
from listmill.llm.shared import ship, text_chunks, text_column, without_rows, written
from listmill.llm.words import LEAD, SPACE, mix, per_text, shingle_hashes, span_hashes, word_spans

ORDER, BITS, SYMBOLS = 5, 8, 256
HELD = 1 << 19  # n-grams whose log probabilities tasks hold, 16 bytes each; it changes no result
WIDTH, SHORT = 1.0, 4.0
FILTER_BITS, FILTER_PROBES = 26, 3  # 8 MB
STEPS = 1000  # losses are held against the band in steps of 1/1000
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_NO_LANGUAGE = ""


def base_measures(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    n = len(offsets) - 1
    starts, ends, first = word_spans(data, offsets)
    words = np.diff(first)
    chars = per_text(LEAD[data] & ~SPACE[data], offsets)
    symbols = per_text(SYMBOL[data], offsets)

    # lines with a word, by their bytes
    cut = np.zeros(len(data) + 1, bool)
    cut[np.flatnonzero(data == 10) + 1] = True
    cut[offsets] = True
    edges = np.flatnonzero(cut)
    line_ends = edges[1:] - (data[edges[1:] - 1] == 10) if len(edges) > 1 else edges[1:]
    begin = edges[:-1]
    solid = np.searchsorted(starts, begin) < np.searchsorted(starts, line_ends)
    begin, line_ends = begin[solid], np.asarray(line_ends)[solid]
    # a newline at the very end of a text belongs to its last line alone
    owner = np.searchsorted(offsets, begin, "right") - 1
    key = mix(span_hashes(data, begin, line_ends) + mix(owner.astype(np.uint64)))
    _, unique = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[unique] = False
    dup_lines = np.bincount(owner[again], minlength=n)

    windows, where = shingle_hashes(span_hashes(data, starts, ends), first, 5)
    full = np.repeat(words >= 5, np.diff(where))
    text = np.repeat(np.arange(n), np.diff(where))
    keys = mix(windows + mix(text.astype(np.uint64)))
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    covered = np.zeros(len(starts) + 1, np.int64)
    if len(twice):
        place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
        hit = np.flatnonzero((twice[place] == keys) & full)
        at = hit - where[text[hit]] + first[text[hit]]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + 5, -1)
    repeat = per_text(np.cumsum(covered)[:-1] > 0, first)
    return [words, chars, symbols, dup_lines, repeat]


def _language() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit(_NO_LANGUAGE))


def _half() -> Column:
    """The half of its language that a text is counted in."""
    return F.pmod(F.xxhash64("text"), F.lit(2))


def _group(language: Column, half: Column) -> Column:
    return F.concat(half.cast("string"), F.lit(":"), language)


def repeated_filter(hashes: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter of the 64-bit hashes (h) that occur more than once: 2^bits bits, whatever the number of rows."""
    again = hashes.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    places = again.select(F.explode(F.array(*[F.pmod(F.xxhash64("h", F.lit(salt)), F.lit(1 << bits)) for salt in range(FILTER_PROBES)])).alias("at"))
    words = places.groupBy(F.shiftright("at", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("bits"))
    table, out = words.toArrow(), np.zeros(1 << bits - 6, np.int64)  # at most 2^(bits - 6) rows
    out[table["word"].to_numpy()] = table["bits"].to_numpy()
    return out


def language_counts(docs: DataFrame) -> DataFrame:
    """(grp, gram, c): n-grams of every distinct text of each half of each language."""
    rows = docs.filter("text IS NOT NULL").select(_group(_language(), _half()).alias("grp"), "text")
    keyed = rows.select("grp", "text", F.xxhash64("grp", "text").alias("h"))
    held = docs.sparkSession.sparkContext.broadcast(repeated_filter(keyed.select("h")))  # of fixed size
    probes = F.array(*[F.pmod(F.xxhash64("h", F.lit(salt)), F.lit(1 << FILTER_BITS)) for salt in range(FILTER_PROBES)])

    def repeated(batch: pa.RecordBatch) -> np.ndarray:
        at = batch.column(2).flatten().to_numpy().reshape(-1, FILTER_PROBES)
        return ((held.value[at >> 6] >> (at & 63)) & 1).all(axis=1)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select([0, 1]).filter(pa.array(repeated(batch)))

    ship(docs.sparkSession)
    again = keyed.select("grp", "text", probes.alias("at")).mapInArrow(choose, "grp string, text string").distinct()
    once = keyed.select(F.array("grp").alias("grps"), "text", probes.alias("at"))
    parts = ngrams.partial_counts(once, ngrams.byte_tokens, ORDER, BITS, lambda batch: ~repeated(batch)).union(
        ngrams.partial_counts(again.select(F.array("grp").alias("grps"), "text"), ngrams.byte_tokens, ORDER, BITS))
    return parts.groupBy("grp", "gram").agg(F.sum("c").alias("c"))


def log_probabilities(docs: DataFrame) -> DataFrame:
    """(grp, gram, c, logp) of every n-gram of the texts that are scored by a group's whole model; c counts it in these texts."""
    counts = written(language_counts(docs), "counts")
    model = ngrams.kneser_ney(counts, ORDER, BITS, SYMBOLS, share=0.0)
    half, rest = F.substring("grp", 1, 1).cast("int"), F.expr("substring(grp, 3)")
    return written(ngrams.resolved(model, counts.select(_group(rest, 1 - half).alias("grp"), "gram", "c"), ORDER, BITS, SYMBOLS), "resolved")


def most_frequent(rows: DataFrame, held: int = HELD) -> dict[str, ngrams.HashArray]:
    """The log probabilities of the most frequent n-grams, at most ``held`` of them, by group on the driver."""
    step = F.floor(F.log2("c") * 8)
    room, least = held, None
    for r in rows.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():  # at most 8 * 63
        room -= r.n
        if room < 0:
            break
        least = r.step
    got = rows.filter(step >= least if least is not None else F.lit(False)).select("grp", "gram", "logp").toArrow().combine_chunks()
    names = got["grp"].combine_chunks().dictionary_encode() if len(got) else pa.array([], pa.string()).dictionary_encode()
    group, gram, logp = names.indices.to_numpy(), got["gram"].to_numpy(), got["logp"].to_numpy()
    return {grp: ngrams.HashArray(gram[group == i], logp[group == i], np.zeros((group == i).sum(), np.float32)) for i, grp in enumerate(names.dictionary.to_pylist())}


def _others(grams: np.ndarray, offsets: np.ndarray, places: np.ndarray) -> pa.ListArray:
    """The distinct n-grams at these places, counted, by text."""
    text = np.searchsorted(offsets, places, "right") - 1
    own = grams[places]
    order = np.lexsort((own, text))
    text, own = text[order], own[order]
    edge = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (text[1:] != text[:-1])))) if len(own) else np.empty(0, np.int64)
    lists = np.searchsorted(text[edge], np.arange(len(offsets))).astype(np.int32)
    counts = np.diff(np.append(edge, len(own)))
    return pa.ListArray.from_arrays(pa.array(lists), pa.StructArray.from_arrays([pa.array(own[edge].view(np.int64)), pa.array(counts.astype(np.int64))], ["gram", "c"]))


def measured(docs: DataFrame, held: int = HELD) -> DataFrame:
    """doc_id, language, text_hash, the base measures, n_bytes and loss (mean per byte; null without text)."""
    scores = log_probabilities(docs)
    shared = docs.sparkSession.sparkContext.broadcast(most_frequent(scores, held))  # of bounded size

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = ngrams.HashArray(np.empty(0, np.int64), np.empty(0), np.empty(0))
        for batch in batches:
            others = np.array(batch.column(4).to_pylist(), object)
            texts = text_column(batch)
            for other in set(others.tolist()):
                rows = np.flatnonzero(others == other)
                mine = texts.take(pa.array(rows))
                known = shared.value.get(other, none)
                for a, b, data, offsets in text_chunks(mine):
                    grams = ngrams.pack(data, offsets, ORDER, BITS)
                    at = known.find(grams)
                    logp = np.zeros(len(grams))
                    logp[at >= 0] = known.logp[at[at >= 0]]
                    total = np.concatenate(([0.0], np.cumsum(logp)))
                    part = batch.take(pa.array(rows[a:b]))
                    columns = [part.column(0), part.column(2), part.column(3), part.column(4), *[pa.array(x.astype(np.int64)) for x in base_measures(data, offsets)],
                               pa.array(np.diff(offsets).astype(np.int64)), pa.array(total[offsets[1:]] - total[offsets[:-1]]), _others(grams, offsets, np.flatnonzero(at < 0))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "language", "other", *BASE, "n_bytes", "known", "rest"])

    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"),
                       _language().alias("language"), _group(_language(), 1 - _half()).alias("other"))
    rows = written(rows.mapInArrow(measure, "doc_id bigint, text_hash bigint, language string, other string, " + ", ".join(f"{c} bigint" for c in BASE)
                                   + ", n_bytes bigint, known double, rest array<struct<gram:bigint,c:bigint>>"), "known")
    # Each text once, so that no n-gram that is left meets copies.  Written: if little is left, the documents aren't dealt.
    left = rows.filter("size(rest) > 0").select("other", "text_hash", "rest").dropDuplicates(["other", "text_hash"]).select("other", "text_hash", F.explode("rest").alias("r"))
    sums = left.select("other", "text_hash", "r.gram", F.col("r.c").alias("times")).join(scores.select(F.col("grp").alias("other"), "gram", "logp"), ["other", "gram"]).groupBy(
        "other", "text_hash").agg(F.sum(F.col("times") * F.col("logp").cast("double")).alias("more"))
    loss = F.when(F.col("n_bytes") > 0, -(F.col("known") + F.coalesce("more", F.lit(0.0))) / F.col("n_bytes"))
    return rows.drop("rest").join(written(sums, "sums"), ["other", "text_hash"], "left").select("doc_id", "text_hash", "language", *BASE, "n_bytes", loss.alias("loss"))


def bands(rows: DataFrame, width: float = WIDTH) -> DataFrame:
    """language, lower, upper: from the quartiles of the losses of all distinct texts, counted in steps."""
    texts = rows.filter("loss IS NOT NULL").groupBy("language", "text_hash").agg(F.min("loss").alias("loss"))
    steps = texts.groupBy("language", F.round(F.col("loss") * STEPS).cast("long").alias("step")).agg(F.count("*").alias("rows"))
    quartiles = steps.groupBy("language").agg(F.percentile("step", F.array(F.lit(0.25), F.lit(0.75)), F.col("rows")).alias("q"))
    apart = F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(1.0)) * width
    return quartiles.select(F.col("language").alias("of"), ((F.col("q")[0] - apart) / STEPS).alias("lower"), ((F.col("q")[1] + apart) / STEPS).alias("upper"))


def judge_quality(docs: DataFrame, width: float = WIDTH, short: float = SHORT, held: int = HELD) -> DataFrame:
    """One row a document: doc_id, the base measures, base_failed, kept, loss, lower, upper, text_hash."""
    rows = written(measured(docs, held), "measured")
    room = F.lit(short) / F.sqrt(F.greatest(F.col("n_bytes"), F.lit(1)))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    inside = F.coalesce(F.round(F.col("loss"), 3).between(F.col("lower") - room, F.col("upper") + room), F.lit(True))
    # Written first: Spark then knows how small the bands are, and documents aren't dealt by language.
    return rows.join(written(bands(rows, width), "bands"), F.col("language") == F.col("of"), "left").select(
        "doc_id", *BASE, failed.alias("base_failed"), (~failed & inside).alias("kept"), "loss",
        (F.col("lower") - room).alias("lower"), (F.col("upper") + room).alias("upper"), "text_hash")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    rejected = written(judge_quality(docs).filter("not kept").select("doc_id", "text_hash").distinct(), "rejected")
    return without_rows(docs, rejected)
