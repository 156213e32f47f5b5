"""Modified Kneser-Ney n-gram models counted by Spark and stored in sorted hash arrays.

Tokens are small integers of a fixed number of bits, so an n-gram is one 64-bit integer:
its suffix is a mask and its context a shift.  Texts are padded in front with token 0.
Tasks count their n-grams in sorted arrays and pass on partial counts; all counts,
continuation counts, discounts and interpolated probabilities are made by Spark.

Models are kept apart by a group (a language, or target and background).  A level keeps
the n-grams that have at least ``share`` of the counts of the level in their own group, and
those that are the contexts of such a share of the next level's counts, so a small group's model is pruned no
more than a large one's.  At most 1/share can be either, so the stored model of a group has at most 2 * order/share
entries of 16 bytes, whatever the corpus; that is what is sent to the driver and broadcast.  Others back off, with the
weights of the full counts.

Facts of a group (discounts, totals) are written first: Spark then knows how small they are, and the tables of n-grams
aren't dealt by group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listmill.llm.shared import ship, text_chunks, text_column, written
from listmill.llm.words import mix

SHARE = 2.0**-18
LEAST_WEIGHT = 1e-9  # of backing off, so that nothing is impossible
FLUSH = 1 << 20  # distinct n-grams a task holds before it passes some on
#: Discounts for a level with too few counts to estimate them.
PLAIN_DISCOUNTS = (0.5, 1.0, 1.5)

Tokenise = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]  # bytes, offsets -> tokens, first token of each text


def byte_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, offsets


def pack(tokens: np.ndarray, first: np.ndarray, order: int, bits: int) -> np.ndarray:
    """The n-gram that ends at each token, as an integer; tokens in front of the text are 0."""
    n = len(tokens)
    place = np.arange(n, dtype=np.int64) - np.repeat(first[:-1], np.diff(first))
    wide = tokens.astype(np.uint64)
    out = wide.copy()
    for back in range(1, min(order, n + 1)):
        part = np.zeros(n, np.uint64)
        part[back:] = wide[:-back]
        part[place < back] = 0
        out |= part << np.uint64(bits * back)
    return out


def add_counts(held: tuple[np.ndarray, np.ndarray] | None, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    new = keys[edge], np.diff(np.append(edge, len(keys)))
    if held is None:
        return new
    every = np.concatenate((held[0], new[0]))
    order = np.argsort(every, kind="stable")
    every, counts = every[order], np.concatenate((held[1], new[1]))[order]
    edge = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    return every[edge], np.add.reduceat(counts, edge)


def partial_counts(docs: DataFrame, tokenise: Tokenise, order: int, bits: int, keep: Callable[[pa.RecordBatch], np.ndarray] | None = None) -> DataFrame:
    """(grp, gram, c): each task's counts over (grps, text, ...); a row of several groups has them in an array.

    ``keep`` chooses rows.  A task holds FLUSH distinct n-grams over all groups and passes the largest group on beyond that.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out(grp: str) -> pa.RecordBatch:
            keys, counts = held.pop(grp)
            names = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(keys), np.int32)), pa.array([grp])).cast(pa.string())
            return pa.RecordBatch.from_arrays([names, pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["grp", "gram", "c"])

        for batch in batches:
            if keep is not None:
                batch = batch.filter(pa.array(keep(batch)))
            groups = batch.column(0).to_pylist()
            texts = text_column(batch)
            for key in set(map(tuple, groups)):
                rows = pa.array([i for i, g in enumerate(groups) if tuple(g) == key])
                for _, _, data, offsets in text_chunks(texts.take(rows)):
                    tokens, first = tokenise(data, offsets)
                    if not len(tokens):
                        continue
                    grams = pack(tokens, first, order, bits)
                    for grp in key:
                        held[grp] = add_counts(held.get(grp), grams)
                    while sum(len(k) for k, _ in held.values()) > FLUSH:
                        yield out(max(held, key=lambda g: len(held[g][0])))
        for grp in list(held):
            yield out(grp)

    ship(docs.sparkSession)
    return docs.mapInArrow(count, "grp string, gram bigint, c bigint")


def count_ngrams(docs: DataFrame, tokenise: Tokenise, order: int, bits: int) -> DataFrame:
    """(grp, gram, c) of all texts of (grps, text)."""
    return partial_counts(docs.select("grps", "text"), tokenise, order, bits).groupBy("grp", "gram").agg(F.sum("c").alias("c"))


def _discounts(counts: DataFrame) -> DataFrame:
    """grp, d1, d2, d3: the modified Kneser-Ney discounts of a level."""
    of = {k: F.sum(F.when(F.col("c") == k, 1).otherwise(0)).cast("double") for k in (1, 2, 3, 4)}
    t = counts.groupBy("grp").agg(*[of[k].alias(f"t{k}") for k in of])
    y = F.col("t1") / (F.col("t1") + 2 * F.col("t2"))
    enough = F.least("t1", "t2", "t3", "t4") > 0
    made = [k - (k + 1) * y * F.col(f"t{k + 1}") / F.col(f"t{k}") for k in (1, 2, 3)]
    return t.select("grp", *[F.when(enough, F.greatest(d, F.lit(0.0))).otherwise(F.lit(p)).alias(f"d{k}")
                             for k, (d, p) in enumerate(zip(made, PLAIN_DISCOUNTS), 1)])


def kneser_ney(counts: DataFrame, order: int, bits: int, symbols: int, share: float = SHARE) -> DataFrame:
    """(grp, n, gram, logp, backoff) of the n-grams kept, from the counts (grp, gram, c) of the highest order.

    Lower orders count in how many distinct longer n-grams they end.  ``symbols`` is the size of the shared
    vocabulary, over which the lowest level is interpolated evenly.
    """
    def low(n: int) -> Column:
        return F.col("gram").bitwiseAND(F.lit((1 << bits * n) - 1))

    levels = {order: written(counts, "ngrams")}
    for n in range(order - 1, 0, -1):
        levels[n] = written(levels[n + 1].groupBy("grp", low(n).alias("gram")).agg(F.count("*").alias("c")), "ngrams")
    lower, stored, weights, totals = None, {}, {}, {}
    for n in range(1, order + 1):
        taken = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        level = levels[n].join(written(_discounts(levels[n]), "discounts"), "grp").select(
            "grp", "gram", "c", taken.alias("d"), F.shiftright("gram", bits).alias("context"), low(n - 1).alias("suffix"))
        contexts = written(level.groupBy("grp", "context").agg(F.sum("c").alias("total"), F.sum("d").alias("held")).select(
            "grp", "context", "total", F.greatest(F.col("held") / F.col("total"), F.lit(LEAST_WEIGHT)).alias("gamma")), "contexts")
        weights[n] = contexts
        level = level.join(contexts, ["grp", "context"])
        if lower is None:
            rest = F.lit(1.0 / symbols)
        else:
            level = level.join(lower.select("grp", F.col("gram").alias("suffix"), F.col("p").alias("_rest")), ["grp", "suffix"])
            rest = F.col("_rest")
        level = level.select("grp", "gram", "c", ((F.col("c") - F.col("d")) / F.col("total") + F.col("gamma") * rest).alias("p"))
        lower = written(level, "levels")
        totals[n] = written(lower.groupBy("grp").agg((F.sum("c") * share).alias(f"least{n}")), "totals")
        stored[n] = lower.select("grp", "gram", "c", "p")
    out = weights[1].select("grp", F.lit(0).alias("n"), F.lit(0).cast("long").alias("gram"),
                            F.lit(-np.log(symbols)).cast("float").alias("logp"), F.log("gamma").cast("float").alias("backoff"))
    for n, rows in stored.items():
        rows = rows.join(totals[n], "grp", "left")
        keep, gamma = F.coalesce(F.col("c") >= F.col(f"least{n}"), F.lit(False)), F.lit(1.0)
        if n < order:  # contexts that begin before the text are no n-grams of their level, but have a weight
            after = weights[n + 1].join(totals[n + 1], "grp").select("grp", F.col("context").alias("gram"), "gamma", (F.col("total") >= F.col(f"least{n + 1}")).alias("context"))
            rows = rows.join(after, ["grp", "gram"], "full")
            keep, gamma = keep | F.coalesce("context", F.lit(False)), F.coalesce("gamma", F.lit(1.0))
        out = out.union(rows.filter(keep).select("grp", F.lit(n).alias("n"), "gram", F.log("p").cast("float").alias("logp"), F.log(gamma).cast("float").alias("backoff")))
    return out


def resolved(model: DataFrame, needed: DataFrame, order: int, bits: int, symbols: int) -> DataFrame:
    """(grp, gram, c, logp) of all n-grams ``needed`` (grp, gram, c), under their group's whole model, by joins; a group without one is even."""
    model = written(model, "model")
    left, parts = needed.select("grp", "gram", "c", F.lit(0.0).alias("weight")), []
    for n in range(order, 0, -1):
        level = model.filter((F.col("n") == n) & F.col("logp").isNotNull()).select("grp", F.col("gram").alias("own"), "logp")
        met = written(left.withColumn("own", F.col("gram").bitwiseAND(F.lit((1 << bits * n) - 1))).join(level, ["grp", "own"], "left"), "met")
        parts.append(met.filter("logp IS NOT NULL").select("grp", "gram", "c", (F.col("weight") + F.col("logp")).alias("logp")))
        below = model.filter(F.col("n") == n - 1).select("grp", F.col("gram").alias("context"), "backoff")
        left = met.filter("logp IS NULL").withColumn("context", F.shiftright("own", bits)).join(below, ["grp", "context"], "left").select(
            "grp", "gram", "c", (F.col("weight") + F.coalesce("backoff", F.lit(0.0))).alias("weight"))
    out = left.select("grp", "gram", "c", (F.col("weight") - float(np.log(symbols))).alias("logp"))
    for part in parts:
        out = out.union(part)
    return out.withColumn("logp", F.col("logp").cast("float"))


class HashArray:
    """A level: hashes in order, with values; the upper bits of a hash say where to look."""

    def __init__(self, grams: np.ndarray, logp: np.ndarray, backoff: np.ndarray):
        hashes = mix(grams.astype(np.uint64))  # a bijection: equal hashes are equal n-grams
        order = np.argsort(hashes)
        self.hashes, self.logp, self.backoff = hashes[order], logp[order].astype(np.float32), backoff[order].astype(np.float32)
        bits = max(1, int(len(grams)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(self.hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift)
        self.starts = np.append(self.starts, len(grams)).astype(np.int32)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Places of the n-grams; -1 where there is none."""
        hashes = mix(grams)
        bucket = hashes >> self.shift
        at, end = self.starts[bucket], self.starts[bucket + np.uint64(1)]
        out = np.full(len(grams), -1, np.int32)
        left = np.flatnonzero(at < end)
        while len(left):
            here = at[left]
            same = self.hashes[here] == hashes[left]
            out[left[same]] = here[same]
            left = left[~same]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


class Model:
    """The levels of one group."""

    def __init__(self, levels: dict[int, HashArray], order: int, bits: int, floor: float):
        self.levels, self.order, self.bits, self.floor = levels, order, bits, floor

    def log_probabilities(self, grams: np.ndarray) -> np.ndarray:
        """The log probability of the last token of each packed n-gram."""
        out = np.full(len(grams), self.floor, np.float64)
        left, weight = np.arange(len(grams)), np.zeros(len(grams))
        for n in range(self.order, 0, -1):
            if not len(left):
                break
            own = grams[left] & np.uint64((1 << self.bits * n) - 1)
            if n in self.levels:
                at = self.levels[n].find(own)
                hit = (at >= 0) & ~np.isnan(self.levels[n].logp[at])
                out[left[hit]] = weight[hit] + self.levels[n].logp[at[hit]]
                left, weight, own = left[~hit], weight[~hit], own[~hit]
            if n == 1:
                # the level below is even over the vocabulary
                out[left] = weight + self.floor + self.empty
            elif n - 1 in self.levels and len(left):
                at = self.levels[n - 1].find(own >> np.uint64(self.bits))
                weight = weight + np.where(at >= 0, self.levels[n - 1].backoff[at], 0)
        return out

    empty = 0.0


def load_models(rows: DataFrame, order: int, bits: int, symbols: int) -> dict[str, Model]:
    """The stored model of every group on the driver: at most 2 * order/share entries each."""
    got = rows.toArrow().combine_chunks()
    names = got["grp"].combine_chunks().dictionary_encode()
    group, level, gram, logp, backoff = (x.to_numpy(zero_copy_only=False) for x in (names.indices, *(got[c].combine_chunks() for c in ("n", "gram", "logp", "backoff"))))
    models = {}
    for i, grp in enumerate(names.dictionary.to_pylist()):
        levels = {}
        for n in range(1, order + 1):
            own = np.flatnonzero((group == i) & (level == n))
            if len(own):
                levels[n] = HashArray(gram[own], logp[own], backoff[own])
        models[grp] = Model(levels, order, bits, -float(np.log(symbols)))
        models[grp].empty = float(backoff[np.flatnonzero((group == i) & (level == 0))[0]])
    return models


def even_model(order: int, bits: int, symbols: int) -> Model:
    """For a group that has no model: every token is as likely."""
    return Model({}, order, bits, -float(np.log(symbols)))
