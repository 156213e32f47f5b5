"""The array forms of words, shingles, pieces and n-gram models against plain Python."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from listmill.llm import decontam, near_dup, ngrams, quality, token_files, words
from listmill.llm.queries import tokenizer_file
from listmill.llm.shared import text_chunks
from tests.llm import odd

TEXTS = [t or "" for _, t, *_ in odd.rows()]


def joined(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))


def test_word_spans_are_the_words():
    data, offsets = joined(TEXTS)
    starts, ends, first = words.word_spans(data, offsets)
    found = [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]
    assert [found[a:b] for a, b in zip(first, first[1:])] == [odd.words(t) for t in TEXTS]


def test_equal_spans_have_equal_hashes_and_others_differ():
    data, offsets = joined(TEXTS)
    starts, ends, _ = words.word_spans(data, offsets)
    hashes = words.span_hashes(data, starts, ends)
    by_word = {}
    for a, b, h in zip(starts, ends, hashes.tolist()):
        assert by_word.setdefault(bytes(data[a:b]), h) == h
    assert len(set(by_word.values())) == len(by_word)


@pytest.mark.parametrize("k", [1, 3, 5])
def test_distinct_shingles(k):
    data, offsets = joined(TEXTS)
    _, where = near_dup.distinct_shingles(data, offsets, k)
    assert np.diff(where).tolist() == [len(odd.shingle_set(t, k)) for t in TEXTS]


def test_base_measures():
    data, offsets = joined(TEXTS)
    got = list(zip(*[x.tolist() for x in quality.base_measures(data, offsets)]))
    assert got == [odd.base_measures(t) for t in TEXTS]


def test_chunks_hold_all_texts():
    column = pa.array(TEXTS * 3, pa.large_string())[2:]
    got = [bytes(data[a:b]).decode() for _, _, data, offsets in text_chunks(column, 1000, 5) for a, b in zip(offsets, offsets[1:])]
    assert got == (TEXTS * 3)[2:]


def test_encoder_equals_the_library():
    path = tokenizer_file()
    encoder = token_files.Encoder(path, token_files.character_classes(path))
    random.seed(3)
    alphabet = "ab 's're've'll'd'm't\n\t  é½12٣中  ́!?.\"'_-\U0001F600ßÅ\x00\x1c"
    texts = TEXTS + ["".join(random.choice(alphabet) for _ in range(random.randrange(60))) for _ in range(3000)]
    texts += ["a<|endoftext|>b", "''s", "\n's", "x'sabc 's", "  's", "it's'll've"]
    for lot in (texts[i:i + 50] for i in range(0, len(texts), 50)):
        ids, sizes = encoder.encode(*joined(lot))
        want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in lot]
        assert sizes.tolist() == list(map(len, want))
        assert ids.tolist() == [i for x in want for i in x]


def test_every_code_point_is_classed_as_the_library_does():
    path = tokenizer_file()
    encoder = token_files.Encoder(path, token_files.character_classes(path))
    points = [c for c in range(0x30000) if not 0xD800 <= c <= 0xDFFF]
    lot = ["".join(f"a{chr(c)}a1{chr(c)}1!{chr(c)}! {chr(c)} " for c in points[i:i + 512]) for i in range(0, len(points), 512)]
    split = encoder.tokenizer.pre_tokenizer.pre_tokenize_str
    for text in lot:
        starts = token_files.piece_starts(np.frombuffer(text.encode("utf-32-le"), np.uint32), np.array([0, len(text)]), encoder.classes)
        assert starts.tolist() == [a for _, (a, _) in split(text)]


def test_compressed_registers():
    values = np.array([2**63, 2**62 + 2**60, 1, 0, 2**64 - 1], np.uint64)
    got = near_dup.compress(values).tolist()
    assert got == [0 << 10 | 0, 1 << 10 | 0b0100000000, 63 << 10, 63 << 10, 0 << 10 | 0b1111111111]


def test_jaccard_estimate_is_close():
    random.seed(5)
    for shared, own in ((400, 40), (300, 200), (30, 3), (0, 300)):
        errors = []
        for _ in range(20):
            both = [random.getrandbits(60) for _ in range(shared)]
            sets = [sorted(both + [random.getrandbits(60) for _ in range(own)]) for _ in range(2)]
            rows = near_dup.sketches(np.array(sets[0] + sets[1], np.uint64), np.array([0, shared + own, 2 * (shared + own)]))
            n = np.array([shared + own])
            errors.append(near_dup.estimate(np.array([(rows[0] == rows[1]).sum()]), n, n)[0] - shared / (shared + 2 * own))
        assert abs(np.mean(errors)) < 0.02 and max(map(abs, errors)) < near_dup.MARGIN


def test_band_rows_keep_pairs_at_the_threshold():
    for similarity in (0.8, 0.85, 0.9):
        r = near_dup.band_rows(similarity)
        assert (1 - similarity**r) ** (near_dup.REGISTERS // r) <= near_dup.MISS


def test_index_finds_all_fingerprints_within_the_radius_and_no_others():
    random.seed(7)
    prints = np.array([random.getrandbits(64) for _ in range(200)], np.uint64)
    queries = []
    for k in range(600):
        x = int(prints[k % 200])
        for bit in random.sample(range(64), k % 12):
            x ^= 1 << bit
        queries.append(x)
    queries = np.array(queries, np.uint64)
    left, right = decontam.Index(prints, np.zeros((200, 2), np.int64)).find(queries)
    near = np.bitwise_count(queries[:, None] ^ prints[None, :]) <= decontam.RADIUS
    assert set(zip(left.tolist(), right.tolist())) == set(zip(*map(list, np.nonzero(near))))


def plain_kneser_ney(texts, order):
    """log p of every n-gram by recursion over counts, as a function."""
    levels = {order: Counter()}
    for t in texts:
        padded = (0,) * (order - 1) + tuple(t)
        levels[order].update(padded[i:i + order] for i in range(len(t)))
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    discount = {}
    for n, c in levels.items():
        t1, t2, t3, t4 = (sum(1 for v in c.values() if v == k) for k in (1, 2, 3, 4))
        if min(t1, t2, t3, t4) == 0:
            discount[n] = ngrams.PLAIN_DISCOUNTS
        else:
            y = t1 / (t1 + 2 * t2)
            discount[n] = tuple(max(0.0, k - (k + 1) * y * b / a) for k, (a, b) in enumerate(((t1, t2), (t2, t3), (t3, t4)), 1))
    contexts = {n: defaultdict(list) for n in levels}
    for n, c in levels.items():
        for g, v in c.items():
            contexts[n][g[:-1]].append((v, discount[n][min(v, 3) - 1]))

    def p(gram, symbols):
        n = len(gram)
        if n == 0:
            return 1 / symbols
        rows = contexts[n].get(gram[:-1])
        if not rows:
            return p(gram[1:], symbols)
        total, held = sum(v for v, _ in rows), sum(d for _, d in rows)
        c = levels[n].get(gram, 0)
        own = (c - discount[n][min(c, 3) - 1]) / total if c else 0.0
        return own + held / total * p(gram[1:], symbols)

    return p


def test_spark_model_equals_plain_kneser_ney(spark):
    random.seed(9)
    texts = ["".join(random.choice("aabbbcde ") for _ in range(random.randrange(0, 80))) for _ in range(60)]
    df = spark.createDataFrame([(["g"], t) for t in texts], "grps array<string>, text string")
    counts = ngrams.count_ngrams(df, ngrams.byte_tokens, 3, 8)
    model = ngrams.load_models(ngrams.kneser_ney(counts, 3, 8, 256, share=0.0), 3, 8, 256)["g"]
    p = plain_kneser_ney([t.encode() for t in texts], 3)
    seen = texts + ["zzz", "az q", "ed cba aab", "\x00\x00"]
    data, offsets = joined(seen)
    got = model.log_probabilities(ngrams.pack(data, offsets, 3, 8))
    want = [math.log(p(((0, 0) + tuple(t.encode()))[i:i + 3], 256)) for t in seen for i in range(len(t.encode()))]
    assert np.allclose(got, want, atol=1e-5)
    # a stored model has at most 1 / share n-grams a level
    kept = ngrams.kneser_ney(counts, 3, 8, 256, share=0.02).filter("n > 0").groupBy("n").count().collect()
    assert kept and all(r["count"] <= 100 for r in kept)


def test_hash_array_finds_its_own_and_nothing_else():
    rng = np.random.default_rng(1)
    grams = np.unique(rng.integers(0, 2**40, 5000).astype(np.uint64))
    held = ngrams.HashArray(grams[::2], np.arange(len(grams[::2]), dtype=float), np.zeros(len(grams[::2])))
    at = held.find(grams)
    assert (at[1::2] == -1).all()
    assert (held.logp[at[::2]] == np.arange(len(grams[::2]))).all()
