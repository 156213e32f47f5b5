"""Every corpus operator on odd rows against a brute-force version, on empty tables, and on planted cases."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from listmill.llm import decontam, fixity, line_runs, mixing, near_dup, ngrams, pii, quality, scoring, token_files, url_rules
from listmill.llm.components import components
from listmill.llm.queries import URL_RULES, WEIGHTS, tokenizer_file
from listmill.llm.shared import NO_ID
from tests.llm import odd

ITEM = " ".join(f"question{i} of the benchmark{i * 5 % 11}" for i in range(15))


@pytest.fixture(scope="module")
def docs(spark):
    return odd.frame(spark)


@pytest.fixture(scope="module")
def none(spark):
    return odd.frame(spark, [])


@pytest.fixture(scope="module")
def crowd(spark):
    """Generated documents: one hot source, copies, near copies, junk."""
    random.seed(1)
    vocabulary = ["".join(random.choice("aeinorst") for _ in range(random.randrange(2, 9))) for _ in range(400)]
    texts = []
    for i in range(300):
        w = [random.choice(vocabulary) for _ in range(random.randrange(15, 120))]
        if i % 10 == 3:
            w = list(texts[i - 1].split(" "))
            w[random.randrange(len(w))] = "changed"
        if i % 10 == 5:
            w = texts[0].split(" ")
        if i == 77:
            w = ["".join(chr(random.randrange(34, 127)) for _ in range(6)) for _ in range(150)]
        texts.append(" ".join(w))
    rows = [(i, t, "en" if i % 3 else "de", "hot" if i % 3 == 0 else f"s{i % 7}", len(t), *odd.CLASH) for i, t in enumerate(texts)]
    return odd.frame(spark, rows)


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# -- quality ---------------------------------------------------------------------------

def test_quality_base_on_odd_rows(docs):
    got = sorted(quality.judge_quality(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.n_words))
    want = sorted(((i, odd.base_measures(t)) for i, t, *_ in odd.rows()), key=lambda r: (r[0] is None, r[0], r[1]))
    assert [(r.doc_id, tuple(r[c] for c in quality.BASE)) for r in got] == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_rejects_what_the_language_does_not_look_like(crowd):
    rows = {r.doc_id: r for r in quality.judge_quality(crowd).collect()}
    assert len(rows) == 300
    assert not rows[77].kept and rows[77].loss > rows[77].upper
    assert sum(not r.kept for i, r in rows.items() if i != 77) <= 3


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_random_characters_of_a_small_language_are_rejected(spark):
    """What a language's model has counted itself would look best predicted; the other half's model hasn't."""
    random.seed(6)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    junk = [(10**6 + i, " ".join("".join(chr(random.randrange(34, 127)) for _ in range(6)) for _ in range(100)), "es" if i % 3 == 0 else "en") for i in range(90)]
    rows = quality.judge_quality(docs.unionByName(spark.createDataFrame(junk, "doc_id long, text string, lang string"))).collect()
    assert not [r for r in rows if r.doc_id >= 10**6 and r.kept]
    clean = [r for r in rows if r.doc_id < 10**6 and not r.base_failed]
    assert sum(r.kept for r in clean) > 0.9 * len(clean)


def test_copies_do_not_set_the_band(crowd):
    """One text in over three quarters of a language's rows leaves all results as they are without its copies."""
    one = crowd.filter("lang = 'de' AND doc_id = 0")
    copies = one.crossJoin(crowd.sparkSession.range(1000, 1400).withColumnRenamed("id", "copy")).withColumn("doc_id", F.col("copy")).select(crowd.columns)
    want = {r.doc_id: (r.kept, round(r.loss, 9), r.lower, r.upper) for r in quality.judge_quality(crowd).collect()}
    got = {r.doc_id: (r.kept, round(r.loss, 9), r.lower, r.upper) for r in quality.judge_quality(crowd.unionByName(copies)).collect()}
    assert {i: r for i, r in got.items() if i < 1000} == want
    assert {r for i, r in got.items() if i >= 1000} == {want[0]}


def test_losses_are_of_the_whole_models(spark):
    """Also where a half has many more counts than n-grams that tasks hold; the others meet theirs in a join."""
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 101, 3000, dtype=np.uint8)).decode() + "".join(chr(c) for c in rng.integers(33, 120, 20)) for _ in range(120)]
    texts += texts[:30]
    df = spark.createDataFrame([(i, t, "en" if i % 30 else None) for i, t in enumerate(texts)] + [(None, None, "en"), (999, "", "en")], "doc_id long, text string, lang string")
    models = ngrams.load_models(ngrams.kneser_ney(quality.language_counts(df), 5, 8, 256, share=0.0), 5, 8, 256)
    half = {r.text: r.half for r in df.select("text", F.pmod(F.xxhash64("text"), F.lit(2)).alias("half")).collect()}
    for held in (0, 700, quality.HELD):
        rows = quality.measured(df, held).collect()
        assert len(rows) == len(texts) + 2 and all(r.loss is None for r in rows if r.doc_id in (None, 999))
        for r in rows:
            if r.loss is not None:
                data = np.frombuffer(texts[r.doc_id].encode(), np.uint8)
                model = models.get(f"{1 - half[texts[r.doc_id]]}:{r.language}", ngrams.even_model(5, 8, 256))
                want = -model.log_probabilities(ngrams.pack(data, np.array([0, len(data)]), 5, 8)).mean()
                assert r.loss == pytest.approx(want, abs=1e-5)


def test_kept_documents_have_all_columns(docs, none):
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns
    judged = quality.judge_quality(docs).filter("kept").count()
    assert kept.count() == judged
    assert quality.judge_quality(none).count() == 0 and quality.kept_documents(none).count() == 0


def test_the_filter_of_repeated_hashes_misses_none(spark):
    rows = spark.range(5000).select(F.xxhash64((F.col("id") % 4000)).alias("h"))
    bits = quality.repeated_filter(rows, 16)
    assert bits.dtype == np.int64 and len(bits) == 1 << 10
    again = rows.groupBy("h").count().select(F.array(*[F.pmod(F.xxhash64("h", F.lit(s)), F.lit(1 << 16)) for s in range(quality.FILTER_PROBES)]).alias("at"), "count").collect()
    hit = {r["count"]: [] for r in again}
    for r in again:
        hit[r["count"]].append(all((int(bits[p >> 6]) >> (p & 63)) & 1 for p in r["at"]))
    assert all(hit[2]) and sum(hit[1]) < 0.1 * len(hit[1])
    assert not quality.repeated_filter(rows.filter("h is null"), 16).any()


# -- lines -----------------------------------------------------------------------------

@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2)])
def test_line_dedup(docs, batches, fanout):
    numbered = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(1000) + F.length("text")))
    got = sorted(tuple(r) for r in line_runs.dedup_lines(numbered, batches, fanout).drop("kept_text").collect())
    assert got == sorted(odd.line_dedup(pairs_of(numbered)))


def test_line_dedup_without_ids_and_rows(docs, none):
    got = line_runs.dedup_lines(docs).collect()
    assert len(got) == len(odd.rows())
    # of the rows without an id, each is behind all others
    assert {(r.n_lines, r.n_dropped) for r in got if r.doc_id is None} == {(1, 0)}
    assert line_runs.dedup_lines(none).count() == 0


def test_runs_are_levelled_and_sorted(spark, docs):
    runs = line_runs.LineRuns(spark, buckets=4, fanout=2)
    keys = line_runs.line_keys(docs.filter("doc_id is not null"))
    for k in range(5):
        runs.add(keys.filter(F.pmod("doc", F.lit(5)) == k))
    assert sorted(level for level, _ in runs.runs) == [0, 2]
    assert runs.owners().groupBy("h1", "h2").count().filter("count > 1").isEmpty()
    plan = keys.join(spark.table(runs.runs[0][1]).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the run isn't shuffled
    runs.drop()


# -- personal data -----------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for n, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            fits = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if fits:
                out.append((m.start(), n, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def private_texts():
    random.seed(4)
    texts = [t for _, t, *_ in odd.rows()]
    cards = ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "41111111111111112222", "4111  1111 1111 1111"]
    marks = ["a@b.c.d", "@x.y", "x@y", "a@b.com@c.de", ".@-.-", "1.2.3.4.5.6.7.8", "256.1.1.1", "0000255.1.1.1", "+1 (017) 555-7713", "+1-2", "++12345678901 ", *cards]
    texts += ["".join(random.choice(["0", "1", "9", " ", "-", ".", "+", "@", "a", "(", ")", "\n", *marks]) for _ in range(40)) for _ in range(150)]
    texts += ["1 " * 3_000, "a.b@" * 300, "1." * 300, "a@" + "b." * 30_000 + "c", "+" + "1 " * 3_000, "7" * 60_000]
    for i in range(40):
        texts.append(f"some words before token = \"{random.getrandbits(160):040x}\" and after, order 12345{i:05d} ok")
        texts.append(f"call now +1 (0{i:02d}) 555-77{i:02d} or mail me{i}@site.org about version 2023{i:03d}4567")
    return texts


def test_personal_data(spark):
    texts = private_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.find_personal_data(df)
    rows = {r.doc_id: r for r in pii.span_digest(found).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        base = plain_base(t)
        assert rows[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest(), t[:80]
        assert [rows[i][f"n_{k}"] for k in PATTERNS] == [base.count(f"{k}:") for k in PATTERNS]
        spans = [x.split(":") for x in rows[i].spans.split(",") if x]
        assert set(filter(None, base.split(","))) <= {":".join(x) for x in spans}
        ends = sorted((int(a), int(b)) for k, a, b in spans if f"{k}:{a}:{b}" not in base)
        assert all(b <= c for (_, b), (c, _) in zip(ends, ends[1:]))  # added spans don't overlap
    secret = [i for i, t in enumerate(texts) if t and "token = " in t]
    caught = [i for i in secret if f"secret:{texts[i].index(chr(34)) + 1}:" in rows[i].spans]
    assert len(caught) >= 0.9 * len(secret)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "Exchange" not in plan
    text = {r.doc_id: r.redacted for r in pii.redacted(found).collect()}
    assert all("@site.org" not in (text[i] or "") and "[EMAIL]" in text[i] for i, t in enumerate(texts) if t and "@site.org" in t)


def test_personal_data_on_odd_rows(docs, none):
    got = pii.span_digest(pii.find_personal_data(docs)).collect()
    assert len(got) == len(odd.rows())
    assert pii.span_digest(pii.find_personal_data(none)).count() == 0


def test_personal_data_is_fitted_on_all_documents(spark):
    """Over 20,000 documents: every candidate counts, also those that few documents hold."""
    rare = spark.range(40).select((F.col("id") * 997).alias("doc_id"), F.concat(F.lit("word token = \""), F.sha2(F.col("id").cast("string"), 256), F.lit("\" word")).alias("text"))
    rest = spark.range(40_000).select((F.col("id") + 50_000).alias("doc_id"), F.concat(F.lit("order 12345"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit(" ok")).alias("text"))
    rows = pii.examples(rare.union(rest))
    assert {(r.label, r.n) for r in rows.groupBy("label").agg(F.sum("n").alias("n")).collect()} == {(1.0, 40), (0.0, 40_000)}
    edges = pii.edges_of(rows.filter("part < 2"))
    assert ("credential", 0.5) in edges and ("is_id", 0.5) in edges and len(edges) <= 31 * len(pii.FEATURES)
    found = pii.span_digest(pii.find_personal_data(rare.union(rest))).filter("spans <> ''").collect()
    assert len(found) == 40 and all(r.spans == "secret:14:78" for r in found)


# -- decontamination --------------------------------------------------------------------

def test_decontamination(spark, docs, none):
    w = ITEM.split(" ")
    changed = [*w[:30], "altered", *w[31:]]
    planted = {100: "before " * 3 + ITEM + " after it" * 5, 101: "intro text " + ITEM.upper().replace(" ", "\n") + "!", 102: " ".join(changed),
               103: " ".join(w[:20]) + " then something else entirely " + " ".join(f"x{i}" for i in range(60)), 104: " ".join(w[4:]), 105: ITEM + " " + ITEM}
    df = docs.unionByName(odd.frame(spark, [(i, t, "en", "a", 0, *odd.CLASH) for i, t in planted.items()]))
    items = spark.createDataFrame([(1, ITEM, 5), (2, odd.PASSAGE, 5), (3, None, 5), (4, "too short", 5), (5, "five words are one shingle", 5), (None, ITEM, 5)], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.matches(df, items).collect()}
    sure = {(100, 1), (101, 1), (105, 1), (9, 2), (10, 2)}
    assert sure <= set(got) and all(got[k] == 1.0 for k in sure)
    assert {k[0] for k in got} <= {100, 101, 102, 104, 105, 9, 10}
    assert (104, 1) in got and 0.8 <= got[104, 1] < 1.0
    assert (102, 1) in got and got[102, 1] == pytest.approx(51 / 61)
    clean = decontam.clean_documents(df, items)
    assert clean.columns == df.columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in df.collect()} - {k[0] for k in got}
    assert decontam.matches(none, items).count() == 0
    assert decontam.matches(docs, items.filter("item_id > 99")).count() == 0
    assert decontam.clean_documents(docs, items.filter("item_id > 99")).count() == docs.count()


def edited(w, edits):
    w = list(w)
    for _ in range(edits):
        at = random.randrange(len(w))
        kind = random.randrange(4)
        if kind == 0:
            w[at] = f"new{random.random()}"
        elif kind == 1:
            del w[at]
        elif kind == 2:
            w.insert(at, f"more{random.random()}")
        else:  # a part is moved
            w = w[at:] + w[:at]
    return w


def test_edited_items_are_found_down_to_the_similarity(spark):
    """Against brute force over all windows: every copy at 0.8 or more, with its best similarity."""
    random.seed(8)
    items = [[f"i{k}w{random.randrange(80)}" for _ in range(n)] for k, n in enumerate([8, 15, 20, 30, 45, 50, 60, 100, 150, 300] * 3)]
    rows = []
    for k, w in enumerate(items):
        for edits in (1, 1, 1, 2, 3, 4, 6):
            around = [f"t{random.random()}" for _ in range(random.randrange(40))]
            cut = random.randrange(len(around) + 1)
            rows.append((len(rows), k, " ".join(around[:cut] + edited(w, min(edits, 1 + len(w) // 50)) + around[cut:])))

    def grams(w):
        return [tuple(w[i:i + 5]) for i in range(len(w) - 4)]

    def best(own, text):
        most, own_counts = 0.0, Counter(own)
        for a in range(1 - len(own), len(text)):
            window = text[max(0, a):a + len(own)]
            both = sum((own_counts & Counter(window)).values())
            most = max(most, both / (len(own) + len(window) - both))
        return most

    want = {(i, k): best(grams(items[k]), grams(t.split(" "))) for i, k, t in rows}
    want = {key: v for key, v in want.items() if v >= 0.8}
    got = decontam.matches(spark.createDataFrame(rows, "doc_id long, k long, text string"),
                           spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): pytest.approx(r.similarity) for r in got} == want
    assert len([v for v in want.values() if v < 0.9]) > 30


def test_item_blocks_change_nothing(spark, docs, monkeypatch):
    items = spark.createDataFrame([(k, odd.PASSAGE if k == 7 else f"{ITEM} {k}") for k in range(10)], "item_id long, text string")
    one = sorted(map(tuple, decontam.matches(docs, items).collect()))
    blocks = list(decontam.item_blocks(items, 3))
    assert [len(i) for i, _ in blocks] == [3, 3, 3, 1]
    monkeypatch.setattr(decontam, "item_blocks", lambda benchmark: iter(blocks))
    assert sorted(map(tuple, decontam.matches(docs, items).collect())) == one and one


# -- scoring -----------------------------------------------------------------------------

def test_cross_entropy_difference_ranks_target_like_texts_first(spark):
    random.seed(2)
    good, bad = [f"good{i}" for i in range(30)], [f"bad{i}" for i in range(30)]
    texts = [" ".join(random.choice(good if i % 2 else bad) for _ in range(40)) for i in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, None), (1000, "")], "doc_id long, text string")
    target = spark.createDataFrame([(i,) for i in range(1, 100, 2)] * 2 + [(None,)], "doc_id long")
    rows = {r.doc_id: r for r in scoring.cross_entropy_difference(df, target).collect()}
    assert len(rows) == 202 and rows[1000].score is None and rows[None].n_words == 0
    assert max(rows[i].score for i in range(101, 200, 2)) < min(rows[i].score for i in range(100, 200, 2))
    for r in rows.values():
        assert r.score is None or r.score == pytest.approx(r.target_loss - r.background_loss)


def test_scores_on_odd_rows(spark, docs, none):
    target = spark.createDataFrame([(1,), (7,)], "doc_id long")
    got = scoring.cross_entropy_difference(docs, target).collect()
    assert sorted(r.n_words for r in got) == sorted(len(odd.words(t)) for _, t, *_ in odd.rows())
    assert scoring.cross_entropy_difference(none, target).count() == 0
    assert scoring.cross_entropy_difference(docs, target.filter("doc_id > 99")).count() == len(odd.rows())


# -- near duplicates ---------------------------------------------------------------------

@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates(crowd, k, percent):
    want = odd.components(pairs_of(crowd), k, percent)
    got = {r.doc_id: r for r in near_dup.near_duplicates(crowd, k, percent).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (i == want[i]) and r.n_shingles >= 0 for i, r in got.items())


def test_near_duplicates_on_odd_rows(docs, none):
    items = [(NO_ID + n if i is None else i, t) for n, (i, t, *_) in enumerate(odd.rows())]
    want = odd.components(items, 3, 85)
    got = near_dup.near_duplicates(docs, 3, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == sorted(
        (i, len(odd.shingle_set(t, 3)), want[i]) for i, t in items if i < NO_ID)
    assert len([r for r in got if r.doc_id is None]) == 2
    kept = near_dup.first_documents(docs, 3, 85)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({i for i in want.values() if i < NO_ID})
    assert near_dup.near_duplicates(none).count() == 0 and near_dup.first_documents(none).count() == 0


def test_a_group_whose_hub_is_no_hub(spark):
    """All are close to the middle one, which has the largest id; the smallest id isn't linked with most of them."""
    random.seed(6)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(60):
        w = list(base)
        for at in random.sample(range(200), 4):
            w[at] = f"x{random.random()}"
        texts.append(" ".join(w))
    texts.append(" ".join(base))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = odd.components(list(enumerate(texts)), 3, 85)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, 3, 85).collect()}
    assert got == want and len(set(want.values())) < 30


def test_short_texts_are_linked_exactly(spark):
    """Texts of 5 to 20 words, each with a copy that lost or gained a word at an end, against brute force."""
    random.seed(11)
    rows, want = [], {}
    for i in range(0, 6000, 2):
        w = [f"w{i}x{j}" for j in range(random.choice([8, 8, 9, 9, random.randrange(5, 21)]))]
        pair = w, random.choice([w[1:], [*w, "more"], w[:-1]])
        sets = [odd.shingle_set(" ".join(x), 3) for x in pair]
        linked = 100 * len(sets[0] & sets[1]) >= 85 * len(sets[0] | sets[1])
        rows += [(i, " ".join(pair[0])), (i + 1, " ".join(pair[1]))]
        want |= {i: i, i + 1: i if linked else i + 1}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, 3, 85).collect()} == want
    assert sum(i != c for i, c in want.items()) > 1000


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 50)] + [(300, 299), (299, 298)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: 0 if n <= 40 else 100 if n < 200 else 298 for ab in links for n in ab}
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


# -- fixity ------------------------------------------------------------------------------

def page_rows():
    pages = [(i, f"https://h{i}.example/{i}", f"<p>page {i}</p>\r\n\r\nWARC/1.0\r\n" * (i % 4)) for i in range(300)]
    return pages + [(None, None, None), (None, "http://x/\r\n", "no id"), (5, "http://again/", "repeated id"), (5, "http://again/", "repeated id"), (-3, "u", "é" * 100), (1000, "u", "x" * 2_000_000)]


def test_audit_finds_damaged_records_alone(spark):
    pages = spark.createDataFrame([(*r, 1) for r in page_rows()], "page_id long, url string, html string, shard int")
    damage = F.coalesce(F.pmod("page_id", F.lit(50)) == 7, F.lit(False))
    got = fixity.audit_pages(pages, damage, per_file=20).collect()
    want = [(i, h) for i, _, h in page_rows() if i is not None and i % 50 == 7 and h]
    assert sorted(int(r.id) for r in got) == sorted(i for i, _ in want)
    assert all(r.status == "changed" and r.digest_a != r.digest_b for r in got)
    assert fixity.audit_pages(pages, F.lit(False), per_file=20).isEmpty()
    assert fixity.audit_pages(pages.filter("page_id = 77777"), F.lit(True)).isEmpty()


def test_audit_tells_lost_and_added_records(spark):
    pages = spark.createDataFrame(page_rows()[:300], "page_id long, url string, html string")
    records = fixity.page_records(pages, 4)
    paths = [fixity.work_dir(spark, "warc-test") for _ in range(2)]
    fixity.write_replicas(records.filter("page_id <> 123"), {"a": F.col("record")}, paths[0])
    fixity.write_replicas(records.filter("page_id NOT IN (9, 250)"), {"a": F.col("record")}, paths[1])
    got = {(int(r.id), r.status) for r in fixity.compare_replicas(spark, *[f"{p}/replica=a" for p in paths]).collect()}
    assert got == {(9, "missing"), (250, "missing"), (123, "extra")}


def test_offsets_lead_to_the_records(spark):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string")
    records = fixity.page_records(pages, 3)
    path = fixity.work_dir(spark, "warc-test")
    fixity.write_replicas(records, {"a": F.col("record")}, path)
    texts = {r.record for r in records.collect()}
    import gzip
    files = {}
    for r in spark.read.format("binaryFile").load(path).select("path", "content").collect():
        files[int(re.search(r"shard=(\d+)", r.path)[1])] = gzip.decompress(r.content)
    leaves = fixity.record_leaves(spark, path).collect()
    assert len(leaves) == len(page_rows())
    for r in leaves:
        piece = files[r.shard][r.first_byte:r.first_byte + r.n_bytes]
        assert hashlib.sha256(piece).hexdigest() == r.digest and piece.decode()[:-4] in texts
    assert sum(r.n_bytes for r in leaves) == sum(map(len, files.values()))


# -- mixing ------------------------------------------------------------------------------

def water_filled(sizes, weights, share=1.5, epochs=2):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full, budget = set(), share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        level = (budget - sum(epochs * sizes[s] for s in full)) / sum(w[s] for s in free) if free else 0
        over = {s for s in free if level * w[s] > epochs * sizes[s]}
        if not over:
            return {s: float(epochs * sizes[s]) if s in full else level * w[s] for s in order}
        full |= over


def check_mix(rows, texts):
    sizes, largest = {}, {}
    for s, t in texts:
        n = len(odd.words(t))
        sizes[s], largest[s] = sizes.get(s, 0) + n, max(largest.get(s, 0), n)
    targets, taken = water_filled(sizes, WEIGHTS), dict.fromkeys(sizes, 0)
    assert len(rows) == len(texts)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    slack = max(largest.values(), default=0)
    assert all(abs(taken[s] - targets[s]) <= 2 * slack + 1 for s in sizes)


def test_mix_hits_its_targets_and_reruns_agree(crowd):
    first = mixing.mix_sources(crowd, WEIGHTS).collect()
    check_mix(first, [(r.source, r.text) for r in crowd.collect()])
    assert sorted(map(tuple, first)) == sorted(map(tuple, mixing.mix_sources(crowd.repartition(7), WEIGHTS).collect()))


def test_mix_on_odd_rows(docs, none):
    rows = mixing.mix_sources(docs, WEIGHTS).collect()
    assert sorted(r.size for r in rows) == sorted(len(odd.words(t)) for _, t, *_ in odd.rows())
    assert all(r.taken <= 2 * r.size for r in rows)
    mixed = mixing.mixed_documents(docs, WEIGHTS)
    assert mixed.columns == docs.columns
    assert mixing.mixed_documents(docs.withColumn("_copy", F.lit("own")), WEIGHTS).filter("_copy = 'own'").count() == mixed.count()
    assert sum(len(odd.words(r.text)) for r in mixed.collect()) == sum(r.taken for r in rows)
    assert mixing.mix_sources(none, WEIGHTS).count() == 0 and mixing.mixed_documents(none, WEIGHTS).count() == 0


# -- token files -------------------------------------------------------------------------

def test_token_files_round_trip(docs, none):
    tokenizer = token_files._tokenizer(tokenizer_file())
    encoded = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, *_ in odd.rows()]
    got = token_files.encode_documents(docs, tokenizer_file()).collect()
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_crc32) for r in got) == sorted((-1 if i is None else i, len(x), crc(x)) for i, x in encoded)
    rows = sorted(got, key=lambda r: r.start)
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    ids = [r.doc_id if r.doc_id is not None else NO_ID for r in rows]
    assert ids == sorted(ids)
    assert token_files.encode_documents(none, tokenizer_file()).count() == 0


def test_token_files_are_encoded_and_indexed(spark, crowd, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write_token_files(crowd.coalesce(1), path, tokenizer_file(), options={"parquet.block.size": "20000", "parquet.page.size": "4096"})
    files = [os.path.join(path, f) for f in os.listdir(path) if f.endswith(".parquet")]
    seen = set()
    for f in files:
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                assert column.has_offset_index
                seen.add((column.path_in_schema.split(".")[0], *[e for e in column.encodings if "DICT" in e or "DELTA" in e]))
    assert any(x[0] == "ids" and "RLE_DICTIONARY" in x for x in seen)
    assert any(x[0] == "doc_id" and "DELTA_BINARY_PACKED" in x for x in seen)
    plan = token_files.token_starts(token_files.read_token_files(spark, path))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<slice:int,n_tokens:bigint>" in plan


# -- URL rules ---------------------------------------------------------------------------

def test_url_parts_and_fixed_rules(spark):
    urls = ["https://A.Example.NET/en/x?y#z", "http://example.net", "http://example.net/", "http://m.example.com/de/1", "http://badexample.com/de/1",
            "https://x.org/fr/", "https://x.org/frx", "ftp://org/fr/?a://b/", "no scheme", None, "", "://", "://host", "a?b://c.net/d", "http://h\nx/p\nq?r"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1)).withColumn("tokens", F.lit("x"))
    labels = spark.createDataFrame([], "id long, bad boolean")
    got = {r.page_id: r for r in url_rules.judge_urls(df, labels, URL_RULES).collect()}
    for i, url in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
        fits = [(h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0])) if fits else (None, "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), url
    assert url_rules.judge_urls(df.limit(0), labels, URL_RULES).count() == 0


def test_mined_rules_block_what_labels_call_bad(spark):
    urls = [f"http://{'casino' if i % 4 == 0 else 'news'}{i % 3}.site.org/{'win' if i % 4 == 0 else 'read'}/{i}?page={i}" for i in range(400)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 4 == 0) for i in range(0, 200)] + [(None, True), (3, None), (8, False)], "id long, bad boolean")
    got = {r.page_id: r for r in url_rules.judge_urls(df, labels, []).collect()}
    assert all((got[i].verdict == "block") == (i % 4 == 0) for i in range(400))
    mined = {r.mined_rule for r in got.values() if r.mined_rule}
    assert mined <= {f"host=casino{k}" for k in range(3)} | {"path=win"}  # wider rules are pruned
    assert all(r.confidence >= url_rules.MIN_CONFIDENCE for r in got.values() if r.mined_rule)
