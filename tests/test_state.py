"""The listing table: merges, reviews, snapshots, exports, streams."""

import csv
import json
import os
import tempfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from listmill import vocab as V
from listmill.operators import merge, report
from listmill.schema import LISTING
from listmill.sources import snapshot
from listmill.streaming.ingest import ingest
from listmill.streaming.progress import change_only, change_only_stream, progress, progress_stream
from listmill.streaming.reviews import review_stream

def now():
    return F.lit("now")


def listing(**given):
    row = {**{c: "" for c in V.LISTING_FIELDS}, "status": "unreviewed", **given}
    return tuple(row[c] for c in V.LISTING_FIELDS)


def table(spark, *rows):
    return spark.createDataFrame([listing(**r) for r in rows], LISTING)


def batch(spark, *rows):
    df = spark.createDataFrame([(i, *listing(**r)) for i, r in enumerate(rows)],
                               "seq int, " + ", ".join(f"{c} string" for c in V.LISTING_FIELDS))
    return df


def as_dict(df):
    return {r.id: r.asDict() for r in df.collect()}


def test_upsert_rules(spark):
    state = table(spark, dict(id="a", url="http://x/1", title="A", status="saved"), dict(id="b", url="http://x/2/", title="B"),
                  dict(id="c", url="http://x/3", title="C", status="deleted"), dict(id="d", url="", title="D"))
    new = batch(spark, dict(id="n1", url="HTTP://x/1/", title="new"), dict(id="n2", url="http://X/2", title="", company="co"),
                dict(id="n3", url="http://x/3", title="new"), dict(id="n4", url="http://x/4", title="one", company="k"),
                dict(id="n5", url="http://x/4/", title="two"), dict(id="d", url="", title="D2"))
    out = as_dict(merge.upsert_listings(state, new, now()))
    assert set(out) == {"a", "b", "c", "d", "n4"}
    assert out["a"]["title"] == "A" and out["c"]["title"] == "C"
    assert (out["b"]["title"], out["b"]["company"], out["b"]["updated_at"]) == ("B", "co", "now")
    assert (out["n4"]["title"], out["n4"]["company"], out["n4"]["url"]) == ("two", "k", "http://x/4")
    assert out["d"]["title"] == "D2"


def test_upsert_refreshes_the_newest_of_two_listings_with_one_key(spark):
    state = table(spark, dict(id="a", url="http://x/1", title="A", created_at="1"), dict(id="b", url="http://x/1/", title="B", created_at="2"))
    out = as_dict(merge.upsert_listings(state, batch(spark, dict(id="n", url="http://x/1", title="N")), now()))
    assert (out["a"]["title"], out["b"]["title"]) == ("A", "N")


texts = st.sampled_from(["", "x", "y"])
rows = st.lists(st.tuples(st.integers(0, 4), texts, texts, st.sampled_from(V.STATUSES)), min_size=1, max_size=8)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows, rows)
def test_upsert_twice_is_upsert_once(spark, old, new):
    seen = {}
    for k, t, c, s in old:
        seen.setdefault(k, dict(id=f"s{k}", url=f"http://x/{k}", title=t, company=c, status=s))
    state = table(spark, *seen.values())
    more = batch(spark, *[dict(id=f"n{i}", url=f"http://x/{k}/", title=t, company=c) for i, (k, t, c, _) in enumerate(new)])
    once = merge.upsert_listings(state, more, now())
    first = as_dict(once)
    assert as_dict(merge.upsert_listings(once, more, now())).keys() == first.keys()
    twice = as_dict(merge.upsert_listings(once, more, now()))
    assert all({**twice[i], "updated_at": ""} == {**first[i], "updated_at": ""} for i in first)
    for k, r in seen.items():
        if r["status"] != "unreviewed":
            assert first[f"s{k}"]["title"] == r["title"]


def actions(spark):
    return spark.createDataFrame([
        ("a", 1, 1, "patch", "p1", None, None), ("a", 2, 2, "delete", None, None, None), ("a", 3, 3, "patch", None, "n3", None),
        ("b", 1, 4, "patch", "p4", None, "unreviewed"), ("c", 5, 5, "delete", "ignored", None, None),
        ("zz", 1, 6, "save", None, None, None), ("d", 1, 7, "view", "x", "x", None)],
        "id string, ts_n int, event_id int, action string, pay_rate string, notes string, status string").withColumn(
        "ts", F.timestamp_seconds("ts_n"))


def test_reviews(spark):
    state = table(spark, *[dict(id=i, title=i, pay_rate="old") for i in "abcd"])
    folded = merge.fold_actions(actions(spark), ["pay_rate", "notes", "status"])
    out = as_dict(merge.apply_reviews(state, folded))
    assert (out["a"]["status"], out["a"]["pay_rate"], out["a"]["notes"]) == ("saved", "p1", "n3")
    assert (out["b"]["status"], out["b"]["pay_rate"]) == ("unreviewed", "p4")
    assert (out["c"]["status"], out["c"]["pay_rate"]) == ("deleted", "old")
    assert (out["d"]["status"], out["d"]["updated_at"]) == ("unreviewed", "")
    assert [r.url for r in merge.unknown_reviews(state, folded).collect()] == ["zz"]


def test_snapshot_versions_and_replay(spark):
    path = tempfile.mkdtemp(prefix="run-") + "/listings"
    assert snapshot.read_listings(spark, path).count() == 0
    snapshot.write_listings(table(spark, dict(id="a")), path)
    two = table(spark, dict(id="a"), dict(id="b", status="saved"))
    version = snapshot.write_listings(two, path, "b1")
    assert snapshot.write_listings(two, path, "b1") == version
    assert snapshot.read_listings(spark, path).count() == 2
    os.remove(f"{path}/{version}/_SUCCESS")
    assert snapshot.read_listings(spark, path).count() == 1


def test_exports(spark):
    odd = 'say "hi", \nzwölf  '
    state = table(spark, dict(id="a", status="saved", title=odd, notes=" n "), dict(id="b"))
    base = tempfile.mkdtemp(prefix="run-")
    snapshot.export_json(state, f"{base}/j")
    snapshot.export_csv(state, f"{base}/c")

    def parts(folder):
        names = sorted(n for n in os.listdir(folder) if n.startswith("part-"))
        return [open(f"{folder}/{n}", encoding="utf-8", newline="") for n in names]

    lines = [x for f in parts(f"{base}/j") for x in f.read().splitlines()]
    assert len(lines) == 1 and list(json.loads(lines[0])) == V.LISTING_FIELDS and "zwölf" in lines[0]
    files = [list(csv.reader(f)) for f in parts(f"{base}/c")]
    assert all(rows[0] == V.CSV_FIELDS for rows in files if rows)
    data = [dict(zip(V.CSV_FIELDS, r)) for rows in files for r in rows[1:]]
    assert len(data) == 1 and data[0]["title"] == odd and data[0]["notes"] == " n "


@pytest.fixture()
def landed(spark):
    """The same rows as one table and as three files that arrive in order."""
    base = tempfile.mkdtemp(prefix="run-")
    df = spark.range(300).select(
        F.col("id").cast("int").alias("event_id"), F.timestamp_seconds(F.col("id")).alias("ts"), (F.col("id") % 4).alias("run_id"),
        F.element_at(F.array(*[F.lit(x) for x in "abb"]), (F.floor(F.col("id") / 5) % 3 + 1).cast("int")).alias("message"),
        F.when(F.col("id") % 7 == 0, F.col("id")).alias("collected"))
    for i in range(3):
        df.where((F.col("event_id") >= i * 100) & (F.col("event_id") < i * 100 + 100)).coalesce(1).write.mode("append").parquet(base)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(base)
    return df, stream


def same(a, b):
    return sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(a.columns)).collect()))


def test_streams_equal_batches(spark, landed):
    df, stream = landed
    fields = ["message", "collected"]
    assert same(progress(df, fields), progress_stream(stream, fields))
    assert same(change_only(df, ["message"]), change_only_stream(stream, ["message"]))
    acts = [d.select(F.col("run_id").cast("string").alias("id"), "ts", "event_id",
                     F.when(F.col("message") == "a", "patch").otherwise("view").alias("action"),
                     F.col("collected").cast("string").alias("notes")) for d in (df, stream)]
    assert same(merge.fold_actions(acts[0], ["notes"]), review_stream(acts[1], ["notes"]))


def test_ingest_equals_one_batch(spark):
    base = tempfile.mkdtemp(prefix="run-")
    rows = [dict(id=f"n{i}", url=f"http://x/{i % 7}", title="" if i % 3 else f"t{i}") for i in range(30)]
    all_rows = batch(spark, *rows)
    for i in range(3):
        all_rows.where(F.floor(F.col("seq") / 10) == i).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(all_rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    got = {r.url: r.title for r in ingest(stream, f"{base}/s", now()).collect()}
    want = {r.url: r.title for r in merge.upsert_listings(table(spark).limit(0), all_rows, now()).collect()}
    assert got == want and len(got) == 7


def test_outcomes(spark):
    cases = spark.createDataFrame([(0, 2, 5), (0, 0, 5), (3, 0, 5), (5, 1, 5), (5, 0, 5)], "g bigint, f bigint, t bigint")
    out = report.outcome_columns(F.col("g"), F.col("f"), F.col("t"))
    got = [(r.error, r.message) for r in cases.select(*[c.alias(n) for n, c in out.items()]).collect()]
    assert got[0][0] == got[0][1] == "Search failed — no contract jobs collected (2 source error(s))."
    assert got[1][0].startswith("No matching contract jobs found.")
    assert got[2][1].startswith("Only found 3 of 5 requested.")
    assert got[3] == ("Finished with 1 source warning(s).", "Done. Collected 5 / 5 matching contract jobs.")
    assert got[4] == (None, "Done. Collected 5 / 5 matching contract jobs.")


def test_actions_with_an_unknown_status_change_nothing(spark):
    actions = spark.createDataFrame(
        [("a", 1, 1, "patch", "saved", "x"), ("a", 2, 2, "patch", "archived", "y"), ("b", 1, 3, "patch", None, "z")],
        "id string, ts int, event_id int, action string, status string, notes string")
    folded = merge.fold_actions(actions, ["status", "notes"]).select("id", "_status", "_notes").collect()
    assert sorted(map(tuple, folded)) == [("a", "saved", "x"), ("b", "saved", "z")]
    assert [tuple(r) for r in merge.bad_reviews(actions).collect()] == [("a", "Unknown status: archived")]
