"""The bucketed listing table: runs, compaction, versions, and equality with the plain merges."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from listmill import vocab as V
from listmill.operators import merge
from listmill.sources.listing_table import Conflict, ListingTable
from listmill.streaming.ingest import ingest
from tests.test_state import as_dict, batch, now, table


def fresh(spark, buckets=16, fan=3):
    return ListingTable(spark, tempfile.mkdtemp(prefix="run-") + "/t", buckets, fan)


def listings(spark, n=60):
    return table(spark, *[dict(id=f"id{i}", url=f"http://x/{i}" if i % 10 else "", title=f"T{i}", created_at=str(i), description=f"{random.Random(i).getrandbits(1600):x}" if n > 100 else "",
                               status=V.STATUSES[i % 3]) for i in range(n)])


def files(t, kind="rows"):
    """The files of each bucket of the newest version."""
    return {e.bucket: sorted(n for n in os.listdir(f"{t.path}/{e.path}") if n.endswith(".parquet")) for e in t.entries() if e.kind == kind}


def folder_size(path):
    return sum(os.path.getsize(f"{d}/{n}") for d, _, names in os.walk(path) for n in names if n.endswith(".parquet"))


def test_an_empty_table(spark):
    t = fresh(spark)
    assert t.version() == 0 and t.read().count() == 0 and t.settle() == 0 and t.vacuum() == []
    t.load(table(spark))
    assert t.read().count() == 0
    t.upsert(batch(spark, dict(id="a", url="http://x/a", title="A")), now())
    assert as_dict(t.read())["a"]["title"] == "A"
    t.settle()
    assert as_dict(t.read())["a"]["title"] == "A" and not t._runs(t.entries())


def test_untouched_buckets_keep_their_files(spark):
    t = fresh(spark)
    state = listings(spark)
    t.load(state)
    before, index = files(t), files(t, "ids")
    new = batch(spark, dict(id="n", url="http://x/1/", title="new"), dict(id="m", url="http://y/1", title="more"))
    t.upsert(new, now())
    assert files(t) == before
    t.settle()
    want = as_dict(merge.upsert_listings(state, new, now()))
    assert as_dict(t.read()) == want and len(want) == 61
    touched = {r.b for r in spark.createDataFrame([("http://x/1",), ("http://y/1",)], "k string").select(t.bucket(F.col("k")).alias("b")).collect()}
    after = files(t)
    assert {b for b in after if after[b] != before.get(b)} == touched
    assert sum(files(t, "ids")[b] != index.get(b) for b in files(t, "ids")) == 1  # the one new id


def test_reviews_deletes_and_tombstones(spark):
    t = fresh(spark)
    state = listings(spark)
    t.load(state)
    before = files(t)
    actions = spark.createDataFrame([("id1", 1, 1, "patch", "p"), ("id2", 2, 2, "save", None), ("id1", 3, 3, "patch", None), ("zz", 1, 4, "save", None)],
                                    "id string, ts_n int, event_id int, action string, pay_rate string").withColumn("ts", F.timestamp_seconds("ts_n"))
    folded = merge.fold_actions(actions, ["pay_rate"])
    t.review(folded)
    t.delete(spark.createDataFrame([("id5",), ("id5",), ("none",)], "id string"), "then")
    t.drop(spark.createDataFrame([("id7",)], "id string"))
    want = merge.apply_reviews(state, folded)
    want = as_dict(merge.mark_deleted(want, spark.createDataFrame([("id5",)], "id string"), F.lit("then")).where("id <> 'id7'"))
    assert as_dict(t.read()) == want
    t.settle()
    assert as_dict(t.read()) == want
    assert sum(files(t).get(b) != before[b] for b in before) <= 4
    assert [r.id for r in t.lookup(spark.createDataFrame([("id1",), ("id5",), ("id7",), ("zz",)], "id string")).collect()] == ["id1"]
    t.clear()
    assert set(as_dict(t.read())) == {i for i, r in want.items() if r["status"] == "saved"}
    t.settle()
    assert set(as_dict(t.read())) == {i for i, r in want.items() if r["status"] == "saved"}


def test_a_patched_url_moves_a_listing(spark):
    t = fresh(spark)
    t.load(listings(spark))
    actions = spark.createDataFrame([("id1", 1, 1, "patch", "http://moved/0")], "id string, ts_n int, event_id int, action string, url string")
    t.review(merge.fold_actions(actions.withColumn("ts", F.timestamp_seconds("ts_n")), ["url"]))
    t.settle()
    assert as_dict(t.read())["id1"]["url"] == "http://moved/0" and t.read().count() == 60
    ids = spark.createDataFrame([("id1",)], "id string")
    assert [r.url for r in t.lookup(ids).collect()] == ["http://moved/0"]
    t.upsert(batch(spark, dict(id="n", url="http://x/1", title="again")), now())  # the old key is free
    t.settle()
    got = as_dict(t.read())
    assert len(got) == 61 and got["n"]["title"] == "again" and got["id1"]["title"] == "T1"


def test_any_order_of_changes_equals_the_plain_merges(spark):
    rng = random.Random(1)
    t = fresh(spark, buckets=5, fan=2)
    want = listings(spark, 12)
    t.load(want)
    for step in range(9):
        kind = rng.choice(["upsert"] * 4 + ["review", "delete", "clear", "compact", "settle"])
        stamp = f"now{step}"
        if kind == "upsert":
            new = batch(spark, *[dict(id=f"s{step}-{i}", url=rng.choice([f"http://x/{rng.randrange(16)}/", ""]), title=rng.choice(["", f"t{step}{i}"]),
                                      company=rng.choice(["", f"c{step}"]), status=rng.choice([*["unreviewed"] * 3, "saved"]), updated_at=f"own{step}") for i in range(6)])
            t.upsert(new, F.lit(stamp))
            want = merge.upsert_listings(want, new, F.lit(stamp))
        elif kind == "review":
            acts = spark.createDataFrame([(f"id{rng.randrange(12)}", step, i, "patch", rng.choice([None, f"p{step}"])) for i in range(3)],
                                         "id string, ts_n int, event_id int, action string, pay_rate string").withColumn("ts", F.timestamp_seconds("ts_n"))
            t.review(merge.fold_actions(acts, ["pay_rate"]))
            want = merge.apply_reviews(want, merge.fold_actions(acts, ["pay_rate"]))
        elif kind == "delete":
            ids = spark.createDataFrame([(f"id{rng.randrange(12)}",)], "id string")
            t.delete(ids, stamp)
            want = merge.mark_deleted(want, ids, F.lit(stamp))
        elif kind == "clear":
            t.clear()
            want = merge.clear_queue(want)
        elif kind == "compact":
            t.compact()
        else:
            t.settle()
        want = spark.createDataFrame(want.collect(), want.schema)
    rows = sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, t.read().collect())) == rows
    t.compact()
    t.settle()
    assert sorted(map(tuple, t.read().collect())) == rows


def test_runs_follow_the_batch_and_are_folded_by_level(spark):
    t = fresh(spark, fan=3)
    t.load(listings(spark, 3000))
    whole = folder_size(f"{t.path}/data")
    for i in range(9):
        t.upsert(batch(spark, dict(id=f"n{i}", url=f"http://x/{i + 1}", title=f"new{i}")), now(), name="s", number=i)
        assert t.upsert(batch(spark, dict(id="other")), now(), name="s", number=i) == t.version()  # a replay
        t.compact()
    runs = t._runs(t.entries())
    assert [(r.level, r.rows) for r in runs] == [(2, 9)]
    written = folder_size(f"{t.path}/data") - whole
    assert written < whole / 2
    assert sum(r["title"].startswith("new") for r in as_dict(t.read()).values()) == 3  # the unreviewed of the nine
    assert t.settle_at(0.5) == t.version() and t._runs(t.entries())
    t.settle_at(0.001)
    assert not t._runs(t.entries())


def test_versions_conflicts_and_pins(spark):
    t = fresh(spark)
    first = t.load(listings(spark))
    other = ListingTable(spark, t.path, buckets=99)
    assert other.buckets == 16
    entries, base = other.entries(), other.version()
    t.upsert(batch(spark, dict(id="n", url="http://x/1", title="new")), now())
    with pytest.raises(Conflict):
        other._commit(entries, base)
    with t.pinned(first) as version:
        t.settle()
        t.upsert(batch(spark, dict(id="o", url="http://x/4", title="new")), now())
        t.settle()
        t.vacuum(keep=1)
        assert set(t.versions()) == {version, t.version()}
        assert t.read(version).count() == 60 and as_dict(t.read(version))["id1"]["title"] == "T1"
    gone = t.vacuum(keep=1)
    assert gone and t.versions() == [t.version()] and t.read().count() == 60
    needed = {e.path.split("/bucket=")[0] for e in t.entries() if e.path}
    assert {f"data/{n}" for n in os.listdir(f"{t.path}/data")} == needed


def test_an_unfinished_version_does_not_count(spark):
    t = fresh(spark)
    t.load(listings(spark))
    version = t.upsert(batch(spark, dict(id="n", url="http://new/", title="new")), now())
    os.remove(f"{t.path}/manifests/m={version:010d}/_SUCCESS")
    assert t.read().count() == 60 and t.version() == version - 1
    assert t.upsert(batch(spark, dict(id="n", url="http://new/", title="new")), now()) == version + 1
    assert t.read().count() == 61


def test_ingest_settles_and_replays(spark):
    base = tempfile.mkdtemp(prefix="run-")
    rows = batch(spark, *[dict(id=f"n{i}", url=f"http://x/{i % 40}", title="" if i % 3 else f"t{i}") for i in range(90)])
    for i in range(4):
        rows.where(F.floor(F.col("seq") / 25) == i).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    ListingTable(spark, f"{base}/t", 8, 2).load(listings(spark))
    def told(df):  # a listing that one batch adds and another refreshes was updated, one that a single batch brings wasn't
        return as_dict(df.drop("updated_at"))

    want = told(merge.upsert_listings(listings(spark), rows, now()))
    assert told(ingest(stream, f"{base}/t", now(), path=f"{base}/stream")) == want
    assert told(ingest(stream, f"{base}/t", now(), path=f"{base}/stream")) == want
