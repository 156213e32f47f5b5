"""Hot keys: results stay whole and equal brute force when one key holds most rows."""

import random

from pyspark.sql import functions as F

from listmill.operators import crawl, merge, rank, slices
from listmill.streaming.progress import change_only, until_finished


def test_previous_and_next_over_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"k{i % 7}", i, rng.randint(0, 3)) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o int, v int").repartition(6)
    got = {(r.k, r.o): (r.prev_v, r.next_v) for r in slices.with_next(
        slices.with_previous(df, ["k"], ["o"], ["v"]), ["k"], ["o"], ["v"]).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        run = sorted((o, v) for k, o, v in rows if k == key)
        for i, (o, _) in enumerate(run):
            want[key, o] = (run[i - 1][1] if i else None, run[i + 1][1] if i + 1 < len(run) else None)
    assert got == want


def test_a_hot_group_spans_slices(spark):
    df = spark.range(20000).select(F.lit("hot").alias("k"), F.col("id").alias("o"))
    # Partitions this small would be merged again.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sliced = slices._sliced(df.repartition(4), ["k", "o"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    per = [r.n for r in sliced.groupBy("_slice").agg(F.count("*").alias("n")).collect()]
    assert sum(per) == 20000 and max(per) <= 20000 * 0.6


def test_positions(spark):
    df = spark.createDataFrame([(i * 7919 % 1000,) for i in range(1000)], "o int")
    got = {r.o: (r.position, r.total) for r in slices.with_position(df, ["o"]).collect()}
    assert got == {o: (o + 1, 1000) for o in range(1000)}


def test_change_only_on_one_long_run(spark):
    rng = random.Random(2)
    rows = [(7, i // 3, i, rng.choice(["a", "b"]), rng.random() < 0.001, False) for i in range(4000)]
    df = spark.createDataFrame(rows, "run_id int, ts int, event_id int, message string, finished boolean, running boolean")
    got = sorted(r.event_id for r in change_only(df, ["message"]).collect())
    assert got == [i for i in range(4000) if i == 0 or rows[i][3] != rows[i - 1][3]]
    end = next((r[2] for r in rows if r[4]), 3999)
    assert until_finished(df, ["ts", "event_id"]).count() == end + 1


def test_first_distinct_when_one_key_fills_the_head(spark):
    rows = [("hot", i) for i in range(500)] + [(f"k{i % 40}", 500 + i) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, o int").repartition(5)
    got = [(r.key, r.o) for r in rank.first_distinct(df, "key", ["o"], 20).orderBy("o").collect()]
    assert got == [("hot", 0)] + [(f"k{i}", 500 + i) for i in range(19)]
    few = spark.createDataFrame([("a", 1), ("a", 2)], "key string, o int")
    assert rank.first_distinct(few, "key", ["o"], 20).count() == 1


def brute_robots(url, rules):
    origin, path = url[: url.index("/", 8)], url[url.index("/", 8):].split("#")[0]
    mine = [r for r in rules if r[0] == origin]
    named = sorted((r for r in mine if r[2] != "*" and r[2] in "mozilla"), key=lambda r: r[1])
    group = named[0][2] if named else "*"
    for _, _, agent, allow, prefix in sorted(mine, key=lambda r: r[1]):
        if agent == group and (prefix in ("", "*") or path.startswith(prefix)):
            return allow or prefix == ""
    return True


def test_robots_on_a_hot_origin(spark):
    rng = random.Random(3)
    hosts = ["https://hot.example"] * 8 + ["https://b.example", "http://c.example"]
    rules = [(rng.choice(hosts), i, rng.choice(["*", "*", "moz", "googlebot", "mozilla"]), rng.random() < 0.5,
              rng.choice(["", "*", "/", "/a", "/a/b", "/jobs/1", "/jobs/1?x", "/z"])) for i in range(60)]
    rules = [r for r in rules if r[4] not in ("", "*") or rng.random() < 0.3]
    urls = [rng.choice(hosts) + rng.choice(["/", "/a", "/a/b/c?d#e", "/jobs/12", "/jobs/1?x=1", "/q"]) for _ in range(400)]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    robots = spark.createDataFrame(rules, "origin string, rule_order int, agent string, allow boolean, path_prefix string")
    got = sorted((r.url, r.allowed) for r in crawl.robots_filter(df, robots).collect())
    assert got == sorted((u, brute_robots(u, rules)) for u in urls)


def test_walk_with_cycles_and_a_hot_target(spark):
    nxt = {i: 0 for i in range(1, 200)} | {0: 500} | {500 + i: 501 + i for i in range(30)} | {530: 510, 900: 900}
    edges = spark.createDataFrame(list(nxt.items()), "node int, next_node int")
    seeds = [*range(1, 100), 900, 901]
    got = {(r.seed, r.node): r.hop for r in crawl.walk(spark.createDataFrame([(s,) for s in seeds], "node int"), edges, 37).collect()}
    want = {}
    for seed in seeds:
        node, hop = seed, 0
        while hop < 37 and (seed, node) not in want:
            want[seed, node] = hop
            if nxt.get(node, node) == node:
                break
            node, hop = nxt[node], hop + 1
    assert got == want


def test_dedup_plans_a_group_limit_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = rank.first_per(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_batch_with_one_hot_key_folds_to_one_row(spark):
    from listmill import vocab as V
    names = ["seq", *V.LISTING_FIELDS]
    base = {c: "" for c in V.LISTING_FIELDS}
    rows = []
    for i in range(900):
        row = dict(base, id=f"i{i}", url="https://x/1/" if i % 3 else f"https://x/u{i}", title="" if i % 2 else f"t{i}",
                   status="unreviewed")
        rows.append((i, *[row[c] for c in V.LISTING_FIELDS]))
    df = spark.createDataFrame(rows, ", ".join(["seq int", *[f"{c} string" for c in names[1:]]])).repartition(4)
    folded = {r._key: r for r in merge.fold_batch(df).collect()}
    assert len(folded) == 301
    assert folded["https://x/1"].id == "i1" and folded["https://x/1"].title == "t898"


def test_tree_top_keeps_the_first_rows(spark):
    df = spark.range(0, 5000, 1, 8).select((F.col("id") * 7919 % 5000).alias("o"))
    got = sorted(r.o for r in rank.top_rows(df, ["o"], 30).collect())
    assert got == list(range(30))


def test_a_queue_page_reads_one_slice(spark):
    import tempfile

    from listmill.sources.queue_slices import QueueSlices
    df = spark.range(500).select((F.col("id") * 7919 % 500).cast("string").alias("id"), F.lit("t").alias("created_at"),
                                 F.when(F.col("id") % 10 == 0, "deleted").otherwise("unreviewed").alias("status"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        queue = QueueSlices.build(df.repartition(3), tempfile.mkdtemp(prefix="run-") + "/q")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(queue.counts) > 1 and queue.total == 450
    ids = sorted(str(i) for i in range(500))
    shown = {r.id for r in df.where("status <> 'deleted'").collect()}
    ids = [i for i in ids if i in shown]
    for index in (-3, 0, 57, 449, 10_000):
        page = queue.page(index)
        at = min(max(index, 0), 449)
        assert [(r.id, r.position, r.total) for r in page.collect()] == [(ids[at], at + 1, 450)]
    plan = queue.page(57)._jdf.queryExecution().executedPlan().toString()
    assert QueueSlices.build(df.where("id < ''"), tempfile.mkdtemp(prefix="run-") + "/q").page(3).count() == 0
    assert "(slice#" in plan and f"= {queue.place(57)[0]})" in plan and "PartitionFilters: [isnotnull(slice" in plan
