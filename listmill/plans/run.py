"""A whole run: feeds first, boards for what is left, one outcome.

Each stage is kept below the run's folder and its record is written last, so a run that was cut off is taken up behind
its last whole stage: what was collected before isn't collected again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listmill import vocab as V
from listmill.operators.report import outcome_columns
from listmill.plans.scrape import ORDER, scrape
from listmill.plans.search import Feed, first_items, listings_of, reached, search_failures
from listmill.schema import FAILURE, strings
from listmill.session import work_dir
from listmill.sources.listing_table import ListingTable
from listmill.sources.page_table import PageTable
from listmill.sources.pages import board_seeds

MODES = ("online", "urls", "both")
_LISTING = strings(*V.LISTING_FIELDS).add("seq", "long")
_RECORD = "request string, collected bigint, failed bigint"


@dataclass
class Ran:
    """``listings`` and ``failures`` carry their stage; ``outcome`` is one row, ``progress`` one for each step of the run."""

    listings: DataFrame
    failures: DataFrame
    outcome: DataFrame
    progress: DataFrame


class Stages:
    """The stages of one run in a folder that the cluster shares."""

    def __init__(self, spark: SparkSession, path: str, request: str):
        self.spark, self.path, self.request = spark, path.rstrip("/"), request
        self.done: dict[str, tuple[int, int]] = {}  # collected and failed, by stage

    def _recorded(self, stage: str) -> bool:
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{stage}/record/_SUCCESS")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def run(self, stage: str, work: Callable[[], tuple[DataFrame, DataFrame]]) -> int:
        """Do a stage unless its record is there; the number of listings that it collected."""
        at = f"{self.path}/{stage}"
        if not self._recorded(stage):
            listings, failed = work()
            # At most MAX_TARGET rows in an order that work() gave: one task numbers them.
            listings.select(*V.LISTING_FIELDS).coalesce(1).withColumn("seq", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{at}/listings")
            failed.select("url", "error").write.mode("overwrite").parquet(f"{at}/failures")
            counts = [self.listings(stage).count(), self.failures(stage).count()]
            self.spark.createDataFrame([(self.request, *counts)], _RECORD).coalesce(1).write.mode("overwrite").parquet(f"{at}/record")
        record = self.spark.read.schema(_RECORD).parquet(f"{at}/record").first()
        if record["request"] != self.request:
            raise ValueError(f"The run in {self.path} was asked for something else")
        self.done[stage] = record["collected"], record["failed"]
        return record["collected"]

    def listings(self, stage: str) -> DataFrame:
        return self.spark.read.schema(_LISTING).parquet(f"{self.path}/{stage}/listings")

    def failures(self, stage: str) -> DataFrame:
        return self.spark.read.schema(FAILURE).parquet(f"{self.path}/{stage}/failures")

    def all(self, read: Callable[[str], DataFrame]) -> DataFrame:
        out = None
        for stage in self.done:
            rows = read(stage).select(F.lit(stage).alias("stage"), "*")
            out = rows if out is None else out.unionByName(rows)
        return out


def _check(mode: str, keywords: Sequence[str], boards: DataFrame | None) -> None:
    """What makes a request unfit: nothing runs and nothing is changed then."""
    if mode not in MODES:
        raise ValueError(f"A run is one of {', '.join(MODES)}")
    if mode != "urls" and not keywords:
        raise ValueError("Add at least one keyword for online search")
    if mode != "online" and (boards is None or board_seeds(boards).isEmpty()):
        raise ValueError("Add at least one board URL")


def run(spark: SparkSession, mode: str, keywords: Sequence[str], n: int, feeds: Sequence[Feed] = (), boards: DataFrame | None = None,
        pages: DataFrame | PageTable | None = None, robots: DataFrame | None = None, now: Column | None = None,
        table: ListingTable | None = None, path: str | None = None) -> Ran:
    """Collect ``n`` contract listings from feeds, from boards, or from feeds and then boards for what is left.

    Boards run with the caps of what is left, and not at all once the feeds have filled the target.  Failures are those
    of the feeds and boards that the run came to.  Keywords may be empty if only boards are asked.
    With ``table`` the run starts by clearing its queue, and each stage's listings are added when the stage
    is whole; changes carry the run's name, so taking a run up again doesn't make them twice.

    ``path`` names the run: the same request with the same path goes on behind the last whole stage, another request is
    an error.
    """
    _check(mode, keywords, boards)
    target = max(1, int(n or 1))
    if target > V.MAX_TARGET:
        raise ValueError(f"A run collects at most {V.MAX_TARGET} listings")
    path = path or work_dir(spark, "run")
    stages = Stages(spark, path, repr((mode, list(keywords), target)))

    def settled(stage: str, number: int, work: Callable[[], tuple[DataFrame, DataFrame]]) -> int:
        got = stages.run(stage, work)
        if table is not None and got:
            table.upsert(stages.listings(stage), now if now is not None else F.current_timestamp(), name=path, number=number)
        return got

    def online() -> tuple[DataFrame, DataFrame]:
        winners = first_items(feeds, keywords, target)
        asked = reached(feeds, winners, target)
        return listings_of(feeds, winners, keywords, now), search_failures(asked, keywords)

    def urls() -> tuple[DataFrame, DataFrame]:
        found = scrape(boards, pages, robots, keywords, target - got, now)
        return found.listings.repartition(1).sortWithinPartitions(*ORDER), found.failures  # sorted once, where a global sort parses twice to sample

    if table is not None:
        table.clear(name=path, number=1)
    got = settled("feeds", 2, online) if mode != "urls" else 0
    if mode == "urls" or (mode == "both" and got < target):
        settled("boards", 3, urls)
    return Ran(stages.all(stages.listings), stages.all(stages.failures), _outcome(stages, target), _progress(stages, mode, target))


def _outcome(stages: Stages, target: int) -> DataFrame:
    """collected, failed, target, zero, short, error and message of the run."""
    totals = [sum(counts) for counts in zip(*stages.done.values())]
    row = stages.spark.createDataFrame([(*totals, target)], "collected bigint, failed bigint, target bigint")
    return row.select("*", *[v.alias(k) for k, v in outcome_columns(F.col("collected"), F.col("failed"), F.col("target")).items()])


def _progress(stages: Stages, mode: str, target: int) -> DataFrame:
    """step, message, collected, failed, target, running, finished, error: the start, what the feeds left to the boards, and the end."""
    steps = [(0, "Starting…", 0, 0)]
    if mode == "both" and "boards" in stages.done:
        got, bad = stages.done["feeds"]
        steps.append((1, f"Online found {got}. Scraping boards for {target - got} more…", got, bad))
    rows = stages.spark.createDataFrame(steps, "step int, message string, collected bigint, failed bigint").select(
        "*", F.lit(target).cast("bigint").alias("target"), F.lit(True).alias("running"), F.lit(False).alias("finished"), F.lit(None).cast("string").alias("error"))
    last = _outcome(stages, target).select(
        F.lit(len(steps)).alias("step"), "message", "collected", "failed", "target", F.lit(False).alias("running"), F.lit(True).alias("finished"), "error")
    return rows.unionByName(last)
