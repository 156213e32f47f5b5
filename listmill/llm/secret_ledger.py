"""Secret scan of a history with a ledger of scanned blobs.

A history is a table of places (path, version, content).  Each content is addressed by its sha256, so a text that many
places hold is one blob.  The ledger remembers which blob was scanned under which version of which rules; a scan
looks only at pairs it has not seen and adds what it found, and findings are joined back to all places ever entered.  A rule
set's version is the hash of its rules, so changed rules scan old blobs anew, and only for the changed set.

The ledger is a folder of Parquet tables in the shared folder:

    places/<commit>           path, version, blob
    pairs/<commit>-<rules>    blob, rules, spans: every pair scanned, also those without a finding

A table counts once its ``_SUCCESS`` is there, so a scan that is repeated after a failure, or replayed, neither loses nor
doubles anything.  ``compact`` folds the pairs of many commits into one table.

Copies meet in the tasks before texts are shuffled, and hashes alone are held against the ledger.  A blob
with a third of all places is one text to scan, and its places meet the findings in a join that Spark may split.

Nulls: a null content is the empty text; null paths and versions are kept.  Repeated places are all
returned.  An empty history gives an empty report.  Whole texts are searched, of any length; patterns are
bounded so that no text takes more than linear time.  Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listmill.llm.shared import partitions, ship, text_column
from listmill.session import work_dir


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches count whose group has at least ``least`` characters; texts without any of ``hints`` (lower case) have none."""

    kind: str
    pattern: str
    hints: tuple[str, ...]
    group: int = 0
    least: int = 0


@dataclass(frozen=True)
class RuleSet:
    name: str
    rules: tuple[Rule, ...]

    @property
    def version(self) -> str:
        said = repr([self.name, *[(r.kind, r.pattern, r.group, r.least) for r in self.rules]])
        return f"{self.name}@{hashlib.sha256(said.encode()).hexdigest()[:16]}"


def either_case(word: str) -> str:
    """A pattern of a word in any case of its ASCII letters, and of no other letters that fold to them."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: The base kinds, in their order.
BASE_KINDS = ["assign", "access", "hex"]
_ASSIGN = "|".join(["password", "passwd", "secret", "token", "api_?key"])
BASE = RuleSet("base", (
    Rule("assign", rf"""({either_case(_ASSIGN)})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", ("password", "passwd", "secret", "token", "api"), 2, 8),
    # the same as a match of the whole run that is long enough, as runs are matched from their beginning
    Rule("access", r"AKIA[A-Z0-9]{12,}", ("akia",)),
    Rule("hex", r"[0-9a-f]{32,}", ()),
))
#: Secrets with a form of their own.  Parts are bounded, so that no start looks at more than a few thousand characters.
FORMS = RuleSet("forms", (
    Rule("private_key", r"-----BEGIN [A-Z0-9\x20]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\x20\r\n]*-----END [A-Z0-9\x20]{0,40}PRIVATE KEY-----", ("private key-----",)),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", ("xox",)),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", ("aiza",)),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}", ("k_live_",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,1000}\.eyJ[A-Za-z0-9_-]{8,1000}\.[A-Za-z0-9_-]{8,1000}", (".eyj",)),
    Rule("login", r"://[^\x20\x09-\x0D/:@]{1,200}:[^\x20\x09-\x0D/:@]{1,200}@", ("://",)),
))

_SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


def search(text: str, rules: Sequence[Rule], compiled: dict[str, re.Pattern]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of what the rules find, leftmost and without overlaps for each kind; in code points."""
    out, low = [], text.lower()
    for rule in rules:
        if rule.hints and not any(h in low for h in rule.hints):
            continue
        for m in compiled[rule.pattern].finditer(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                out.append((rule.kind, m.start(), m.end()))
    return out


class Ledger:
    """The ledger in ``path``, a folder that driver and executors share; a fresh one without."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, (path or work_dir(spark, "secret-ledger")).rstrip("/")

    def _tables(self, kind: str) -> list[str]:
        """The complete tables; those that were folded into another one don't count."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(root))
        done = [n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{n}/_SUCCESS"))]
        folded = [n for n in done if n.startswith("folded-")]
        last = max(folded, default="")  # a folded table holds all that was complete before it, and says so in its list
        if not last:
            return done
        gone = {r.name for r in self.spark.read.parquet(f"{self.path}/lists/{last}").collect()}  # a row a table
        return [n for n in done if n == last or n not in gone and n not in folded]

    def _read(self, kind: str, schema: str) -> DataFrame:
        tables = self._tables(kind)
        if not tables:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{kind}/{n}" for n in tables])

    def pairs(self) -> DataFrame:
        """Every (blob, rules) scanned so far, with its spans."""
        return self._read("pairs", f"blob binary, rules string, spans {_SPANS}")

    def places(self, like: DataFrame) -> DataFrame:
        """All places entered so far; ``like`` has path and version of the right types."""
        types = dict(like.dtypes)
        return self._read("places", f"path {types['path']}, version {types['version']}, blob binary")

    def scan(self, history: DataFrame, commit: str, sets: Sequence[RuleSet] = (BASE, FORMS)) -> None:
        """Enter the places of ``history`` (path, version, content) under the name of a commit, and scan the pairs not seen before."""
        content = F.coalesce(F.col("content"), F.lit(""))
        address = F.unhex(F.sha2(content, 256))
        if commit not in self._tables("places"):
            history.select("path", "version", address.alias("blob")).write.mode("overwrite").parquet(f"{self.path}/places/{commit}")
        versions = {s.version: s for s in sets}
        name = f"{commit}-{hashlib.sha256(repr(sorted(versions)).encode()).hexdigest()[:16]}"
        if name in self._tables("pairs"):
            return
        texts = history.select(address.alias("blob"), content.alias("content")).dropDuplicates(["blob"])
        every = F.array(*[F.lit(v) for v in versions])
        if self._tables("pairs"):
            seen = self.pairs().filter(F.col("rules").isin(*versions)).groupBy("blob").agg(F.collect_set("rules").alias("seen"))
            texts = texts.join(seen, "blob", "left").select("blob", "content", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
        else:
            texts = texts.select("blob", "content", every.alias("todo"))
        self._scanned(texts.filter(F.size("todo") > 0), versions).write.mode("overwrite").parquet(f"{self.path}/pairs/{name}")

    def _scanned(self, texts: DataFrame, versions: dict[str, RuleSet]) -> DataFrame:
        rank = {r.kind: i for i, r in enumerate(r for s in versions.values() for r in s.rules)}

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            compiled = {r.pattern: re.compile(r.pattern, re.ASCII) for s in versions.values() for r in s.rules}
            kind = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
            for batch in batches:
                blobs, rules, spans = [], [], []
                for blob, text, todo in zip(batch.column(0), text_column(batch, "content"), batch.column(2).to_pylist()):
                    text = text.as_py()
                    for version in todo:
                        blobs.append(blob.as_py())
                        rules.append(version)
                        spans.append([{"start": a, "rank": rank[k], "kind": k, "end": b} for k, a, b in search(text, versions[version].rules, compiled)])
                yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array(rules, pa.string()), pa.array(spans, kind)], ["blob", "rules", "spans"])

        ship(self.spark)
        return texts.select("blob", "content", "todo").mapInArrow(scan, f"blob binary, rules string, spans {_SPANS}")

    def report(self, like: DataFrame, sets: Sequence[RuleSet] = (BASE, FORMS)) -> DataFrame:
        """A row for each place: path, version, blob, spans (by start, then by kind in the order of the rules)."""
        found = self.pairs().filter(F.col("rules").isin(*[s.version for s in sets]) & (F.size("spans") > 0))
        by_blob = found.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("found"))  # one row a rule set
        none = F.array().cast(_SPANS)
        return self.places(like).join(by_blob, "blob", "left").select("path", "version", "blob", F.coalesce("found", none).alias("spans"))

    def compact(self) -> None:
        """Fold the pairs of all commits into one table, bucketed by blob; older tables are no longer read."""
        tables = self._tables("pairs")
        if len(tables) < 2:
            return
        older = [int(n.split("-")[1]) for n in tables if n.startswith("folded-")]
        name = f"folded-{max(older, default=0) + 1:010d}"
        # the list first: without the table it says nothing
        self.spark.createDataFrame([(n,) for n in tables], "name string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/lists/{name}")
        self.pairs().repartition(partitions(self.spark), "blob").sortWithinPartitions("blob").write.mode("overwrite").parquet(f"{self.path}/pairs/{name}")


def scan_history(history: DataFrame, commits: int = 2, sets: Sequence[RuleSet] = (BASE, FORMS)) -> DataFrame:
    """The report of a history that is entered in ``commits`` parts, by the hash of the path."""
    ledger = Ledger(history.sparkSession)
    part = F.pmod(F.xxhash64("path", "version"), F.lit(commits))
    for i in range(commits):
        ledger.scan(history.filter(part == i), f"commit-{i:06d}", sets)
    return ledger.report(history, sets)


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(report: DataFrame, history: DataFrame) -> DataFrame:
    """path, version, redacted: each content with every span replaced by its kind in brackets; of overlapping spans the first counts."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    content = F.coalesce(F.col("content"), F.lit(""))
    body = F.aggregate("spans", start, lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(
        s["end"].alias("at"), F.concat(a["out"], F.substring(content, a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"))),
        lambda a: F.concat(a["out"], F.substring(content, a["at"] + 1, F.length(content))))
    found = report.filter(F.size("spans") > 0).select("blob", "spans").dropDuplicates(["blob"])
    own = history.select("path", "version", "content").withColumn("_blob", F.unhex(F.sha2(content, 256)))
    return own.join(found, F.col("_blob") == F.col("blob"), "left").select(
        "path", "version", F.when(F.col("spans").isNull(), content).otherwise(body).alias("redacted"))


def digest(report: DataFrame) -> DataFrame:
    """path, n_assign, n_access, n_hex, base_sha256, spans."""
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE_KINDS]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return report.select("path", *counts, F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))
