"""The registered queries of the corpus operators and their SQL: thin calls with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listmill.llm import (centroids, decontam, fixity, line_runs, mixing, near_dup, pii, quality, scoring, secret_ledger, token_files, url_rules,
                          whitening)
from listmill.llm.shared import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WEIGHTS = [5.0, 2.0, 1.0]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_file() -> str:
    """The public vocabulary's place; the file itself stays where it is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_perplexity_bands(spark, sf):
    return quality.judge_quality(table(spark, sf, "documents")).drop("text_hash")


@query
def op2_line_dedup(spark, sf):
    return line_runs.dedup_lines(table(spark, sf, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


#: White space that is stripped, in one place for the SQL below.
_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLES["op2_line_dedup"] = f"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, {_STRIP}), '{_AZ}', '{_AZ.lower()}') AS k
  FROM (SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), shared AS (
  SELECT k, min(doc_id) AS owner FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT doc_id, pos, line, shared.k IS NOT NULL AND owner <> doc_id AS dropped FROM lines LEFT JOIN shared USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@query
def op3_personal_data(spark, sf):
    return pii.span_digest(pii.find_personal_data(table(spark, sf, "documents")))


@query
def op4_simhash_decontamination(spark, sf):
    return decontam.matches(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("text_hash")


@query
def op5_cross_entropy_difference(spark, sf):
    """The target are the documents labelled as good and not toxic."""
    good = table(spark, sf, "labels").filter("quality = 1 AND toxic = 0")
    return scoring.cross_entropy_difference(table(spark, sf, "documents"), good)


@query
def op6_hyperminhash_near_dup(spark, sf):
    return near_dup.near_duplicates(table(spark, sf, "documents"), k=3, percent=85)


ORACLES["op6_hyperminhash_near_dup"] = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_AZ}', '{_AZ.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, documents.doc_id = c AS kept
FROM documents LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) USING (doc_id)"""


@query
def op7_merkle_fixity(spark, sf):
    """Two WARC replicas of all pages; the second has lost the last byte of every page whose id leaves 5 by 97."""
    damage = F.pmod(F.col("page_id"), F.lit(97)) == 5
    return fixity.audit_pages(table(spark, sf, "pages"), damage).select(
        F.col("id").cast("long").alias("page_id"), "shard", "status", "first_byte", "n_bytes", "digest_a", "digest_b")


_CRLF = "chr(13) || chr(10)"
ORACLES["op7_merkle_fixity"] = f"""
WITH shards AS (SELECT greatest(1, ceil(count(*) / {fixity.RECORDS_PER_FILE}))::BIGINT AS n FROM pages),
records AS (
  SELECT page_id, page_id % n AS shard, coalesce(html, '') AS body,
         'WARC/1.0' || {_CRLF} || 'WARC-Type: resource' || {_CRLF} || 'WARC-Date: {fixity.DATE}' || {_CRLF}
         || 'WARC-Record-ID: <urn:page:' || page_id || '>' || {_CRLF} || 'WARC-Target-URI: ' || coalesce(url, '') || {_CRLF}
         || 'Content-Type: text/html' || {_CRLF} || 'Content-Length: ' || strlen(coalesce(html, '')) || {_CRLF} || {_CRLF} AS head
  FROM pages, shards
), placed AS (
  SELECT *, strlen(head) + strlen(body) + 4 AS n_bytes,
         sum(strlen(head) + strlen(body) + 4) OVER (PARTITION BY shard ORDER BY page_id) - (strlen(head) + strlen(body) + 4) AS first_byte
  FROM records
)
SELECT page_id, shard::INTEGER AS shard, 'changed' AS status, first_byte::BIGINT AS first_byte, n_bytes,
       sha256(head || body || {_CRLF} || {_CRLF}) AS digest_a,
       sha256(head || substr(body, 1, length(body) - 1) || CASE WHEN right(body, 1) = '#' THEN '%' ELSE '#' END || {_CRLF} || {_CRLF}) AS digest_b
FROM placed WHERE page_id % 97 = 5 AND body <> ''"""


@query
def op8_weighted_fair_mix(spark, sf):
    return mixing.mix_sources(table(spark, sf, "documents"), WEIGHTS)


@query
def op9_token_files(spark, sf):
    return token_files.encode_documents(table(spark, sf, "documents"), tokenizer_file())


#: The host and path rules of the URL filter.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@query
def op10_association_rules(spark, sf):
    """A page is labelled by the row of its id: bad if of low quality or toxic."""
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_rules.judge_urls(table(spark, sf, "pages"), labels, URL_RULES).drop("mined_rule", "confidence")


ORACLES["op10_association_rules"] = f"""
WITH parsed AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_AZ}', '{_AZ.lower()}'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), split AS (
  SELECT *, list_filter(string_split(host, '.'), lambda x: x <> '') AS names FROM parsed
), tokens AS (
  SELECT page_id, host, path, CASE WHEN contains(coalesce(url, ''), '://') THEN list_sort(list_distinct(
    ['scheme=' || translate(regexp_extract(url, '(?s)^(.*?)://', 1), '{_AZ}', '{_AZ.lower()}')]
    || list_transform(names, lambda x: 'host=' || x)
    || CASE WHEN len(names) >= 2 THEN ['domain=' || names[-2] || '.' || names[-1]] ELSE [] END
    || list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'path=' || regexp_replace(x, '[0-9]+', '0', 'g'))
    || list_transform(list_filter(string_split(regexp_extract(url, '(?s)^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> ''), lambda x: 'query=' || string_split(x, '=')[1])
  )) ELSE [] END AS t FROM split
), subsets AS (
  SELECT page_id, list_filter(t, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS s
  FROM (SELECT page_id, t, unnest(range(1, (1 << len(t))::BIGINT)) AS mask FROM tokens)
), known AS (
  SELECT page_id, coalesce(bool_or(quality = 0 OR toxic = 1), false) AS bad FROM pages JOIN labels ON page_id = doc_id GROUP BY page_id
), least AS (
  SELECT ceil(greatest({url_rules.MIN_SUPPORT}, {url_rules.MIN_ROWS} / count(*)) * count(*)) AS rows, count(*) AS n FROM known
), mined AS (
  SELECT s FROM subsets JOIN known USING (page_id), least WHERE n >= {url_rules.MIN_ROWS} GROUP BY s, rows
  HAVING count(*) FILTER (WHERE bad) >= rows AND count(*) FILTER (WHERE bad) / count(*) >= {url_rules.MIN_CONFIDENCE}
), hit AS (SELECT DISTINCT page_id FROM subsets JOIN mined USING (s)),
fits AS (
  SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict FROM tokens,
    (VALUES ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'), ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')) r(h, p, rule, verdict)
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN hit.page_id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM tokens LEFT JOIN fits USING (page_id) LEFT JOIN hit USING (page_id)"""


@query
def op11_pca_filtered_centroids(spark, sf):
    return centroids.cluster_vectors(table(spark, sf, "embeddings"), dims=64, k=8, rounds=10, scale=1024, seed="3")


def _lloyd_sql(k: int, rounds: int) -> str:
    """Every round spelled out: a{r} are the assignments, m{r} the means, c{r} the centroids."""
    steps = [f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), vec_id) AS rid, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64
), c0 AS MATERIALIZED (SELECT (rid - 1)::INTEGER AS c, x FROM v WHERE rid <= {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT rid, min(struct_pack(d := d, c := c)) AS best FROM (
    SELECT rid, c, list_sum(list_transform(list_zip(v.x, t.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{r} t) GROUP BY rid)""")
        if r < rounds:
            steps.append(f"""m{r} AS MATERIALIZED (
  SELECT c, list(floor_mean ORDER BY i) AS x FROM (
    SELECT best.c AS c, i, ((sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS floor_mean
    FROM (SELECT rid, generate_subscripts(x, 1) AS i, unnest(x) AS e FROM v) JOIN a{r} USING (rid) GROUP BY 1, 2) GROUP BY c
), c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN m{r} ON c{r}.c = m{r}.c)""")
    return ",\n".join(steps) + f"""
SELECT vec_id, best.c AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(t.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (rid) JOIN c{rounds} t ON t.c = best.c"""


ORACLES["op11_pca_filtered_centroids"] = _lloyd_sql(8, 10)


@query
def op12_secret_ledger(spark, sf):
    """Every document is one version of the path that its id names; the history is entered in two commits."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.lit(1).alias("version"), F.col("text").alias("content"))
    return secret_ledger.digest(secret_ledger.scan_history(docs, commits=2)).withColumnRenamed("path", "doc_id")


def _secrets_sql() -> str:
    """Positions of matches are the lengths of all that stands before them."""
    rules = [r for s in (secret_ledger.BASE, secret_ledger.FORMS) for r in s.rules]

    def said(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    found = "\n  UNION ALL ".join(
        f"SELECT rid, {i} AS rank, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, {said(r.pattern)}, 0) AS ms, "
        f"regexp_extract_all(t, {said(r.pattern)}, {r.group}) AS gs, string_split_regex(t, {said(r.pattern)}) AS pc FROM docs" for i, r in enumerate(rules))
    base = ", ".join(f"'{k}'" for k in secret_ledger.BASE_KINDS)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in secret_ledger.BASE_KINDS)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
found AS (
  {found}
), placed AS (
  SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM found
), spans AS (
  SELECT rid, rank, kind, ms[i] AS m, (coalesce(list_sum(list_transform(pc[1:i], lambda x: length(x))), 0)
         + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
  FROM placed WHERE length(gs[i]) >= least
), said AS (SELECT rid, rank, kind, s, kind || ':' || s || ':' || (s + length(m)) AS span FROM spans),
summed AS (
  SELECT rid, {counts}, string_agg(span, ',' ORDER BY s, rank) FILTER (WHERE kind IN ({base})) AS base, string_agg(span, ',' ORDER BY s, rank) AS spans
  FROM said GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN summed USING (rid)"""


ORACLES["op12_secret_ledger"] = _secrets_sql()


@query
def op13_feast_whitening(spark, sf):
    return whitening.whiten(table(spark, sf, "embeddings"), components=32, scale=64, shift=1_000_000)
