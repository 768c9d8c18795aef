"""The queries over whole tables that the entry module registers, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, licences, linededup, neighbours, packing, quality, sharding, toolchat, urlfilter


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into sequences of 4096 tokens, with a digest of the packed ids."""
    placed = packing.pack(_read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op2_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and results of all conversations, linked, levelled, validated and serialised, and a row for every other turn."""
    return toolchat.chat(_read(spark, sf_dir, "conversations"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return jaccard.join(_read(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what stays of its text and the spans cut from the original."""
    return linededup.dedup(_read(spark, sf_dir, "documents")).select("doc_id", "text", "cut_spans")


def op5_histogram_sort_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 24 near-equal byte ranges, and its place there."""
    out = sharding.shard(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph with a licence term, its family (or unknown) and how sure that is."""
    return licences.scan(_read(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words hit and items found of every document."""
    out = decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def _digit(text, at: int):
    """Value of a hexadecimal digit of the md5."""
    return F.conv(F.substring(F.md5(text), at, 1), 16, 10).cast("int")


def url_lists(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Captures and dated list entries: the tables hold no list and no dates, so both follow from hashes of the rows.

    A page was fetched on day page_id mod 365 of 2024. Each host is blocked on a day given by the md5 of its name;
    those whose third digit is below 8 are allowed again later. Parent domains of hosts whose fourth digit is 0 are
    put under review on 1 March, and bare URLs whose md5 begins with 0 are blocked on 1 February.
    """
    captures = pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 365).cast("int")).alias("fetched_on"))
    hosts = pages.select(urlfilter.host(F.col("url")).alias("pattern")).filter("pattern is not null").distinct()
    day = _digit(F.col("pattern"), 1) * 16 + _digit(F.col("pattern"), 2)
    later = day + 1 + _digit(F.col("pattern"), 3) * 16 + _digit(F.col("pattern"), 4)
    on = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    blocked = hosts.select(F.lit("host").alias("kind"), "pattern", F.lit("block").alias("action"), on(day).alias("listed_on"))
    allowed = hosts.filter(_digit(F.col("pattern"), 3) < 8).select(F.lit("host"), "pattern", F.lit("allow"), on(later))
    parents = hosts.filter(_digit(F.col("pattern"), 4) == 0).select(F.lit("host"), F.regexp_replace("pattern", r"^[^.]*\.", "").alias("pattern"), F.lit("review"), F.lit("2024-03-01").cast("date")).distinct()
    urls = pages.filter("url is not null").select(urlfilter.bare(F.col("url")).alias("pattern")).distinct().filter(_digit(F.col("pattern"), 1) == 0).select(F.lit("url"), "pattern", F.lit("block"), F.lit("2024-02-01").cast("date"))
    return captures, blocked.union(allowed).union(parents).union(urls)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page by the entries that held when it was fetched."""
    return urlfilter.verdicts(*url_lists(_read(spark, sf_dir, "pages")))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20."""
    return neighbours.search(_read(spark, sf_dir, "embeddings"))


def queries() -> dict:
    named = (op1_best_fit_packing, op2_tool_call_linking, op3_ngram_jaccard_join, op4_substring_dedup, op5_histogram_sort_sharding, op6_license_scan, op7_benchmark_decontamination, op8_quality_classifier, op9_url_filter, op10_nearest_neighbours)
    return {f.__name__: f for f in named}


_WORDS = r"regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+')"

_OP7 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[i : i + least(len(w), 8) - 1], ' ') AS g
  FROM b, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
wordhits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN wordhits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP2 = """
WITH t AS (SELECT conv_id, turn, role, min(text) AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
c AS (SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island FROM t WHERE role = 'user'),
calls AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS level FROM c),
r AS (SELECT conv_id, turn, text FROM t WHERE role = 'assistant'),
j AS (
  SELECT coalesce(calls.conv_id, r.conv_id) AS conv_id, coalesce(calls.turn, r.turn) AS turn, coalesce(calls.turn, r.turn - 1) AS t0, level,
    calls.text AS prompt, r.text AS content, calls.conv_id IS NOT NULL AS called, r.conv_id IS NOT NULL AS answered
  FROM calls FULL JOIN r ON calls.conv_id = r.conv_id AND calls.turn = r.turn - 1),
k AS (SELECT *, conv_id || '-' || t0 AS call_id, CASE WHEN NOT called THEN 'orphan' WHEN NOT answered THEN 'unanswered' ELSE 'linked' END AS status FROM j)
SELECT conv_id, turn, call_id, level, status,
  CASE WHEN called THEN length(prompt) BETWEEN 1 AND 600 END AS valid,
  CASE WHEN called THEN CASE WHEN length(prompt) < 1 THEN '$.prompt: minLength' WHEN length(prompt) > 600 THEN '$.prompt: maxLength' ELSE '' END END AS errors,
  '{"arguments":' || CASE WHEN called THEN '{"prompt":' || to_json(prompt)::VARCHAR || ',"turn":' || turn || '}' ELSE 'null' END || ',"id":"' || call_id || '","level":' || coalesce(level::VARCHAR, 'null')
    || ',"name":' || CASE WHEN called THEN '"reply"' ELSE 'null' END || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || ',"status":"' || status || '"}' AS record
FROM k
UNION ALL
SELECT conv_id, turn, NULL, NULL, status, NULL, NULL,
  '{"conversation":' || coalesce(to_json(conv_id)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || ',"status":"' || status
    || '","text":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"turn":' || coalesce(turn::VARCHAR, 'null') || '}'
FROM (
  SELECT DISTINCT conv_id, turn, role, text, CASE WHEN conv_id IS NULL OR turn IS NULL THEN 'unplaced' WHEN role IN ('user', 'assistant') THEN 'repeated' ELSE 'turn' END AS status
  FROM conversations
  WHERE conv_id IS NULL OR turn IS NULL OR role IS NULL OR role NOT IN ('user', 'assistant')
    OR text IS DISTINCT FROM (SELECT text FROM t WHERE t.conv_id = conversations.conv_id AND t.turn = conversations.turn AND t.role = conversations.role))
"""

_OP9 = r"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + (page_id % 365)::INT AS fetched_on, count(*) AS n_rows,
    nullif(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS host,
    regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '/$', '') AS bare
  FROM pages GROUP BY ALL),
h AS (SELECT DISTINCT host AS pattern, [instr('0123456789abcdef', x) - 1 FOR x IN string_split(md5(host), '')] AS d FROM p WHERE host IS NOT NULL),
entries AS (
  SELECT 'host' AS kind, pattern, 'block' AS action, DATE '2024-01-01' + (d[1] * 16 + d[2])::INT AS listed_on FROM h
  UNION ALL SELECT 'host', pattern, 'allow', DATE '2024-01-01' + (d[1] * 16 + d[2] + 1 + d[3] * 16 + d[4])::INT FROM h WHERE d[3] < 8
  UNION ALL SELECT DISTINCT 'host', regexp_replace(pattern, '^[^.]*\.', ''), 'review', DATE '2024-03-01' FROM h WHERE d[4] = 0
  UNION ALL SELECT DISTINCT 'url', bare, 'block', DATE '2024-02-01' FROM p WHERE bare IS NOT NULL AND md5(bare) LIKE '0%'),
daily AS (SELECT kind, pattern, listed_on, max(action) AS action FROM entries GROUP BY ALL),
spans AS (SELECT kind, pattern, action, listed_on AS since, lead(listed_on) OVER (PARTITION BY kind, pattern ORDER BY listed_on) AS until FROM daily),
keys AS (
  SELECT page_id, url, fetched_on, 'host' AS kind, array_to_string(string_split(host, '.')[i:], '.') AS pattern, len(string_split(host, '.')) - i + 1 AS rank
  FROM p, unnest(range(1, len(string_split(host, '.')) + 1)) AS t(i) WHERE host IS NOT NULL
  UNION ALL SELECT page_id, url, fetched_on, 'url', bare, 2000 FROM p WHERE host IS NOT NULL),
held AS (
  SELECT k.page_id, k.url, k.fetched_on, max(struct_pack(rank := rank, action := action, pattern := k.pattern, since := since)) AS b
  FROM keys k JOIN spans s ON k.kind = s.kind AND k.pattern = s.pattern AND since <= fetched_on AND (until IS NULL OR fetched_on < until)
  GROUP BY ALL)
SELECT p.page_id, p.url, p.fetched_on, p.n_rows, coalesce(b.action, 'none') AS verdict, b.pattern AS pattern, b.since AS since
FROM p LEFT JOIN held ON p.page_id = held.page_id AND p.url = held.url AND p.fetched_on = held.fetched_on
"""

_GRAMS = "CASE WHEN len(w) = 0 THEN [] ELSE list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, greatest(len(w) - 3, 2))]) END"

_OP3 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, {_GRAMS} AS g FROM d),
t AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, (SELECT min(b) FROM reach WHERE reach.a = d.doc_id) AS class_id, (SELECT count(*) FROM links WHERE links.a = d.doc_id)::BIGINT AS n_links FROM d
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_tool_call_linking": _OP2, "op3_ngram_jaccard_join": _OP3, "op7_benchmark_decontamination": _OP7, "op9_url_filter": _OP9}
