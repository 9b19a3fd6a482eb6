"""Queries of the reading job's bookkeeping: cache, duplicates, rates, responses, segments; and of the scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import codes, dates, money, text
from ledgerloom.operators import job
from ledgerloom.plans.bindings import amount, for_duckdb, view


def money_parse(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "b_money").select("k", "written", money.parse_money_cents(F.col("written")).alias("cents"))


def money_format(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "b_money").select("k", money.format_currency(F.col("signed")).alias("formatted"))


def date_parse(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "b_date").select("k", dates.parse_date(F.col("written")).alias("date"))


def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "b_text").select("k", text.normalize_text(F.col("t")).alias("normal"), text.normalize_identifier(F.col("t")).alias("identifier"))


def person_normalize(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "b_text").select("k", text.normalize_person(F.col("t")).alias("person"))


def barcode_normalize(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "b_text").select("k", codes.normalize_barcode(F.col("bar")).alias("barcode"), codes.ledger_code(F.col("bar")).alias("ledger_code"))


def response_envelope(spark: SparkSession, d: str) -> DataFrame:
    return job.envelopes(view(spark, d, "b_response")).select("k", "number", "error", "retryable")


def retry_hints(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "b_retry").select("k", job.retry_after_ms(F.col("message")).alias("retry_ms"))


def duplicate_files(spark: SparkSession, d: str) -> DataFrame:
    files = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("name"), F.sha2("text", 256).alias("hash"))
    return job.duplicate_files(files)


def cache_miss_hit(spark: SparkSession, d: str) -> DataFrame:
    slots, cache = view(spark, d, "b_slot"), view(spark, d, "b_cache")
    return job.probe(slots, cache, "v2").select("hash", "page", "position", "hit")


def cache_complete(spark: SparkSession, d: str) -> DataFrame:
    return job.complete_files(view(spark, d, "b_cache"), view(spark, d, "b_slot").groupBy("hash").agg(F.count("*").alias("expected")), "v2").select("hash", "complete")


def completion_rate(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return job.rates(events, "user_id", "us", "event_id")


WIDTH = 450


def gutter_segments(spark: SparkSession, d: str) -> DataFrame:
    """The slips of pages whose empty columns are what no band of ink covers."""
    before = Window.partitionBy("page").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    bands = view(spark, d, "b_band").unionByName(view(spark, d, "b_band").select("page", F.lit(WIDTH).alias("lo"), F.lit(WIDTH).alias("hi")).distinct())
    gaps = bands.select("page", F.coalesce(F.max("hi").over(before), F.lit(0)).alias("from"), "lo").filter("lo > from").select("page", F.col("from").alias("lo"), F.col("lo").alias("hi"))
    runs = bands.select("page").distinct().join(gaps.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("empty")), "page", "left")
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    return runs.select("page", F.explode(job.segments(F.coalesce("empty", none), F.lit(WIDTH))).alias("s")).select("page", F.col("s.lo").cast("bigint").alias("lo"), F.col("s.hi").cast("bigint").alias("hi"))


QUERIES = {
    f.__name__: f
    for f in (
        money_parse, money_format, date_parse, text_normalize, person_normalize, barcode_normalize, response_envelope, retry_hints, duplicate_files, cache_miss_hit, cache_complete,
        completion_rate, gutter_segments,
    )
}

FORMAT = "('R$ ' || CASE WHEN signed < 0 THEN '-' ELSE '' END || replace(format('{:,}', abs(signed) // 100), ',', '.') || ',' || lpad(CAST(abs(signed) % 100 AS VARCHAR), 2, '0'))"
ORACLE = {
    "money_parse": for_duckdb("SELECT k, written, CASE k % 9 WHEN 0 THEN cents WHEN 1 THEN cents WHEN 2 THEN -cents WHEN 3 THEN 0 WHEN 4 THEN NULL WHEN 5 THEN cents WHEN 6 THEN 0 WHEN 7 THEN -cents ELSE CAST(floor(cents / 100) AS BIGINT) * 100 END AS cents FROM b_money"),
    "money_format": for_duckdb(f"SELECT k, {FORMAT} AS formatted FROM b_money"),
    "date_parse": for_duckdb("SELECT k, CASE WHEN k % 6 = 5 THEN NULL ELSE d END AS date FROM b_date"),
    "text_normalize": for_duckdb(
        "SELECT k, trim(regexp_replace(lower(strip_accents(t)), '\\s+', ' ', 'g')) AS normal, trim(regexp_replace(lower(strip_accents(t)), '[^a-z0-9]+', '_', 'g'), '_') AS identifier FROM b_text"
    ),
    "person_normalize": for_duckdb("SELECT k, nullif(trim(regexp_replace(upper(strip_accents(t)), '\\s+', ' ', 'g')), '') AS person FROM b_text"),
    "barcode_normalize": for_duckdb("SELECT k, coalesce(nullif(ltrim(g, '0'), ''), g) AS barcode, CASE WHEN length(g) < 13 THEN lpad(g, 13, '0') ELSE g END AS ledger_code FROM (SELECT k, regexp_replace(bar, '[^0-9]', '', 'g') AS g FROM b_text)"),
    "response_envelope": for_duckdb("SELECT k, CASE WHEN k % 5 < 3 THEN CAST(k AS VARCHAR) END AS number, CASE k % 5 WHEN 3 THEN 'rate limit reached' WHEN 4 THEN 'bad image' END AS error, CASE k % 5 WHEN 3 THEN true WHEN 4 THEN false END AS retryable FROM b_response"),
    "retry_hints": for_duckdb("SELECT k, CASE k % 3 WHEN 0 THEN k % 900 WHEN 1 THEN (k % 60) * 1000 END AS retry_ms FROM b_retry"),
    "duplicate_files": "SELECT copy, original FROM (SELECT CAST(doc_id AS VARCHAR) AS copy, CAST(first_value(doc_id) OVER w AS VARCHAR) AS original, row_number() OVER w AS r FROM documents WINDOW w AS (PARTITION BY sha256(text) ORDER BY doc_id)) WHERE r > 1",
    "cache_miss_hit": for_duckdb("SELECT s.hash, s.page, s.position, c.hash IS NOT NULL AS hit FROM b_slot s LEFT JOIN (SELECT DISTINCT hash, page, position FROM b_cache WHERE render_version = 'v2') c ON s.hash = c.hash AND s.page = c.page AND s.position = c.position"),
    "cache_complete": for_duckdb("SELECT s.hash, coalesce(c.n, 0) = s.n AS complete FROM (SELECT hash, count(*) AS n FROM b_slot GROUP BY hash) s LEFT JOIN (SELECT hash, count(DISTINCT (page, position)) AS n FROM b_cache WHERE render_version = 'v2' GROUP BY hash) c ON s.hash = c.hash"),
    "completion_rate": "SELECT user_id, event_id, CASE WHEN n >= 5 AND us > first THEN CAST(floor((n - 1) * CAST(60000000000 AS BIGINT) / (us - first)) AS BIGINT) END AS per_minute_x1000 FROM (SELECT user_id, event_id, epoch_us(ts) AS us, count(*) OVER w AS n, first_value(epoch_us(ts)) OVER w AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 39 PRECEDING AND CURRENT ROW))",
    # Gutters are 5.4 columns wide at least (5.4 = 0.012 x 450), one if no more than 22.5 apart; slips have 45 columns at least.
    "gutter_segments": for_duckdb(
        "SELECT page, lo, hi FROM (WITH ends AS (SELECT page, lo, hi FROM b_band UNION ALL SELECT DISTINCT page, 450, 450 FROM b_band), "
        "gaps AS (SELECT page, was AS lo, lo AS hi FROM (SELECT *, coalesce(max(hi) OVER (PARTITION BY page ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS was FROM ends) WHERE lo - was >= 5.4), "
        "gutters AS (SELECT page, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(CASE WHEN lo - last <= 22.5 THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY lo) AS g FROM (SELECT *, lag(hi) OVER (PARTITION BY page ORDER BY lo) AS last FROM gaps)) GROUP BY page, g), "
        "bounds AS (SELECT page, hi AS lo FROM gutters UNION ALL SELECT DISTINCT page, 0 FROM b_band), "
        "slips AS (SELECT b.page, b.lo, coalesce(min(g.lo), 450) AS hi FROM bounds b LEFT JOIN gutters g ON g.page = b.page AND g.lo >= b.lo GROUP BY b.page, b.lo) "
        "SELECT page, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM slips WHERE hi - lo >= 45)"
    ),
}
