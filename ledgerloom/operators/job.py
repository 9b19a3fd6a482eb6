"""The reading job's bookkeeping: responses, retries, duplicates, cache probes, rates and column segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import let

#: Fixed value: what marks an error that may pass.
TRANSIENT = r"(?i)rate limit|timeout|timed out|overloaded|temporar|429|50[234]"


def envelopes(responses: DataFrame) -> DataFrame:
    """responses.body: an object, {boleta: {...}}, a list of one of these, or {error}. Adds slip (JSON), number, error, retryable."""
    body = F.try_parse_json("body")
    one = F.coalesce(F.try_variant_get(body, "$[0]", "variant"), body)
    rows = responses.withColumn("one", one).withColumn("error", F.try_variant_get("one", "$.error", "string"))
    slip = F.when(F.col("error").isNull(), F.coalesce(F.try_variant_get("one", "$.boleta", "variant"), F.col("one")))
    rows = rows.withColumn("v", slip).withColumn("number", F.try_variant_get("v", "$.numero", "string")).withColumn("slip", F.to_json("v"))
    return rows.withColumn("retryable", F.rlike("error", F.lit(TRANSIENT))).drop("one", "v")


def retry_after_ms(message: Column) -> Column:
    """How long a message asks to wait (450ms, 12s), in milliseconds; null if it does not say."""
    pattern = r"(?i)(?:again|after|in)\s+(\d+(?:\.\d+)?)\s*(ms|s)\b"
    amount = F.nullif(F.regexp_extract(message, pattern, 1), F.lit("")).try_cast("decimal(12,3)")
    return (amount * F.when(F.lower(F.regexp_extract(message, pattern, 2)) == "s", 1000).otherwise(1)).cast("bigint")


def backoff_ms(attempt: Column, hint_ms: Column, rate_limited: Column) -> Column:
    """Wait before a retry without its jitter: the hint, or doubling from half a second (two when rate limited), 60 s at most."""
    base = F.when(rate_limited, 2000).otherwise(500)
    return F.least(F.lit(60000), F.coalesce(hint_ms, (base * F.pow(F.lit(2), attempt)).cast("bigint")))


def duplicate_files(files: DataFrame) -> DataFrame:
    """files: seq, name, hash. copy and original (the first by seq) of all but the first of equal files."""
    first = files.groupBy("hash").agg(F.min_by(F.struct("seq", "name"), "seq").alias("f"), F.count("*").alias("n")).filter("n > 1")
    both = files.join(first.select("hash", F.col("f.seq").alias("first_seq"), F.col("f.name").alias("original")), "hash")
    return both.filter("seq > first_seq").select(F.col("name").alias("copy"), "original")


def probe(slots: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """slots (hash, page, position, ...) with hit: whether the cache has them in the given render version."""
    known = cache.filter(F.col("render_version") == version).select("hash", "page", "position").distinct().withColumn("hit", F.lit(True))
    return slots.join(known, ["hash", "page", "position"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def complete_files(cache: DataFrame, expected: DataFrame, version: str) -> DataFrame:
    """expected: hash, expected. complete: whether the cache has as many slots of the file as expected."""
    have = cache.filter(F.col("render_version") == version).groupBy("hash").agg(F.count_distinct("page", "position").alias("n"))
    return expected.join(have, "hash", "left").withColumn("complete", F.coalesce("n", F.lit(0)) == F.col("expected"))


def rates(done: DataFrame, key: str, us: str, tie: str, last: int = 40, least: int = 5) -> DataFrame:
    """Completions a minute, in thousandths, over the last 40 of each key; null under 5."""
    w = Window.partitionBy(key).orderBy(us, tie).rowsBetween(-(last - 1), 0)
    rows = done.withColumn("n", F.count("*").over(w)).withColumn("first", F.first(us).over(w))
    rate = F.floor((F.col("n") - 1) * F.lit(60_000_000_000) / (F.col(us) - F.col("first"))).cast("bigint")
    return rows.select(key, tie, F.when((F.col("n") >= least) & (F.col(us) > F.col("first")), rate).alias("per_minute_x1000"))


#: Fixed values, in shares of a page's width: what a gutter has at least, what two gutters that are one lie apart at most, and what a
#: slip has at least.
GUTTER, JOIN, NARROWEST = 0.012, 0.05, 0.10


def segments(empty: Column, width: Column) -> Column:
    """lo and hi of the slips of a page, left to right, from its runs of empty columns (lo, hi; in order) and its width.

    Runs that are wide enough are gutters; gutters with next to nothing between them are one; what lies between gutters, or between one
    and the page's edge, is a slip if it is wide enough. All of it inside the row, on a few runs a page.
    """
    run = "array<struct<lo:int,hi:int>>"
    wide = F.filter(empty, lambda r: r["hi"] - r["lo"] >= width * GUTTER)

    def joined(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        one = F.array(F.struct(last["lo"].alias("lo"), r["hi"].alias("hi")))
        apart = (F.size(done) == 0) | (r["lo"] - F.try_element_at(done, F.lit(-1))["hi"] > width * JOIN)
        return F.when(apart, F.array_append(done, r)).otherwise(F.concat(F.slice(done, F.lit(1), F.size(done) - 1), one))

    def between(gutters: Column) -> Column:
        start, stop = F.concat(F.array(F.lit(0)), F.transform(gutters, lambda g: g["hi"])), F.concat(F.transform(gutters, lambda g: g["lo"]), F.array(width.cast("int")))
        return F.filter(F.arrays_zip(start.alias("lo"), stop.alias("hi")), lambda s: s["hi"] - s["lo"] >= width * NARROWEST)

    return let(F.aggregate(wide, F.array().cast(run), joined), between)


#: Fixed value: slips a page, until a page has been cut.
PER_PAGE = 2.4


def progress(jobs: DataFrame) -> DataFrame:
    """jobs: pages, pages_done, found, done, failed, finished, and others. Adds estimated_total (what is found, and for the pages
    that are left as many slips a page as so far) and progress (0.99 at most until the job is finished)."""
    rate = F.when(F.col("pages_done") > 0, F.col("found") / F.col("pages_done")).otherwise(F.lit(PER_PAGE))
    left = F.greatest(F.lit(0), F.col("pages") - F.col("pages_done"))
    rows = jobs.withColumn("estimated_total", F.col("found").cast("bigint") + F.bround(left * rate).cast("bigint"))
    ended = F.col("done") + F.col("failed")
    share = ended / F.greatest(F.col("estimated_total"), ended, F.lit(1))
    return rows.withColumn("progress", F.when(F.col("finished"), F.lit(1.0)).otherwise(F.least(F.lit(0.99), share)))


def within_cap(rows: DataFrame, key: str, order: str, n: str, cap: int) -> DataFrame:
    """The rows of each key, in order, before which fewer than `cap` things were counted (n each): the last one may pass it."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum(n).over(before), F.lit(0))).filter(F.col("before") < cap).drop("before")


def files_signature(files: DataFrame) -> DataFrame:
    """files: seq, name, content. signature: one digest of all names and contents in order, made of a digest each."""
    each = files.select("seq", F.sha2(F.concat(F.sha2(F.col("name").cast("binary"), 256), F.sha2("content", 256)), 256).alias("h"))
    # A digest a file: uploads are few, and their contents stay where they are.
    return each.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "h"))), lambda x: x["h"]), ","), 256).alias("signature"))
