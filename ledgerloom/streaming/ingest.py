"""The reading job as a file stream: new response files are taken in once, with what is already cached left out."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.job import envelopes
from ledgerloom.sources import slips

RESPONSE = "hash string, page int, position int, body string"


def start(spark: SparkSession, source: str, cache: str, failures: str, checkpoint: str, version: str, files_at_once: int = 100, name: str | None = None, each: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Start (or resume from `checkpoint`) and stop by itself when all files are read.

    What a batch writes, to the cache and to `failures`, lies in partitions that are named after the checkpoint and the batch's
    number: a batch that is run again after a failure, at whatever point, replaces what it wrote before. Slots that another batch has
    brought are left out. files_at_once bounds a batch, which is read once. Failed slips are read again if a later file brings them.
    """
    rows = spark.readStream.schema(RESPONSE).option("maxFilesPerTrigger", files_at_once).json(source)
    own = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, number: int) -> None:
        label = f"{own}-{number}"
        found = envelopes(batch).dropDuplicates(["hash", "page", "position", "error"]).persist()
        try:
            good = found.filter("error is null and slip is not null").select("hash", "page", "position", F.col("slip").alias("payload"), "error").dropDuplicates(["hash", "page", "position"])
            try:
                known = batch.sparkSession.read.schema(slips.CACHE).parquet(cache).filter((F.col("render_version") == version) & (F.col("batch") != label))
                good = good.join(known.select("hash", "page", "position"), ["hash", "page", "position"], "left_anti")
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
            slips.append_cache(good, cache, version, label)
            bad = found.filter("error is not null").select("hash", "page", "position", "error", "retryable", F.lit(label).alias("batch"))
            bad.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(failures)
        finally:
            found.unpersist()
        if each:
            each(batch, number)

    stream = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (stream.queryName(name) if name else stream).start()


STATES = ("preparing", "reading", "done", "cancelled", "failed")
_cancelled: set[str] = set()


def state(query: StreamingQuery) -> str:
    """One of STATES. A query that was stopped by `cancel` keeps what it has committed."""
    if not query.isActive:
        return "failed" if query.exception() else "cancelled" if str(query.runId) in _cancelled else "done"
    return "reading" if query.recentProgress or query.status["isTriggerActive"] and query.status["isDataAvailable"] else "preparing"


def cancel(query: StreamingQuery) -> None:
    """Stop after the batch at hand; whole batches stay, and a later start goes on from the checkpoint."""
    _cancelled.add(str(query.runId))
    query.stop()


def running(spark: SparkSession) -> dict[str, StreamingQuery]:
    """The jobs that run in this session, by name."""
    return {q.name: q for q in spark.streams.active if q.name}
