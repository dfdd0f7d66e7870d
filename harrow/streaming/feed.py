"""Micro-batches: unseen postings against a state table, and one message for each new row."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from harrow.operators import dedup
from harrow.plans import board


def read_postings(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """NDJSON files as they arrive; a bound on files per batch leaves the rest for the next one."""
    r = spark.readStream.schema(schema).format("json")
    return (r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r).load(path)


def fresh_once(postings: DataFrame, delay: str = "1 day", parity: bool = True) -> DataFrame:
    """Each key once within the watermark; later repeats are the state table's concern."""
    return dedup.with_key(postings, parity=parity).withWatermark("posted_at", delay).dropDuplicatesWithinWatermark(["job_key"])


def upsert_unseen(postings: DataFrame, state: str, out: str, checkpoint: str, parity: bool = True, **trigger) -> StreamingQuery:
    """Appends postings whose key the state table (Parquet, job_key) lacks to `out`, then their keys to the state.

    Both are written in a folder named by the batch, which a batch that runs again overwrites, so each key is written once.
    """

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        keyed = dedup.with_key(batch, parity=parity)
        new = dedup.first_by_key(keyed, "job_key", "seq")
        try:
            known = spark.read.option("basePath", state).parquet(state).where(F.col("batch") != n)
            new = dedup.unseen(new, known, ["job_key"])
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
        new.write.mode("overwrite").parquet(f"{out}/batch={n}")
        written = spark.read.parquet(f"{out}/batch={n}")
        written.select("job_key").write.mode("overwrite").parquet(f"{state}/batch={n}")

    return postings.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def notify(jobs: DataFrame, send: Callable[[dict[str, str]], None], checkpoint: str, pause: float = 1.5, **trigger) -> StreamingQuery:
    """One message for each row, `pause` seconds apart; rows come to the driver one partition at a time."""

    def step(batch: DataFrame, n: int) -> None:
        for row in batch.toLocalIterator():
            send(board.mail(row.asDict(recursive=True)))
            time.sleep(pause)

    return jobs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def events_per_window(events: DataFrame, ts: str = "ts", width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Counts per type and window, with late rows dropped after the delay."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("day"), "event_type", "n", "value")
