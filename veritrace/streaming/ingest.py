"""Resumable ingestion: micro-batches of hypotheses go into a keyed cache, and are merged from time to time.

A cache is a folder: batches/batch=N holds the last line of each segment in batch N; bases/base=N what batches up to N come to. A base counts
when it is complete (_SUCCESS); the latest one and the batches after it are the cache. Batches and bases that are no longer read go one merge later, so
that a reader that has begun can end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import Folders


def _last(lines: DataFrame) -> DataFrame:
    """The last line of each segment."""
    rest = F.struct(*(c for c in lines.columns if c != "segment_id"))
    return lines.groupBy("segment_id").agg(F.max_by(rest, "seq").alias("r")).select("segment_id", "r.*")


def _numbers(folders: Folders, path: str, name: str) -> list[int]:
    """Numbers of the complete batches or bases of a cache."""
    found = [n.removeprefix(f"{name}=") for n in folders.names(path) if n.startswith(f"{name}=")]
    return sorted(int(n) for n in found if folders.exists(f"{path}/{name}={n}/_SUCCESS"))


def ingest(lines: DataFrame, cache: str, checkpoint: str, merge_after: int = 20) -> None:
    """Take in all files that are there and not taken yet, then stop.

    A batch is written under its number, so one that is run again after a failure replaces itself, or does nothing if a base holds it
    already; the checkpoint knows which files are done. When merge_after batches have come since the last base they are merged.
    """
    spark = lines.sparkSession
    folders = Folders(spark, cache)

    def add(batch: DataFrame, number: int) -> None:
        bases = _numbers(folders, f"{cache}/bases", "base")
        if bases and number <= bases[-1]:
            return
        _last(batch).write.mode("overwrite").parquet(f"{cache}/batches/batch={number}")
        if number - (bases[-1] if bases else -1) >= merge_after:
            merge(spark, cache)

    running = lines.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()


def parts(spark: SparkSession, cache: str) -> list[str]:
    """The folders that make up a cache: the latest base and the batches after it."""
    folders = Folders(spark, cache)
    bases = _numbers(folders, f"{cache}/bases", "base")[-1:]
    later = [b for b in _numbers(folders, f"{cache}/batches", "batch") if not bases or b > bases[0]]
    return [f"{cache}/bases/base={b}" for b in bases] + [f"{cache}/batches/batch={b}" for b in later]


def merge(spark: SparkSession, cache: str) -> None:
    """Make a base of all that a cache holds, then delete what only the base before the former one needed.

    A merge that dies leaves a base that isn't complete and is written anew; no reader takes it.
    """
    folders, held = Folders(spark, cache), parts(spark, cache)
    batches = _numbers(folders, f"{cache}/batches", "batch")
    former = _numbers(folders, f"{cache}/bases", "base")
    if not batches or former and batches[-1] <= former[-1]:
        return
    _last(spark.read.parquet(*held)).write.mode("overwrite").parquet(f"{cache}/bases/base={batches[-1]}")
    for b in former[:-1]:
        folders.delete(f"{cache}/bases/base={b}")
    for b in batches:
        if former and b <= former[-1]:
            folders.delete(f"{cache}/batches/batch={b}")


def state(spark: SparkSession, cache: str) -> DataFrame:
    """The cache as it stands: the last line of each segment."""
    return _last(spark.read.parquet(*parts(spark, cache)))


def windowed_counts(events: DataFrame, out: str, checkpoint: str, late: str = "10 minutes", width: str = "1 hour") -> None:
    """Counts by event-time window and type, written once the watermark has passed a window."""
    counts = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    flat = counts.select(F.col("window.start").alias("start"), "event_type", "n")
    flat.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
