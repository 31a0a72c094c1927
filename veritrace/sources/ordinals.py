"""Rows in the order of their files: their place in a corpus, the first of them, a seeded shuffle in a buffer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .annotations import missing_files


def with_index(rows: DataFrame) -> DataFrame:
    """Adds `index`: the place of each row, from 0, in the order of file names and of rows in a file.

    rows: as read from files, not shuffled yet. A task numbers the rows of its splits as they come; how many lie before a split follows from
    a count for each split (the only thing that is brought together). So the same rows have the same place however many tasks read them.
    """
    meta = F.col("_metadata")
    placed = rows.select("*", meta["file_path"].alias("_file"), meta["file_block_start"].alias("_block"), F.monotonically_increasing_id().alias("_at"))
    splits = placed.groupBy("_file", "_block").agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
    earlier = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select(F.col("_file").alias("_f"), F.col("_block").alias("_b"), "_from", "_n")
    starts = starts.select("_f", "_b", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_from")).alias("_shift"))
    joined = placed.join(F.broadcast(starts), (F.col("_file") == F.col("_f")) & (F.col("_block") == F.col("_b")))
    return joined.withColumn("index", F.col("_at") + F.col("_shift")).drop("_file", "_block", "_at", "_f", "_b", "_shift")


def shuffled_place(index: Column, buffer: int, seed: int = 0) -> Column:
    """Where a row comes in a seeded shuffle in which it waits behind fewer than `buffer` later rows: its index and a share of the buffer.

    The share is a hash (MD5) of seed and index, so reruns agree. Without a buffer it is the index.
    """
    if not buffer:
        return index.cast("double")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), index.cast("string")).cast("binary"))
    return index + buffer * (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0)


def first_rows(rows: DataFrame, n: int, buffer: int = 0, seed: int = 0) -> DataFrame:
    """The first n rows (with `index`) in file order, or as a seeded buffer of a stream would give them."""
    return rows.orderBy(shuffled_place(F.col("index"), buffer, seed), "index").limit(n)


def complete_corpus(records: DataFrame, files: DataFrame, n: int) -> DataFrame | None:
    """The first n records of a corpus that is prepared already, or None if there are fewer or one of them lacks its file.

    records: as read from files, with wav_path; files: path. All or nothing: the caller then prepares the corpus anew.
    """
    first = first_rows(with_index(records), n)
    if first.count() < n or not missing_files(first, files).isEmpty():
        return None
    return first
