"""Sinks: records, manifests, caches, packs, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_records(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def manifest(rows: DataFrame, task: str = "asr", pnc: str = "yes") -> DataFrame:
    """The fields that a recogniser's manifest has."""
    return rows.select(
        F.col("wav_path").alias("audio_filepath"),
        "duration",
        F.lit(task).alias("taskname"),
        F.col("lang").alias("source_lang"),
        F.col("lang").alias("target_lang"),
        F.lit(pnc).alias("pnc"),
        F.col("reference").alias("answer"),
        "segment_id",
    )


def append_cache(rows: DataFrame, path: str) -> None:
    """Add hypotheses to a cache; on reading, a segment's last line counts."""
    rows.select("segment_id", "system", "text").write.mode("append").json(path)


def write_pack(pool: DataFrame, path: str) -> None:
    """A pool as one folder for each corpus, language and condition, so that a plan prunes what it reads."""
    pool.write.mode("overwrite").partitionBy("corpus", "lang", "condition").parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def audio_usage(files: DataFrame) -> DataFrame:
    """Megabytes by tag and in all (tag null); files: tag, length."""
    return files.rollup("tag").agg(F.round(F.sum("length") / 1e6, 3).alias("mb"), F.count("*").alias("n"))


def regroup(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Give segments the call that a mapping (sample_id, call) names; running it again changes nothing."""
    known = rows if "original_sample_id" in rows.columns else rows.withColumn("original_sample_id", F.lit(None).cast("string"))
    known = known.withColumn("original_sample_id", F.coalesce("original_sample_id", "sample_id"))
    joined = known.join(mapping.select(F.col("sample_id").alias("original_sample_id"), "call"), "original_sample_id", "left")
    return joined.withColumn("sample_id", F.coalesce("call", "sample_id")).drop("call")


def report(rows: DataFrame, most: int = 100_000) -> str:
    """A small result as JSON text; one of more than `most` rows is an error."""
    held = rows.limit(most + 1).collect()
    if len(held) > most:
        raise ValueError(f"more than {most} rows are no report: write them")
    return json.dumps([r.asDict(recursive=True) for r in held], ensure_ascii=False, indent=1)
