"""Schemas of the tables, and the defaults of optional columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = ("target", "proxy_a", "proxy_b")
PROXIES = ("proxy_a", "proxy_b")

SEGMENT = """
start_time double, end_time double, channel string,
annotation struct<speaker_id: string, speaker_role: string, text: string, words: array<string>>
"""
ANNOTATIONS = f"""
samples map<string, struct<
  sample_id: string, path_audio: string, channel_operator: string, channel_client: string,
  prediction: struct<segments: array<struct<{SEGMENT}>>>, label: struct<segments: array<struct<{SEGMENT}>>>>>
"""
RECORDS = """
segment_id string, sample_id string, path_audio string, channel_raw string, channel_operator string,
channel_client string, speaker_role string, speaker_id string, start_time double, end_time double,
duration double, reference string, reference_norm string, n_ref_words int, lang string, wav_path string,
channel_index int, group_id string, session_id string, corpus string, condition string
"""
CACHE = "segment_id string, system string, text string"

#: Optional columns and what a missing value means.
DEFAULTS = {"corpus": "internal", "condition": "clean", "speaker_role": ""}


def canonicalise(rows: DataFrame) -> DataFrame:
    """Fill the defaults; group_id falls back to sample_id where it is missing or ''."""
    for name, value in DEFAULTS.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in rows.columns else F.lit(value))
    group = F.nullif(F.col("group_id"), F.lit("")) if "group_id" in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("group_id", F.coalesce(group, "sample_id"))
