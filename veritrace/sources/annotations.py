"""Scans: annotation documents, records, transcription caches, pools of corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_text, words
from ..schema import ANNOTATIONS, CACHE, RECORDS

#: Corpora, their languages, and the columns of text and session in order of preference.
CORPORA = {
    "fleurs": {"langs": ["es", "de", "en", "fr", "pt"], "text": ["transcription", "raw_transcription"], "session": []},
    "mls": {"langs": ["es", "de", "fr", "pt"], "text": ["transcript", "text"], "session": ["speaker_id", "chapter_id"]},
    "voxpopuli": {"langs": ["es", "de", "en", "fr"], "text": ["normalized_text", "raw_text"], "session": ["session_id"]},
}


def corpora(spark: SparkSession) -> DataFrame:
    """The registry as a table: a row for each corpus and language."""
    rows = [(c, lang, x["text"], x["session"]) for c, x in CORPORA.items() for lang in x["langs"]]
    return spark.createDataFrame(rows, "corpus string, lang string, text_keys array<string>, session_keys array<string>")


def read_annotations(spark: SparkSession, path: str, **kw) -> DataFrame:
    """Segments of annotation documents (one JSON object a file); see `segments_of`."""
    return segments_of(spark.read.schema(ANNOTATIONS).json(path, multiLine=True, mode="FAILFAST"), **kw)


def segments_of(documents: DataFrame, lang: str, min_ref_words: int = 10, roles: list[str] | None = None, source: str = "label", accents: bool = False, numbers: bool = True) -> DataFrame:
    """Unnest samples and segments. Rows that are rejected stay, with the first reason that holds:
    wrong_role, empty_text, bad_span, too_short. The ordinal in segment_id counts rejected ones too.
    """
    samples = documents.select(F.explode("samples").alias("key", "s"))
    rows = samples.select(
        F.col("key").alias("sample_id"),
        F.col("s.path_audio").alias("path_audio"),
        F.col("s.channel_operator").alias("channel_operator"),
        F.col("s.channel_client").alias("channel_client"),
        F.posexplode(F.col(f"s.{source}.segments")).alias("ordinal", "g"),
    )
    text = F.col("g.annotation.text")
    start, end = (F.coalesce(F.col(f"g.{c}"), F.lit(0.0)) for c in ("start_time", "end_time"))
    rows = rows.select(
        F.format_string("%s__%04d", "sample_id", "ordinal").alias("segment_id"),
        "sample_id",
        "path_audio",
        F.col("g.channel").alias("channel_raw"),
        "channel_operator",
        "channel_client",
        F.coalesce("g.annotation.speaker_role", F.lit("")).alias("speaker_role"),
        F.col("g.annotation.speaker_id").alias("speaker_id"),
        start.alias("start_time"),
        end.alias("end_time"),
        F.round(end - start, 3).alias("duration"),
        F.trim(text).alias("reference"),
        F.lit(lang).alias("lang"),
    )
    return with_reject_reason(rows.withColumn("reference_norm", normalize_text(F.col("reference"), F.col("lang"), accents, numbers)), min_ref_words, roles)


def with_reject_reason(rows: DataFrame, min_ref_words: int = 10, roles: list[str] | None = None) -> DataFrame:
    rows = rows.withColumn("n_ref_words", F.size(words(F.col("reference_norm"))))
    wrong = ~F.col("speaker_role").isin(roles) if roles else F.lit(False)
    reason = (
        F.when(wrong, "wrong_role")
        .when(F.coalesce(F.trim("reference"), F.lit("")) == "", "empty_text")
        .when(F.col("end_time") <= F.col("start_time"), "bad_span")
        .when(F.col("n_ref_words") < min_ref_words, "too_short")
    )
    return rows.withColumn("reject_reason", reason)


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("reject_reason is null").drop("reject_reason")


def reject_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reject_reason")).agg(F.count("*").alias("n"))


def read_records(spark: SparkSession, *paths: str) -> DataFrame:
    """Records or labelled tables in JSON Lines; blank lines are skipped."""
    return spark.read.schema(RECORDS).json(list(paths), mode="FAILFAST")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """An append-only transcription cache: the last line of a segment counts, lines without a segment don't.

    The order of lines is that of file names and of blocks in a file.
    """
    lines = spark.read.schema(CACHE).json(path, mode="FAILFAST")
    meta = F.col("_metadata")
    lines = lines.select("*", F.struct(meta["file_name"], meta["file_block_start"], F.monotonically_increasing_id()).alias("seq"))
    return last_wins(lines.where("segment_id is not null"), F.col("seq")).drop("seq")


def last_wins(lines: DataFrame, seq: Column) -> DataFrame:
    """One row for each segment_id: the one of the greatest seq."""
    fields = F.struct(*(F.col(c) for c in lines.columns))
    return lines.groupBy("segment_id").agg(F.max_by(fields, seq).alias("r")).select("r.*")


def load_results(caches: dict[str, DataFrame]) -> DataFrame:
    """Caches by role as one long table (segment_id, role, text)."""
    tables = [c.select("segment_id", F.lit(role).alias("role"), "text") for role, c in caches.items()]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def public_records(examples: DataFrame, corpus: str, lang: str, condition: str, text: Column, session: Column, limit: int | None = None, min_ref_words: int = 10) -> DataFrame:
    """Records of a public corpus: examples has `index` (place in the source) and `duration`.

    Ids hold the source's index, so they have gaps where rows are rejected; the limit comes after the
    rejection. Readings of one text without a session are a group.
    """
    prefix = F.lit(f"{corpus}__{lang}__{condition}")
    rows = examples.select("index", "duration", text.alias("reference"), session.alias("session_id"), F.lit(lang).alias("lang"))
    rows = rows.withColumn("reference_norm", normalize_text(F.col("reference"), F.col("lang")))
    rows = rows.withColumn("n_ref_words", F.size(words(F.col("reference_norm")))).where(f"n_ref_words >= {int(min_ref_words)}")
    segment = F.format_string("%s__%05d", prefix, F.col("index"))
    with_session = F.concat_ws("__", prefix, F.col("session_id"))
    group = F.concat(F.lit("txt"), F.substring(F.sha1(F.col("reference_norm").cast("binary")), 1, 12))
    rows = rows.withColumns(
        {
            "segment_id": segment,
            "sample_id": F.when(F.col("session_id").isNull(), segment).otherwise(with_session),
            "group_id": F.when(F.col("session_id").isNull(), F.concat_ws("__", prefix, group)).otherwise(with_session),
            "corpus": F.lit(corpus),
            "condition": F.lit(condition),
        }
    )
    return rows.orderBy("index").limit(limit) if limit else rows


def missing_files(records: DataFrame, files: DataFrame) -> DataFrame:
    """Records whose audio is not among the files (column path)."""
    return records.join(files.select(F.col("path").alias("wav_path")), "wav_path", "left_anti")


def load_pool(tables: list[DataFrame]) -> DataFrame:
    """Union of labelled tables whose columns may differ."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def first_per_group(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")
