"""Joins of records with hypotheses, labels, and key checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.align import edit_counts, rate, word_errors
from ..functions.ids import call_dir
from ..functions.text import normalize_text
from ..schema import ROLES
from ..store import small_batches


def merge_transcriptions(records: DataFrame, results: DataFrame, roles: tuple[str, ...] = ROLES, accents: bool = False, numbers: bool = True) -> DataFrame:
    """Left join of records with results (segment_id, role, text), one column for each role.

    A null hypothesis was not transcribed; '' was, and nothing was heard.
    """
    small_batches(records.sparkSession)
    wide = results.groupBy("segment_id").pivot("role", list(roles)).agg(F.first("text"))
    wide = wide.select("segment_id", *(F.col(r).alias(f"hyp_{r}") for r in roles))
    rows = records.join(wide, "segment_id", "left")
    normal = lambda hyp: F.when(hyp.isNotNull(), normalize_text(hyp, F.col("lang"), accents, numbers))
    # all at once: column after column, each would have a Python worker of its own in every task
    return rows.withColumns({f"hyp_{r}_norm": normal(F.col(f"hyp_{r}")) for r in roles})


def coverage(rows: DataFrame, roles: tuple[str, ...] = ROLES) -> DataFrame:
    """How many rows each role has transcribed."""
    counts = rows.agg(*(F.count(f"hyp_{r}").alias(r) for r in roles))
    return counts.unpivot([], list(roles), "role", "n")


def add_labels(rows: DataFrame, role: str = "target", split: bool = True) -> DataFrame:
    """Errors of the target against the reference; rows that were not transcribed go.

    split: also tell substitutions, deletions and insertions, which needs a Python worker.
    """
    return with_labels(rows.where(F.col(f"hyp_{role}").isNotNull()), role, split)


def with_labels(rows: DataFrame, role: str = "target", split: bool = False) -> DataFrame:
    """The same for all rows: those that were not transcribed have null labels."""
    small_batches(rows.sparkSession)
    hyp, ref = F.col(f"hyp_{role}_norm"), F.col("reference_norm")
    if split:
        rows = rows.withColumn("_c", edit_counts(ref, hyp))
        made = {f"label_{k.upper()}": F.col(f"_c.{k}") for k in "sdi"} | {"label_errors": F.col("_c.errors"), "label_wer": F.col("_c.wer"), "n_hyp_words": F.col("_c.n_hyp"), "n_ref_words": F.col("_c.n_ref")}
        return rows.withColumns(made).drop("_c")
    n = lambda x: F.when(x == "", 0).otherwise(F.size(F.split(x, " ")))
    rows = rows.withColumns({"n_ref_words": n(ref), "n_hyp_words": n(hyp), "label_errors": word_errors(ref, hyp)})
    return rows.withColumn("label_wer", rate(F.col("label_errors"), F.col("n_ref_words"), F.col("n_hyp_words")))


def pending(records: DataFrame, cache: DataFrame) -> DataFrame:
    """Records that a cache lacks."""
    return records.join(cache, "segment_id", "left_anti")


def remap_results(results: DataFrame, triplet: dict[str, str]) -> DataFrame:
    """Let systems change roles: triplet maps a role to the system that plays it."""
    played = F.lit(None).cast("string")
    for role, system in triplet.items():
        played = F.when(F.col("role") == system, F.lit(role)).otherwise(played)
    return results.withColumn("role", played).where("role is not null")


def call_mapping(rows: DataFrame) -> DataFrame:
    """Name -> call, from the folder of the recording; a name with several folders is a collision."""
    dirs = rows.select("sample_id", call_dir(F.col("path_audio")).alias("dir")).where("dir is not null")
    return dirs.groupBy("sample_id").agg(F.min("dir").alias("call"), F.countDistinct("dir").alias("n_dirs"))


def duplicate_ids(rows: DataFrame) -> DataFrame:
    """segment_ids that stand on several rows; should be empty."""
    return rows.groupBy("segment_id").agg(F.count("*").alias("n")).where("n > 1")


def check_unique_ids(rows: DataFrame) -> DataFrame:
    """The rows; an action on them fails if a segment_id repeats."""
    counts = duplicate_ids(rows).agg(F.count("*").alias("_bad"))
    guard = F.when(F.col("_bad") > 0, F.raise_error(F.lit("segment_id is not unique"))).otherwise(F.lit(True))
    return rows.join(F.broadcast(counts.select(guard.alias("_ok"))), F.lit(True)).where("_ok").drop("_ok")
