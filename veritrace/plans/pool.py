"""A pool of call segments over the conversations table: turns as references, with three imitated recognisers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import tag_of
from ..functions.text import normalize_text, words
from ..operators.labels import add_labels, merge_transcriptions
from ..sources.annotations import load_results
from ..store import small_batches, written


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment for each turn; corpus, language and condition follow from the call's number."""
    small_batches(spark)
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("conv_id") % len(values) + 1).cast("int"))
    rows = turns.select(
        F.format_string("%d__%04d", "conv_id", "turn").alias("segment_id"),
        F.concat(F.lit("call"), "conv_id").alias("sample_id"),
        F.concat(F.lit("/calls/"), F.col("conv_id") % 5, F.lit("/call"), "conv_id", F.lit("/audios/"), "turn", F.lit(".wav")).alias("path_audio"),
        F.col("role").alias("speaker_role"),
        (F.col("turn") * 10.0).alias("start_time"),
        F.col("text").alias("reference"),
        pick(["en", "de", "fr", "es"]).alias("lang"),
        pick(["calls", "read", "debate"]).alias("corpus"),
        pick(["clean", "noise"]).alias("condition"),
        "conv_id",
        "turn",
    )
    rows = rows.withColumn("reference_norm", normalize_text(F.col("reference"), F.col("lang"), numbers=False))
    rows = rows.withColumn("n_ref_words", F.size(words(F.col("reference_norm"))))
    duration = F.round(F.col("n_ref_words") * 0.4 + 0.5, 3)
    return rows.withColumns({"duration": duration, "group_id": F.concat(F.lit("group"), (F.col("conv_id") / 2).cast("long")), "tag": tag_of(F.col("corpus"), F.col("lang"), F.col("condition"))})


def hypotheses(rows: DataFrame) -> DataFrame:
    """Long table (segment_id, role, text): every system drops or changes words by their place, or misses whole segments."""
    ws = words(F.col("reference_norm"))
    drop = lambda k: F.filter(ws, lambda w, i: (i + 1) % k != 0)
    target = F.filter(F.transform(ws, lambda w, i: F.when((i + 1) % 7 == 0, F.lit("")).when((i + 1) % 11 == 5, F.lit("uh")).otherwise(w)), lambda w: w != "")
    changed = F.transform(ws, lambda w, i: F.when((i + 1) % 9 == 4, F.reverse(w)).otherwise(w))
    join = lambda x: F.array_join(x, " ")
    systems = {
        "target": rows.where("(conv_id * 7 + turn) % 29 <> 0").select("segment_id", join(target).alias("text")),
        "proxy_a": rows.select("segment_id", join(drop(5)).alias("text")),
        "proxy_b": rows.where("(conv_id + turn) % 13 <> 0").select("segment_id", join(changed).alias("text")),
    }
    return load_results(systems)


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with their hypotheses, as the files are when an action runs: nothing is kept from one call to the next.

    Alignments cost far more than reading what they align, so rows are dealt over all shuffle partitions, however few files hold them.
    """
    rows = records(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "segment_id")
    return merge_transcriptions(rows, hypotheses(rows), numbers=False)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled table, written anew in each call: its alignments are then made once, however often a plan reads it."""
    return written(add_labels(merged(spark, sf_dir), split=False), "labelled")
