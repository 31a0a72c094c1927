"""Features of a labelled row: agreement of the systems, and the target's text."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import PROXIES
from ..store import small_batches
from .align import char_error_rate, edit_counts
from .text import words

#: Names of the features of the text, and of those that mean the same at any length.
TEXT = ["n_hyp_words", "n_hyp_chars", "duration", "words_per_second", "chars_per_word", "gzip_ratio", "type_token_ratio", "repeated_word_ratio", "max_word_repeat", "log_duration"]
SCALE_FREE_TEXT = ["words_per_second", "chars_per_word", "gzip_ratio", "type_token_ratio", "repeated_word_ratio"]
EXTRA = ["x_is_operator"]


def proxy_names(roles: tuple[str, ...] = PROXIES) -> list[str]:
    names = [f"{kind}_{r}" for r in roles for kind in ("pwer", "pcer", "psub", "pdel", "pins", "plen_ratio")]
    return names + ["pwer_mean", "pwer_min", "pwer_max", "pwer_spread"] + (["pwer_proxy_vs_proxy"] if len(roles) > 1 else [])


def feature_names(blocks: tuple[str, ...] = ("proxy", "text"), roles: tuple[str, ...] = PROXIES) -> list[str]:
    parts = {"proxy": proxy_names(roles), "text": TEXT, "extra": EXTRA}
    return sorted(n for b in blocks for n in parts[b])


def block_of(name: str) -> str:
    return "extra" if name.startswith("x_") else "text" if name in TEXT else "proxy"


def is_transferable(name: str) -> bool:
    """Free of scale: means the same in another corpus."""
    return block_of(name) == "proxy" or name in SCALE_FREE_TEXT


@F.pandas_udf(T.DoubleType())
def compression_ratio(texts: pd.Series) -> pd.Series:
    """Size of the deflated text by its size; 0 for ''."""

    def one(text: str | None) -> float:
        data = (text or "").encode()
        # a gzip stream is the raw deflate stream and 18 bytes
        packer = zlib.compressobj(9, zlib.DEFLATED, -15)
        return (len(packer.compress(data) + packer.flush()) + 18) / len(data) if data else 0.0

    return texts.map(one)


def with_proxy_features(rows: DataFrame, roles: tuple[str, ...] = PROXIES) -> DataFrame:
    """Each proxy plays the reference of the target; a missing proxy has no features (null, later 0)."""
    target = F.coalesce("hyp_target_norm", F.lit(""))
    for r in roles:
        proxy = F.col(f"hyp_{r}_norm")
        rows = rows.withColumn(f"_{r}", edit_counts(proxy, target))
        n = F.greatest(F.col(f"_{r}.n_ref"), F.lit(1))
        rows = rows.withColumns(
            {
                f"pwer_{r}": F.col(f"_{r}.wer"),
                f"pcer_{r}": char_error_rate(proxy, target),
                f"psub_{r}": F.col(f"_{r}.s") / n,
                f"pdel_{r}": F.col(f"_{r}.d") / n,
                f"pins_{r}": F.col(f"_{r}.i") / n,
                f"plen_ratio_{r}": F.col(f"_{r}.n_hyp") / n,
            }
        )
    rates = F.filter(F.array(*(F.col(f"pwer_{r}") for r in roles)), lambda x: x.isNotNull())
    rows = rows.withColumn("_rates", rates)
    some = F.size("_rates") > 0
    mean = F.aggregate("_rates", F.lit(0.0), lambda acc, x: acc + x) / F.size("_rates")
    rows = rows.withColumns(
        {
            "pwer_mean": F.when(some, mean),
            "pwer_min": F.array_min("_rates"),
            "pwer_max": F.array_max("_rates"),
            "pwer_spread": F.array_max("_rates") - F.array_min("_rates"),
        }
    )
    if len(roles) > 1:
        rows = rows.withColumn("_pair", edit_counts(F.col(f"hyp_{roles[0]}_norm"), F.col(f"hyp_{roles[1]}_norm"))).withColumn("pwer_proxy_vs_proxy", F.col("_pair.wer")).drop("_pair")
    return rows.drop("_rates", *(f"_{r}" for r in roles))


def _repeats(ws: Column) -> Column:
    """How often each distinct word stands in the text."""
    return F.transform(F.array_distinct(ws), lambda w: F.size(F.filter(ws, lambda x: x == w)))


def with_text_features(rows: DataFrame) -> DataFrame:
    text = F.coalesce("hyp_target_norm", F.lit(""))
    rows = rows.withColumn("_ws", words(text)).withColumn("_n", F.size("_ws")).withColumn("_c", _repeats(F.col("_ws")))
    duration = F.greatest(F.coalesce(F.col("duration"), F.lit(0.0)), F.lit(1e-6))
    per_word = lambda x: F.when(F.col("_n") > 0, x / F.col("_n")).otherwise(0.0)
    repeated = F.aggregate(F.filter("_c", lambda c: c > 1), F.lit(0), lambda acc, c: acc + c)
    return rows.withColumns(
        {
            "n_hyp_chars": F.length(text),
            "words_per_second": F.col("_n") / duration,
            "chars_per_word": per_word(F.length(text)),
            "gzip_ratio": compression_ratio(text),
            "type_token_ratio": per_word(F.size("_c")),
            "repeated_word_ratio": per_word(repeated),
            "max_word_repeat": F.coalesce(F.array_max("_c"), F.lit(0)),
            "log_duration": F.log1p(duration),
            "n_hyp_words": F.col("_n"),
            "duration": duration,
        }
    ).drop("_ws", "_n", "_c")


def with_extra_features(rows: DataFrame) -> DataFrame:
    return rows.withColumn("x_is_operator", F.when(F.lower(F.trim(F.coalesce("speaker_role", F.lit("")))).startswith("oper"), 1.0).otherwise(0.0))


def with_call_context(rows: DataFrame, rate: str = "pwer_mean") -> DataFrame:
    """What stands around a segment in its call: the rates of the segments before and after it and of the call, and its place (0 to 1).

    A segment without a neighbour has its own rate there. The order is that of start_time; calls are short enough for one task each.
    """
    order = Window.partitionBy("sample_id").orderBy("start_time", "segment_id")
    call = Window.partitionBy("sample_id")
    return rows.withColumns(
        {
            "ctx_pwer_prev": F.coalesce(F.lag(rate).over(order), F.col(rate)),
            "ctx_pwer_next": F.coalesce(F.lead(rate).over(order), F.col(rate)),
            "ctx_pwer_call": F.avg(rate).over(call),
            "ctx_position": F.coalesce((F.row_number().over(order) - 1) / F.nullif(F.count("*").over(call) - 1, F.lit(0)), F.lit(0.0)),
        }
    )


def repeated_ngram_ratio(text: Column, n: int) -> Column:
    """Share of a text's n-grams that repeat an earlier one."""
    ws = words(text)
    grams = F.when(F.size(ws) >= n, F.transform(F.sequence(F.lit(1), F.size(ws) - n + 1), lambda i: F.array_join(F.slice(ws, i, n), " "))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(grams) > 0, 1 - F.size(F.array_distinct(grams)) / F.size(grams)).otherwise(0.0)


def orphan_word_ratio(target: Column, proxies: list[Column]) -> Column:
    """Share of the target's words that no proxy has."""
    known = F.flatten(F.array(*(words(F.coalesce(p, F.lit(""))) for p in proxies)))
    ws = words(target)
    return F.when(F.size(ws) > 0, F.size(F.filter(ws, lambda w: ~F.array_contains(known, w))) / F.size(ws)).otherwise(0.0)


def build_features(rows: DataFrame, blocks: tuple[str, ...] = ("proxy", "text"), roles: tuple[str, ...] = PROXIES, names: list[str] | None = None) -> DataFrame:
    """Adds `features`: a struct of doubles in the order of their names; what is missing is 0. No label is needed.

    names: only these (of the blocks' features); what none of them needs is not computed.
    """
    small_batches(rows.sparkSession)
    every = feature_names(blocks, roles)
    names = every if names is None else [n for n in every if n in set(names)]
    own = {c: F.col(c) for c in every if c in rows.columns}  # columns of the row that a feature is named like
    made = rows.withColumns({f"_own_{c}": column for c, column in own.items()})
    if "proxy" in blocks and any(block_of(n) == "proxy" for n in names):
        made = with_proxy_features(made, roles)
    if "text" in blocks and any(block_of(n) == "text" for n in names):
        made = with_text_features(made)
    if "extra" in blocks and any(block_of(n) == "extra" for n in names):
        made = with_extra_features(made)
    made = made.withColumn("features", F.struct(*(F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names)))
    return made.select(*(F.col(f"_own_{c}").alias(c) if c in own else c for c in rows.columns), "features")
