"""Composite reports: metrics by stratum, by dataset, by threshold; transfer and significance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import binary_metrics, calibration, precision_at_k, rank_agreement, regression_metrics, resolve_k
from .summaries import call_metrics


def union_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def metrics_by_stratum(result: DataFrame, key: str, y: str = "y", pred: str = "pred") -> DataFrame:
    """Regression metrics for each value of a key and each model."""
    return regression_metrics(result, y, pred, key, "model")


def evaluate_by_dataset(rows: DataFrame, dataset: str = "corpus", y: str = "label_wer", pred: str = "pred") -> DataFrame:
    """Regression metrics for each dataset and for all (POOL)."""
    pooled = rows.withColumn(dataset, F.lit("POOL"))
    return regression_metrics(rows.unionByName(pooled), y, pred, dataset)


def classification_report(rows: DataFrame, y: str, pred: str, thresholds: list[float], k_values: list[float], order: str) -> DataFrame:
    """Screening metrics for each threshold, and precision among the greatest k predictions."""
    parts = []
    for t in thresholds:
        n, bad = rows.agg(F.count("*"), F.sum((F.col(y) > t).cast("long"))).first()
        parts.append(binary_metrics(rows, y, pred, t).withColumn("threshold", F.lit(t)))
        parts += [precision_at_k(rows, y, pred, k, t, order).withColumn("threshold", F.lit(t)) for k in resolve_k(k_values, n, bad or 0)]
    return union_of(parts)


def transfer_report(rows: DataFrame, preds: list[str], y: str = "label_wer") -> DataFrame:
    """Several predictions side by side, by segments and by calls, with calibration."""
    parts = []
    for p in preds:
        calls = call_metrics(rows, p)
        for level, table, truth, guess in (("segment", rows, y, p), ("call", calls, "wer_true", "wer_pred")):
            one = regression_metrics(table, truth, guess).join(F.broadcast(calibration(table, truth, guess)), F.lit(True))
            one = one.join(F.broadcast(rank_agreement(table, truth, guess)), F.lit(True))
            parts.append(one.withColumns({"level": F.lit(level), "prediction": F.lit(p)}))
    return union_of(parts)


def importance_comparison(permutation: DataFrame, gains: DataFrame, n: int = 10) -> DataFrame:
    """The n features of greatest permutation importance with their gains, both scaled to their maximum."""
    top = permutation.orderBy(F.desc("importance"), "feature").limit(n).join(gains.select("feature", "gain"), "feature", "left")
    most = top.agg(F.max("importance").alias("_i"), F.max("gain").alias("_g"))
    scaled = top.join(F.broadcast(most), F.lit(True))
    over = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0.0))
    return scaled.select("feature", over("importance", "_i").alias("importance"), over("gain", "_g").alias("gain"))
