"""Statistical aggregates: correlation, regression and classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import written
from .ranks import concordant_pairs, rank_correlation, running_sums, same_keys


def pearson(x: str, y: str) -> Column:
    """Correlation; null where one side is constant."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def regression_metrics(rows: DataFrame, y: str, pred: str, *keys: str, floor: float = 0.02) -> DataFrame:
    """n, MAE, RMSE, R2, bias, MAPE over y > floor, correlations; R2 is null for a constant truth."""
    error = F.col(pred) - F.col(y)
    large = F.col(y) > floor
    base = (
        rows.groupBy(*keys)
        .agg(
            F.count("*").alias("n"),
            F.avg(F.abs(error)).alias("mae"),
            F.sqrt(F.avg(error**2)).alias("rmse"),
            (1 - F.sum(error**2) / F.nullif(F.var_pop(y) * F.count("*"), F.lit(0.0))).alias("r2"),
            F.avg(F.when(large, F.abs(error) / F.nullif(F.col(y), F.lit(0.0)))).alias("mape"),
            F.sum(F.when(large, 0).otherwise(1)).alias("mape_excluded"),
            F.avg(error).alias("bias"),
            pearson(y, pred).alias("pearson"),
        )
    )
    return same_keys(base, rank_correlation(rows, y, pred, *keys), *keys)


def calibration(rows: DataFrame, y: str, pred: str, *keys: str) -> DataFrame:
    """Least squares of truth on prediction."""
    slope = F.covar_pop(y, pred) / F.nullif(F.var_pop(pred), F.lit(0.0))
    return rows.groupBy(*keys).agg(slope.alias("slope"), (F.avg(y) - slope * F.avg(pred)).alias("intercept"))


def pair_counts(rows: DataFrame, y: str, pred: str) -> DataFrame:
    """Concordant, discordant and tied pairs of rows, over all pairs; one row.

    Equal (y, pred) rows are collapsed to a count first; ties follow from counts, rising pairs are counted by blocks of both sides.
    """
    points = rows.where(F.col(y).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(y).cast("double").alias("y"), F.col(pred).cast("double").alias("p")).agg(F.count("*").alias("n"))
    points = written(points, "points")
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    tied = points.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(pairs("n"), F.lit(0.0)).alias("tied_both"))
    for c in "yp":
        tied = tied.join(F.broadcast(points.groupBy(c).agg(F.sum("n").alias("n")).agg(F.coalesce(pairs("n"), F.lit(0.0)).alias(f"tied_{c}"))), F.lit(True))
    rising = F.lit(concordant_pairs(points)).cast("double")
    every = F.col("n") * (F.col("n") - 1) / 2
    return tied.select(
        rising.alias("concordant"),
        (every - F.col("tied_y") - F.col("tied_p") + F.col("tied_both") - rising).alias("discordant"),
        (F.col("tied_p") - F.col("tied_both")).alias("tied_pred"),
        "n",
        "tied_y",
        "tied_both",
    )


def rank_agreement(rows: DataFrame, y: str, pred: str) -> DataFrame:
    """Concordance index and Kendall's tau-b; null where no pair can be compared."""
    c = pair_counts(rows, y, pred)
    comparable = F.col("concordant") + F.col("discordant") + F.col("tied_pred")
    pairs = F.col("n") * (F.col("n") - 1) / 2.0
    tied_pred = F.col("tied_pred") + F.col("tied_both")
    return c.select(
        ((F.col("concordant") + 0.5 * F.col("tied_pred")) / F.nullif(comparable.cast("double"), F.lit(0.0))).alias("c_index"),
        ((F.col("concordant") - F.col("discordant")) / F.nullif(F.sqrt((pairs - F.col("tied_y")) * (pairs - tied_pred)), F.lit(0.0))).alias("kendall_tau"),
    )


def extended_metrics(rows: DataFrame, y: str, pred: str, floor: float = 1e-9) -> DataFrame:
    """Regression metrics of all rows, with the relative error over all truths that are not zero (beyond floor), their number, and rank agreement."""
    base = regression_metrics(rows, y, pred).drop("mape", "mape_excluded")
    some = F.abs(F.col(y)) > floor
    relative = rows.agg(F.avg(F.when(some, F.abs((F.col(pred) - F.col(y)) / F.nullif(F.col(y), F.lit(0.0))))).alias("mape"), F.count_if(some).alias("mape_n"))
    return same_keys(same_keys(base, relative), rank_agreement(rows, y, pred))


def binary_metrics(rows: DataFrame, y: str, pred: str, threshold: float, *keys: str) -> DataFrame:
    """Screening of rows with y > threshold by pred > threshold; areas are null where one class is missing."""
    t = F.col(y) > threshold
    rows = rows.withColumns({"_t": t.cast("int"), "_p": (F.col(pred) > threshold).cast("int")})
    by_score = rows.groupBy(*keys, pred).agg(F.sum("_t").alias("_pos"), F.count("*").alias("_n"))
    steps = running_sums(by_score, pred, ["_pos", "_n"], *keys)
    tp_so_far, all_so_far = (F.col(f"total_{c}") - F.col(f"before_{c}") for c in ("_pos", "_n"))  # from the greatest down to this score
    areas = steps.groupBy(*keys).agg(
        (F.sum(F.col("_pos") * tp_so_far / all_so_far) / F.nullif(F.sum("_pos").cast("double"), F.lit(0.0))).alias("pr_auc"),
        F.sum(F.col("_pos") * (F.col("before__n") + (F.col("_n") + 1) / 2.0)).alias("_ranks"),
    )
    count = lambda a, b: F.sum(F.when((F.col("_t") == a) & (F.col("_p") == b), 1).otherwise(0)).cast("double")
    base = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("_t").alias("prevalence"), count(1, 1).alias("tp"), count(0, 1).alias("fp"), count(1, 0).alias("fn"), count(0, 0).alias("tn")
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    pos, neg = tp + fn, fp + tn
    over = lambda a, b: a / F.nullif(b, F.lit(0.0))
    both = (pos > 0) & (neg > 0)
    made = same_keys(base, areas, *keys).withColumns(
        {
            "roc_auc": over(F.col("_ranks") - pos * (pos + 1) / 2, pos * neg),
            "precision": F.coalesce(over(tp, tp + fp), F.lit(0.0)),
            "recall": F.coalesce(over(tp, pos), F.lit(0.0)),
            "f1": F.coalesce(over(2 * tp, 2 * tp + fp + fn), F.lit(0.0)),
            "balanced_accuracy": (over(tp, pos) + over(tn, neg)) / 2,
            "mcc": F.coalesce(over(tp * tn - fp * fn, F.sqrt((tp + fp) * pos * neg * (tn + fn))), F.lit(0.0)),
            "pr_auc": F.when(both, F.col("pr_auc")),
        }
    ).drop("_ranks")
    return made


def precision_at_k(rows: DataFrame, y: str, pred: str, k: int, threshold: float, order: str) -> DataFrame:
    """Share of true ones among the k greatest predictions, and the lift over all; ties by `order`."""
    total = rows.agg(F.avg((F.col(y) > threshold).cast("double")).alias("prevalence"))
    top = rows.orderBy(F.desc(pred), order).limit(k).agg(F.avg((F.col(y) > threshold).cast("double")).alias("precision"), F.count("*").alias("k"))
    return top.join(F.broadcast(total), F.lit(True)).withColumn("lift", F.col("precision") / F.nullif(F.col("prevalence"), F.lit(0.0)))


def resolve_k(k_values: list[float], n: int, n_bad: int) -> list[int]:
    """Fractions of n or counts, and the number of bad ones; distinct, sorted, within (0, n]."""
    ks = {round(k * n) if isinstance(k, float) and k < 1 else int(k) for k in k_values} | {n_bad}
    return sorted(k for k in ks if 0 < k <= n)


def gain(metrics: DataFrame, model: str = "model", baseline: str = "pwer") -> DataFrame:
    """1 - MAE / MAE of the baseline; null where that is missing or 0."""
    base = metrics.where(F.col(model) == baseline).select(F.col("mae").alias("_base"))
    joined = metrics.join(F.broadcast(base), F.lit(True), "left")
    return joined.withColumn("gain", 1 - F.col("mae") / F.nullif(F.col("_base"), F.lit(0.0))).drop("_base")
