"""Bootstrap intervals, sampled concordance and significance tests."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import written
from .metrics import pair_counts, rank_agreement
from .ranks import rank_correlation

#: Up to so many rows Kendall's p-value is counted exactly, if nothing ties.
EXACT_KENDALL = 33

#: Probabilities of at most 0, 1, 2, ... where one is expected.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


def _poisson(key: np.ndarray, replicates: np.ndarray, seed: int) -> np.ndarray:
    """A Poisson(1) number for each replicate and key: the quantile of a hash of both."""
    offset = np.uint64(seed * 0xD1342543DE82EF95 & (1 << 64) - 1)
    x = _mixed(key + offset)[None, :] + (replicates[:, None] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    uniform = (_mixed(x) >> np.uint64(11)) / float(1 << 53)
    return np.searchsorted(_POISSON, uniform, side="right").astype(float)


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _replicates(groups: DataFrame, columns: list[str], n_boot: int, seed: int) -> np.ndarray:
    """Sums of the columns in each bootstrap replicate of groups.

    Each group counts a Poisson(1) number of times in each replicate, drawn from its own key: groups need not
    come together in one task, and reruns agree. Row `n_boot` is the sample itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((n_boot + 1, len(columns)))
        for batch in batches:
            values = np.column_stack([batch.column(c).to_numpy().astype(float) for c in columns])
            key = batch.column("key").to_numpy().view(np.uint64)
            sums[n_boot] += values.sum(axis=0)
            for a in range(0, n_boot, 64):
                replicates = np.arange(a, min(a + 64, n_boot), dtype=np.uint64)
                sums[a : a + len(replicates)] += _poisson(key, replicates, seed) @ values
        place = np.repeat(np.arange(n_boot + 1), len(columns))
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.tile(np.arange(len(columns)), n_boot + 1)), pa.array(sums.ravel())], ["b", "c", "v"])

    found = groups.mapInArrow(run, "b long, c long, v double").groupBy("b", "c").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((n_boot + 1, len(columns)))
    out[found.b, found.c] = found.v
    return out


def cluster_bootstrap(rows: DataFrame, y: str, pred: str, group: str, n_boot: int = 1000, seed: int = 0) -> DataFrame:
    """MAE with a 95 % percentile interval, groups drawn instead of rows."""
    groups = rows.groupBy(group).agg(F.sum(F.abs(F.col(pred) - F.col(y))).alias("e"), F.count("*").alias("n")).withColumn("key", F.xxhash64(group))
    sums = _replicates(groups.select("key", "e", "n"), ["e", "n"], n_boot, seed)
    mae = sums[:, 0] / np.maximum(sums[:, 1], 1)
    low, high = np.percentile(mae[:-1][sums[:-1, 1] > 0], [2.5, 97.5])
    return rows.sparkSession.createDataFrame([(float(mae[-1]), float(low), float(high), groups.count())], "mae double, ci_low double, ci_high double, n_groups long")


def paired_bootstrap(rows: DataFrame, y: str, a: str, b: str, group: str, n_boot: int = 1000, seed: int = 0) -> DataFrame:
    """MAE(a) - MAE(b) with its interval; b is better if that is above 0."""
    error = lambda p: F.sum(F.abs(F.col(p) - F.col(y)))
    groups = rows.groupBy(group).agg((error(a) - error(b)).alias("e"), F.count("*").alias("n")).withColumn("key", F.xxhash64(group))
    sums = _replicates(groups.select("key", "e", "n"), ["e", "n"], n_boot, seed)
    diff = sums[:, 0] / np.maximum(sums[:, 1], 1)
    low, high = np.percentile(diff[:-1][sums[:-1, 1] > 0], [2.5, 97.5])
    return rows.sparkSession.createDataFrame([(float(diff[-1]), float(low), float(high), bool(low > 0))], "mae_difference double, ci_low double, ci_high double, favours_b boolean")


def compare_models(result: DataFrame, models: list[str] | None = None, n_boot: int = 1000, seed: int = 0) -> DataFrame:
    """`paired_bootstrap` of every two models of a protocol's out-of-fold predictions (segment_id, group_id, model, y, pred), in one pass.

    A row for each pair (reference, challenger), names in order: difference of the mean absolute errors, its 95 % interval, and whether that
    favours the challenger. Only segments that every model has predicted count.
    """
    names = sorted(models or [r.model for r in result.select("model").distinct().collect()])
    errors = [F.max(F.when(F.col("model") == m, F.abs(F.col("pred") - F.col("y")))).alias(f"e{i}") for i, m in enumerate(names)]
    wide = result.where(F.col("model").isin(names)).groupBy("segment_id", "group_id").agg(*errors).dropna(subset=[f"e{i}" for i in range(len(names))])
    sums = [F.sum(f"e{i}").alias(f"e{i}") for i in range(len(names))]
    groups = wide.groupBy("group_id").agg(*sums, F.count("*").alias("n")).withColumn("key", F.xxhash64("group_id"))
    columns = [*(f"e{i}" for i in range(len(names))), "n"]
    drawn = _replicates(groups.select("key", *columns), columns, n_boot, seed)
    mae = drawn[:, :-1] / np.maximum(drawn[:, -1:], 1)
    some, rows = drawn[:-1, -1] > 0, []
    for a in range(len(names)):
        for b in range(a + 1, len(names)):
            diff = mae[:, a] - mae[:, b]
            low, high = np.percentile(diff[:-1][some], [2.5, 97.5]) if some.any() else (np.nan, np.nan)
            rows.append((names[a], names[b], float(diff[-1]), float(low), float(high), bool(low > 0)))
    return result.sparkSession.createDataFrame(rows, "reference string, challenger string, mae_difference double, ci_low double, ci_high double, favours_b boolean")


def concordance_sample(rows: DataFrame, y: str, pred: str, key: str, max_pairs: int = 2_000_000, seed: int = 0) -> DataFrame:
    """Concordance index over about max_pairs random pairs: rows are dealt at random into buckets, and paired inside them."""
    n = rows.count()
    buckets = max(1, math.ceil(n * n / 2 / max_pairs))
    dealt = rows.select(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(buckets)).alias("bucket"), F.col(key).alias("k"), F.col(y).alias("y"), F.col(pred).alias("p"))
    a, b = (dealt.select("bucket", *(F.col(c).alias(c + s) for c in "kyp")) for s in "12")
    pairs = a.join(b, "bucket").where("k1 < k2 and y1 <> y2")
    good = F.when((F.col("y1") - F.col("y2")) * (F.col("p1") - F.col("p2")) > 0, 1.0).when(F.col("p1") == F.col("p2"), 0.5).otherwise(0.0)
    return pairs.agg(F.avg(good).alias("c_index"), F.count("*").alias("pairs"))


def _normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _t_sf(t: float, df: float) -> float:
    """Upper tail of Student's t: the density is integrated by Simpson's rule after t = tan(u)."""
    upper = math.atan(abs(t) / math.sqrt(df))
    u = np.linspace(upper, math.pi / 2, 4001)
    f = np.cos(u) ** (df - 1)
    weights = np.ones(4001)
    weights[1:-1:2], weights[2:-1:2] = 4, 2
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    tail = scale * float((weights * f).sum()) * float(u[1] - u[0]) / 3
    return tail if t >= 0 else 1 - tail


def kendall_variance(rows: DataFrame, y: str, pred: str) -> DataFrame:
    """(n, tied_y, tied_pred, variance): pairs that tie on each side, and the variance of concordant less discordant pairs without association.

    Corrected for ties from the sizes of tied groups, which are counted and never gathered. Null for fewer than 3 rows.
    """
    c = F.col("count").cast("double")

    def side(column: str, name: str) -> DataFrame:
        sums = {"tied": c * (c - 1) / 2, "triples": c * (c - 1) * (c - 2), "weights": c * (c - 1) * (2 * c + 5)}
        return rows.groupBy(column).count().agg(F.sum("count").alias(f"n_{name}"), *(F.coalesce(F.sum(x), F.lit(0.0)).alias(f"{k}_{name}") for k, x in sums.items()))

    both = side(y, "y").join(F.broadcast(side(pred, "pred")), F.lit(True))
    n, pairs = F.col("n_y").cast("double"), F.col("n_y") * (F.col("n_y") - 1.0)
    plain = (pairs * (2 * n + 5) - F.col("weights_y") - F.col("weights_pred")) / 18
    variance = plain + 2 * F.col("tied_y") * F.col("tied_pred") / pairs + F.col("triples_y") * F.col("triples_pred") / (9 * pairs * (n - 2))
    return both.select(F.coalesce("n_y", F.lit(0)).alias("n"), "tied_y", "tied_pred", F.when(n > 2, variance).alias("variance"))


def kendall_exact(n: int, discordant: int) -> float:
    """Probability of at most so many discordant pairs of n rows without ties and without association: orders are counted by their inversions."""
    orders = [1]
    for k in range(2, n + 1):
        # the k-th row adds 0 to k - 1 inversions
        longer, window = [], 0
        for i in range(len(orders) + k - 1):
            window += (orders[i] if i < len(orders) else 0) - (orders[i - k] if i >= k else 0)
            longer.append(window)
        orders = longer
    return sum(orders[: discordant + 1]) / math.factorial(n)


def kendall_p(rows: DataFrame, y: str, pred: str) -> float | None:
    """One-sided p-value of Kendall's tau: exact for up to EXACT_KENDALL rows without ties, else normal with the variance corrected for ties."""
    about = kendall_variance(rows, y, pred).first()
    pairs = pair_counts(rows, y, pred).first()
    if not about.tied_y and not about.tied_pred and 1 < about.n <= EXACT_KENDALL:
        return kendall_exact(about.n, int(pairs.discordant))
    if not about.variance:
        return None
    return _normal_sf((pairs.concordant - pairs.discordant) / math.sqrt(about.variance))


def call_significance(calls: DataFrame, margin: float | None = None, alpha: float = 0.05) -> DataFrame:
    """One-sided tests on calls (wer_true, wer_pred): association by Kendall and Spearman, equivalence by two t-tests.

    Kendall's p-value is that of `kendall_p`, Spearman's takes the t.
    """
    calls = written(calls.where("wer_true is not null and wer_pred is not null").select("wer_true", "wer_pred"), "calls")
    agreement = rank_agreement(calls, "wer_true", "wer_pred").first()
    rho = rank_correlation(calls, "wer_true", "wer_pred").first()["spearman"]
    d = F.col("wer_pred") - F.col("wer_true")
    n, mean, sd = calls.agg(F.count("*"), F.avg(d), F.stddev_samp(d)).first()
    tau = agreement["kendall_tau"]
    tau_p = kendall_p(calls, "wer_true", "wer_pred") if tau is not None else None
    spearman_p = tost_p = None
    if rho is not None and n > 2:
        spearman_p = _t_sf(rho * math.sqrt((n - 2) / max(1 - rho * rho, 1e-300)), n - 2)
    if margin is not None and n > 1 and sd:
        error = sd / math.sqrt(n)
        tost_p = max(_t_sf((mean + margin) / error, n - 1), _t_sf((margin - mean) / error, n - 1))
    row = (n, tau, tau_p, rho, spearman_p, mean, tost_p, None if tau_p is None else tau_p < alpha, None if tost_p is None else tost_p < alpha)
    return calls.sparkSession.createDataFrame([row], "n_calls long, kendall_tau double, kendall_p double, spearman_rho double, spearman_p double, mean_difference double, tost_p double, associated boolean, equivalent boolean")
