"""Aggregates over labelled rows: corpora, calls, conditions, systems, datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.align import edit_counts
from ..store import written
from .metrics import pearson
from .ranks import quantiles, rank_correlation, running_sums, same_keys


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def share(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def weighted_wer() -> Column:
    return ratio(F.sum("label_errors"), F.sum("n_ref_words"))


def corpus_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("n"),
        (F.sum("duration") / 3600).alias("hours"),
        weighted_wer().alias("wer_weighted"),
        F.avg("label_wer").alias("wer_mean"),
        ratio(F.sum(F.col("label_wer") * F.col("duration")), F.sum("duration")).alias("wer_duration"),
        share(F.col("label_wer") == 0).alias("pct_zero"),
    )


def wer_by(rows: DataFrame, *keys: str) -> DataFrame:
    """Word error rate by group (corpus and condition, say)."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        weighted_wer().alias("wer_weighted"),
        F.avg("label_wer").alias("wer_mean"),
        F.stddev_pop("label_wer").alias("wer_std"),
        share(F.col("label_wer") == 0).alias("pct_zero"),
    )


def proxy_blindness(rows: DataFrame, *keys: str) -> DataFrame:
    """How often the proxies agree fully with the target, and with one that is wrong; correlation of rate and proxy.

    rows: label_wer, pwer_mean.
    """
    base = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        share(F.col("pwer_mean") == 0).alias("pct_agree"),
        share((F.col("pwer_mean") == 0) & (F.col("label_wer") > 0)).alias("pct_blind"),
        pearson("pwer_mean", "label_wer").alias("pearson"),
    )
    return same_keys(base, rank_correlation(rows, "pwer_mean", "label_wer", *keys), *keys)


def length_report(rows: DataFrame, *keys: str, short_words: int = 5, high_wer: float = 1.0) -> DataFrame:
    """Lengths, and how much of the squared error lies in the top hundredth of rows."""
    base = rows.groupBy(*keys).agg(
        share(F.col("n_ref_words") < short_words).alias("pct_short"),
        F.max("label_wer").alias("wer_max"),
        share(F.col("label_wer") > high_wer).alias("pct_high"),
    )
    of_words = quantiles(rows, "n_ref_words", [0.05, 0.5], *keys).select(*keys, *(F.floor(F.col("quantiles")[i]).cast("long").alias(c) for i, c in enumerate(("words_p05", "words_median"))))
    of_rates = quantiles(rows, "label_wer", [0.99], *keys).select(*keys, F.col("quantiles")[0].alias("wer_p99"))
    base = same_keys(same_keys(base, of_words, *keys), of_rates, *keys)
    squares = rows.groupBy(*keys, (F.col("label_wer") ** 2).alias("square")).agg(F.count("*").alias("n"))
    placed = running_sums(squares, "square", ["n"], *keys)
    wanted = F.greatest(F.floor(F.col("total_n") / 100), F.lit(1)) - (F.col("total_n") - F.col("before_n") - F.col("n"))  # after the greater ones
    top = F.sum(F.col("square") * F.least(F.greatest(wanted, F.lit(0)), F.col("n")))
    return same_keys(base, placed.groupBy(*keys).agg(ratio(top, F.sum(F.col("square") * F.col("n"))).alias("top_share")), *keys)


def wer_by_system(rows: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """Each system against the reference: weighted rate and coverage."""
    pairs = F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.col(f"hyp_{r}_norm").alias("hyp")) for r in roles)))
    long = rows.select("reference_norm", pairs.alias("p")).select("reference_norm", "p.role", "p.hyp")
    counted = long.withColumn("c", edit_counts(F.col("reference_norm"), F.col("hyp")))
    return counted.groupBy("role").agg(ratio(F.sum("c.errors"), F.sum("c.n_ref")).alias("wer"), F.count("hyp").alias("n"), F.avg(F.col("hyp").isNotNull().cast("double")).alias("coverage"))


def label_spread(rows: DataFrame, group: str = "sample_id") -> DataFrame:
    """Law of total variance over sessions: between, within, and the intraclass share."""
    by = rows.groupBy(group).agg(F.count("*").alias("n"), F.avg("label_wer").alias("m"), F.var_pop("label_wer").alias("v"))
    n = F.sum("n")
    mean = F.sum(F.col("n") * F.col("m")) / n
    between = F.sum(F.col("n") * F.col("m") ** 2) / n - mean**2
    within = F.sum(F.col("n") * F.col("v")) / n
    total = by.agg(F.count("*").alias("sessions"), n.alias("n"), between.alias("var_between"), within.alias("var_within"), F.avg("n").alias("per_session"))
    return total.withColumn("icc", ratio(F.col("var_between"), F.col("var_between") + F.col("var_within")))


def structure_stats(rows: DataFrame) -> DataFrame:
    sessions = rows.groupBy("sample_id").agg(F.sum("duration").alias("seconds"), F.count("*").alias("n"))
    per = sessions.agg((F.avg("seconds") / 60).alias("session_minutes"), F.max("n").alias("session_max"), F.count("*").alias("sessions"))
    whole = rows.agg(F.count("*").alias("n"), F.countDistinct("group_id").alias("groups"), (F.sum("duration") / 3600).alias("hours"), F.avg("duration").alias("mean_s"), F.max("duration").alias("max_s"))
    return whole.join(F.broadcast(per), F.lit(True))  # one row each


def call_estimates(rows: DataFrame, pred: str = "pred") -> DataFrame:
    """Duration-weighted estimate of each call, worst first."""
    by = rows.groupBy("sample_id").agg(F.count("*").alias("n_segments"), F.sum("duration").alias("duration"), F.sum(F.col(pred) * F.col("duration")).alias("_s"))
    return by.where("duration > 0").select("sample_id", "n_segments", "duration", (F.col("_s") / F.col("duration")).alias("wer_estimate")).orderBy(F.desc("wer_estimate"), "sample_id")


def call_metrics(rows: DataFrame, pred: str = "pred") -> DataFrame:
    """True and estimated rate of each call, duration-weighted, with errors."""
    weigh = lambda c: F.sum(F.col(c) * F.col("duration")) / F.sum("duration")
    by = rows.groupBy("sample_id").agg(F.sum("duration").alias("duration"), F.count("*").alias("n"), ratio(F.sum(F.col("label_wer") * F.col("duration")), F.sum("duration")).alias("wer_true"), ratio(F.sum(F.col(pred) * F.col("duration")), F.sum("duration")).alias("wer_pred"))
    return by.where("duration > 0").withColumn("abs_error", F.abs(F.col("wer_true") - F.col("wer_pred"))).withColumn("rel_error", ratio(F.col("abs_error"), F.col("wer_true")))


def call_summary_of(calls: DataFrame, digits: int = 4) -> DataFrame:
    """Means over calls of the rounded errors, and the rank correlation if there are more than two."""
    rounded = calls.withColumns({c: F.round(c, digits) for c in ("wer_true", "wer_pred", "abs_error", "rel_error")})
    out = rounded.agg(F.count("*").alias("calls"), F.avg("rel_error").alias("werr_mean"), F.avg("abs_error").alias("mae"))
    ranked = same_keys(out, rank_correlation(rounded, "wer_pred", "wer_true"))
    return ranked.withColumn("spearman", F.when(F.col("calls") > 2, F.col("spearman")))


def true_wer(rows: DataFrame) -> DataFrame:
    """True rate of each call by words and by duration, worst first."""
    by = rows.groupBy("sample_id").agg(
        F.count("*").alias("n_segments"),
        F.sum("duration").alias("duration"),
        F.sum("n_ref_words").alias("n_words"),
        F.sum("label_errors").alias("n_errors"),
        weighted_wer().alias("wer_true"),
        ratio(F.sum(F.col("label_wer") * F.col("duration")), F.sum("duration")).alias("wer_true_duration"),
    )
    return by.orderBy(F.coalesce("wer_true", F.lit(0.0)).desc(), "sample_id")


def call_sizes(rows: DataFrame) -> DataFrame:
    """Segments and minutes of the calls: least, median, most."""
    by = written(rows.groupBy("sample_id").agg(F.count("*").alias("n"), (F.sum("duration") / 60).alias("minutes")), "calls")
    ends = [f(c).alias(f"{c}_{name}") for c in ("n", "minutes") for name, f in (("min", F.min), ("max", F.max))]
    out = by.agg(F.count("*").alias("calls"), *ends, F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("singletons"))
    for c in ("n", "minutes"):
        out = same_keys(out, quantiles(by, c, [0.5]).select(F.col("quantiles")[0].alias(f"{c}_median")))
    return out


def call_wer_by_dataset(rows: DataFrame, dataset: str = "corpus") -> DataFrame:
    """Mean and spread of the calls' rates for each dataset and for all (POOL)."""
    calls = rows.groupBy(dataset, "sample_id").agg(weighted_wer().alias("wer"))
    out = calls.groupingSets([[dataset], []], dataset).agg(F.count("*").alias("calls"), F.avg("wer").alias("wer_mean"), F.stddev_pop("wer").alias("wer_std"), F.grouping(dataset).alias("_all"))
    return out.withColumn(dataset, F.when(F.col("_all") == 1, "POOL").otherwise(F.col(dataset))).drop("_all")


def dataset_report(rows: DataFrame, roles: tuple[str, ...], dataset: str = "corpus") -> DataFrame:
    """Rows, complete rows, missing hypotheses by role and distinct calls of each dataset."""
    complete = F.lit(True)
    for r in roles:
        complete = complete & F.col(f"hyp_{r}").isNotNull()
    missing = [F.sum(F.col(f"hyp_{r}").isNull().cast("int")).alias(f"missing_{r}") for r in roles]
    return rows.groupBy(dataset).agg(F.count("*").alias("rows_in"), F.sum(complete.cast("int")).alias("rows_kept"), *missing, F.countDistinct("sample_id").alias("calls"))


def denominator_bias(rows: DataFrame) -> DataFrame:
    """Words of the reference by words of the hypothesis."""
    r = written(rows.select((F.col("n_ref_words") / F.greatest("n_hyp_words", F.lit(1))).alias("r")), "ratios")
    base = r.agg(F.avg("r").alias("mean"), share(F.abs(F.col("r") - 1) <= 0.1).alias("within_10pct"))
    return same_keys(base, quantiles(r, "r", [0.5, 0.1, 0.9]).select(*(F.col("quantiles")[i].alias(c) for i, c in enumerate(("median", "p10", "p90")))))


def status(rows: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """Counts, calls, hours, languages and coverage."""
    return rows.agg(F.count("*").alias("n"), F.countDistinct("sample_id").alias("calls"), (F.sum("duration") / 3600).alias("hours"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"), *(F.count(f"hyp_{r}").alias(f"n_{r}") for r in roles))


def corpus_wer_gap(rows: DataFrame, pred: str = "pred") -> DataFrame:
    """Estimated against true rate of a whole corpus."""
    n = F.greatest("n_hyp_words", F.lit(1))
    est, true = ratio(F.sum(F.col(pred) * n), F.sum(n)), weighted_wer()
    return rows.agg(est.alias("estimated"), true.alias("true"), F.abs(est - true).alias("gap"))


def histogram(rows: DataFrame, column: str, bins: int = 40, clip: float = 1.5) -> DataFrame:
    """Counts in equal bins up to min(clip, 1.05 max); what is beyond is in the last bin."""
    upper = rows.agg(F.least(F.lit(clip), F.lit(1.05) * F.max(column)).alias("upper"))
    placed = rows.join(F.broadcast(upper), F.lit(True))
    bin_ = F.least(F.floor(F.col(column) / (F.col("upper") / bins)), F.lit(bins - 1)).cast("int")
    return placed.where(F.col(column).isNotNull()).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.sum((F.col(column) > F.col("upper")).cast("int")).alias("tail"))
