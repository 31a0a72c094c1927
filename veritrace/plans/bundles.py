"""Fitted models with all that their use needs, their evaluation at both levels, and the evaluation of a pool."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import build_features, feature_names
from ..operators.metrics import binary_metrics, regression_metrics
from ..operators.ranks import same_keys
from ..operators.reports import classification_report, union_of
from ..operators.resample import cluster_bootstrap
from ..operators.summaries import call_metrics, corpus_summary, corpus_wer_gap, label_spread, ratio, wer_by_system
from ..schema import PROXIES, ROLES
from ..store import written
from .models import PROTOCOLS, TREES, Linear, clipped, design, fitted_trees, run_protocol_on, summarize, tuned_on_all, with_folds
from .trees import Forest, forest_of


@dataclass
class Bundle:
    """A linear model or boosted trees, the features they need and what they were fitted on; JSON holds all of it.

    Fixed values: the fields' names.
    """

    model: str
    feature_names: list[str]
    linear: Linear | None
    blocks: list[str]
    roles: list[str]
    feature_set: str
    norm_config: dict = field(default_factory=dict)
    n_train_segments: int = 0
    n_train_calls: int = 0
    train_wer_mean: float = 0.0
    train_corpora: list[str] = field(default_factory=list)
    train_langs: list[str] = field(default_factory=list)
    train_conditions: list[str] = field(default_factory=list)
    notes: str = ""
    forest: Forest | None = None

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, indent=1)

    @staticmethod
    def from_json(text: str) -> Bundle:
        held = json.loads(text)
        return Bundle(**held | {"linear": held["linear"] and Linear(**held["linear"]), "forest": held["forest"] and forest_of(held["forest"])})


def fit_bundle(rows: DataFrame, model: str = "ridge", blocks: tuple[str, ...] = ("proxy", "text"), roles: tuple[str, ...] = PROXIES, feature_set: str = "transferable", norm_config: dict | None = None, notes: str = "") -> Bundle:
    """Fit on all rows, a penalty or a setting by inner folds. model: mean, pwer, ridge, lasso, hgb, xgb or tuned (trees)."""
    table, names = design(rows, blocks, feature_set, roles)
    table = written(with_folds(table), "design")
    about = table.agg(
        F.count("*").alias("n"), F.countDistinct("sample_id").alias("calls"), F.avg("y").alias("y"), *(F.array_sort(F.collect_set(c)).alias(c) for c in ("corpus", "lang", "condition"))
    ).first()
    linear, forest = (None, fitted_trees(table, names, model)) if model in TREES else (tuned_on_all(table, names, model), None)
    return Bundle(model, names, linear, list(blocks), list(roles), feature_set, dict(norm_config or {}), about.n, about.calls, about.y, about.corpus, about.lang, about.condition, notes, forest)


def predict(bundle: Bundle, rows: DataFrame, norm_config: dict | None = None) -> DataFrame:
    """Adds `pred`: the estimate from features alone; no label is needed. Text normalised in another way than for fitting is an error."""
    if norm_config and bundle.norm_config and dict(norm_config) != bundle.norm_config:
        raise ValueError(f"fitted on texts normalised by {bundle.norm_config}, not {dict(norm_config)}")
    made = build_features(rows, tuple(bundle.blocks), tuple(bundle.roles), bundle.feature_names)
    known = set(feature_names(tuple(bundle.blocks), tuple(bundle.roles)))
    values = [F.col(f"features.{name}") if name in known else F.lit(0.0) for name in bundle.feature_names]
    if bundle.forest:
        pred = bundle.forest.column(F.array(*values))
    else:
        pred = sum((v * coef for v, coef in zip(values, bundle.linear.coef, strict=True)), F.lit(bundle.linear.intercept))
    return made.withColumn("pred", clipped(pred)).drop("features")


def full_report(rows: DataFrame, y: str, pred: str, threshold: float, *keys: str) -> DataFrame:
    """Regression metrics and screening metrics side by side."""
    return same_keys(regression_metrics(rows, y, pred, *keys), binary_metrics(rows, y, pred, threshold, *keys).drop("n"), *keys)


def calls_by_words(rows: DataFrame, pred: str = "pred") -> DataFrame:
    """True rate of each call by words, its estimate by duration."""
    by = rows.groupBy("sample_id").agg(F.sum("duration").alias("_d"), ratio(F.sum("label_errors"), F.sum("n_ref_words")).alias("wer_true"), ratio(F.sum(F.col(pred) * F.col("duration")), F.sum("duration")).alias("wer_pred"))
    return by.where("_d > 0 and wer_true is not null").drop("_d")


def evaluate_predictions(rows: DataFrame, thresholds: tuple[float, ...] = (0.5,), k_values: tuple[float, ...] = (0.1, 0.2), n_boot: int = 500) -> DataFrame:
    """Regression and screening of estimates (`pred`) by segments and by calls, whose truth is weighed by words or by duration.

    A row for each level and kind; what a kind doesn't have is null.
    """
    parts = []
    levels = (("segment", rows, "label_wer", "pred", "segment_id"), ("call_words", calls_by_words(rows), "wer_true", "wer_pred", "sample_id"), ("call_duration", call_metrics(rows), "wer_true", "wer_pred", "sample_id"))
    for level, table, y, pred, order in levels:
        kept = [y, pred, order, "sample_id", *(("n_hyp_words", "n_ref_words", "label_errors") if level == "segment" else ())]
        table = written(table.select(*dict.fromkeys(kept)), "level")
        one = regression_metrics(table, y, pred)
        if level == "segment":
            one = same_keys(one, corpus_wer_gap(table))
            if n_boot:
                one = same_keys(one, cluster_bootstrap(table, y, pred, "sample_id", n_boot).drop("mae"))
        parts.append(one.withColumns({"level": F.lit(level), "kind": F.lit("regression")}))
        parts.append(classification_report(table, y, pred, list(thresholds), list(k_values), order).withColumns({"level": F.lit(level), "kind": F.lit("classification")}))
    return union_of(parts)


def evaluate_bundle(bundle: Bundle, rows: DataFrame, **kw) -> DataFrame:
    """`evaluate_predictions` of a bundle on labelled rows. Its estimates are written: features are made once, not for each level and report."""
    return evaluate_predictions(written(predict(bundle, rows), "predicted"), **kw)


def evaluate_pool(rows: DataFrame, protocols: tuple[str, ...] = tuple(PROTOCOLS), models: tuple[str, ...] = ("mean", "pwer", "ridge", "lasso"), feature_set: str = "transferable") -> DataFrame:
    """`summarize` of each protocol; features and labels are made once for all."""
    table, names = design(rows, feature_set=feature_set)
    table = written(table, "design")
    return union_of([summarize(run_protocol_on(with_folds(table, p), names, models)).withColumn("protocol", F.lit(p)) for p in protocols])


def pilot_report(rows: DataFrame, roles: tuple[str, ...] = ROLES) -> DataFrame:
    """What is looked at after a pilot, in long form (section, name, value): the systems, the target, the spread of its labels.

    rows: merged and labelled; those without a target go for the latter two.
    """
    def long(section: str, table: DataFrame, name: str | None = None) -> DataFrame:
        values = [c for c in table.columns if c != name]
        pair = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in values)))
        prefix = F.concat(F.col(name), F.lit(".")) if name else F.lit("")
        return table.select(prefix.alias("_p"), pair.alias("x")).select(F.lit(section).alias("section"), F.concat("_p", "x.name").alias("name"), "x.value")

    rows = written(rows, "pilot")  # three parts read it
    done = rows.where("hyp_target is not null")
    return union_of([long("systems", wer_by_system(rows, roles), "role"), long("target", corpus_summary(done)), long("spread", label_spread(done))])


def roles_for(kind: str, systems: dict[str, tuple[str, str]]) -> list[str]:
    """The roles that a kind of engine plays; systems: role -> (model, kind)."""
    kinds = {k for _, k in systems.values()}
    if kind not in kinds:
        raise ValueError(f"unknown kind {kind}: there are {sorted(kinds)}")
    return [role for role, (_, k) in systems.items() if k == kind]


def write_norm_config(spark: SparkSession, path: str, config: dict) -> None:
    """Keep how texts were normalised beside a corpus."""
    spark.createDataFrame([(json.dumps(config),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_norm_config(spark: SparkSession, path: str, default: dict | None = None) -> dict | None:
    """What `write_norm_config` wrote; the default where nothing was."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None if default is None else dict(default)
    return json.loads("\n".join(r.value for r in spark.read.text(path).collect()))


def checked_norms(configs: dict[str, dict | None]) -> dict:
    """The one normalisation of all corpora of a pool (name -> config); several are an error."""
    distinct = {json.dumps(c, sort_keys=True) for c in configs.values() if c is not None}
    if len(distinct) > 1:
        raise ValueError(f"corpora normalised in different ways: {configs}")
    return json.loads(distinct.pop()) if distinct else {}

