"""Evaluation protocols and estimators of the error rate.

Linear models are fitted from Gram matrices: one pass over the rows sums them by fold, all folds and
penalties are then solved from sums that don't grow with the data, and a second pass scores every penalty.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import build_features, feature_names, is_transferable
from ..operators.metrics import gain, regression_metrics
from ..operators.ranks import quantiles, running_sums
from ..schema import PROXIES
from ..store import written
from . import trees
from .folds import deal_counts, deal_groups, with_parts

#: Penalties that are tried, bounds of an estimate.
RIDGE_ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0)
LASSO_ALPHAS = (0.0001, 0.001, 0.01, 0.1)
CLIP = (0.0, 2.0)
INNER = 3
#: Boosted trees, robust ones, and those whose settings are searched for.
TREES = ("hgb", "xgb", "tuned")
PROTOCOLS = {"group": None, "lodo": "corpus", "lolo": "lang", "loco": "condition"}


def clipped(pred: Column, upper: float | None = CLIP[1]) -> Column:
    low = F.greatest(pred, F.lit(CLIP[0]))
    return low if upper is None else F.least(low, F.lit(upper))


def design(rows: DataFrame, blocks: tuple[str, ...] = ("proxy", "text"), feature_set: str = "transferable", roles: tuple[str, ...] = PROXIES) -> tuple[DataFrame, list[str]]:
    """Rows with `x` (array of features), `y`, and the names of the features in order."""
    names = [n for n in feature_names(blocks, roles) if feature_set == "full" or is_transferable(n)]
    made = build_features(rows, blocks, roles, names)
    kept = ["segment_id", "sample_id", "group_id", "corpus", "lang", "condition", "duration", "n_ref_words", "n_hyp_words", "label_errors"]
    return made.select(*kept, F.col("label_wer").alias("y"), F.array(*(F.col(f"features.{n}") for n in names)).alias("x")), names


def with_folds(rows: DataFrame, protocol: str = "group", n_splits: int = 5, group: str = "group_id") -> DataFrame:
    """Adds `fold` and `inner`: rows of a group are in one fold; the protocols lodo, lolo and loco hold a corpus, language or condition out.

    Groups are dealt so that folds have like numbers of rows (`plans/folds.py`); with as few groups as folds each is held out alone. Inner
    folds for penalties are dealt the same way, within each fold where folds are made of groups.
    """
    if key := PROTOCOLS[protocol]:
        inner = deal_groups(rows, group, INNER).select(group, F.col("part").alias("inner"))
        return with_parts(rows.withColumn("fold", F.col(key)), inner, group)
    dealt = written(deal_groups(rows, group, n_splits).withColumnRenamed("part", "fold"), "dealt")
    inner = deal_counts(dealt, group, INNER, "fold").select(group, F.col("fold").cast("string").alias("fold"), F.col("part").alias("inner"))
    return with_parts(rows, inner, group)


def grams(rows: DataFrame, width: int) -> dict[tuple[str, int], np.ndarray]:
    """Sums of z z' with z = (1, x, y) for each (fold, inner): all that linear models need."""
    size = width + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            z = np.column_stack([np.ones(len(x)), x, batch.column("y").to_numpy()])
            keys = list(zip(batch.column("fold").to_pylist(), batch.column("inner").to_pylist(), strict=True))
            for key in set(keys):
                own = z[[k == key for k in keys]]
                sums[key] = sums.get(key, 0) + own.T @ own
        for (fold, inner), s in sums.items():
            n = size * size
            yield pa.RecordBatch.from_arrays([pa.array([fold] * n), pa.array([inner] * n, pa.int32()), pa.array(np.arange(n)), pa.array(s.ravel())], ["fold", "inner", "i", "v"])

    out: dict[tuple[str, int], np.ndarray] = {}
    table = rows.select("fold", "inner", "x", "y").mapInArrow(run, "fold string, inner int, i long, v double")
    for r in table.groupBy("fold", "inner", "i").agg(F.sum("v").alias("v")).collect():
        out.setdefault((r.fold, r.inner), np.zeros(size * size))[r.i] = r.v
    return {k: v.reshape(size, size) for k, v in out.items()}


@dataclass
class Linear:
    """A linear model on raw features."""

    coef: list[float]
    intercept: float
    alpha: float | None = None
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    scaled_coef: list[float] = field(default_factory=list)


def solve(gram: np.ndarray, kind: str, alpha: float | None) -> Linear:
    """Fit on a Gram matrix. ridge: sum of squares + alpha |w|^2; lasso: mean of squares / 2 + alpha |w|, on standardised features."""
    n = gram[0, 0]
    mean, y_mean = gram[0, 1:-1] / n, gram[0, -1] / n
    scatter = gram[1:-1, 1:-1] - n * np.outer(mean, mean)
    cross = gram[1:-1, -1] - n * mean * y_mean
    scale = np.sqrt(np.maximum(np.diag(scatter) / n, 0))
    scale[scale < 1e-12] = 1.0
    a, b = scatter / np.outer(scale, scale), cross / scale
    if kind == "ridge":
        w = np.linalg.solve(a + alpha * np.eye(len(b)), b)
    elif kind == "lasso":
        w = np.zeros(len(b))
        for _ in range(20_000):
            before = w.copy()
            for j in range(len(b)):
                if a[j, j] > 1e-12:
                    rest = b[j] - a[j] @ w + a[j, j] * w[j]
                    w[j] = np.sign(rest) * max(abs(rest) - n * alpha, 0) / a[j, j]
            if np.abs(w - before).max() < 1e-10:
                break
    else:
        w = np.zeros(len(b))
    coef = w / scale
    return Linear(coef.tolist(), float(y_mean - coef @ mean), alpha, mean.tolist(), scale.tolist(), w.tolist())


def _tuned(rows: DataFrame, sums: dict, folds: list[str | None], kind: str) -> dict[str | None, Linear]:
    """For each held-out fold (None: nothing held out) the model with the penalty of least inner MAE."""
    alphas = RIDGE_ALPHAS if kind == "ridge" else LASSO_ALPHAS
    total = lambda keep: sum((g for k, g in sums.items() if keep(k)), np.zeros_like(next(iter(sums.values()))))
    inner = {}
    for fold in folds:
        for i in range(INNER):
            gram = total(lambda k, fold=fold, i=i: k[0] != fold and k[1] != i)
            if gram[0, 0]:
                inner[fold, i] = [solve(gram, kind, a) for a in alphas]
    shared = rows.sparkSession.sparkContext.broadcast({k: (np.array([m.coef for m in v]), np.array([m.intercept for m in v])) for k, v in inner.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            y = batch.column("y").to_numpy()
            x = np.array(batch.column("x").to_pylist(), dtype=float).reshape(len(y), -1)
            own, part = np.array(batch.column("fold").to_pylist()), batch.column("inner").to_numpy()
            for (fold, i), (coef, intercept) in shared.value.items():
                scored = (own != fold) & (part == i)
                if scored.any():
                    error = np.abs(x[scored] @ coef.T + intercept - y[scored, None]).sum(axis=0)
                    sums[fold] = sums.get(fold, 0) + error
        for fold, error in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([fold] * len(error), pa.string()), pa.array(np.arange(len(error))), pa.array(error)], ["fold", "a", "e"])

    errors = rows.select("fold", "inner", "x", "y").mapInArrow(run, "fold string, a long, e double").groupBy("fold", "a").agg(F.sum("e").alias("e")).collect()
    best: dict[str | None, tuple[float, int]] = {}
    for r in errors:
        best[r.fold] = min(best.get(r.fold, (np.inf, 0)), (r.e, r.a))
    return {f: solve(total(lambda k, f=f: k[0] != f), kind, alphas[best.get(f, (0, 0))[1]]) for f in folds}


def linear_models(rows: DataFrame, names: list[str], kinds: list[str]) -> dict[tuple[str, str], Linear]:
    """(model, fold) -> model fitted on the rows outside the fold; kinds: mean, pwer, ridge, lasso. A fold without others is left out."""
    sums = grams(rows, len(names))
    folds = sorted({f for f, _ in sums})
    folds = [f for f in folds if any(k[0] != f for k in sums)]
    out = {}
    for kind in kinds:
        if kind in ("ridge", "lasso"):
            out |= {(kind, f): m for f, m in _tuned(rows, sums, folds, kind).items()}
        elif kind == "mean":
            out |= {(kind, f): solve(sum(g for k, g in sums.items() if k[0] != f), "mean", None) for f in folds}
        elif kind == "pwer":
            out |= {(kind, f): proxy_alone(names) for f in folds}
    return out


def score_linear(rows: DataFrame, models: dict[tuple[str, str], Linear], upper: float | None = CLIP[1]) -> DataFrame:
    """Out-of-fold predictions in long form: a row for each segment and model."""
    table = rows.sparkSession.createDataFrame([(m, f, x.coef, x.intercept) for (m, f), x in models.items()], "model string, fold string, coef array<double>, intercept double")
    both = rows.join(F.broadcast(table), "fold")  # a row for each fold and model
    pred = F.aggregate(F.zip_with("x", "coef", lambda a, b: a * b), F.col("intercept"), lambda acc, v: acc + v)
    return both.withColumn("pred", clipped(pred, upper)).drop("coef", "intercept")


def score_trees(rows: DataFrame, names: list[str], folds: list[str], seed: int = 0, robust: bool = False, steps: int = 50, upper: float | None = CLIP[1], forests: dict[str, trees.Forest] | None = None) -> DataFrame:
    """Out-of-fold predictions of boosted trees; robust: absolute loss on samples of rows and features. forests: fitted already."""
    forests = forests or trees.fit_folds(rows, len(names), folds, seed=seed, robust=robust, steps=steps)
    both = rows.join(F.broadcast(trees.as_table(rows, forests)), "fold")
    return both.withColumns({"pred": clipped(trees.score(F.col("trees"), F.col("x")), upper), "model": F.lit("xgb" if robust else "hgb")}).drop("trees")


def tuned_trees(rows: DataFrame, names: list[str], folds: list[str], grid: tuple[dict, ...] = trees.GRID, seed: int = 0, upper: float | None = CLIP[1]) -> DataFrame:
    """Out-of-fold predictions of boosted trees whose settings are chosen for each fold by its inner folds; adds `setting` as JSON."""
    chosen = trees.tuned(rows, len(names), folds, grid, seed=seed)
    forests = {}
    for setting in {json.dumps(s, sort_keys=True) for s in chosen.values()}:
        own = [f for f in folds if json.dumps(chosen[f], sort_keys=True) == setting]
        forests |= trees.fit_folds(rows, len(names), own, seed=seed, **json.loads(setting))
    settings = rows.sparkSession.createDataFrame([(f, json.dumps(s, sort_keys=True)) for f, s in chosen.items()], "fold string, setting string")
    both = rows.join(F.broadcast(trees.as_table(rows, forests)), "fold").join(F.broadcast(settings), "fold")
    return both.withColumns({"pred": clipped(trees.score(F.col("trees"), F.col("x")), upper), "model": F.lit("tuned")}).drop("trees")


def run_protocol(
    rows: DataFrame,
    protocol: str,
    models: tuple[str, ...] = ("mean", "pwer", "ridge", "lasso"),
    blocks: tuple[str, ...] = ("proxy", "text"),
    feature_set: str = "transferable",
    n_splits: int = 5,
    roles: tuple[str, ...] = PROXIES,
    target: str = "wer",
) -> DataFrame:
    """Out-of-fold predictions of several models under a protocol.

    target: wer, or errors: then the number of errors is what is learnt, and the rate is that by the hypothesis's words; `pred_errors` is added.
    """
    table, names = design(rows, blocks, feature_set, roles)
    if target == "wer":
        return run_protocol_on(written(with_folds(table, protocol, n_splits), "design"), names, models)
    if target != "errors":
        raise ValueError(f"no target {target}")
    table = table.withColumn("wer", F.col("y")).withColumn("y", F.col("label_errors").cast("double"))
    out = run_protocol_on(written(with_folds(table, protocol, n_splits), "design"), names, models, upper=None)
    rate = F.col("pred_errors") / F.greatest("n_hyp_words", F.lit(1))
    return out.withColumnRenamed("pred", "pred_errors").withColumns({"pred": clipped(rate), "y": F.col("wer")}).drop("wer")


def run_protocol_on(table: DataFrame, names: list[str], models: tuple[str, ...], upper: float | None = CLIP[1], forests: dict[str, trees.Forest] | None = None) -> DataFrame:
    """The same on a design table with folds. forests: of the one model hgb or xgb, if they are fitted already."""
    out = score_linear(table, linear_models(table, names, [m for m in models if m not in TREES]), upper)
    for kind in TREES:
        if kind in models:
            folds = sorted(r.fold for r in table.select("fold").distinct().collect())
            scored = tuned_trees(table, names, folds, upper=upper).drop("setting") if kind == "tuned" else score_trees(table, names, folds, robust=kind == "xgb", upper=upper, forests=forests)
            out = out.unionByName(scored, allowMissingColumns=True)
    return out


def tuned_on_all(table: DataFrame, names: list[str], model: str) -> Linear:
    """A model on all rows of a design table, its penalty by inner folds."""
    sums = grams(table, len(names))
    if model in ("ridge", "lasso"):
        return _tuned(table, sums, [None], model)[None]
    if model == "mean":
        return solve(sum(sums.values()), "mean", None)
    if model == "pwer":
        return proxy_alone(names)
    raise ValueError(f"no linear model {model}")


def fitted_trees(table: DataFrame, names: list[str], model: str, seed: int = 0) -> trees.Forest:
    """Boosted trees on all rows of a design table; `tuned`: settings by inner folds."""
    setting = trees.tuned(table, len(names), [None], seed=seed)[None] if model == "tuned" else {"robust": model == "xgb"}
    return trees.fit(table, len(names), seed=seed, **setting)


def proxy_alone(names: list[str]) -> Linear:
    """The estimate is the proxies' mean rate, or that of the one there is."""
    proxy = "pwer_mean" if "pwer_mean" in names else next(n for n in names if n.startswith("pwer_"))
    return Linear([float(n == proxy) for n in names], 0.0)


def summarize(result: DataFrame) -> DataFrame:
    """A row for each model, with its gain over the proxy."""
    return gain(regression_metrics(result, "y", "pred", "model"))


#: Feature blocks and model of each configuration.
ABLATION = {
    "mean": (("proxy", "text"), "mean"),
    "text": (("text",), "hgb"),
    "proxy": (("proxy",), "hgb"),
    "proxy+text hgb": (("proxy", "text"), "hgb"),
    "proxy+text xgb": (("proxy", "text"), "xgb"),
    "proxy+text ridge": (("proxy", "text"), "ridge"),
}


def ablation(rows: DataFrame, configurations: dict = ABLATION) -> DataFrame:
    """Regression metrics of each configuration; the features of all blocks are made once, trees of all configurations are fitted side by side."""
    table, every = design(rows, ("proxy", "text"), "full")
    table = written(with_folds(table), "design")
    names_of = {name: [n for n in every if n in feature_names(blocks)] for name, (blocks, _) in configurations.items()}
    parts = {name: table.withColumn("x", F.array(*(F.col("x")[every.index(n)] for n in names))) for name, names in names_of.items()}
    grown = [name for name, (_, model) in configurations.items() if model in ("hgb", "xgb")]
    folds = sorted(r.fold for r in table.select("fold").distinct().collect()) if grown else []
    forests = dict(zip(grown, trees.fit_all([(parts[name], len(names_of[name]), folds, {"robust": configurations[name][1] == "xgb"}) for name in grown]), strict=True))
    out = None
    for name, (_, model) in configurations.items():
        part = regression_metrics(run_protocol_on(parts[name], names_of[name], (model,), forests=forests.get(name)), "y", "pred", "model").withColumn("config", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def single_proxy_ablation(rows: DataFrame, model: str = "ridge") -> DataFrame:
    """The same model with each proxy alone and with both."""
    out = None
    for roles in (*((r,) for r in PROXIES), PROXIES):
        part = regression_metrics(run_protocol(rows, "group", (model,), roles=roles), "y", "pred", "model").withColumn("proxies", F.lit("+".join(roles)))
        out = part if out is None else out.unionByName(part)
    return out


def tree_gains(rows: DataFrame, seed: int = 0, steps: int = 30) -> DataFrame:
    """Share of each feature in the loss that boosted trees on all rows save."""
    table, names = design(rows)
    fitted = trees.regressor(seed, steps=steps).fit(trees.assembled(written(table.select("x", "y"), "design"), len(names)))
    return rows.sparkSession.createDataFrame(list(zip(names, fitted.featureImportances.toArray().tolist(), strict=True)), "feature string, gain double")


def ridge_export(rows: DataFrame, blocks: tuple[str, ...] = ("proxy", "text"), feature_set: str = "transferable", alpha: float | None = None, roles: tuple[str, ...] = PROXIES) -> str:
    """A ridge on all rows as JSON (the keys are fixed values): names, scaler, coefficients."""
    table, names = design(rows, blocks, feature_set, roles)
    table = written(with_folds(table), "design")
    sums = grams(table, len(names))
    model = solve(sum(sums.values()), "ridge", alpha) if alpha is not None else _tuned(table, sums, [None], "ridge")[None]
    sets = table.agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in ("corpus", "lang", "condition")), F.count("*").alias("n"), F.avg("y").alias("y")).first()
    return json.dumps(
        {
            "feature_names": names,
            "scaler_mean": model.mean,
            "scaler_scale": model.scale,
            "coef": model.scaled_coef,
            "intercept": model.intercept + float(np.dot(model.coef, model.mean)),
            "alpha": model.alpha,
            "clip": list(CLIP),
            "blocks": list(blocks),
            "feature_set": feature_set,
            "roles": list(roles),
            "n_train_segments": sets.n,
            "train_wer_mean": round(sets.y, 4),
            "train_corpora": sets.corpus,
            "train_langs": sets.lang,
            "train_conditions": sets.condition,
            "linear": asdict(model),
        }
    )


def apply_export(export: str, rows: DataFrame) -> DataFrame:
    """Adds `pred`: a dot product in plain column arithmetic. No label is needed; a feature that can't be built is an error."""
    e = json.loads(export)
    roles = tuple(e.get("roles", PROXIES))
    if missing := set(e["feature_names"]) - set(feature_names(tuple(e["blocks"]), roles)):
        raise ValueError(f"features missing from the records: {sorted(missing)}")
    made = build_features(rows, tuple(e["blocks"]), roles, e["feature_names"])
    pred = F.lit(e["intercept"])
    for name, mean, scale, coef in zip(e["feature_names"], e["scaler_mean"], e["scaler_scale"], e["coef"], strict=True):
        pred = pred + (F.col(f"features.{name}") - mean) / scale * coef
    return made.withColumn("pred", F.least(F.greatest(pred, F.lit(e["clip"][0])), F.lit(e["clip"][1]))).drop("features")


def ridge_coefficients(rows: DataFrame, blocks: tuple[str, ...] = ("proxy", "text")) -> DataFrame:
    """Mean and spread of the standardised coefficients over folds; stable if the mean is beyond the spread."""
    table, names = design(rows, blocks)
    table = written(with_folds(table), "design")
    models = linear_models(table, names, ["ridge"])
    w = np.array([m.scaled_coef for m in models.values()])
    out = [(n, float(a), float(s), bool(abs(a) > s)) for n, a, s in zip(names, w.mean(axis=0), w.std(axis=0), strict=True)]
    return rows.sparkSession.createDataFrame(out, "feature string, mean double, std double, stable boolean").orderBy(F.abs("mean").desc())


def permutation_importance(rows: DataFrame, model: str = "ridge", n_repeats: int = 3, seed: int = 0) -> DataFrame:
    """Rise of the out-of-fold MAE when a feature is shuffled among the rows of its fold.

    In each repeat every row gets a partner: the row that has its place in another random order of the fold. A linear estimate moves by
    the feature's coefficient times the difference to the partner's value; trees are scored anew with it. All features go in one pass.
    """
    table, names = design(rows)
    table = written(with_folds(table), "design")
    if model in TREES:
        folds = sorted(r.fold for r in table.select("fold").distinct().collect())
        fitted = trees.as_table(table, trees.fit_folds(table, len(names), folds, seed=seed, robust=model == "xgb"))
        raw = trees.score(F.col("trees"), F.col("x"))
    else:
        models = [(f, m.coef, m.intercept) for (_, f), m in linear_models(table, names, [model]).items()]
        fitted = table.sparkSession.createDataFrame(models, "fold string, coef array<double>, intercept double")
        raw = F.aggregate(F.zip_with("x", "coef", lambda a, b: a * b), F.col("intercept"), lambda acc, v: acc + v)
    both = table.join(F.broadcast(fitted), "fold")  # a row for each fold
    kept = [c for c in fitted.columns if c not in ("fold", "intercept")]

    def in_order(rows: DataFrame, s: int) -> DataFrame:
        return running_sums(rows.withColumns({"_h": F.xxhash64(F.lit(s), "segment_id"), "n": F.lit(1)}), "_h", ["n"], "fold")

    own = in_order(both.select("fold", "segment_id", "y", "x", *kept, raw.alias("raw")), seed).drop("_h", "n", "total_n")
    rises = None
    for r in range(n_repeats):
        partner = in_order(table.select("fold", "segment_id", "x"), seed + r + 1).select("fold", "before_n", F.col("x").alias("z"))
        if model in TREES:  # each feature in turn has the partner's value
            swapped = lambda j: F.transform("x", lambda v, i: F.when(i == j, F.col("z")[j]).otherwise(v))
            moved = F.transform("x", lambda _, j: trees.score(F.col("trees"), swapped(j)))
        else:
            moved = F.transform(F.zip_with(F.zip_with("z", "x", lambda a, b: a - b), "coef", lambda d, c: d * c), lambda m: F.col("raw") + m)
        rise = F.transform(moved, lambda m: F.abs(clipped(m) - F.col("y")) - F.abs(clipped(F.col("raw")) - F.col("y")))
        part = own.join(partner, ["fold", "before_n"]).select(F.posexplode(rise).alias("j", "rise")).groupBy("j").agg(F.avg("rise").alias("rise"))
        rises = part if rises is None else rises.union(part)
    named = table.sparkSession.createDataFrame(list(enumerate(names)), "j int, feature string")
    out = rises.groupBy("j").agg(F.avg("rise").alias("importance"), F.stddev_pop("rise").alias("std"))
    return out.join(F.broadcast(named), "j").select("feature", "importance", "std").orderBy(F.desc("importance"))


def partial_dependence(rows: DataFrame, feature: str, n_points: int = 10, model: str = "ridge") -> DataFrame:
    """Average prediction of a model on all rows as one feature goes from its 5th to its 95th percentile."""
    table, names = design(rows)
    table = written(with_folds(table), "design")
    j = names.index(feature)
    ends = quantiles(table.select(F.col("x")[j].alias("v")), "v", [0.05, 0.95]).first()
    grid = F.explode(F.array(*(F.lit(float(v)) for v in np.linspace(*ends.quantiles, n_points))))
    swapped = F.transform("x", lambda v, i: F.when(i == j, F.col("value")).otherwise(v))
    if model in TREES:
        pred = fitted_trees(table, names, model).column(swapped)
    else:
        fitted = tuned_on_all(table, names, model)
        pred = F.aggregate(F.zip_with(swapped, F.array(*map(F.lit, fitted.coef)), lambda a, b: a * b), F.lit(fitted.intercept), lambda acc, v: acc + v)
    return table.withColumn("value", grid).withColumn("pred", clipped(pred)).groupBy("value").agg(F.avg("pred").alias("pred"))
