"""Boosted trees as node arrays: fitted by Spark, kept as JSON, scored by a column expression without Python.

A forest is an array of trees, a tree a weight, its depth and four arrays over its nodes: the feature it looks at, the threshold up to which
a row goes left, where the left child is (the right one follows it; 0 for a leaf) and the value of a leaf.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Schema of a forest as a column.
FOREST = "array<struct<weight: double, levels: int, feature: array<int>, threshold: array<double>, child: array<int>, value: array<double>>>"
#: Settings of boosted trees that a search tries, and fits that run at the same time.
GRID: tuple[dict, ...] = ({"depth": 2, "steps": 30}, {"depth": 3, "steps": 30}, {"depth": 3, "steps": 60})
PARALLEL_FITS = 8


@dataclass
class Tree:
    weight: float
    levels: int
    feature: list[int]
    threshold: list[float]
    child: list[int]
    value: list[float]


@dataclass
class Forest:
    """A regression by boosted trees on features in a fixed order."""

    trees: list[Tree]

    def column(self, x: Column) -> Column:
        """The estimate for an array of features."""
        trees = [F.struct(*((F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).alias(k) for k, v in asdict(t).items())) for t in self.trees]
        return score(F.array(*trees), x)

    def predict(self, x: Sequence[float]) -> float:
        """The same for one row of plain numbers."""
        out = 0.0
        for t in self.trees:
            node = 0
            while t.child[node]:
                node = t.child[node] + (x[t.feature[node]] > t.threshold[node])
            out += t.weight * t.value[node]
        return out


def forest_of(held: dict) -> Forest:
    """A forest from what `asdict` made of it."""
    return Forest([Tree(**t) for t in held["trees"]])


def score(trees: Column, x: Column) -> Column:
    """Sum of the trees' weighted leaves for an array of features; trees is a column of type FOREST."""

    def leaf(t: Column) -> Column:
        # every level takes a row one node down; a leaf stays where it is
        def down(node: Column, _: Column) -> Column:
            right = (x[t["feature"][node]] > t["threshold"][node]).cast("int")
            return F.when(t["child"][node] > 0, t["child"][node] + right).otherwise(node)

        return t["value"][F.aggregate(F.slice(t["feature"], 1, t["levels"]), F.lit(0), down)]

    return F.aggregate(trees, F.lit(0.0), lambda total, t: total + t["weight"] * leaf(t))


def flattened(model: GBTRegressionModel) -> Forest:
    """The node arrays of a fitted ensemble."""
    trees = []
    for weight, tree in zip(model.treeWeights, model._java_obj.trees(), strict=True):
        nodes, t = [tree.rootNode()], Tree(float(weight), tree.depth(), [], [], [], [])
        for node in nodes:  # grows while it is walked through
            inner = node.getClass().getSimpleName() == "InternalNode"
            t.feature.append(node.split().featureIndex() if inner else 0)
            t.threshold.append(float(node.split().threshold()) if inner else 0.0)
            t.child.append(len(nodes) if inner else 0)
            t.value.append(float(node.prediction()))
            if inner:
                nodes += [node.leftChild(), node.rightChild()]
        trees.append(t)
    return Forest(trees)


def regressor(seed: int = 0, robust: bool = False, steps: int = 50, depth: int = 3) -> GBTRegressor:
    """Boosted trees; robust: absolute loss on samples of rows and features."""
    gbt = GBTRegressor(featuresCol="v", labelCol="y", predictionCol="p", maxDepth=depth, maxIter=steps, stepSize=0.05, minInstancesPerNode=20, seed=seed)
    return gbt.setLossType("absolute").setSubsamplingRate(0.8).setFeatureSubsetStrategy("0.8") if robust else gbt


def assembled(table: DataFrame, width: int) -> DataFrame:
    """A design table with its array `x` as a vector `v`."""
    columns = [f"_f{i}" for i in range(width)]
    flat = table.select("*", *(F.col("x")[i].alias(c) for i, c in enumerate(columns)))
    return VectorAssembler(inputCols=columns, outputCol="v").transform(flat).drop(*columns)


def fit(table: DataFrame, width: int, **settings) -> Forest:
    """Fit boosted trees on a design table (x, y)."""
    return flattened(regressor(**settings).fit(assembled(table, width)))


def fit_folds(table: DataFrame, width: int, folds: list[str], **settings) -> dict[str, Forest]:
    """A forest for each fold, fitted on the rows outside it; a few fits run at the same time."""
    return fit_all([(table, width, folds, settings)])[0]


def fit_all(jobs: list[tuple[DataFrame, int, list[str], dict]]) -> list[dict[str, Forest]]:
    """`fit_folds` of several (table, width, folds, settings). A fit is many short jobs one after the other, so those of one table don't wait for those of another."""
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        running = []
        for table, width, folds, settings in jobs:
            ready = assembled(table.select("fold", "x", "y"), width)
            running.append({f: pool.submit(lambda f=f, ready=ready, settings=settings: flattened(regressor(**settings).fit(ready.where(F.col("fold") != f)))) for f in folds})
        return [{f: fit.result() for f, fit in own.items()} for own in running]


def as_table(table: DataFrame, forests: dict[str, Forest]) -> DataFrame:
    """(fold, trees) for a join with rows of a design table."""
    rows = [(f, [tuple(asdict(t).values()) for t in forest.trees]) for f, forest in forests.items()]
    return table.sparkSession.createDataFrame(rows, f"fold string, trees {FOREST}")


def tuned(table: DataFrame, width: int, folds: list[str | None], grid: tuple[dict, ...] = GRID, **settings) -> dict[str | None, dict]:
    """For each held-out fold (None: nothing held out) the setting of least absolute error over the inner folds.

    Fits for every (fold, inner fold, setting) run a few at a time on one design table (fold, inner, x, y), without the rows of either; then all errors
    are summed in one pass. Ties go to the first setting.
    """
    inner = sorted(r.inner for r in table.select("inner").distinct().collect())
    ready = assembled(table.select("fold", "inner", "x", "y"), width)
    jobs = list(itertools.product(folds, inner, range(len(grid))))

    def one(job: tuple[str | None, int, int]) -> Forest | None:
        f, i, g = job
        train = ready.where(F.col("inner") != i) if f is None else ready.where((F.col("inner") != i) & (F.col("fold") != f))
        return None if train.isEmpty() else flattened(regressor(**settings, **grid[g]).fit(train))

    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        forests = [x for x in zip(jobs, pool.map(one, jobs), strict=True) if x[1] is not None]
    rows = [(f, i, g, [tuple(asdict(t).values()) for t in forest.trees]) for (f, i, g), forest in forests]
    fitted = table.sparkSession.createDataFrame(rows, f"outer string, inner int, setting int, trees {FOREST}")
    seen = table.select("fold", "inner", "x", "y").join(F.broadcast(fitted), "inner").where("outer is null or fold <> outer")
    error = F.abs(score(F.col("trees"), F.col("x")) - F.col("y"))
    best: dict[str | None, tuple[float, int]] = {}
    for r in seen.groupBy("outer", "setting").agg(F.sum(error).alias("e")).collect():
        best[r.outer] = min(best.get(r.outer, (float("inf"), 0)), (r.e, r.setting))
    return {f: grid[best.get(f, (0.0, 0))[1]] for f in folds}
