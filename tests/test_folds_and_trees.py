"""Balanced folds, boosted trees as node arrays, quantiles and tests of association, against plain versions."""

import itertools
import math
import random
import shutil
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrace.operators import resample, summaries
from veritrace.operators.ranks import quantiles
from veritrace.plans import bundles, folds, models, pool, trees

SF = "/root/testdata/sf0.001"


def greedy(groups, k):
    """groups: key -> rows; each goes to the lightest fold, the largest first."""
    loads, out = [0] * k, {}
    for key, n in sorted(groups.items(), key=lambda g: (-g[1], g[0] is not None, g[0] or "")):
        out[key] = loads.index(min(loads))
        loads[out[key]] += n
    return out


def test_runs_of_equal_groups():
    rng = random.Random(1)
    for _ in range(200):
        loads = np.array([rng.randint(0, 40) for _ in range(rng.randint(1, 6))])
        size, n = rng.randint(1, 9), rng.randint(1, 30)
        now, want = loads.copy(), []
        for _ in range(n):
            want.append(int(now.argmin()))
            now[want[-1]] += size
        assert folds.picks(loads, size, np.arange(n)).tolist() == want
        assert folds.loads_after(loads, size, n).tolist() == now.tolist()


def test_groups_are_dealt_as_one_after_the_other(spark):
    rng = random.Random(2)
    groups = [None, *(f"g{i}" for i in range(60))]
    rows = [(rng.choice(["a", "b", None]), rng.choices(groups, [30, *(1 + i % 5 for i in range(60))])[0]) for _ in range(700)]
    df = spark.createDataFrame(rows, "w string, g string").repartition(7)
    for k in (1, 5, 100):
        got = {r.g: (r.n, r.part) for r in folds.deal_groups(df, "g", k).collect()}
        sizes = Counter(g for _, g in rows)
        assert got == {g: (sizes[g], part) for g, part in greedy(sizes, k).items()}
    got = {(r.w, r.g): r.part for r in folds.deal_groups(df, "g", 3, "w").collect()}
    for w in ("a", "b", None):
        assert {g: p for (x, g), p in got.items() if x == w} == greedy(Counter(g for x, g in rows if x == w), 3)
    assert folds.deal_groups(df.limit(0), "g", 3).count() == 0


def test_folds_are_balanced_and_hold_whole_groups(spark):
    rows = pool.labelled(spark, SF).select("segment_id", "group_id", "corpus")
    got = models.with_folds(rows, "group").collect()
    assert len(got) == rows.count()
    assert len({(r.group_id, r.fold) for r in got}) == len({(r.group_id, r.fold, r.inner) for r in got}) == len({r.group_id for r in got})
    sizes = Counter(r.fold for r in got)
    assert len(sizes) == 5 and max(sizes.values()) - min(sizes.values()) <= max(Counter(r.group_id for r in got).values())
    # as few groups as folds: each is held out alone
    few = models.with_folds(rows.withColumn("group_id", F.col("corpus")), "group").collect()
    assert {(r.corpus, r.fold) for r in few} == {(c, f) for c, f in zip(sorted({r.corpus for r in few}), sorted({r.fold for r in few}), strict=True)} or len({r.fold for r in few}) == len({r.corpus for r in few})


def sample_design(spark, n=400, folds_=4):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        x = [rng.random(), float(rng.randint(0, 3)), rng.gauss(0, 1)]
        rows.append((f"s{i}", str(i % folds_), i // folds_ % 3, x, 0.3 * (x[0] > 0.4) + 0.2 * x[1] + rng.gauss(0, 0.02)))
    return spark.createDataFrame(rows, "segment_id string, fold string, inner int, x array<double>, y double")


@pytest.mark.parametrize("robust", [False, True])
def test_node_arrays_score_like_spark(spark, robust):
    table = sample_design(spark)
    ready = trees.assembled(table, 3)
    model = trees.regressor(steps=15, robust=robust, depth=4).fit(ready)
    forest = trees.flattened(model)
    assert max(t.levels for t in forest.trees) > 1 and len(forest.trees) == 15
    own = model.transform(ready).select("x", "p", forest.column(F.col("x")).alias("q"))
    assert "Python" not in own._jdf.queryExecution().toString()
    for r in own.collect():
        assert r.q == pytest.approx(r.p, abs=1e-9) and forest.predict(r.x) == pytest.approx(r.p, abs=1e-9)


def test_out_of_fold_trees(spark):
    table = sample_design(spark)
    got = models.score_trees(table, ["a", "b", "c"], [str(i) for i in range(4)], steps=10).collect()
    alone = {f: trees.fit(table.where(F.col("fold") != f), 3, steps=10) for f in ("0", "1")}
    for r in got:
        if r.fold in alone:
            assert r.pred == pytest.approx(min(max(alone[r.fold].predict(r.x), 0), 2), abs=1e-9)


def test_settings_are_those_of_a_plain_search(spark):
    table = sample_design(spark, 240, 3).cache()
    grid = ({"depth": 1, "steps": 3}, {"depth": 3, "steps": 20}, {"depth": 2, "steps": 10})
    got = trees.tuned(table, 3, ["0", None], grid)
    rows = table.collect()
    for held in ("0", None):
        errors = []
        for setting in grid:
            total = 0.0
            for i in range(3):
                train = table.where(F.col("inner") != i) if held is None else table.where((F.col("inner") != i) & (F.col("fold") != held))
                forest = trees.fit(train, 3, **setting)
                total += sum(abs(forest.predict(r.x) - r.y) for r in rows if r.inner == i and r.fold != held)
            errors.append(total)
        assert got[held] == grid[errors.index(min(errors))]
    scored = models.tuned_trees(table, ["a", "b", "c"], ["0", "1", "2"], grid)
    assert scored.count() == 240 and scored.where("pred is null").count() == 0


def test_bundle_of_trees(spark, monkeypatch):
    made = trees.regressor
    monkeypatch.setattr(trees, "regressor", lambda *a, **kw: made(*a, **kw).setMaxIter(6))  # a few trees do
    rows = pool.labelled(spark, SF).where("hyp_proxy_b is not null").cache()
    for model in ("hgb", "xgb"):
        bundle = bundles.fit_bundle(rows, model)
        again = bundles.Bundle.from_json(bundle.to_json())
        assert again == bundle and again.linear is None
        x = {r.segment_id: r.x for r in models.design(rows)[0].collect()}
        got = {r.segment_id: r.pred for r in bundles.predict(again, rows.drop("label_wer", "label_errors")).collect()}
        assert got == pytest.approx({s: min(max(bundle.forest.predict(v), 0), 2) for s, v in x.items()}, abs=1e-9)
    importance = {r.feature: r.importance for r in models.permutation_importance(rows, "hgb", n_repeats=1).collect()}
    assert set(importance) == set(models.design(rows)[1]) and max(importance.values()) > 0
    curve = models.partial_dependence(rows, "pwer_mean", 4, "hgb").orderBy("value").collect()
    assert len(curve) == 4 and all(0 <= r.pred <= 2 for r in curve)


def test_quantiles_by_counted_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.5, -3.0, rng.gauss(0, 9)])) for _ in range(500)] + [("only null", None), ("one", 4.0)]
    ps = [0.0, 0.05, 0.5, 0.99, 1.0]
    got = {r.k: r.quantiles for r in quantiles(spark.createDataFrame(rows, "k string, v double"), "v", ps, "k").collect()}
    for k in {k for k, _ in rows}:
        values = [v for x, v in rows if x == k and v is not None]
        want = np.quantile(values, ps) if values else [None] * len(ps)
        assert got[k] == (pytest.approx(list(want)) if values else want)
    assert "ercentile" not in summaries.length_report(pool.labelled(spark, SF), "corpus")._jdf.queryExecution().toString()


def test_exact_kendall_against_all_orders():
    for n in range(2, 9):
        inversions = Counter(sum(a > b for a, b in itertools.combinations(p, 2)) for p in itertools.permutations(range(n)))
        for d in range(n * (n - 1) // 2 + 1):
            want = sum(c for i, c in inversions.items() if i <= d) / math.factorial(n)
            assert resample.kendall_exact(n, d) == pytest.approx(want, abs=1e-15)


def test_kendall_with_ties(spark):
    """The corrected variance is that of concordant less discordant pairs over all orders."""
    y, p = [0.1, 0.1, 0.2, 0.3, 0.3, 0.3, 0.4], [1.0, 2.0, 2.0, 2.0, 3.0, 4.0, 4.0]
    df = spark.createDataFrame(list(zip(y, p, strict=True)), "y double, p double")
    sign = lambda x: (x > 0) - (x < 0)
    stat = lambda q: sum(sign(y[i] - y[j]) * sign(q[i] - q[j]) for i, j in itertools.combinations(range(7), 2))
    values = [stat(q) for q in itertools.permutations(p)]
    assert resample.kendall_variance(df, "y", "p").first().variance == pytest.approx(np.var(values))
    z = stat(p) / math.sqrt(np.var(values))
    assert resample.kendall_p(df, "y", "p") == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)))
    plain = spark.createDataFrame([(float(i), float(i * 7 % 5)) for i in range(5)], "y double, p double")
    d = sum((i * 7 % 5) > (j * 7 % 5) for i, j in itertools.combinations(range(5), 2))
    assert resample.kendall_p(plain, "y", "p") == pytest.approx(resample.kendall_exact(5, d))
    assert resample.kendall_variance(df.limit(0), "y", "p").first().n == 0


def test_all_pairs_of_models(spark):
    rng = random.Random(5)
    rows = []
    for i in range(200):
        y = rng.random()
        rows += [(f"s{i}", f"g{i // 4}", m, y, y + rng.gauss(0, spread)) for m, spread in (("bad", 0.5), ("good", 0.05), ("same", 0.5))]
    result = spark.createDataFrame(rows, "segment_id string, group_id string, model string, y double, pred double")
    got = {(r.reference, r.challenger): r for r in resample.compare_models(result, n_boot=200).collect()}
    assert set(got) == {("bad", "good"), ("bad", "same"), ("good", "same")}
    assert got["bad", "good"].favours_b and not got["good", "same"].favours_b
    error = lambda m: np.mean([abs(p - y) for _, _, x, y, p in rows if x == m])
    for (a, b), r in got.items():
        assert r.mae_difference == pytest.approx(error(a) - error(b)) and r.ci_low <= r.mae_difference <= r.ci_high
    wide = result.groupBy("segment_id", "group_id", "y").pivot("model").agg(F.first("pred"))
    assert resample.paired_bootstrap(wide, "y", "bad", "good", "group_id", 200).first().ci_low == pytest.approx(got["bad", "good"].ci_low)


def test_replaced_files_are_read_anew(spark, tmp_path):
    path = f"{tmp_path}/conversations.parquet"
    shutil.copyfile(f"{SF}/conversations.parquet", path)
    before = summaries.corpus_summary(pool.labelled(spark, str(tmp_path))).first().n
    half = spark.read.parquet(path).where("conv_id % 2 = 0").toPandas()
    half.to_parquet(path)
    spark.catalog.refreshByPath(path)
    after = summaries.corpus_summary(pool.labelled(spark, str(tmp_path))).first().n
    assert 0 < after < before and after <= len(half)


def test_fits_of_several_tables_run_side_by_side(spark, monkeypatch):
    """Fits of one table don't wait for those of another, and each forest is that of its own table and settings."""
    import threading

    table = spark.createDataFrame([(str(i % 2), [float(i % 7), float(i % 5)], float(i % 7)) for i in range(80)], "fold string, x array<double>, y double")
    other = table.selectExpr("fold", "array(x[1]) AS x", "-y AS y")
    jobs = [(table, 2, ["0", "1"], {"steps": 1, "depth": 1}), (other, 1, ["0", "1"], {"steps": 2, "depth": 1})]
    alone = [trees.fit_folds(t, width, folds, **settings) for t, width, folds, settings in jobs]
    meet, flat = threading.Barrier(4, timeout=60), trees.flattened
    monkeypatch.setattr(trees, "flattened", lambda model: (meet.wait(), flat(model))[1])
    assert trees.fit_all(jobs) == alone
