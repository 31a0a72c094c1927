"""Ranks, running sums and pairs over ranges of values against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrace.operators import ranks
from veritrace.operators.metrics import pair_counts, regression_metrics
from veritrace.operators.resample import _poisson


def table(spark, n, seed=0):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0.0, 0.25, 0.5, rng.random()]), rng.choice([0.5, rng.random()])) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "k string, y double, p double")


def test_running_sums(spark):
    rows, df = table(spark, 400)
    counts = df.groupBy("k", "y").agg(F.count("*").alias("n"))
    got = {(r.k, r.y): (r.before_n, r.total_n) for r in ranks.running_sums(counts, "y", ["n"], "k").collect()}
    assert got == {(k, y): (sum(a == k and b < y for a, b, _ in rows), sum(a == k for a, *_ in rows)) for k, y, _ in rows}


def test_rank_correlation(spark):
    rows, df = table(spark, 300, 1)

    def place(values):
        return [sum(v < x for v in values) + (sum(v == x for v in values) + 1) / 2 for x in values]

    got = {r.k: r.spearman for r in ranks.rank_correlation(df, "y", "p", "k").collect()}
    for key in ("a", "b", None):
        own = [(y, p) for k, y, p in rows if k == key]
        want = np.corrcoef(*(place(list(x)) for x in zip(*own, strict=True)))[0, 1]
        assert got[key] == pytest.approx(want)
    one = ranks.rank_correlation(df.where("y = 0.5"), "y", "p").first()
    assert one.spearman is None


@pytest.mark.parametrize("block", [3, 40, 50_000])
def test_pairs(spark, monkeypatch, block):
    """Blocks of a few values, values with blocks of their own, and one block for all."""
    monkeypatch.setattr(ranks, "BLOCK", block)
    rows, df = table(spark, 160, 2)
    got = pair_counts(df, "y", "p").first()
    pairs = [(a, b) for i, a in enumerate(rows) for b in rows[:i]]
    sign = [np.sign(a[1] - b[1]) * np.sign(a[2] - b[2]) for a, b in pairs]
    assert (got.concordant, got.discordant) == (sum(s > 0 for s in sign), sum(s < 0 for s in sign))
    assert got.tied_pred == sum(a[1] != b[1] and a[2] == b[2] for a, b in pairs)
    assert (got.n, got.tied_y, got.tied_both) == (160, sum(a[1] == b[1] for a, b in pairs), sum(a[1:] == b[1:] for a, b in pairs))
    none = pair_counts(df.where("false"), "y", "p").first()
    assert (none.concordant, none.n) == (0, 0)


def test_rising_pairs():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 57, 200):
        a, b, w = rng.integers(0, 9, n), rng.integers(0, 30, n), rng.integers(1, 5, n)
        want = sum(int(w[i] * w[j]) for i in range(n) for j in range(n) if a[i] < a[j] and b[i] < b[j])
        assert ranks.rising_pairs(a, b, w) == want


def test_metrics_of_an_empty_table(spark):
    _, df = table(spark, 5)
    assert regression_metrics(df.where("false"), "y", "p", "k").collect() == []


def test_poisson_numbers():
    keys = np.arange(3000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    drawn = _poisson(keys, np.arange(50, dtype=np.uint64), 7)
    assert drawn.shape == (50, 3000) and abs(drawn.mean() - 1) < 0.02 and abs(drawn.var() - 1) < 0.03
    assert abs(np.corrcoef(drawn[0], drawn[1])[0, 1]) < 0.06
