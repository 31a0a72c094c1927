import random
from collections import Counter

import pytest

from veritrace.llm.mixing import apportion, capped_targets, mix_sources

from . import tables


def brute_targets(sizes, weights, cap=3):
    """Reshare what is above the cap until none is above."""
    total, fixed = sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        left, weight = total - sum(fixed.values()), sum(weights[i] for i in free)
        share = {i: left * weights[i] / weight for i in free}
        above = [i for i in free if share[i] > cap * sizes[i]]
        if not above:
            return [fixed.get(i, share.get(i)) for i in range(len(sizes))]
        fixed |= {i: cap * sizes[i] for i in above}


def brute_seats(votes, total):
    seats = [0] * len(votes)
    if sum(votes):
        for _ in range(total):
            best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * seats[i] + 1), -i))
            seats[best] += 1
    return seats


def test_capped_targets(spark):
    rng = random.Random(1)
    for _ in range(6):
        sizes = [int(10 ** rng.uniform(0, 6)) for _ in range(rng.randint(1, 12))]
        weights = [i % 3 + 1 for i in range(len(sizes))]
        df = spark.createDataFrame(list(zip(range(len(sizes)), sizes, weights, strict=True)), "rank int, source_size long, weight int")
        got = [r.target for r in capped_targets(df).orderBy("rank").collect()]
        assert got == pytest.approx(brute_targets(sizes, weights))
        assert sum(got) == pytest.approx(sum(sizes))


def test_apportionment_by_highest_quotients(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for g in range(12):
        votes = [rng.choice([0, 1, 5, 5, rng.randint(1, 10_000)]) for _ in range(rng.randint(1, 9))]
        total = rng.choice([0, 1, 3, 50, 997])
        rows += [(g, i, v, total) for i, v in enumerate(votes)]
        want |= {(g, i): s for i, s in enumerate(brute_seats(votes, total))}
    df = spark.createDataFrame(rows, "g int, i int, votes long, total long")
    got = {(r.g, r.i): r.seats for r in apportion(df, ["g"], "votes", "total", ["i"]).collect()}
    assert got == want


def test_mix(spark):
    rng = random.Random(3)
    names = ["b", "a", "Z", None, "é", "tiny"]
    rows = []
    for i in range(400):
        s = rng.choices(names, [30, 5, 10, 5, 10, 0.5])[0]
        rows.append(tables.row(i, tables.text(rng, rng.randint(0, 300)), s))
    df = spark.createDataFrame(rows, tables.DOCS)
    out = mix_sources(df)
    assert "Python" not in out._jdf.queryExecution().toString()
    got = {r.doc_id: r for r in out.collect()}
    assert got == {r.doc_id: r for r in mix_sources(df.repartition(7)).collect()}
    order = sorted((n for n in names if n), key=lambda n: n.encode()) + [None]
    size, taken = Counter(), Counter()
    for i, (_, body, _, s, *_) in enumerate(rows):
        assert got[i].size == len(body.split()) and 0 <= got[i].taken <= 3 * got[i].size
        size[s] += got[i].size
        taken[s] += got[i].taken
    targets = brute_targets([size[n] for n in order], [i % 3 + 1 for i in range(len(order))])
    for n, t in zip(order, targets, strict=True):
        row = next(got[i] for i in got if rows[i][3] == n)
        assert row.target == pytest.approx(t) and row.source_size == size[n]
        assert abs(taken[n] - t) <= 32


def test_awkward_rows(spark):
    docs = tables.awkward(spark)
    got = mix_sources(docs).collect()
    assert len(got) == docs.count()
    assert all(r.taken <= 3 * r.size and r.size >= 0 for r in got)
    assert mix_sources(tables.empty(spark)).collect() == []
    blank = docs.where("doc_id in (3, 4, 5)")
    assert [r.taken for r in mix_sources(blank).collect()] == [0, 0, 0]
