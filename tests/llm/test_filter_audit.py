import itertools
import random
import re
from fractions import Fraction

import pytest

from veritrace.llm.common import looked_up, written
from veritrace.llm.filter_audit import RemovalPolynomial, audit, filter_audit, judge

from . import tables

LABELS = "doc_id long, quality int, toxic int, part string"


def brute_mask(body, smaller_copy):
    body = body or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", body)
    capitals = sum("A" <= c <= "Z" for c in body)
    fails = [len(ws) < 100, 100 * len(set(ws)) < 80 * len(ws), 100 * capitals > 10 * len(body), any(c in "#$%&*|" for c in body), smaller_copy]
    return {f for f, x in zip("ABCDE", fails, strict=True) if x}


def brute(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic). Every document walks through every order."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    judged = {}
    for i, body, lang in docs:
        copy = i is not None and any(j is not None and j < i and (b or "") == (body or "") for j, b, _ in docs)
        judged.setdefault(lang or "", []).append((i, brute_mask(body, copy)))
    out = {}
    for part, rows in judged.items():
        sums = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = [r for r in rows if f in r[1]]
                sums[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in rows), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(sums[order[step - 1]])
    return out


def as_dict(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in df.collect()}


def test_polynomial_is_what_sets_of_filters_remove():
    rng = random.Random(1)
    for k in (1, 2, 4):
        counts = {m: rng.choice([0, 0, 3, rng.randint(0, 10**15)]) for m in range(1 << k)}
        p = RemovalPolynomial(counts, k)
        for used in range(1 << k):
            assert p.corner(used) == sum(n for m, n in counts.items() if m & used)
        for i in range(k):
            orders = list(itertools.permutations(range(k)))
            first = sum(sum(n for m, n in counts.items() if m >> i & 1 and not any(m >> j & 1 for j in o[: o.index(i)])) for o in orders)
            assert p.shapley(i) == Fraction(first, len(orders))
        assert sum(map(p.shapley, range(k))) == p.corner((1 << k) - 1)


def test_all_orders_against_walking_through_them(spark):
    rng = random.Random(2)
    bodies = [None, "", " \t", "word", "A B C", "a # b", tables.text(rng, 99), tables.text(rng, 100), " ".join(["x y"] * 60), tables.text(rng, 30_000), "é" * 9 + "A", "é" * 8 + "AB", "ſ # K"]
    bodies += [" ".join(rng.sample([f"w{i}" for i in range(200)], 110)) + rng.choice(["", " $", " AAAAAAAAAA" * 9]) for _ in range(10)]
    docs = [(rng.choice([None, i, i, i]), rng.choice(bodies), rng.choice([None, "", "en", "de"])) for i in range(120)]
    docs += docs[:3] + [(500 + i, "copied", "hot") for i in range(60)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(0, 120, 2), None, 4, 4, 9_999, *range(500, 530)]]
    frame = spark.createDataFrame([(i, b, lang, 5, "x", "y") for i, b, lang in docs], "doc_id long, text string, lang string, mask int, part string, words string")
    got = as_dict(filter_audit(frame, spark.createDataFrame([(*row, "z") for row in labels], LABELS)))
    assert got == brute(docs, labels)


def test_awkward_and_empty_tables(spark):
    docs, none = tables.awkward(spark), spark.createDataFrame([], LABELS)
    want = brute([(r.doc_id, r.text, r.lang) for r in docs.collect()], [])
    assert as_dict(filter_audit(docs, none)) == want
    assert filter_audit(tables.empty(spark), none).count() == 0


def test_other_filters(spark):
    rows = [("p", 3, 1, 0), ("p", 1, 0, 1), ("p", 0, 1, 1), ("q", 2, 0, 0)]
    got = as_dict(audit(spark.createDataFrame(rows, "part string, mask int, good int, toxic int"), "XY"))
    assert len(got) == 2 * 2 * 2
    assert got["p", "XY", 1] == [1, 2, 0, 1, 1, 1, 3] and got["p", "XY", 2] == [1, 0, 1, 0, 0, 0, 1]
    assert got["q", "YX", 1] == [0, 1, 0, 1, 0, 0, 2]


@pytest.mark.parametrize("broadcast_rows", [1_000, 0])
def test_lookups_find_the_same_with_and_without_a_broadcast(spark, broadcast_rows):
    """Half of the rows have one key, a few none."""
    rng = random.Random(3)
    keys = [7] * 300 + [None] * 20 + [rng.randrange(400) for _ in range(300)]
    rows = written(spark.createDataFrame(list(enumerate(keys)), "i int, k int"), "rows")
    table = written(spark.createDataFrame([(k, k * 2) for k in range(0, 400, 7)], "k int, v int"), "table")
    got = sorted((r.i, r.k, r.v) for r in looked_up(rows, table, "k", broadcast_rows).collect())
    assert got == [(i, k, k * 2 if k is not None and k % 7 == 0 else None) for i, k in enumerate(keys)]


def test_judged_in_one_pass_over_the_texts(spark):
    plan = judge(tables.awkward(spark), spark.createDataFrame([], LABELS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "regexp" not in plan  # texts were judged before; the plan reads what was written
