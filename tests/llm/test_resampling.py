import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veritrace.llm.resampling import feature_buckets, kth_key, resample

from . import tables

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_features(body):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (body or "").translate(LOWER))
    return len(ws), [zlib.crc32(f.encode()) % 10_000 for f in ws + [f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)]]


def brute(docs, wanted):
    counts = [Counter(b for body in side for b in brute_features(body)[1]) for side in ([d[1] for d in docs], wanted)]
    s, t = counts
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + 10_000) / ((s[b] + 1) * (total_t + 10_000))))
    rows = []
    for doc_id, body in docs:
        n_words, features = brute_features(body)
        weight = sum(map(gain, features)) // len(features) if features else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, n_words, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = [(*r, i) for i, r in enumerate(able[: len(able) * 25 // 100], 1)]
    return rows, drawn


def check(got, docs, wanted):
    rows, drawn = brute(docs, wanted)
    assert Counter(tuple(r)[:5] for r in got) == Counter(map(tuple, rows))
    ranked = sorted((r for r in got if r.rank is not None), key=lambda r: r.rank)
    # rows that tie in score and id may stand in any order
    assert [(r.doc_id, r.score, r.rank) for r in ranked] == [(d[0], d[4], d[5]) for d in drawn]


def test_features_are_those_of_the_pattern():
    rng = random.Random(1)
    alphabet = "aZ9é名 -_[`{~\x7f\x00\n'ſK@/:"
    for _ in range(300):
        body = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        n, buckets = feature_buckets(body.encode())
        want = brute_features(body)
        assert (n, sorted(buckets.tolist())) == (want[0], sorted(want[1]))


def test_resampling(spark):
    rng = random.Random(2)
    docs = [(i, tables.text(rng, rng.choice([0, 5, 19, 20, 21, 60]))) for i in range(400)]
    docs += [(None, tables.text(rng, 30)), (None, docs[9][1]), (401, None), (402, ""), (403, tables.text(rng, 30_000))] + [(5, tables.text(rng, 40))] * 30
    wanted = [tables.text(rng, 40) for _ in range(20)] + [None, ""]
    frame = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "doc_id long, text string, score int, rank string, place int").repartition(5)
    check(resample(frame, spark.createDataFrame([(t,) for t in wanted], "text string")).collect(), docs, wanted)


def test_a_draw_within_equal_rows(spark):
    """The last place falls into rows that tie in everything: exactly as many as wanted are drawn."""
    body = tables.text(random.Random(3), 25)
    docs = [(1, body)] * 40
    got = resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(body,)], "text string")).collect()
    check(got, docs, [body])


def test_awkward_and_empty_tables(spark):
    docs, target = tables.awkward(spark), spark.createDataFrame([("a b c",), (None,)], "text string")
    got = resample(docs, target).collect()
    check(got, [(r.doc_id, r.text) for r in docs.collect()], ["a b c", None])
    assert resample(tables.empty(spark), target).collect() == []
    nothing = spark.createDataFrame([], "text string")
    check(resample(docs, nothing).collect(), [(r.doc_id, r.text) for r in docs.collect()], [])


@pytest.mark.parametrize("digit_bits", [3, 12])
def test_kth_key_by_digits(spark, digit_bits):
    rng = random.Random(4)
    values = [-(2**63), 2**63 - 1, 0, -1, *(rng.choice([5, -3, rng.randint(-50, 50), rng.randint(-(2**63), 2**63 - 1)]) for _ in range(60))]
    rows = [(rng.choice(values), rng.choice(values)) for _ in range(300)]
    df = spark.createDataFrame(rows, "a long, b long")
    keys, ordered = [F.col("a"), F.col("b")], sorted(rows)
    for k in (1, 2, 150, 299, 300):
        assert tuple(kth_key(df, keys, k, digit_bits)) == ordered[k - 1]
    assert kth_key(df, keys, 0) is None and kth_key(df, keys, 301) is None
    assert kth_key(df.limit(0), keys, 1) is None

