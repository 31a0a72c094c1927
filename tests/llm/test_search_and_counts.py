import random

import numpy as np
import public_tokenizers
import pytest

from veritrace.llm.hamming_search import hamming_top_k
from veritrace.llm.token_counts import LongestMatch, token_counts, word_piece_vocabulary

from . import tables

VECTORS = "vec_id long, embedding array<float>, label int, query string, code string"


def brute(vectors, queries, k):
    out = []
    for q, x in queries:
        ranked = sorted((sum((a > 0) != (b > 0) for a, b in zip(x, y, strict=True)), v) for v, y in vectors)
        out += [(q, i + 1, v, d) for i, (d, v) in enumerate(ranked[:k])]
    return sorted(out)


@pytest.mark.parametrize(("dims", "bits"), [(64, None), (50, 7), (16, 16)])
def test_top_k_is_exact_with_ties_and_copies(spark, dims, bits):
    rng = np.random.default_rng(dims)
    x = rng.standard_normal((150, dims))
    x[30:60] = x[0] + 0.3 * rng.standard_normal((30, dims))
    x[60:100] = x[1]
    rows = [(i, v.tolist(), 0, "q", "c") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, VECTORS)
    got = hamming_top_k(df, df.where("vec_id % 30 = 0"), k=7, bits=bits)
    vectors = [(r[0], r[1]) for r in rows]
    assert sorted(map(tuple, got.collect())) == brute(vectors, [v for v in vectors if v[0] % 30 == 0], 7)


def test_top_k_of_awkward_vectors(spark):
    rows = [(1, [1.0, -1.0]), (2, None), (3, [1.0]), (None, [1.0, -1.0]), (4, [float("nan"), 2.0]), (1, [1.0, -1.0])]
    df = spark.createDataFrame([(i, v, 0, "q", "c") for i, v in rows], VECTORS)
    got = sorted(map(tuple, hamming_top_k(df, df.where("vec_id in (2, 3)"), k=9).collect()))
    # the short vector has a 0 bit at its end; not-a-number is no positive component
    assert [(r[1], r[2], r[3]) for r in got] == [(1, None, 0), (2, 1, 0), (3, 1, 0), (4, 3, 0), (5, 4, 2)]
    assert hamming_top_k(df.limit(0), df, 3).collect() == [] and hamming_top_k(df, df.limit(0), 3).collect() == []


def greedy(word, first, inner):
    n, i = 0, 0
    while i < len(word):
        pieces = first if i == 0 else inner
        j = next((j for j in range(len(word), i, -1) if word[i:j] in pieces), None)
        if j is None:
            return 1
        n, i = n + 1, j
    return n


def test_automaton_counts_what_greedy_matching_gives():
    rng = random.Random(3)
    for _ in range(60):
        piece = lambda: bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5)))
        first, inner = ({piece() for _ in range(rng.randint(1, 12))} for _ in range(2))
        machine = LongestMatch(first, inner)
        for _ in range(100):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 12)))
            assert machine.count(word) == greedy(word, first, inner), (word, first, inner)


def test_token_counts_of_awkward_rows(spark):
    first, inner = word_piece_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    a, b = set(first), set(inner)
    docs = tables.awkward(spark)
    got = sorted(map(tuple, token_counts(docs, (first, inner)).collect()), key=str)
    want = []
    for r in docs.collect():
        words = (r.text or "").encode().split()
        want.append((r.doc_id, len(words), sum(greedy(w, a, b) for w in words)))
    assert got == sorted(want, key=str)
    assert token_counts(tables.empty(spark), (first, inner)).collect() == []
