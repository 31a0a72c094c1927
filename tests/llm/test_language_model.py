import math
import os
import random
import resource
from collections import Counter

import numpy as np
import pytest

from veritrace.llm import language_model as lm
from veritrace.llm.ngram_arrays import Files, find, keys_of, narrow

from . import tables


def discounts(n):
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    raw = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5 * k for k in (1, 2, 3)]
    return [0] + [min(max(d, 0.05), k - 0.05) for d, k in zip(raw, (1, 2, 3), strict=True)]


def tokens_of(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + ["</s>"]


class Slow:
    """The model in dictionaries of words."""

    def __init__(self, texts, order):
        self.order, self.count, self.levels = order, Counter(), {order: Counter()}
        for t in texts:
            words = tokens_of(t)
            self.count.update(words)
            padded = ["<s>"] * (order - 1) + words
            self.levels[order].update(zip(*(padded[i:] for i in range(order)), strict=False))
        for k in range(order - 1, 0, -1):
            self.levels[k] = Counter(g[1:] for g in self.levels[k + 1])
        self.discounts = {k: discounts(Counter(min(n, 5) for n in x.values())) for k, x in self.levels.items()}
        self.total, self.left = Counter(), Counter()
        for k, grams in self.levels.items():
            for g, n in grams.items():
                self.total[k, g[:-1]] += n
                self.left[k, g[:-1]] += self.discounts[k][min(n, 3)]

    def p(self, history, w):
        k = len(history) + 1
        lower = self.p(history[1:], w) if k > 1 else 1 / (len(self.count) + 1)
        total = self.total[k, history]
        if not total:
            return lower
        n = self.levels[k][(*history, w)]
        return max(n - self.discounts[k][min(n, 3)], 0) / total + self.left[k, history] / total * lower

    def score(self, text):
        padded = ["<s>"] * (self.order - 1) + tokens_of(text)
        return sum(math.log10(self.p(tuple(padded[i : i + self.order - 1]), padded[i + self.order - 1])) for i in range(len(padded) - self.order + 1))


def corpus(rng, n):
    out, words = [], tables.WORDS[:25]
    for _ in range(n):
        w = rng.choice(words)
        text = []
        for _ in range(rng.randint(0, 40)):
            text.append(w.upper() if rng.random() < 0.1 else w)
            w = words[((words.index(w) if w in words else 3) * 7 + rng.choice([1, 1, 1, 2, 3, 9])) % 25] if rng.random() < 0.9 else rng.choice(tables.WORDS)
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize(("order", "part"), [(2, 2_500_000), (3, 2_500_000), (2, 60), (3, 60)])
def test_scores_match_brute_force(spark, monkeypatch, order, part):
    """With small parts, many words are so frequent that their pairs are dealt over several parts."""
    monkeypatch.setattr(lm, "PART_TOKENS", part)
    monkeypatch.setattr(lm, "PART_WORDS", 20)
    rng = random.Random(4)
    texts = corpus(rng, 120)
    train = spark.createDataFrame([(t,) for t in texts] + [(None,), ("",)], "text string")
    model = lm.train(train, order)
    slow = Slow([*texts, None, ""], order)
    assert (model.n_tokens, model.n_words, model.n_types) == (sum(slow.count.values()), len(slow.count), len(slow.levels[2]))
    assert (len(model.deal.hot) > 10) == (part == 60)
    new = corpus(rng, 30) + ["never seen words", "x", "", None, texts[3], texts[4]]
    docs = spark.createDataFrame([tables.row(i, t) for i, t in enumerate(new)], tables.DOCS)
    got = {r.doc_id: r for r in lm.score(docs, model).collect()}
    for i, t in enumerate(new):
        words = tokens_of(t)
        assert got[i].n_tokens == len(words) and got[i].n_known == sum(slow.count[w] > 0 for w in words)
        assert got[i].score == pytest.approx(slow.score(t), rel=1e-6)
        base = sum(math.log10((slow.count[w] + 0.1) / (model.n_tokens + 0.1 * (model.n_words + 1))) for w in words)
        assert got[i].base_score == pytest.approx(base)
    assert sum(got[i].score for i in range(30)) > sum(got[i].base_score for i in range(30))


@pytest.mark.parametrize("order", [2, 3])
def test_probabilities_after_words_sum_to_one(spark, order):
    texts = corpus(random.Random(6), 50)
    model = lm.train(spark.createDataFrame([(t,) for t in texts], "text string"), order)
    end = model.words.end
    tokens = np.append(np.arange(end + 1), end + 2).astype(np.uint32)  # all words, the end, and one that was never seen
    for two, one in ((3, 5), (end + 1, 4), (end + 1, end + 1), (7, end + 2), (0, 1)):
        scores, _ = lm.Reader(model).scores(np.full(len(tokens), two, np.uint32), np.full(len(tokens), one, np.uint32), tokens)
        assert (10.0**scores).sum() == pytest.approx(1, abs=1e-6)


def test_sorted_keys():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 3000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        arrays = keys_of("x", keys)
        others = rng.integers(0, 2**64, 500, dtype=np.uint64)
        assert find(arrays, "x", keys).tolist() == list(range(len(keys)))
        assert (find(arrays, "x", others) == -1).all()


def test_blocks_of_columns():
    rng = np.random.default_rng(1)
    columns = [np.sort(rng.integers(0, 2**32, 500)), rng.integers(0, 2**32, 500), rng.integers(0, 2**63, 500)]
    assert all((a == b).all() for a, b in zip(columns, lm._unpack("suffix", lm._pack("suffix", columns)), strict=True))


def test_counts_beyond_32_bits():
    assert narrow(np.array([1, 2**32 - 1])).dtype == np.uint32 and narrow(np.array([1, 2**40])).tolist() == [1, 2**40]
    total, n1 = np.array([2**33, 5]), np.array([7, 2**34])
    hi, _, sums = lm._merged(np.array([3, 3], dtype=np.uint64), np.zeros(2, np.uint32), [total, n1])
    assert hi.tolist() == [3] and [x.tolist() for x in sums] == [[2**33 + 5], [2**34 + 7]]


def test_few_files_are_open_at_a_time(tmp_path, monkeypatch):
    """200 parts under a limit of 256 open files; what was asked for longest ago is closed."""
    from pyspark import TaskContext

    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: type("T", (), {"taskAttemptId": lambda self: 1})()))
    files = Files(str(tmp_path))
    for k in range(200):
        files.save(f"top-{k:06d}", a=np.arange(k), b=np.full((k % 3, 2), k, dtype=np.uint64))
    soft, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    held = len(os.listdir("/proc/self/fd"))
    resource.setrlimit(resource.RLIMIT_NOFILE, (held + 100, hard))
    try:
        for _ in range(2):
            for k in range(200):
                arrays = files.arrays(f"top-{k:06d}")
                assert arrays["a"].tolist() == list(range(k)) and arrays["b"].shape == (k % 3, 2) and (arrays["b"] == k).all()
                assert len(files.open) <= Files.MAPPED
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard))


def test_parts_are_told_by_bits(spark):
    rows = [("level3", p, None) for p in (0, 5, 32_767, 32_768, 70_000)] + [("done", 3, None), ("level2", 1, None), ("types", None, None), ("words", 9, b"x")]
    got = lm._present(spark.createDataFrame(rows, "kind string, part int, data binary"), 80_000)
    assert {k: np.flatnonzero(v).tolist() for k, v in got.items()} == {"top": [0, 5, 32_767, 32_768, 70_000], "context": [0, 3, 5, 32_767, 32_768, 70_000], "suffix": [1], "table": []}


def test_other_orders_are_refused(spark):
    with pytest.raises(ValueError, match="order"):
        lm.train(tables.empty(spark), 4)


def test_awkward_rows_and_empty_tables(spark):
    docs = tables.awkward(spark)
    empty = tables.empty(spark)
    for train in (docs, empty):
        model = lm.train(train)
        got = lm.score(docs, model).collect()
        assert len(got) == docs.count() and all(r.score <= 1e-9 and r.n_tokens >= 1 for r in got)
        assert lm.score(empty, model).collect() == []
