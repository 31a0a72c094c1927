import collections
import random
import re

import numpy as np
import pytest

from veritrace.llm.common import hash_shingles, hash_words
from veritrace.llm.components import connected_components
from veritrace.llm import near_dedup
from veritrace.llm.near_dedup import near_duplicates, super_minhash

from . import tables


def sets_of(rows, k):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[j : j + k]) for j in range(max(len(w) - k + 1, 1))} if w else set())
    return out


def brute(rows, k, percent=80):
    sets = sets_of(rows, k)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        least[find(a)] = min(least.get(find(a), i), i)
    return {rows[a][0]: (len(sets[a]), least[find(a)]) for a in range(len(rows))}


@pytest.mark.parametrize("k", [2, 5])
def test_families_of_edited_copies_match_brute_force(spark, k):
    """A family whose members hover around the threshold, where hubs alone lose links."""
    rng = random.Random(k)
    rows = [(i, tables.text(rng, rng.randint(1, 60))) for i in range(60)]
    for family in range(4):
        base = tables.text(rng, 120).split()
        for _ in range(45):
            words = list(base)
            for _ in range(rng.randint(0, 12)):
                i = rng.randrange(len(words))
                if rng.random() < 0.5:
                    words[i] = rng.choice(tables.WORDS)
                else:
                    del words[i]
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=k).collect()}
    assert got == brute(rows, k)


def test_awkward_rows(spark):
    got = collections.defaultdict(list)
    for r in near_duplicates(tables.awkward(spark)).collect():
        got[r.doc_id].append((r.n_shingles, r.component_id, r.kept))
    assert got[1] == [(76, 1, True)] and got[2] == [(76, 1, False)] * 2
    for i in (3, 4, 5):
        assert got[i] == [(0, i, True)]
    assert got[6] == [(1, 6, True)] and got[7] == [(1, 6, False)]
    assert sorted(got[None], key=str) == [(0, None, False), (76, 1, False)]
    assert len(got[8]) == 1 and got[8][0][1:] == (8, True)


def test_empty_table(spark):
    assert near_duplicates(tables.empty(spark)).collect() == []


def slow_super_minhash(items, m):
    """The textbook form: element after element, a full permutation each."""
    mask = (1 << 64) - 1

    def mix(x):
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & mask
        return x ^ x >> 31

    out = [mask] * m
    for e in items:
        p = list(range(m))
        for j in range(m):
            z = mix((e + (j + 1) * 0x9E3779B97F4A7C15) & mask)
            k = j + ((z & 0xFFFFFFFF) * (m - j) >> 32)
            p[j], p[k] = p[k], p[j]
            out[p[j]] = min(out[p[j]], j << 32 | z >> 32)
    return out


def test_signature_is_that_of_the_textbook():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 7, 300)] + [np.empty(0, np.uint64)]
    got = super_minhash(sets, 40)
    for s, row in zip(sets, got, strict=True):
        assert row.tolist() == slow_super_minhash(s.tolist(), 40)


def test_signature_estimates_the_jaccard_similarity():
    rng = np.random.default_rng(1)
    estimates = []
    for _ in range(60):
        pool = rng.integers(0, 2**63, 125).astype(np.uint64)
        a, b = super_minhash([pool[:100], pool[25:]], 160)
        estimates.append((a == b).mean())
    assert abs(np.mean(estimates) - 0.6) < 0.02


def test_words_hash_by_their_bytes():
    data = np.frombuffer("The the\tTHE été x" "y z".encode(), np.uint8)
    words, begins = hash_words(np.array([0, 19, len(data)]), data)
    assert words[0] == words[1] == words[2] and len(set(words.tolist())) == 5 and begins.tolist() == [0, 5, 7]
    assert [len(s) for s in hash_shingles(words, begins, 5)] == [1, 1]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(40)] + [(5, 5)]
    got = dict(connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {i: 0 for i in range(1, 31)} | {100 + i: 100 for i in range(1, 40)}


def test_texts_in_a_template_meet_nobody(spark, monkeypatch):
    """Texts with most words from a template and a few of their own, below the threshold: no pairs come from the shared words."""
    rng = random.Random(4)
    template = tables.text(rng, 60)
    rows = [(i, f"{template} {tables.text(rng, 9)} own{i} {tables.text(rng, 4)}") for i in range(300)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(5)]
    pairs = []
    prefix_pairs = near_dedup._prefix_pairs
    monkeypatch.setattr(near_dedup, "_prefix_pairs", lambda *a: pairs.append(prefix_pairs(*a)) or pairs[-1])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()}
    assert got == brute(rows, 2)
    assert pairs[0].count() < len(rows)


def test_sets_whose_class_is_the_same_by_chance(spark, monkeypatch):
    """With classes of two bits many sets share one, and are told apart by the other bits."""
    keys = near_dedup._set_keys
    monkeypatch.setattr(near_dedup, "_set_keys", lambda sets: ([k and k % 4 for k in keys(sets)[0]], keys(sets)[1]))
    rng = random.Random(5)
    rows = [(i, tables.text(rng, 40)) for i in range(30)]
    rows += [(100 + i, t) for i, t in rows[:10]]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 5)


def test_known_components_take_no_round(spark, monkeypatch):
    """Stars are done as they come; an edge more is joined to them without starting over."""
    from veritrace.llm import components

    rounds, write = [], components.written
    monkeypatch.setattr(components, "written", lambda df, name: rounds.append(name) or write(df, name))
    stars = [(u, 0) for u in range(1, 30)] + [(u, 100) for u in range(101, 120)]
    table = lambda edges: spark.createDataFrame(edges, "u long, v long")
    known = connected_components(table(stars + stars[::3] + [(7, 7), (None, 5), (6, None)]))
    assert dict(known.collect()) == dict(stars) and len(rounds) == 1
    rounds.clear()
    joined = connected_components(known.toDF("u", "v").union(table([(17, 105)])))
    assert dict(joined.collect()) == dict.fromkeys([*range(1, 30), *range(100, 120)], 0)
    assert len(rounds) <= 4
