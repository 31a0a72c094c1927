import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from veritrace.llm import decontamination, toxicity, url_filters
from veritrace.llm.common import doc_remainder
from veritrace.llm.decontamination import find_leaks, lcs_length

from . import tables

SF = "/root/testdata/sf0.1"


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held_out = doc_remainder(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs, labels.where(~held_out))
    judged = toxicity.score(docs.where(held_out), model).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    # outside English the labels follow nothing in the texts
    english = judged[judged.lang == "en"]
    assert (english.predicted == english.toxic).mean() > 0.97
    assert judged[judged.toxic == 0].predicted.mean() < 0.02


def test_toxicity_learns_and_keeps_rows(spark):
    rng = random.Random(5)
    rows = [tables.row(i, tables.text(rng, 30) + (" you horrible nitwit " if i % 4 == 0 else " ")) for i in range(200)]
    docs = spark.createDataFrame(rows, tables.DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(150)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert got == {i: int(i % 4 == 0) for i in range(200)}
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == 150
    again = toxicity.train(docs, labels)
    assert again.bias == model.bias and again.weights.tolist() == model.weights.tolist()
    strange = tables.awkward(spark)
    assert sorted(r.doc_id or 0 for r in toxicity.score(strange, model).collect()) == sorted(r.doc_id or 0 for r in strange.collect())
    assert toxicity.score(tables.empty(spark), model).collect() == []


def test_toxicity_features_and_ratios_match_brute_force(spark, monkeypatch):
    """Texts and n-grams counted one by one; repeated rows, and ids with two texts or without one, count as the docstring says."""
    rng = random.Random(6)
    texts = {i: tables.text(rng, 12) + (" you nitwit" if i % 3 == 0 else " dear friend") for i in range(90)}
    rows = [tables.row(i, t.upper() if i % 2 else t) for i, t in texts.items()] + [tables.row(5, texts[5].upper())] * 40 + [tables.row(None, "nitwit")]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(95)], "doc_id long, toxic int")

    def grams(text):
        text = " ".join(re.split("[\\x20\\x09-\\x0D]", text.lower())).encode()
        return {text[i : i + n] for n in toxicity.LENGTHS for i in range(len(text) - n + 1) if b" " not in text[i + 1 : i + n - 1]}

    toxic, clean = (Counter(g for i, t in texts.items() if (i % 3 == 0) == y for g in grams(t)) for y in (True, False))
    want = []
    for g in set(toxic) | set(clean):
        ratio = np.log((toxic[g] + 0.5) / (30 + 1)) - np.log((clean[g] + 0.5) / (60 + 1))
        if toxic[g] + clean[g] >= toxicity.MIN_TEXTS and abs(ratio) >= toxicity.MIN_RATIO:
            want.append(ratio)
    seen = {}
    fit = toxicity._fit
    monkeypatch.setattr(toxicity, "_fit", lambda lists, y, ratio, bias: seen.update(ratio=ratio, y=y, n=len(lists)) or fit(lists, y, ratio, bias))
    model = toxicity.train(spark.createDataFrame(rows, tables.DOCS), labels)
    assert sorted(seen["ratio"]) == pytest.approx(sorted(want)) and seen["n"] == 90 and seen["y"].sum() == 30
    assert len(model.buckets) == len(want)


def test_toxicity_fits_on_a_bounded_number_of_bytes(spark, monkeypatch):
    """Of the sample, the texts of least hash whose features fit; a very long text among them is read whole and does no harm."""
    rng = random.Random(7)
    rows = [tables.row(i, tables.text(rng, 40) + (" you nitwit" if i % 2 else " dear friend")) for i in range(120)]
    rows.append(tables.row(120, tables.text(rng, 250_000) + " dear friend"))
    docs = spark.createDataFrame(rows, tables.DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(121)], "doc_id long, toxic int")
    sizes, seen = [], []
    fit = toxicity._fit
    monkeypatch.setattr(toxicity, "_fit", lambda lists, *a: (sizes.append(sum(map(len, lists)) * 4), seen.append(len(lists))) and fit(lists, *a))
    whole = toxicity.train(docs, labels)
    monkeypatch.setattr(toxicity, "FIT_BYTES", sizes[0] // 2)
    model = toxicity.train(docs, labels)
    assert sizes[1] <= sizes[0] // 2 and seen[0] == 121 and 20 < seen[1] < 121
    assert (model.buckets == whole.buckets).all()  # ratios come from all of the sample
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert got == {i: i % 2 for i in range(121)}


def test_toxicity_learns_from_every_labelled_row(spark):
    """A word that only texts beyond the first `rows` have, and a fit on every row: parts go on from where the first texts end."""
    rng = random.Random(9)
    place = spark.range(400).select("id", F.xxhash64("id", F.lit(42)).alias("h")).orderBy("h", "id").collect()
    beyond = {r.id for r in place[40:]}
    seldom = set(sorted(beyond)[:60])
    words = {i: "you nitwit" if i % 3 == 0 and i not in seldom else "damned scoundrel" if i in seldom else "dear friend" for i in range(400)}
    docs = spark.createDataFrame([tables.row(i, f"{tables.text(rng, 30)} {w}") for i, w in words.items()], tables.DOCS)
    labels = spark.createDataFrame([(i, int(w != "dear friend")) for i, w in words.items()], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, rows=40)
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert got == {i: int(w != "dear friend") for i, w in words.items()}
    again = toxicity.train(docs, labels, rows=40)
    assert again.bias == model.bias and again.weights.tolist() == model.weights.tolist()


def test_toxicity_without_labels_or_with_one_kind(spark):
    docs = tables.awkward(spark)
    for labels in ([], [(1, 0), (8, 0)]):
        model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {r.predicted for r in toxicity.score(docs, model).collect()} <= {0, 1}


@pytest.mark.parametrize(
    ("url", "host", "path", "rule"),
    [
        ("http://example.com/en/1", "example.com", "/en/1", "example.com/en/"),
        ("http://WWW.Example.com/en/1?x=1", "www.example.com", "/en/1", "www.example.com/en/"),
        ("https://a.www.example.com/en/#x", "a.www.example.com", "/en/", "www.example.com/en/"),
        ("http://notexample.com/en/1", "notexample.com", "/en/1", "com/"),
        ("http://x.net/es/a", "x.net", "/es/a", "net/es/"),
        ("http://x.net/esp", "x.net", "/esp", None),
        ("http://x.com", "x.com", "", None),
        ("http://x.com?u=http://y.net/es/", "x.com", "", None),
        ("http://x.net/EN/a://b", "x.net", "/EN/a://b", None),
        ("no scheme", "", "", None),
        ("", "", "", None),
        (None, "", "", None),
        ("a\nb://h.net/fr/\nq", "h.net", "/fr/\nq", "net/fr/"),
    ],
)
def test_url_parts_and_rules(judged, url, host, path, rule):
    row = judged[url]
    assert (row.host, row.path, row.rule) == (host, path, rule)
    if rule:
        assert row.verdict == dict((b, a) for a, b in url_filters.RULES)[rule]


@pytest.fixture(scope="module")
def judged(spark):
    urls = [p[0] for p in test_url_parts_and_rules.pytestmark[0].args[1]]
    pages = spark.createDataFrame([(i, u, None, "x", "y") for i, u in enumerate(urls)] + [(None, "http://x.org/", None, "x", "y")], "page_id long, url string, html string, host string, rule string")
    model = url_filters.train(url_filters.labelled_urls(spark))
    rows = url_filters.judge_urls(pages, model)
    assert url_filters.judge_urls(pages.limit(0), model).collect() == []
    plan = rows._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    by_id = {r.page_id: r for r in rows.collect()}
    assert len(by_id) == len(urls) + 1
    return {u: by_id[i] for i, u in enumerate(urls)}


def brute_grams(host, path):
    return {text[i : i + n] for text in (f"^{host}$", f"^{path}$") for n in (3, 4, 5) for i in range(len(text) - n + 1)}


def test_url_features_are_the_grams_of_host_and_path(spark):
    urls = [u for u, _ in url_filters.labelled_urls(spark).limit(40).collect()] + ["http://É.org/名/", "x://", "no scheme", "http://a.b/" + "long/" * 300]
    table = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    parts = table.select("url", url_filters.host_of(F.col("url")).alias("host"), url_filters.path_of(F.col("url")).alias("path"))
    model = HashingTF(numFeatures=url_filters.FEATURES, inputCol="grams", outputCol="f")
    for r in url_filters._with_features(parts).collect():
        want = brute_grams(r.host, r.path)
        assert set(r.grams) == want and len(r.grams) == len(want)
        assert set(r.features.indices) == {model.indexOf(g) for g in want} and set(r.features.values) <= {1.0}


def test_url_model_on_hosts_and_paths_it_has_not_seen(spark):
    """A fifth of the hosts is held out at a time, and the model doesn't learn from any url with the path of one of them."""
    table = url_filters.labelled_urls(spark).withColumns({"host": url_filters.host_of(F.col("url")), "path": url_filters.path_of(F.col("url"))}).cache()
    assert table.count() == table.select("url").distinct().count() > 200 and table.select("host").distinct().count() > 180
    right, blocked, hits = 0, 0, 0
    for fold in range(5):
        held_out = F.crc32(F.col("host").cast("binary")) % 5 == fold
        paths = [r.path for r in table.where(held_out).select("path").distinct().collect()]
        model = url_filters.train(table.where(~held_out & ~F.col("path").isin(paths)))
        judged = url_filters.judge_urls(table.where(held_out).select(F.col("label").cast("long").alias("page_id"), "url"), model, rules=[]).toPandas()
        block = judged.verdict == "block"
        right += int((block == (judged.page_id == 1)).sum())
        blocked += int(block.sum())
        hits += int((block & (judged.page_id == 1)).sum())
    print(f"held out: accuracy {right / table.count():.3f}, precision of block {hits / blocked:.3f}, recall {hits / table.where('label = 1').count():.3f}")
    assert right / table.count() > 0.88 and hits / blocked > 0.88


def test_url_model_learns_from_paths(spark):
    """The same unknown host: the path decides."""
    model = url_filters.train(url_filters.labelled_urls(spark))
    paths = ["/free/casino-spins", "/ads/click/7", "/buy/cheap-pills", "/articles/science.html", "/news/2024/garden", "/wiki/history"]
    pages = spark.createDataFrame([(i, f"https://zq.example.org{p}") for i, p in enumerate(paths)], "page_id long, url string")
    got = [r.probability for r in url_filters.judge_urls(pages, model).orderBy("page_id").collect()]
    assert min(got[:3]) > max(got[3:])
    pages = spark.createDataFrame([(i, "https://" + u) for i, u in enumerate(["kitchen.example.org/en/1", "maps.example.org/de/", "casino-palace.example.org/en/1", "cheap-pills-now.example.org/en/9"])], "page_id long, url string")
    assert [r.verdict for r in url_filters.judge_urls(pages, model).orderBy("page_id").collect()] == ["allow"] * 2 + ["block"] * 2


def test_leaks_are_found_and_clean_texts_left_alone(spark):
    rng = random.Random(11)
    items = [tables.text(rng, n) + ". " + tables.text(rng, 6) + "." for n in (12, 25, 40, 60, 33)]
    docs, want = [], set()
    for i in range(120):
        words = tables.text(rng, rng.randint(5, 300)).split()
        if i % 6 == 0:
            k = rng.randrange(len(items))
            leak = items[k].split()
            if i % 12 == 0:  # a paraphrase: words go, the answer stays
                leak = [w for j, w in enumerate(leak) if j % 4 or j > len(leak) - 8]
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() if i % 18 == 0 else w for w in leak]
            want.add((i, k))
        docs.append(tables.row(i, " ".join(words)))
    table = spark.createDataFrame(docs, tables.DOCS).union(tables.awkward(spark).withColumn("doc_id", F.col("doc_id") + 1000))
    bench = spark.createDataFrame([(k, t, "x") for k, t in enumerate(items)] + [(90, None, "x"), (91, "", "x"), (None, "some words here", "x")], "item_id long, text string, doc_id string")
    found = find_leaks(table, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want)
    assert find_leaks(tables.empty(spark), bench).collect() == [] and find_leaks(table, bench.limit(0)).collect() == []


@pytest.mark.parametrize("share", [0.19, 0.38])
def test_leaks_without_their_rarest_words_match_brute_force(spark, share):
    """With the rarest words replaced, what the rules accept is found, and nothing else."""
    rng = random.Random(12)
    common = tables.WORDS[:40]
    items = [" ".join(rng.choice(common) if rng.random() < 0.6 else f"rare{k}x{j}" for j in range(n)) + ". " + tables.text(rng, 6) + "." for k, n in enumerate((14, 26, 34, 54))]
    docs, want = [], set()
    for i in range(80):
        words = [rng.choice(common) for _ in range(rng.randint(5, 200))]
        if i % 2 == 0:
            k = i // 2 % len(items)
            leak = items[k].replace(".", "").split()
            at = sorted(range(len(leak) - 6), key=lambda j: (leak[j][:4] != "rare", rng.random()))
            for j in at[: int(share * len(leak))]:
                leak[j] = f"new{i}x{j}"
            place = rng.randint(0, len(words))
            words[place:place] = leak
            want.add((i, k))
        docs.append(tables.row(i, " ".join(words)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in find_leaks(spark.createDataFrame(docs, tables.DOCS), bench).collect()}
    assert found == want


def test_recall_of_the_candidate_search(spark):
    """Against brute force: the rules applied around every word of every text, without candidates."""
    rng = random.Random(14)
    items = [tables.text(rng, n) + ". " + tables.text(rng, 6) + "." for n in (10, 14, 20, 30, 40, 52)]
    docs = []
    for i in range(90):
        words = tables.text(rng, rng.randint(5, 150)).split()
        if i % 4:
            leak = items[i % len(items)].replace(".", "").split()
            share, kept = (0.1, 0.2, 0.3, 0.38, 0.45)[i % 5], 6 if i % 2 else 0
            for j in rng.sample(range(len(leak) - kept), int(share * len(leak))):
                leak[j] = rng.choice(["", f"new{i}x{j}"])
            at = rng.randint(0, len(words))
            words[at:at] = [w for w in leak if w]
        docs.append(tables.row(i, " ".join(words)))
    hashed = decontamination._items([type("R", (), {"item_id": k, "text": t}) for k, t in enumerate(items)])
    want = set()
    for i, text, *_ in docs:
        data = np.frombuffer(text.encode(), np.uint8)
        words, _ = decontamination.hash_words(np.array([0, len(data)]), data, decontamination.WORD_BYTES)
        for item in hashed:
            width = decontamination._width(len(item.words))
            if any(decontamination._judge(item, words[max(a - width // 4, 0) : a + width + width // 4])[1] for a in range(len(words))):
                want.add((i, item.item_id))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in find_leaks(spark.createDataFrame(docs, tables.DOCS), bench).collect()}
    assert len(want) > 40 and found <= want and len(found) >= 0.97 * len(want)


def test_blocks_of_items_are_searched_alike(spark, monkeypatch):
    rng = random.Random(15)
    items = [(k, tables.text(rng, 20)) for k in range(12)]
    docs = spark.createDataFrame([tables.row(i, f"{tables.text(rng, 30)} {items[i % 12][1]} {tables.text(rng, 9)}") for i in range(24)], tables.DOCS)
    monkeypatch.setattr(decontamination, "ITEMS_PER_BLOCK", 5)
    found = find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(i, i % 12) for i in range(24)]


def test_item_of_one_sentence_is_found_by_its_last_words(spark):
    rng = random.Random(13)
    item = [f"word{j}" for j in range(30)]
    leak = [w if j >= 20 or j % 2 else f"new{j}" for j, w in enumerate(item)]  # 20 of 30 words, the last ten among them
    other = [w if j < 20 or j % 2 else f"new{j}" for j, w in enumerate(leak)]
    docs = [tables.row(i, f"{tables.text(rng, 40)} {' '.join(w)} {tables.text(rng, 40)}") for i, w in enumerate((leak, other, tables.text(rng, 30).split()))]
    bench = spark.createDataFrame([(1, " ".join(item) + ".")], "item_id long, text string")
    found = find_leaks(spark.createDataFrame(docs, tables.DOCS), bench).collect()
    assert [(r.doc_id, r.lcs) for r in found] == [(0, 20)]


def test_subsequence_length():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (rng.integers(0, 6, rng.integers(1, 20)) for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert lcs_length(a, b) == table[-1, -1]
