"""Swaps, packs and the order of files."""

import os

import pytest
from pyspark.sql import functions as F

from veritrace.functions.numbers import cardinal
from veritrace.sources import ordinals, versions

RECORDS = [(f"s{i}", f"c{i // 3}", i) for i in range(9)]


def table(spark, path, rows=RECORDS):
    spark.createDataFrame(rows, "segment_id string, sample_id string, n long").write.mode("overwrite").json(path)
    return path


def calls(spark, path):
    return {r.segment_id: r.sample_id for r in spark.read.json(path).collect()}


def test_regrouping_on_disk(spark, tmp_path):
    path = table(spark, str(tmp_path / "records"))
    mapping = spark.createDataFrame([("c0", "call-x"), ("c2", "call-y"), ("other", "z")], "sample_id string, call string")
    before = calls(spark, path)
    dry = versions.regroup_files(spark, path, mapping)
    assert dry == {"rows": 9, "changed": 6, "calls_before": 3, "calls": 3} and calls(spark, path) == before
    assert sorted(os.listdir(tmp_path)) == ["records"]
    assert versions.regroup_files(spark, path, mapping, dry_run=False)["changed"] == 6
    want = {s: {"c0": "call-x", "c2": "call-y"}.get(c, c) for s, c in before.items()}
    assert calls(spark, path) == want and calls(spark, f"{path}.bak1") == before
    assert versions.regroup_files(spark, path, mapping, dry_run=False)["changed"] == 0  # again: nothing to do
    assert sorted(os.listdir(tmp_path)) == ["records", "records.bak1"]
    versions.regroup_files(spark, path, spark.createDataFrame([("c1", "w")], "sample_id string, call string"), dry_run=False)
    assert calls(spark, f"{path}.bak2") == want
    assert {r.original_sample_id for r in spark.read.json(path).collect()} == {"c0", "c1", "c2"}


@pytest.mark.parametrize("died_after", ["write", "first rename", "second rename"])
def test_a_swap_that_dies(spark, tmp_path, monkeypatch, died_after):
    path = table(spark, str(tmp_path / "records"))
    new = spark.read.json(path).withColumn("sample_id", F.lit("new"))
    renames = []
    real = versions.Folders.rename

    def rename(self, a, b):
        if len(renames) == ["write", "first rename", "second rename"].index(died_after):
            raise KeyboardInterrupt
        renames.append((a, b))
        real(self, a, b)

    monkeypatch.setattr(versions.Folders, "rename", rename)
    if died_after == "second rename":
        versions.swap(new, path)
    else:
        with pytest.raises(KeyboardInterrupt):
            versions.swap(new, path)
    monkeypatch.setattr(versions.Folders, "rename", real)
    versions.recover(spark, path)
    got = calls(spark, path)
    assert len(got) == 9 and (set(got.values()) == {"new"}) == (died_after != "write")
    assert not os.path.exists(f"{path}.next")


def test_a_former_version_comes_back(spark, tmp_path):
    path = table(spark, str(tmp_path / "records"))
    os.rename(path, f"{path}.bak1")
    os.makedirs(f"{path}.next")  # half-written: no _SUCCESS
    versions.recover(spark, path)
    assert len(calls(spark, path)) == 9


def test_packs_go_on_where_they_died(spark, tmp_path):
    dest = str(tmp_path / "pack")
    rows = [("a", "en", "clean", 1), ("a", "en", "clean", 2), ("a", "007", "noise", 3), ("b", None, "clean", 4)]
    pool = spark.createDataFrame(rows, "corpus string, lang string, condition string, n long")
    first = {tuple(r)[:3]: r for r in versions.pack_pool(pool.where("n <= 2"), dest).collect()}
    assert {k: r.rows for k, r in first.items()} == {("a", "en", "clean"): 2}
    # a run that died: files of a tag that the manifest doesn't name, and a tag that it names must not be written again
    pool.where("n = 3").withColumn("n", F.lit(99).cast("long")).write.mode("append").partitionBy("corpus", "lang", "condition").parquet(f"{dest}/data")
    kept = {f: os.path.getmtime(f"{dest}/data/corpus=a/lang=en/condition=clean/{f}") for f in os.listdir(f"{dest}/data/corpus=a/lang=en/condition=clean")}
    got = {tuple(r)[:3]: r for r in versions.pack_pool(pool, dest).collect()}
    assert {k: r.rows for k, r in got.items()} == {("a", "en", "clean"): 2, ("a", "007", "noise"): 1, ("b", None, "clean"): 1}
    assert kept == {f: os.path.getmtime(f"{dest}/data/corpus=a/lang=en/condition=clean/{f}") for f in kept}
    held = spark.read.schema("corpus string, lang string, condition string, n long").parquet(f"{dest}/data")
    assert sorted(r.n for r in held.collect()) == [1, 2, 3, 4]
    sizes = sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(f"{dest}/data") for f in fs if f.endswith(".parquet"))
    total = versions.pack_size(versions.read_manifest(spark, dest)).first()
    assert (total.files, total["rows"]) == (sum(r.files for r in got.values()), 4) and sum(r.bytes for r in got.values()) == sizes
    assert versions.pack_pool(pool, dest).count() == 3


@pytest.mark.parametrize("kind", ["parquet", "json"])
def test_places_do_not_depend_on_tasks(spark, tmp_path, kind):
    path = str(tmp_path / "in")
    data = spark.range(0, 20_000, 1, 5).select("id", F.md5(F.col("id").cast("string").cast("binary")).alias("x"))
    (data.write.json if kind == "json" else data.write.parquet)(path)
    read = lambda: spark.read.schema(data.schema).json(path) if kind == "json" else spark.read.parquet(path)
    want = None
    for size in ("128m", "40k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = {r["index"]: r.id for r in ordinals.with_index(read()).select("id", "index").collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert sorted(got) == list(range(20_000))
        want = want or got
        assert got == want == {i: i for i in range(20_000)}
    indexed = ordinals.with_index(read())
    assert [r.id for r in ordinals.first_rows(indexed, 7).collect()] == list(range(7))
    shuffled = [r.id for r in ordinals.first_rows(indexed, 500, buffer=100, seed=3).collect()]
    assert shuffled == [r.id for r in ordinals.first_rows(indexed.repartition(3), 500, buffer=100, seed=3).collect()]
    assert shuffled != sorted(shuffled) and all(i < place + 100 for place, i in enumerate(shuffled)) and len(set(shuffled)) == 500
    assert shuffled != [r.id for r in ordinals.first_rows(indexed, 500, buffer=100, seed=4).collect()]


def test_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "records")
    spark.createDataFrame([(i, f"/w/{i}.wav") for i in range(20)], "i long, wav_path string").coalesce(1).write.json(path)
    records = spark.read.json(path)
    files = spark.createDataFrame([(f"/w/{i}.wav",) for i in range(15)], "path string")
    assert [r.i for r in ordinals.complete_corpus(records, files, 12).collect()] == list(range(12))
    assert ordinals.complete_corpus(records, files, 16) is None and ordinals.complete_corpus(records, files, 21) is None


@pytest.mark.parametrize(
    ("n", "lang", "want"),
    [
        (10**9, "en", "one billion"),
        (1_200_000_005, "en", "one billion, two hundred million and five"),
        (10**12 + 10**6 + 100, "en", "one trillion, one million, one hundred"),
        (10**9, "de", "eine Milliarde"),
        (2 * 10**9 + 10**6, "de", "zwei Milliarden eine Million"),
        (21 * 10**12, "de", "einundzwanzig Billionen"),
        (10**9, "fr", "un milliard"),
        (80_000_000_000 + 80_000, "fr", "quatre-vingts milliards quatre-vingt mille"),
        (3 * 10**9, "es", "tres mil millones"),
        (21 * 10**12, "es", "veintiún billones"),
        (10**12 + 1, "es", "un billón uno"),
        (10**24, "de", "eins" + " null" * 24),
    ],
)
def test_large_numbers(n, lang, want):
    assert cardinal(n, lang) == want
