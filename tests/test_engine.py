"""Scans, joins, summaries, models and streams on small fixtures."""

import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veritrace.functions import ids
from veritrace.functions.features import build_features, feature_names, is_transferable
from veritrace.operators import labels, metrics, resample, summaries
from veritrace.plans import models, pool
from veritrace.schema import ROLES, canonicalise
from veritrace.sources import annotations, sinks
from veritrace.streaming import ingest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def labelled(spark):
    return pool.labelled(spark, SF).cache()


def test_annotation_documents(spark, tmp_path):
    ten = "one two three four five six seven eight nine ten"
    seg = lambda text, role="client", a=0.0, b=2.0: {"start_time": a, "end_time": b, "channel": "0", "annotation": {"speaker_role": role, "text": text}}
    doc = {
        "samples": {
            "s1": {"path_audio": "x.wav", "label": {"segments": [seg("", "bot"), seg(" "), seg(ten, b=0.0), seg(ten[:-4]), seg(ten), {"annotation": None}]}},
            "s2": {"label": {"segments": None}},
        }
    }
    (tmp_path / "a.json").write_text(json.dumps(doc))
    rows = annotations.read_annotations(spark, str(tmp_path / "a.json"), lang="en", roles=["client", ""])
    counts = {r.reject_reason: r.n for r in annotations.reject_counts(rows).collect()}
    assert counts == {"wrong_role": 1, "empty_text": 2, "bad_span": 1, "too_short": 1, "kept": 1}
    kept = annotations.accepted(rows).first()
    assert (kept.segment_id, kept.duration, kept.n_ref_words) == ("s1__0004", 2.0, 10)


def test_cache_takes_the_last_line(spark, tmp_path):
    lines = [{"segment_id": "a", "system": "x", "text": "old"}, {}, {"segment_id": "b", "system": "x", "text": ""}, {"segment_id": "a", "system": "x", "text": "new"}]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n")
    cache = annotations.read_cache(spark, str(tmp_path / "c.jsonl"))
    assert {r.segment_id: r.text for r in cache.collect()} == {"a": "new", "b": ""}
    assert [r.segment_id for r in labels.pending(spark.createDataFrame([("a",), ("z",)], "segment_id string"), cache).collect()] == ["z"]


def test_null_and_empty_hypotheses_differ(spark):
    records = spark.createDataFrame([("1", "a b", "en"), ("2", "a b", "en"), ("3", "", "en")], "segment_id string, reference_norm string, lang string")
    results = spark.createDataFrame([("1", "target", ""), ("3", "target", "x"), ("1", "proxy_a", "a b"), ("9", "target", "q")], "segment_id string, role string, text string")
    merged = labels.merge_transcriptions(records, results)
    assert {r.role: r.n for r in labels.coverage(merged).collect()} == {"target": 2, "proxy_a": 1, "proxy_b": 0}
    got = {r.segment_id: (r.label_errors, r.label_wer) for r in labels.add_labels(merged).collect()}
    assert got == {"1": (2, 1.0), "3": (1, 1.0)}


def test_keys(spark):
    df = spark.createDataFrame([("a|b", "C:\\x\\call7\\Audios\\1.wav", "es-PE")], "s string, p string, l string")
    got = df.select(ids.stable_seed(F.lit("a"), F.lit("b")).alias("seed"), ids.call_dir(F.col("p")).alias("dir"), ids.short_lang(F.col("l")).alias("lang")).first()
    assert tuple(got) == (2596171234, "C:/x/call7", "es")


def test_unique_ids_are_checked(spark):
    good = spark.createDataFrame([("1",), ("2",)], "segment_id string")
    assert labels.check_unique_ids(good).count() == 2
    with pytest.raises(Exception, match="not unique"):
        labels.check_unique_ids(good.union(good)).collect()


def test_regrouping_twice_changes_nothing(spark):
    rows = spark.createDataFrame([("s1", "a"), ("s2", "b")], "segment_id string, sample_id string")
    mapping = spark.createDataFrame([("a", "call9")], "sample_id string, call string")
    once = sinks.regroup(rows, mapping)
    assert {r.segment_id: r.sample_id for r in once.collect()} == {"s1": "call9", "s2": "b"}
    assert sorted(map(str, sinks.regroup(once, mapping).collect())) == sorted(map(str, once.collect()))


def test_defaults(spark):
    got = canonicalise(spark.createDataFrame([("a", "", None), ("b", "g", "noise")], "sample_id string, group_id string, condition string")).collect()
    assert [(r.group_id, r.corpus, r.condition) for r in got] == [("a", "internal", "clean"), ("g", "internal", "noise")]


def test_packs_prune_by_tag(spark, labelled, tmp_path):
    sinks.write_pack(labelled.select("segment_id", "corpus", "lang", "condition"), str(tmp_path / "pack"))
    read = spark.read.parquet(str(tmp_path / "pack")).where("corpus = 'calls' and condition = 'clean'")
    assert "PartitionFilters: [isnotnull(corpus" in read._jdf.queryExecution().toString()
    assert read.count() == labelled.where("corpus = 'calls' and condition = 'clean'").count()


def test_features(spark, labelled):
    assert len(feature_names()) == 27 and sum(map(is_transferable, feature_names())) == 22
    made = build_features(labelled.withColumn("hyp_proxy_a_norm", F.lit(None).cast("string")))
    row = made.first()
    assert row.features["pwer_proxy_a"] == 0.0 and list(row.features.asDict()) == feature_names()
    assert "duration" in made.columns and made.agg(F.sum("duration")).first()[0] == labelled.agg(F.sum("duration")).first()[0]


def test_spread_and_constant_columns(labelled):
    r = summaries.label_spread(labelled).first()
    assert 0 <= r.icc <= 1
    flat = labelled.withColumn("pred", F.lit(0.1))
    m = metrics.regression_metrics(flat, "label_wer", "pred").first()
    assert m.pearson is None and m.spearman is None and m.mae > 0
    b = metrics.binary_metrics(flat, "label_wer", "pred", 99.0).first()
    assert b.roc_auc is None and b.pr_auc is None


def test_resolve_k():
    assert metrics.resolve_k([0.1, 5, 900], 50, 7) == [5, 7]


def test_bootstrap_and_tests(labelled):
    rows = labelled.withColumn("pred", F.col("label_wer") * 0.9 + 0.01)
    a, b = (resample.cluster_bootstrap(rows, "label_wer", "pred", "group_id", 200).first() for _ in range(2))
    assert a == b and a.ci_low <= a.mae <= a.ci_high
    p = resample.paired_bootstrap(rows.withColumn("bad", F.lit(0.9)), "label_wer", "bad", "pred", "group_id", 200).first()
    assert p.favours_b
    assert resample._t_sf(2.0, 10) == pytest.approx(0.036694, abs=1e-5) and resample._t_sf(-1.0, 3) == pytest.approx(0.804499, abs=1e-5)
    s = resample.call_significance(summaries.call_metrics(rows), margin=0.5).first()
    assert s.associated and s.equivalent


def test_ridge_from_grams_is_the_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 4)) * [1, 5, 0.1, 2]
    y = x @ [1.0, -0.3, 2.0, 0.0] + 0.1 * rng.standard_normal(300)
    z = np.column_stack([np.ones(300), x, y])
    got = models.solve(z.T @ z, "ridge", 10.0)
    s = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(s.T @ s + 10 * np.eye(4), s.T @ (y - y.mean()))
    assert got.scaled_coef == pytest.approx(w) and got.intercept == pytest.approx(y.mean() - (w / x.std(0)) @ x.mean(0))
    lasso = models.solve(z.T @ z, "lasso", 0.05)
    gradient = s.T @ (y - y.mean() - s @ lasso.scaled_coef) / 300
    for g, c in zip(gradient, lasso.scaled_coef, strict=True):
        assert abs(g) <= 0.05 + 1e-6 if c == 0 else g == pytest.approx(0.05 * np.sign(c), abs=1e-6)


def test_protocols_and_export(spark, labelled):
    rows = labelled.where(ids.complete(*ROLES))
    result = models.run_protocol(rows, "loco", ("mean", "pwer", "ridge"))
    assert {(r.model, r.n) for r in models.summarize(result).collect()} == {(m, rows.count()) for m in ("mean", "pwer", "ridge")}
    groups = models.with_folds(rows.select("group_id", "corpus"), "group").groupBy("group_id").agg(F.countDistinct("fold").alias("n"))
    assert groups.where("n > 1").count() == 0
    export = models.ridge_export(rows, alpha=1.0)
    scored = models.apply_export(export, rows.drop("label_wer", "label_errors"))
    linear = json.loads(export)["linear"]
    table, names = models.design(rows)
    direct = {r.segment_id: min(max(float(np.dot(r.x, linear["coef"])) + linear["intercept"], 0), 2) for r in table.collect()}
    assert {r.segment_id: r.pred for r in scored.collect()} == pytest.approx(direct, abs=1e-9)


def test_ingestion_resumes(spark, tmp_path):
    source, cache, progress = (str(tmp_path / n) for n in ("in", "cache", "progress"))
    schema = "segment_id string, seq long, text string"
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
    add([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")])
    stream = lambda: spark.readStream.schema(schema).json(source)
    ingest.ingest(stream(), cache, progress)
    add([("a", 3, "w"), ("c", 1, "v")])
    ingest.ingest(stream(), cache, progress)
    ingest.ingest(stream(), cache, progress)
    got = {r.segment_id: r.text for r in ingest.state(spark, cache).collect()}
    assert got == {"a": "w", "b": "z", "c": "v"}
    assert sum(spark.read.parquet(p).count() for p in ingest.parts(spark, cache)) == 4


def test_reading_a_cache_costs_the_same_after_many_batches(spark, tmp_path):
    cache = str(tmp_path / "cache")
    want = {}
    for number in range(100):  # as the sink of a stream writes them
        rows = [(f"s{i}", number, f"{number}-{i}") for i in range(number % 7, 12)]
        want |= {s: t for s, _, t in rows}
        os.makedirs(f"{cache}/batches/batch={number}")
        pd.DataFrame(rows, columns=["segment_id", "seq", "text"]).to_parquet(f"{cache}/batches/batch={number}/part-0.parquet", index=False)
        open(f"{cache}/batches/batch={number}/_SUCCESS", "w").close()
        if number % 10 == 9:
            before = ingest.state(spark, cache)
            ingest.merge(spark, cache)
            assert {r.segment_id: r.text for r in before.collect()} == want  # a reader that has begun can end
        assert len(ingest.parts(spark, cache)) <= 10
    assert {r.segment_id: r.text for r in ingest.state(spark, cache).collect()} == want
    assert len(os.listdir(f"{cache}/batches")) <= 2 * 10 and len(os.listdir(f"{cache}/bases")) == 2


def test_replayed_batches_do_no_harm(spark, tmp_path):
    source, cache, progress = (str(tmp_path / n) for n in ("in", "cache", "progress"))
    schema = "segment_id string, seq long, text string"
    for k in range(5):
        spark.createDataFrame([("a", k, f"a{k}"), (f"b{k}", 0, "b")], schema).coalesce(1).write.mode("append").json(source)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source)
    ingest.ingest(stream(), cache, progress, merge_after=2)
    want = {"a": "a4"} | {f"b{k}": "b" for k in range(5)}
    state = lambda: {r.segment_id: r.text for r in ingest.state(spark, cache).collect()}
    assert state() == want and len(ingest.parts(spark, cache)) <= 2
    # the last batches run again, as after a crash before their commits
    for number in (3, 4):
        os.remove(f"{progress}/commits/{number}")
        if os.path.exists(f"{progress}/commits/.{number}.crc"):
            os.remove(f"{progress}/commits/.{number}.crc")
    ingest.ingest(stream(), cache, progress, merge_after=2)
    assert state() == want


def test_windowed_counts(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{SF}/[e]vents.parquet")
    out = str(tmp_path / "out")
    ingest.windowed_counts(stream, out, str(tmp_path / "progress"))
    got = {(r.start, r.event_type): r.n for r in spark.read.parquet(out).collect()}
    want = {(r.window.start, r.event_type): r.n for r in events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got and all(want[k] == n for k, n in got.items())
