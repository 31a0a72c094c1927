import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from veritrace.llm import toxicity

from . import tables
from .test_near_dedup import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.written(stage(spark, docs, SF), name)
        out.append((docs, after))
        docs = after
    return out


def ids(df):
    return [r.doc_id for r in df.select("doc_id").collect()]


def test_all_but_the_last_stage_keep_the_columns(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(after.columns == columns for _, after in stages[:-1])


def test_toxic_documents_go(spark, stages):
    before, after = stages[0]
    model = toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(before, model).where("predicted = 1").collect()}
    assert sorted(ids(after)) == sorted(set(ids(before)) - bad)


def test_one_of_each_group_stays(stages):
    before, after = stages[1]
    want = brute([(r.doc_id, r.text) for r in before.collect()], 5)
    assert sorted(ids(after)) == sorted(i for i, (_, c) in want.items() if i == c)


def test_leaks_go_and_nothing_else(spark, stages):
    before, after = stages[2]
    words = lambda t: "".join(c if c.isalnum() or ord(c) > 127 else " " for c in t.lower()).split()
    items = [" ".join(words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [r.doc_id for r in before.collect() if not any(f" {i} " in f" {' '.join(words(r.text))} " for i in items)]
    assert sorted(ids(after)) == sorted(clean)


def test_mix_repeats_whole_documents(stages):
    before, after = stages[3]
    rows = {r.doc_id: r for r in before.collect()}
    taken = {}
    for r in after.collect():
        assert r == rows[r.doc_id]
        taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
    assert max(taken.values()) <= 3
    size = {i: len((r.text or "").encode().split()) for i, r in rows.items()}
    assert sum(size[i] * n for i, n in taken.items()) == pytest.approx(sum(size.values()), rel=0.3)


def test_token_files_hold_all_that_is_left(stages):
    before, after = stages[4]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = [], 0
    for r in sorted(before.collect(), key=lambda r: r.doc_id):
        ids_ = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, start, len(ids_), zlib.crc32(np.array(ids_, "<u4").tobytes())))
        start += len(ids_)
    assert sorted(map(tuple, after.collect())) == sorted(want)


def test_stages_take_awkward_rows_and_empty_tables(spark):
    rng = random.Random(9)
    for docs in (tables.awkward(spark, rng), tables.empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = corpus_pipeline.written(stage(spark, docs, SF), name)
            if name != "token_files":
                assert docs.columns == columns
            if name == "near_dedup":
                kept = [r.doc_id for r in docs.collect()]
                assert kept.count(1) == (1 if kept else 0) and 2 not in kept and 7 not in kept


def test_mix_takes_columns_of_any_name(spark):
    rows = [(i, f"word{i} and more words", "a", i, i, i, i, i) for i in range(6)] + [(None, "one two", None, 0, 0, 0, 0, 0), (7, None, "b", 1, 1, 1, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int, _copy int, mixed int, row int, n int")
    got = corpus_pipeline.mix(spark, docs, SF)
    assert got.columns == docs.columns and got.distinct().subtract(docs).count() == 0 and got.count() >= 6
    assert corpus_pipeline.mix(spark, docs.limit(0), SF).collect() == []
