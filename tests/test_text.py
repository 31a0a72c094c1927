"""Micro-cases of normalisation, numbers and alignment."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrace.functions import bitparallel
from veritrace.functions.align import alignments, char_error_rate, edit_counts, word_errors
from veritrace.functions.bitparallel import edit_distances
from veritrace.functions.numbers import cardinal, spell
from veritrace.functions.text import normalize_text, parse_number, strip_accents


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "lang", "accents", "want"),
    [
        (None, "fr", False, ""),
        ("L'été, c'est-à-dire!", "fr", False, "l'été c'est à dire"),
        ("Möchte Straße", "de", True, "moechte strasse"),
        ("niño", "es", True, "nino"),
        ("ﬁn １２", "fr", False, "fin douze"),
        ("covid-19", "en", False, "covid minus nineteen"),
        ("  A\t b\n", "en", False, "a b"),
        ("3,5 km", "es", False, "tres punto cinco km"),
        ("é", "en", False, "é"),
    ],
)
def test_normalize(spark, text, lang, accents, want):
    assert one(spark, normalize_text(F.col("t"), F.col("l"), accents), t=text, l=lang) == want


@pytest.mark.parametrize(("raw", "want"), [("1.234", 1234.0), ("3,5", 3.5), ("12.345,67", 12345.67), ("5.,", 5.0), ("-19", -19.0), ("+7", 7.0)])
def test_parse_number(spark, raw, want):
    assert one(spark, parse_number(F.col("t")), t=raw) == want


@pytest.mark.parametrize(
    ("n", "lang", "want"),
    [
        (0, "en", "zero"),
        (121, "en", "one hundred and twenty-one"),
        (1234, "en", "one thousand, two hundred and thirty-four"),
        (1005, "en", "one thousand and five"),
        (21, "de", "einundzwanzig"),
        (101, "de", "einhunderteins"),
        (2345, "de", "zweitausenddreihundertfünfundvierzig"),
        (71, "fr", "soixante et onze"),
        (80, "fr", "quatre-vingts"),
        (91, "fr", "quatre-vingt-onze"),
        (200, "fr", "deux cents"),
        (1999, "fr", "mille neuf cent quatre-vingt-dix-neuf"),
        (31, "es", "treinta y uno"),
        (100, "es", "cien"),
        (21_000, "es", "veintiún mil"),
        (1_000_000, "es", "un millón"),
    ],
)
def test_cardinal(n, lang, want):
    assert cardinal(n, lang) == want


def test_numbers_in_another_language_are_english():
    assert spell("2 e 3", "pt").split() == ["two", "e", "three"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def sequences(rng, n, lengths, alphabets=(2, 5, 1000)):
    """Pairs of sequences: unrelated, edited copies, equal and empty ones."""
    out = []
    for _ in range(n):
        size = rng.choice(alphabets)
        a = [rng.randrange(size) for _ in range(rng.choice(lengths))]
        b = [x if rng.random() > 0.1 else rng.randrange(size) for x in a if rng.random() > 0.1] if rng.random() < 0.6 else [rng.randrange(size) for _ in range(rng.choice(lengths))]
        out.append((np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)))
    return out


def test_alignments_of_a_batch():
    pairs = sequences(random.Random(0), 400, [0, 1, 2, 9, 40])
    for (a, b), (errors, s, d, i) in zip(pairs, alignments(pairs).tolist(), strict=True):
        assert errors == s + d + i == distance(a.tolist(), b.tolist()) and d - i == len(a) - len(b)
    alone = [alignments([p])[0].tolist() for p in pairs]
    assert alone == alignments(pairs).tolist()


def test_bit_parallel_distances(monkeypatch):
    pairs = sequences(random.Random(2), 500, [0, 1, 5, 63, 64, 65, 127, 128, 129, 200])
    want = [distance(a.tolist(), b.tolist()) for a, b in pairs]
    assert edit_distances(pairs).tolist() == want
    monkeypatch.setattr(bitparallel, "LANES", 3)  # many small batches
    assert edit_distances(pairs).tolist() == want
    monkeypatch.setattr(bitparallel, "TABLE_WORDS", 100)  # by rows, where the table of matches would be larger
    assert edit_distances(pairs).tolist() == want
    assert edit_distances([]).tolist() == []


def test_distances_are_those_of_the_builtin(spark):
    rng = random.Random(5)
    alphabet = "abc éß名😀"
    rows = [tuple("".join(rng.choice(alphabet) for _ in range(rng.choice([0, 3, 30, 150]))) for _ in range(2)) for _ in range(2_000)]
    df = spark.createDataFrame([*rows, (None, "a"), ("a", None)], "r string, h string")
    plain = [F.replace(c, F.lit(" "), F.lit("")) for c in ("r", "h")]
    n = F.greatest(F.length(plain[0]), F.lit(1))
    want = F.when(F.length(plain[0]) > 0, F.levenshtein(*plain) / n).otherwise((F.length(plain[1]) > 0).cast("double"))
    got = df.select(char_error_rate(F.col("r"), F.col("h")).alias("got"), F.when(F.col("r").isNotNull() & F.col("h").isNotNull(), want).alias("want"))
    assert got.where("not (got <=> want)").count() == 0


def test_word_errors_of_a_large_vocabulary(spark):
    """More distinct words than there are code units."""
    ref = " ".join(f"w{i}" for i in range(70_000))
    df = spark.createDataFrame([(ref, ref.replace("w7 ", "x ").replace(" w500 ", " "))], "r string, h string")
    assert df.select(word_errors(F.col("r"), F.col("h"))).first()[0] == 2


def test_builtin_and_udf_agree(spark):
    rng = random.Random(1)
    rows = [(" ".join(rng.choice(["été", "b", "ça", "x1", "名"]) for _ in range(rng.randint(0, 12))), " ".join(rng.choice(["été", "b", "y"]) for _ in range(rng.randint(0, 12)))) for _ in range(80)]
    df = spark.createDataFrame(rows, "r string, h string").select("r", "h", word_errors(F.col("r"), F.col("h")).alias("e"), edit_counts(F.col("r"), F.col("h")).alias("c"), char_error_rate(F.col("r"), F.col("h")).alias("cer"))
    for x in df.collect():
        a, b = x.r.split(), x.h.split()
        assert x.e == x.c.errors == distance(a, b)
        assert x.c.wer == (x.e / len(a) if a else float(bool(b)))
        p, q = x.r.replace(" ", ""), x.h.replace(" ", "")
        assert x.cer == pytest.approx(distance(p, q) / len(p) if p else float(bool(q)))


def test_null_transcripts_have_no_counts(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("", ""), ("a b c", "")], "r string, h string")
    got = [x[0] for x in df.select(edit_counts(F.col("r"), F.col("h"))).collect()]
    assert got[0].wer is None and got[1].errors is None and got[2].wer == 0.0 and (got[3].d, got[3].wer) == (3, 1.0)


def test_strip_accents_keeps_ascii_in_the_jvm(spark):
    assert one(spark, strip_accents(F.col("t"), F.col("l")), t="ÀÉ ß ñ", l="fr") == "AE ss n"


def test_alignments_of_a_batch_take_bounded_memory():
    """As many rows as a batch may have are held a part at a time; results are those of each row alone."""
    import tracemalloc

    import pandas as pd

    from veritrace.functions import align

    rng = random.Random(5)
    a = pd.Series(["".join(rng.choices("abcdefgh ", k=400)) for _ in range(4000)] + [None, ""])
    b = pd.Series([x and "".join(c for c in x if rng.random() > 0.2) for x in a])
    few = slice(0, len(a), 97)
    for run, parts in ((align._distances, align._code_points), (align._distances, align._words), (lambda x, y, _: align._align_udf.func(x, y), None)):
        tracemalloc.start()
        got = run(a, b, parts)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 50 << 20, peak
        alone = pd.concat([run(a[i : i + 1].reset_index(drop=True), b[i : i + 1].reset_index(drop=True), parts) for i in range(len(a))[few]], ignore_index=True)
        assert got[few].reset_index(drop=True).equals(alone)
        assert got.iloc[4000:4001].isna().all(axis=None)


def test_batches_to_python_are_small(spark):
    """Where features are made, Python gets BATCH_ROWS rows at once at most."""
    from veritrace.plans import pool
    from veritrace.store import BATCH_ROWS

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        pool.merged(spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get(key)) == BATCH_ROWS
    finally:
        spark.conf.set(key, before)


def test_texts_of_a_row_share_a_worker(spark):
    """What a task sends to Python: the hypotheses of all systems in one step, then what is aligned; each step is a worker of its own."""
    from veritrace.operators import labels
    from veritrace.plans import pool

    plan = labels.add_labels(pool.merged(spark, "/root/testdata/sf0.001"), split=False)._jdf.queryExecution().executedPlan().toString()
    after_join = plan[: plan.index("Join")]
    assert after_join.count("ArrowEvalPython") == 2, after_join
    assert all(plan.count(f"ArrowEvalPython [{f}(") for f in ("_compose", "_word_distance"))
