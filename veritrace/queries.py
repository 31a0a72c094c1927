"""Queries over the driver's tables for the transcript operators, with the same in DuckDB's SQL where it can say it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ids, signal
from .functions.align import char_error_rate, edit_counts, word_errors
from .functions.features import build_features, orphan_word_ratio, repeated_ngram_ratio, with_call_context
from .functions.text import normalize_text, parse_number, strip_accents, words
from .operators import labels, metrics, reports, resample, summaries
from .plans import bundles, folds, models, pool
from .plans.oracle import LABELLED, MERGED, edits
from .schema import ROLES
from .sources import annotations, ordinals, sinks, versions
from .store import shared_path, small_batches, written
from .streaming import ingest

QUERIES = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows with an estimate from lengths alone: the share of missing words."""
    rows = pool.labelled(spark, sf_dir)
    return rows.withColumn("pred", F.least(F.greatest(1 - F.col("n_hyp_words") / F.greatest("n_ref_words", F.lit(1)), F.lit(0.0)), F.lit(2.0)))


PREDICTED = LABELLED + ", predicted AS (SELECT *, least(greatest(1 - len(target)::DOUBLE / greatest(len(w), 1), 0.0), 2.0) AS pred FROM labelled)\n"
_WER = "sum(label_errors)::DOUBLE / nullif(sum(n_ref_words), 0)"
_DURATION_WER = "sum(label_wer * duration) / nullif(sum(duration), 0)"
_ZERO = "avg(CASE WHEN label_wer = 0 THEN 1.0 ELSE 0.0 END)"
_PEARSON = "covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"
_RANK = "rank() OVER (PARTITION BY {k} ORDER BY {x}) + (count(*) OVER (PARTITION BY {k}, {x}) - 1) / 2.0"


# --- scans, text, ids


@query(
    MERGED
    + """SELECT CASE WHEN speaker_role = 'system' THEN 'wrong_role' WHEN trim(coalesce(reference, '')) = '' THEN 'empty_text'
    WHEN start_time + duration <= start_time THEN 'bad_span' WHEN len(w) < 10 THEN 'too_short' ELSE 'kept' END AS reject_reason,
    count(*) AS n FROM merged GROUP BY 1"""
)
def s1_reject_counts(spark, sf_dir):
    rows = pool.records(spark, sf_dir).withColumn("end_time", F.col("start_time") + F.col("duration"))
    return annotations.reject_counts(annotations.with_reject_reason(rows, 10, ["user", "assistant"]))


@query(MERGED + "SELECT segment_id, reference_norm, n_ref_words FROM merged")
def t1_normalize_text(spark, sf_dir):
    return pool.records(spark, sf_dir).select("segment_id", "reference_norm", "n_ref_words")


@query(
    r"""SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}'']+', ' ', 'g')) AS text_norm,
    len(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}'']+', ' ', 'g')), ' '))::INTEGER AS n FROM documents WHERE text IS NOT NULL"""
)
def t1_normalize_documents(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").where("text is not null")
    norm = normalize_text(F.col("text"), F.col("lang"), numbers=False)
    return docs.select("doc_id", norm.alias("text_norm")).select("*", F.size(F.split("text_norm", " ")).alias("n"))


@query(
    MERGED
    + """SELECT segment_id, strip_accents(replace(CASE WHEN lang = 'de' THEN replace(replace(replace(reference_norm, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue')
    ELSE reference_norm END, 'ß', 'ss')) AS folded FROM merged"""
)
def t2_strip_accents(spark, sf_dir):
    return pool.records(spark, sf_dir).select("segment_id", strip_accents(F.col("reference_norm"), F.col("lang")).alias("folded"))


@query("SELECT o_orderkey, o_totalprice AS value FROM orders")
def t3_parse_number(spark, sf_dir):
    """Prices with a thousands point and a decimal comma give back their value."""
    price = F.col("o_totalprice")
    text = F.translate(F.format_number(price, 2), ".,", ",.")
    return _table(spark, sf_dir, "orders").select("o_orderkey", parse_number(text).alias("value"))


@query()
def t4_expand_numbers(spark, sf_dir):
    """Numbers in words, over whole document texts."""
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", normalize_text(F.col("text"), F.col("lang")).alias("text_norm"))


@query(LABELLED + "SELECT segment_id, label_errors::INTEGER AS errors, label_s::INTEGER AS s, label_d::INTEGER AS d, label_i::INTEGER AS i, label_wer AS wer FROM labelled")
def t5_edit_counts(spark, sf_dir):
    rows = pool.merged(spark, sf_dir).where("hyp_target is not null").withColumn("c", edit_counts(F.col("reference_norm"), F.col("hyp_target_norm")))
    return rows.select("segment_id", "c.errors", "c.s", "c.d", "c.i", "c.wer")


@query(LABELLED + "SELECT segment_id, label_errors::INTEGER AS errors FROM labelled")
def t5_word_errors(spark, sf_dir):
    rows = pool.merged(spark, sf_dir).where("hyp_target is not null")
    return rows.select("segment_id", word_errors(F.col("reference_norm"), F.col("hyp_target_norm")).alias("errors"))


@query(
    "WITH t AS (SELECT p_partkey, string_split(replace(p_name, ' ', ''), '') AS a, string_split(replace(p_type, ' ', ''), '') AS b FROM part) "
    f"SELECT p_partkey, ({edits('a', 'b')} // {1 << 42})::DOUBLE / len(a) AS cer FROM t"
)
def t6_char_error_rate(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", char_error_rate(F.col("p_name"), F.col("p_type")).alias("cer"))


@query(
    MERGED
    + f""", f AS (SELECT lang, w, list_transform(w, lambda x: strip_accents(replace(CASE WHEN lang = 'de' THEN
    replace(replace(replace(x, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue') ELSE x END, 'ß', 'ss'))) AS v FROM merged),
    g AS (SELECT lang, {edits("w", "v")} // {1 << 42} AS e, len(w) AS n FROM f)
    SELECT lang, sum(e)::DOUBLE / sum(n) AS wer_keep, 0.0::DOUBLE AS wer_strip,
        CASE WHEN sum(e)::DOUBLE / sum(n) > 0.005 THEN 'strip' ELSE 'keep' END AS verdict FROM g GROUP BY lang"""
)
def t8_accent_verdict(spark, sf_dir):
    """Were accents lost in a transcript, would stripping them pay? The hypothesis is the reference without accents."""
    rows = pool.records(spark, sf_dir).withColumn("hyp", strip_accents(F.col("reference_norm"), F.col("lang")))
    rows = rows.withColumn("hyp_stripped", strip_accents(F.col("hyp"), F.col("lang")))
    n = F.sum("n_ref_words")
    keep = F.sum(word_errors(F.col("reference_norm"), F.col("hyp"))) / n
    strip = F.sum(word_errors(F.col("hyp"), F.col("hyp_stripped"))) / n
    out = rows.groupBy("lang").agg(keep.alias("wer_keep"), strip.alias("wer_strip"))
    return out.withColumn("verdict", F.when(F.col("wer_keep") - F.col("wer_strip") > 0.005, "strip").otherwise("keep"))


@query(
    MERGED
    + """SELECT segment_id, concat('txt', substr(sha1(reference_norm), 1, 12)) AS text_group,
    ('0x' || substr(sha1(concat_ws('|', segment_id, condition)), 1, 8))::BIGINT AS seed, concat_ws('__', corpus, lang, condition) AS tag FROM merged"""
)
def p16_p19_p20_keys(spark, sf_dir):
    return pool.records(spark, sf_dir).select("segment_id", ids.text_group(F.col("reference_norm")).alias("text_group"), ids.stable_seed(F.col("segment_id"), F.col("condition")).alias("seed"), "tag")


@query("SELECT page_id, CASE WHEN regexp_matches(trim(x), '^[+-]?[0-9]+$') THEN x::INTEGER END AS value FROM (SELECT page_id, regexp_extract(url, '([0-9a-z]+)[^/]*$', 1) AS x FROM pages)")
def p1_as_int(spark, sf_dir):
    x = F.regexp_extract("url", "([0-9a-z]+)[^/]*$", 1)
    return _table(spark, sf_dir, "pages").select("page_id", ids.as_int(x).alias("value"))


@query(
    """SELECT l_orderkey, l_linenumber, c AS channel FROM (SELECT l_orderkey, l_linenumber,
    CASE WHEN l_suppkey % 3 > 0 AND l_linenumber - least(l_suppkey % 3, 2) BETWEEN 0 AND l_suppkey % 3 - 1 + 1 THEN l_linenumber - least(l_suppkey % 3, 2) END::INTEGER AS c FROM lineitem)"""
)
def p3_resolve_channel(spark, sf_dir):
    """Line numbers as channels of calls with l_suppkey % 3 + 1 channels that count from l_suppkey % 3 or 2."""
    n = (F.col("l_suppkey") % 3 + 1).cast("int")
    channel = ids.resolve_channel(F.col("l_linenumber").cast("string"), (F.col("l_suppkey") % 3).cast("string"), F.lit("2"), n)
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", channel.alias("channel"))


@query(
    MERGED
    + """SELECT segment_id, concat('pool::', segment_id) AS prefixed, concat_ws(',', CASE WHEN (conv_id * 7 + turn) % 29 = 0 THEN 'target' END,
    CASE WHEN (conv_id + turn) % 13 = 0 THEN 'proxy_b' END) AS missing FROM merged"""
)
def p12_p13_prefix_and_missing(spark, sf_dir):
    rows = ids.prefix_ids(pool.merged(spark, sf_dir), "pool")
    return rows.select(F.col("dataset_segment_id").alias("segment_id"), F.col("segment_id").alias("prefixed"), F.array_join(ids.missing_roles(*ROLES), ",").alias("missing"))


@query("SELECT doc_id, coalesce(nullif(trim(source), ''), nullif(trim(lang), '')) AS text, CASE WHEN trim(lang) <> '' THEN lang END AS session, nullif(lower(string_split(lang, '-')[1]), '') AS lang FROM documents")
def s11_s12_p21_picks(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", ids.pick_text(F.col("source"), F.col("lang")).alias("text"), ids.pick_session(F.col("lang")).alias("session"), ids.short_lang(F.col("lang")).alias("lang"))


@query("SELECT doc_id, concat('/audio/', doc_id, '.wav') AS wav_path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def s8_missing_files(spark, sf_dir):
    """Documents as records, labels as the files that are there."""
    path = F.concat(F.lit("/audio/"), "doc_id", F.lit(".wav"))
    records = _table(spark, sf_dir, "documents").select("doc_id", path.alias("wav_path"))
    return annotations.missing_files(records, _table(spark, sf_dir, "labels").select(path.alias("path"))).select("doc_id", "wav_path")


@query(
    """SELECT doc_id, index FROM (SELECT doc_id, n_chars, row_number() OVER () - 1 AS index FROM documents) WHERE n_chars >= 200
    ORDER BY index + 50 * (('0x' || substr(md5('7:' || index), 1, 8))::BIGINT / 4294967296.0), index LIMIT 100"""
)
def s7_first_rows(spark, sf_dir):
    """The first hundred documents of some length, as they come out of a seeded buffer of fifty over the order of the files."""
    docs = ordinals.with_index(_table(spark, sf_dir, "documents")).where("n_chars >= 200")
    return ordinals.first_rows(docs, 100, buffer=50, seed=7).select("doc_id", "index")


@query(
    """SELECT source AS corpus, lang, CASE WHEN n_chars % 2 = 0 THEN 'clean' ELSE 'noise' END AS condition, count(*) AS rows, true AS complete
    FROM documents GROUP BY 1, 2, 3"""
)
def k11_pack_manifest(spark, sf_dir):
    """Documents as a pool, packed by source, language and an imitated condition."""
    condition = F.when(F.col("n_chars") % 2 == 0, "clean").otherwise("noise")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("corpus"), "lang", condition.alias("condition"))
    held = versions.pack_pool(docs, shared_path(spark, "pack"))
    return held.select("corpus", "lang", "condition", "rows", ((F.col("files") > 0) & (F.col("bytes") > 0)).alias("complete"))


@query("SELECT doc_id, lang, NULL::VARCHAR AS url FROM documents UNION ALL SELECT page_id, NULL, url FROM pages")
def s17_load_pool(spark, sf_dir):
    """Tables whose columns differ as one."""
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
    return annotations.load_pool([_table(spark, sf_dir, "documents").select("doc_id", "lang"), pages])


# --- joins


@query(
    MERGED
    + """SELECT 'target' AS role, count(*) FILTER ((conv_id * 7 + turn) % 29 <> 0) AS n FROM merged UNION ALL SELECT 'proxy_a', count(*) FROM merged
    UNION ALL SELECT 'proxy_b', count(*) FILTER ((conv_id + turn) % 13 <> 0) FROM merged"""
)
def j1_merge_coverage(spark, sf_dir):
    return labels.coverage(pool.merged(spark, sf_dir))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j3_pending(spark, sf_dir):
    key = F.col("doc_id").alias("segment_id")
    todo = labels.pending(_table(spark, sf_dir, "documents").select(key), _table(spark, sf_dir, "labels").select(key))
    return todo.select(F.col("segment_id").alias("doc_id"))


@query(
    MERGED
    + "SELECT sample_id, concat('/calls/', any_value(conv_id % 5), '/', sample_id) AS call, 1::BIGINT AS n_dirs, count(*) AS n FROM merged GROUP BY sample_id"
)
def j5_call_mapping(spark, sf_dir):
    rows = pool.records(spark, sf_dir)
    mapping = labels.call_mapping(rows)
    regrouped = sinks.regroup(rows, mapping).groupBy("sample_id").agg(F.count("*").alias("n"))
    return mapping.join(regrouped.withColumnRenamed("sample_id", "call"), "call").select("sample_id", "call", "n_dirs", "n")


@query(
    LABELLED
    + f""", a AS (SELECT sample_id, {_WER} AS wer FROM labelled GROUP BY 1), b AS (SELECT sample_id, {_DURATION_WER} AS wer_ref FROM labelled GROUP BY 1)
    SELECT sample_id, wer, wer_ref FROM a JOIN b USING (sample_id)"""
)
def j6_estimated_with_true(spark, sf_dir):
    rows = pool.labelled(spark, sf_dir)
    a = rows.groupBy("sample_id").agg(summaries.weighted_wer().alias("wer"))
    b = rows.groupBy("sample_id").agg(summaries.ratio(F.sum(F.col("label_wer") * F.col("duration")), F.sum("duration")).alias("wer_ref"))
    return a.join(b, "sample_id")


@query("SELECT user_id AS segment_id, arg_max(event_type, (ts, event_id)) AS system, max(ts) AS ts FROM events GROUP BY 1")
def s5_last_wins(spark, sf_dir):
    lines = _table(spark, sf_dir, "events").select(F.col("user_id").alias("segment_id"), F.col("event_type").alias("system"), "ts", "event_id")
    return annotations.last_wins(lines, F.struct("ts", "event_id")).select("segment_id", "system", "ts")


@query("SELECT * FROM (SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3)")
def w6_first_per_group(spark, sf_dir):
    return annotations.first_per_group(_table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 3)


@query("SELECT lang AS tag, round(sum(n_chars) / 1e6, 3) AS mb, count(*) AS n FROM documents GROUP BY ROLLUP (lang)")
def k12_audio_usage(spark, sf_dir):
    return sinks.audio_usage(_table(spark, sf_dir, "documents").select(F.col("lang").alias("tag"), F.col("n_chars").alias("length")))


@query(MERGED + "SELECT NULL::VARCHAR AS audio_filepath, duration, 'asr' AS taskname, lang AS source_lang, lang AS target_lang, 'yes' AS pnc, reference AS answer, segment_id FROM merged")
def k2_manifest(spark, sf_dir):
    return sinks.manifest(pool.records(spark, sf_dir).withColumn("wav_path", F.lit(None).cast("string")))


# --- summaries


@query(LABELLED + f"SELECT count(*) AS n, sum(duration) / 3600 AS hours, {_WER} AS wer_weighted, avg(label_wer) AS wer_mean, {_DURATION_WER} AS wer_duration, {_ZERO} AS pct_zero FROM labelled")
def a1_corpus_summary(spark, sf_dir):
    return summaries.corpus_summary(pool.labelled(spark, sf_dir))


@query(LABELLED + f"SELECT corpus, condition, count(*) AS n, {_WER} AS wer_weighted, avg(label_wer) AS wer_mean, stddev_pop(label_wer) AS wer_std, {_ZERO} AS pct_zero FROM labelled GROUP BY 1, 2")
def a2_wer_by_condition(spark, sf_dir):
    return summaries.wer_by(pool.labelled(spark, sf_dir), "corpus", "condition")


@query(
    LABELLED
    + f""", p AS (SELECT *, abs(len(proxy_a) - len(target))::DOUBLE / greatest(len(proxy_a), 1) AS pwer_mean FROM labelled),
    r AS (SELECT *, {_RANK.format(k="corpus, condition", x="pwer_mean")} AS rx, {_RANK.format(k="corpus, condition", x="label_wer")} AS ry FROM p)
    SELECT corpus, condition, count(*) AS n, avg(CASE WHEN pwer_mean = 0 THEN 1.0 ELSE 0.0 END) AS pct_agree,
        avg(CASE WHEN pwer_mean = 0 AND label_wer > 0 THEN 1.0 ELSE 0.0 END) AS pct_blind,
        {_PEARSON.format(x="pwer_mean", y="label_wer")} AS pearson, {_PEARSON.format(x="rx", y="ry")} AS spearman FROM r GROUP BY 1, 2"""
)
def a3_proxy_blindness(spark, sf_dir):
    """With the difference of lengths in place of a proxy's rate."""
    rows = pool.labelled(spark, sf_dir)
    n = F.size(words(F.col("hyp_proxy_a_norm")))
    return summaries.proxy_blindness(rows.withColumn("pwer_mean", F.abs(n - F.col("n_hyp_words")) / F.greatest(n, F.lit(1))), "corpus", "condition")


@query(
    LABELLED
    + """, t AS (SELECT *, label_wer ** 2 AS sq, row_number() OVER (PARTITION BY corpus ORDER BY label_wer ** 2 DESC, segment_id)
        <= greatest(count(*) OVER (PARTITION BY corpus) // 100, 1) AS top FROM labelled)
    SELECT corpus, floor(quantile_cont(n_ref_words::DOUBLE, 0.05))::BIGINT AS words_p05, floor(quantile_cont(n_ref_words::DOUBLE, 0.5))::BIGINT AS words_median,
        avg(CASE WHEN n_ref_words < 5 THEN 1.0 ELSE 0.0 END) AS pct_short, max(label_wer) AS wer_max, quantile_cont(label_wer, 0.99) AS wer_p99,
        avg(CASE WHEN label_wer > 1 THEN 1.0 ELSE 0.0 END) AS pct_high, sum(sq) FILTER (top) / nullif(sum(sq), 0) AS top_share FROM t GROUP BY corpus"""
)
def a4_length_report(spark, sf_dir):
    return summaries.length_report(pool.labelled(spark, sf_dir), "corpus")


@query(
    MERGED
    + ", u AS ("
    + " UNION ALL ".join(f"SELECT '{r}' AS role, {r} IS NOT NULL AS has, CASE WHEN {r} IS NOT NULL THEN len(w) END AS n, CASE WHEN {r} IS NOT NULL THEN {edits('w', f'coalesce({r}, [])')} // {1 << 42} END AS e FROM merged" for r in ROLES)
    + ") SELECT role, sum(e)::DOUBLE / sum(n) AS wer, count(*) FILTER (has) AS n, avg(has::INTEGER) AS coverage FROM u GROUP BY role"
)
def a5_wer_by_system(spark, sf_dir):
    return summaries.wer_by_system(pool.merged(spark, sf_dir), ROLES)


@query(
    LABELLED
    + """, g AS (SELECT sample_id, count(*) AS n, avg(label_wer) AS m, var_pop(label_wer) AS v FROM labelled GROUP BY 1),
    t AS (SELECT count(*) AS sessions, sum(n)::BIGINT AS n, sum(n * m ** 2) / sum(n) - (sum(n * m) / sum(n)) ** 2 AS var_between, sum(n * v) / sum(n) AS var_within, avg(n) AS per_session FROM g)
    SELECT *, var_between / nullif(var_between + var_within, 0) AS icc FROM t"""
)
def a6_label_spread(spark, sf_dir):
    return summaries.label_spread(pool.labelled(spark, sf_dir))


@query(
    MERGED
    + """, s AS (SELECT sum(duration) AS seconds, count(*) AS c FROM merged GROUP BY sample_id)
    SELECT (SELECT count(*) FROM merged) AS n, (SELECT count(DISTINCT group_id) FROM merged) AS groups, (SELECT sum(duration) / 3600 FROM merged) AS hours,
    (SELECT avg(duration) FROM merged) AS mean_s, (SELECT max(duration) FROM merged) AS max_s, avg(seconds) / 60 AS session_minutes, max(c) AS session_max, count(*) AS sessions FROM s"""
)
def a7_structure_stats(spark, sf_dir):
    return summaries.structure_stats(pool.records(spark, sf_dir))


_CALLS = """, c AS (SELECT sample_id, sum(duration) AS duration, count(*) AS n, sum(label_wer * duration) / nullif(sum(duration), 0) AS wer_true,
    sum(pred * duration) / nullif(sum(duration), 0) AS wer_pred FROM predicted GROUP BY 1 HAVING sum(duration) > 0),
    calls AS (SELECT *, abs(wer_true - wer_pred) AS abs_error, abs(wer_true - wer_pred) / nullif(wer_true, 0) AS rel_error FROM c)"""


@query(PREDICTED + _CALLS + " SELECT * FROM calls")
def a8_call_metrics(spark, sf_dir):
    return summaries.call_metrics(_predicted(spark, sf_dir))


@query(PREDICTED + "SELECT sample_id, count(*) AS n_segments, sum(duration) AS duration, sum(pred * duration) / sum(duration) AS wer_estimate FROM predicted GROUP BY 1 HAVING sum(duration) > 0")
def a9_predict_calls(spark, sf_dir):
    return summaries.call_estimates(_predicted(spark, sf_dir))


@query(LABELLED + f"SELECT sample_id, count(*) AS n_segments, sum(duration) AS duration, sum(n_ref_words)::BIGINT AS n_words, sum(label_errors)::BIGINT AS n_errors, {_WER} AS wer_true, {_DURATION_WER} AS wer_true_duration FROM labelled GROUP BY 1")
def a12_true_wer(spark, sf_dir):
    return summaries.true_wer(pool.labelled(spark, sf_dir))


@query(
    MERGED
    + """, c AS (SELECT count(*) AS n, sum(duration) / 60 AS minutes FROM merged GROUP BY sample_id)
    SELECT count(*) AS calls, min(n) AS n_min, quantile_cont(n::DOUBLE, 0.5) AS n_median, max(n) AS n_max, min(minutes) AS minutes_min, quantile_cont(minutes, 0.5) AS minutes_median,
    max(minutes) AS minutes_max, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END)::BIGINT AS singletons FROM c"""
)
def a13_call_sizes(spark, sf_dir):
    return summaries.call_sizes(pool.records(spark, sf_dir))


@query(
    LABELLED
    + f""", c AS (SELECT corpus, sample_id, {_WER} AS wer FROM labelled GROUP BY 1, 2)
    SELECT coalesce(corpus, 'POOL') AS corpus, count(*) AS calls, avg(wer) AS wer_mean, stddev_pop(wer) AS wer_std FROM c GROUP BY GROUPING SETS ((corpus), ())"""
)
def a14_call_wer_by_dataset(spark, sf_dir):
    return summaries.call_wer_by_dataset(pool.labelled(spark, sf_dir))


@query(
    MERGED
    + """SELECT corpus, count(*) AS rows_in, count(*) FILTER (target IS NOT NULL AND proxy_b IS NOT NULL) AS rows_kept, count(*) FILTER (target IS NULL) AS missing_target,
    0::BIGINT AS missing_proxy_a, count(*) FILTER (proxy_b IS NULL) AS missing_proxy_b, count(DISTINCT sample_id) AS calls FROM merged GROUP BY 1"""
)
def a15_dataset_report(spark, sf_dir):
    return summaries.dataset_report(pool.merged(spark, sf_dir), ROLES)


@query("SELECT l_orderkey::VARCHAR AS segment_id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def a16_duplicate_ids(spark, sf_dir):
    return labels.duplicate_ids(_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("segment_id")))


@query(
    LABELLED
    + """, t AS (SELECT n_ref_words::DOUBLE / greatest(n_hyp_words, 1) AS r FROM labelled)
    SELECT avg(r) AS mean, quantile_cont(r, 0.5) AS median, quantile_cont(r, 0.1) AS p10, quantile_cont(r, 0.9) AS p90, avg(CASE WHEN abs(r - 1) <= 0.1 THEN 1.0 ELSE 0.0 END) AS within_10pct FROM t"""
)
def a18_denominator_bias(spark, sf_dir):
    return summaries.denominator_bias(pool.labelled(spark, sf_dir))


@query(
    MERGED
    + """SELECT count(*) AS n, count(DISTINCT sample_id) AS calls, sum(duration) / 3600 AS hours, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs,
    count(target) AS n_target, count(proxy_a) AS n_proxy_a, count(proxy_b) AS n_proxy_b FROM merged"""
)
def a19_status(spark, sf_dir):
    return summaries.status(pool.merged(spark, sf_dir), ROLES)


@query(PREDICTED + f"SELECT e AS estimated, t AS true, abs(e - t) AS gap FROM (SELECT sum(pred * greatest(n_hyp_words, 1)) / sum(greatest(n_hyp_words, 1)) AS e, {_WER} AS t FROM predicted)")
def a23_corpus_wer_gap(spark, sf_dir):
    return summaries.corpus_wer_gap(_predicted(spark, sf_dir))


# --- metrics


def _regression_sql(source: str, y: str, p: str, k: str) -> str:
    return f""", r AS (SELECT *, {_RANK.format(k=k, x=y)} AS ry, {_RANK.format(k=k, x=p)} AS rp FROM {source})
    SELECT {k}, count(*) AS n, avg(abs({p} - {y})) AS mae, sqrt(avg(({p} - {y}) ** 2)) AS rmse, 1 - sum(({p} - {y}) ** 2) / nullif(var_pop({y}) * count(*), 0) AS r2,
        avg(CASE WHEN {y} > 0.02 THEN abs({p} - {y}) / nullif({y}, 0) END) AS mape, sum(CASE WHEN {y} > 0.02 THEN 0 ELSE 1 END)::BIGINT AS mape_excluded, avg({p} - {y}) AS bias,
        {_PEARSON.format(x=y, y=p)} AS pearson, {_PEARSON.format(x="ry", y="rp")} AS spearman FROM r GROUP BY {k}"""


@query(PREDICTED + _regression_sql("predicted", "label_wer", "pred", "corpus"))
def m4_regression_metrics(spark, sf_dir):
    return metrics.regression_metrics(_predicted(spark, sf_dir), "label_wer", "pred", "corpus")


@query("WITH predicted AS (SELECT l_shipdate, l_returnflag, l_discount, l_tax FROM lineitem)" + _regression_sql("predicted", "l_discount", "l_tax", "l_returnflag"))
def m4_regression_metrics_lineitem(spark, sf_dir):
    """The same at volume: tax as an estimate of discount."""
    return metrics.regression_metrics(_table(spark, sf_dir, "lineitem"), "l_discount", "l_tax", "l_returnflag")


@query(PREDICTED + "SELECT condition, regr_slope(label_wer, pred) AS slope, regr_intercept(label_wer, pred) AS intercept FROM predicted GROUP BY 1")
def m15_calibration(spark, sf_dir):
    return metrics.calibration(_predicted(spark, sf_dir), "label_wer", "pred", "condition")


@query(
    PREDICTED
    + """, q AS (SELECT a.label_wer < b.label_wer AS up, a.label_wer > b.label_wer AS down, a.pred < b.pred AS pup, a.pred > b.pred AS pdown
        FROM predicted a JOIN predicted b ON a.segment_id < b.segment_id),
    s AS (SELECT count(*) FILTER (up AND pup OR down AND pdown) AS c, count(*) FILTER (up AND pdown OR down AND pup) AS d, count(*) FILTER ((up OR down) AND NOT pup AND NOT pdown) AS t,
        count(*) AS n0, count(*) FILTER (NOT up AND NOT down) AS ty, count(*) FILTER (NOT pup AND NOT pdown) AS tp FROM q)
    SELECT (c + 0.5 * t)::DOUBLE / nullif(c + d + t, 0) AS c_index, (c - d) / nullif(sqrt((n0 - ty)::DOUBLE * (n0 - tp)), 0) AS kendall_tau FROM s"""
)
def m3_m7_rank_agreement(spark, sf_dir):
    return metrics.rank_agreement(_predicted(spark, sf_dir), "label_wer", "pred")


@query(
    "SELECT n, mae, rmse, r2, bias, pearson, spearman, mape, mape_n, c_index, kendall_tau FROM (SELECT * EXCLUDE (mape, mape_excluded) FROM ("
    + PREDICTED
    + ", everything AS (SELECT *, 1 AS one FROM predicted)"
    + _regression_sql("everything", "label_wer", "pred", "one")
    + ")), ("
    + PREDICTED
    + "SELECT avg(CASE WHEN label_wer > 1e-9 THEN abs((pred - label_wer) / label_wer) END) AS mape, count(*) FILTER (label_wer > 1e-9) AS mape_n FROM predicted), ("
    + ORACLE_SQL["m3_m7_rank_agreement"]
    + ")"
)
def m5_extended_metrics(spark, sf_dir):
    return metrics.extended_metrics(_predicted(spark, sf_dir), "label_wer", "pred")


_BINARY = """, z AS (SELECT {k} AS k, ({y} > {t})::INTEGER AS t, ({p} > {t})::INTEGER AS q, {p} AS s FROM {src}),
    r AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY s) + (count(*) OVER (PARTITION BY k, s) - 1) / 2.0 AS rk FROM z),
    st AS (SELECT k, s, sum(t) AS pos, count(*) AS n FROM z GROUP BY 1, 2),
    ap AS (SELECT k, sum(pos * tp / a) / nullif(sum(pos), 0) AS ap FROM (SELECT k, pos::DOUBLE AS pos, sum(pos) OVER w AS tp, sum(n) OVER w AS a FROM st WINDOW w AS (PARTITION BY k ORDER BY s DESC)) GROUP BY k),
    b AS (SELECT k, count(*) AS n, avg(t) AS prevalence, count(*) FILTER (t = 1 AND q = 1)::DOUBLE AS tp, count(*) FILTER (t = 0 AND q = 1)::DOUBLE AS fp, count(*) FILTER (t = 1 AND q = 0)::DOUBLE AS fn,
        count(*) FILTER (t = 0 AND q = 0)::DOUBLE AS tn, sum(rk * t) AS ranks FROM r GROUP BY k)
    SELECT k AS {k}, n, prevalence, tp, fp, fn, tn, (ranks - (tp + fn) * (tp + fn + 1) / 2) / nullif((tp + fn) * (fp + tn), 0) AS roc_auc, coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
        coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, (tp / nullif(tp + fn, 0) + tn / nullif(fp + tn, 0)) / 2 AS balanced_accuracy,
        coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (fp + tn) * (tn + fn)), 0), 0) AS mcc, CASE WHEN tp + fn > 0 AND fp + tn > 0 THEN ap END AS pr_auc
    FROM b JOIN ap USING (k)"""


@query(PREDICTED + _BINARY.format(k="corpus", y="label_wer", p="pred", t=0.21, src="predicted"))
def m8_binary_metrics(spark, sf_dir):
    return metrics.binary_metrics(_predicted(spark, sf_dir), "label_wer", "pred", 0.21, "corpus")


@query("WITH d AS (SELECT source, toxic, (n_chars % 100) / 100.0 AS score FROM documents JOIN labels USING (doc_id))" + _BINARY.format(k="source", y="toxic", p="score", t=0.25, src="d"))
def m8_binary_metrics_labels(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id").withColumn("score", (F.col("n_chars") % 100) / 100.0)
    return metrics.binary_metrics(rows, "toxic", "score", 0.25, "source")


@query(
    PREDICTED
    + """, t AS (SELECT label_wer FROM predicted ORDER BY pred DESC, segment_id LIMIT 50), a AS (SELECT avg((label_wer > 0.21)::INTEGER) AS prevalence FROM predicted)
    SELECT (SELECT avg((label_wer > 0.21)::INTEGER) FROM t) AS precision, 50::BIGINT AS k, prevalence, (SELECT avg((label_wer > 0.21)::INTEGER) FROM t) / nullif(prevalence, 0) AS lift FROM a"""
)
def m9_precision_at_k(spark, sf_dir):
    return metrics.precision_at_k(_predicted(spark, sf_dir), "label_wer", "pred", 50, 0.21, "segment_id")


@query(
    PREDICTED
    + """, m AS (SELECT 'pwer' AS model, avg(abs(pred - label_wer)) AS mae FROM predicted UNION ALL SELECT 'mean', avg(abs(label_wer - (SELECT avg(label_wer) FROM labelled))) FROM predicted)
    SELECT model, mae, 1 - mae / nullif((SELECT mae FROM m WHERE model = 'pwer'), 0) AS gain FROM m"""
)
def m17_gain(spark, sf_dir):
    rows = _predicted(spark, sf_dir)
    mean = rows.agg(F.avg("label_wer").alias("mean"))
    both = rows.join(F.broadcast(mean), F.lit(True))
    models = F.explode(F.array(F.struct(F.lit("pwer").alias("model"), F.col("pred").alias("p")), F.struct(F.lit("mean").alias("model"), F.col("mean").alias("p"))))
    long = both.select("label_wer", models.alias("m")).groupBy(F.col("m.model").alias("model")).agg(F.avg(F.abs(F.col("m.p") - F.col("label_wer"))).alias("mae"))
    return metrics.gain(long)


@query(
    PREDICTED
    + """, u AS (SELECT least(1.5, 1.05 * max(label_wer)) AS upper FROM predicted)
    SELECT least(floor(label_wer / (upper / 40)), 39)::INTEGER AS bin, count(*) AS n, sum((label_wer > upper)::INTEGER)::BIGINT AS tail FROM predicted, u GROUP BY 1"""
)
def o7_histogram(spark, sf_dir):
    return summaries.histogram(_predicted(spark, sf_dir), "label_wer")


@query(PREDICTED + ", pooled AS (SELECT * FROM predicted UNION ALL SELECT * REPLACE ('POOL' AS corpus) FROM predicted)" + _regression_sql("pooled", "label_wer", "pred", "corpus"))
def a22_evaluate_by_dataset(spark, sf_dir):
    return reports.evaluate_by_dataset(_predicted(spark, sf_dir))


def _one_group(template: str, **kw) -> str:
    """A query by groups, over all rows as one: as a subquery without the group's column."""
    return "SELECT * EXCLUDE (one) FROM (WITH everything AS (SELECT *, 1 AS one FROM predicted)" + template.format(k="one", src="everything", **kw) + ")"


def _screening_sql(t: float) -> str:
    binary = _one_group(_BINARY, y="label_wer", p="pred", t=t)
    return f"""SELECT *, {t}::DOUBLE AS threshold FROM ({binary}) UNION ALL BY NAME
    SELECT avg((y > {t})::INTEGER) AS precision, k, any_value(prevalence) AS prevalence, avg((y > {t})::INTEGER) / nullif(any_value(prevalence), 0) AS lift, {t}::DOUBLE AS threshold FROM (
        SELECT k, prevalence, label_wer AS y FROM (SELECT DISTINCT unnest([round_even(0.05 * n, 0)::BIGINT, 50, bad]) AS k, n, bad / n AS prevalence
            FROM (SELECT count(*) AS n, count(*) FILTER (label_wer > {t}) AS bad FROM predicted)) ks
        JOIN (SELECT label_wer, row_number() OVER (ORDER BY pred DESC, segment_id) AS i FROM predicted) ON i <= k WHERE k BETWEEN 1 AND n) GROUP BY k"""


@query(PREDICTED + "SELECT * FROM (" + " UNION ALL BY NAME ".join(_screening_sql(t) for t in (0.2, 0.21)) + ")")
def m11_classification_report(spark, sf_dir):
    return reports.classification_report(_predicted(spark, sf_dir), "label_wer", "pred", [0.2, 0.21], [0.05, 50], "segment_id")


@query()
def v18_transfer_report(spark, sf_dir):
    return reports.transfer_report(_predicted(spark, sf_dir).withColumn("flat", F.lit(0.2)), ["pred", "flat"])


@query(
    PREDICTED
    + "SELECT * FROM (SELECT * FROM ("
    + "WITH everything AS (SELECT * FROM predicted)"
    + _regression_sql("everything", "label_wer", "pred", "corpus")
    + ")) JOIN (SELECT * EXCLUDE (n) FROM (WITH everything AS (SELECT * FROM predicted)"
    + _BINARY.format(k="corpus", y="label_wer", p="pred", t=0.21, src="everything")
    + ")) USING (corpus)"
)
def m12_full_report(spark, sf_dir):
    return bundles.full_report(_predicted(spark, sf_dir), "label_wer", "pred", 0.21, "corpus")


_SYSTEMS = ", u AS (" + " UNION ALL ".join(f"SELECT '{r}' AS role, {r} IS NOT NULL AS has, CASE WHEN {r} IS NOT NULL THEN len(w) END AS n, CASE WHEN {r} IS NOT NULL THEN {edits('w', f'coalesce({r}, [])')} // {1 << 42} END AS e FROM merged" for r in ROLES) + ")"


@query(
    LABELLED
    + _SYSTEMS
    + f""", s AS (SELECT role, (sum(e) / sum(n))::DOUBLE AS wer, count(*) FILTER (has)::DOUBLE AS n, avg(has::INTEGER)::DOUBLE AS coverage FROM u GROUP BY role),
    t AS (SELECT count(*)::DOUBLE AS n, (sum(duration) / 3600)::DOUBLE AS hours, {_WER}::DOUBLE AS wer_weighted, avg(label_wer)::DOUBLE AS wer_mean, {_DURATION_WER}::DOUBLE AS wer_duration, {_ZERO}::DOUBLE AS pct_zero FROM labelled),
    g AS (SELECT sample_id, count(*) AS n, avg(label_wer) AS m, var_pop(label_wer) AS v FROM labelled GROUP BY 1),
    d AS (SELECT count(*)::DOUBLE AS sessions, sum(n)::DOUBLE AS n, sum(n * m ** 2) / sum(n) - (sum(n * m) / sum(n)) ** 2 AS var_between, sum(n * v) / sum(n) AS var_within, avg(n) AS per_session FROM g),
    e AS (SELECT *, var_between / nullif(var_between + var_within, 0) AS icc FROM d)
    SELECT 'systems' AS section, concat(role, '.', name) AS name, value FROM (UNPIVOT s ON wer, n, coverage INTO NAME name VALUE value)
    UNION ALL SELECT 'target', name, value FROM (UNPIVOT t ON COLUMNS(*) INTO NAME name VALUE value)
    UNION ALL SELECT 'spread', name, value FROM (UNPIVOT e ON COLUMNS(*) INTO NAME name VALUE value)"""
)
def a20_pilot_report(spark, sf_dir):
    return bundles.pilot_report(labels.with_labels(pool.merged(spark, sf_dir)))


# --- features


@query(
    PREDICTED
    + """SELECT segment_id, coalesce(lag(pred) OVER o, pred) AS ctx_pwer_prev, coalesce(lead(pred) OVER o, pred) AS ctx_pwer_next, avg(pred) OVER (PARTITION BY sample_id) AS ctx_pwer_call,
    coalesce((row_number() OVER o - 1)::DOUBLE / nullif(count(*) OVER (PARTITION BY sample_id) - 1, 0), 0.0) AS ctx_position FROM predicted WINDOW o AS (PARTITION BY sample_id ORDER BY start_time, segment_id)"""
)
def f6_w9_call_context(spark, sf_dir):
    rows = with_call_context(_predicted(spark, sf_dir), "pred")
    return rows.select("segment_id", "ctx_pwer_prev", "ctx_pwer_next", "ctx_pwer_call", "ctx_position")


@query(
    LABELLED
    + """, x AS (SELECT segment_id, len(w) - 1 AS g, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS d, w, target, proxy_a FROM labelled)
    SELECT segment_id, CASE WHEN len(w) >= 2 THEN 1 - len(d)::DOUBLE / g ELSE 0 END AS repeated_bigrams,
        CASE WHEN len(target) > 0 THEN len(list_filter(target, lambda t: NOT list_contains(proxy_a, t)))::DOUBLE / len(target) ELSE 0 END AS orphan_words FROM x"""
)
def f4_f5_repeats_and_orphans(spark, sf_dir):
    rows = pool.labelled(spark, sf_dir)
    return rows.select("segment_id", repeated_ngram_ratio(F.col("reference_norm"), 2).alias("repeated_bigrams"), orphan_word_ratio(F.col("hyp_target_norm"), [F.col("hyp_proxy_a_norm")]).alias("orphan_words"))


def _one_byte(words: str) -> str:
    """Words without spaces; capitals, which normalised texts don't have, stand for letters of several bytes, as DuckDB counts bytes."""
    return f"translate(array_to_string({words}, ''), letters, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ!$%&()*+,-./:;<=>?@', 1, length(letters)))"


def _pwer(role: str) -> str:
    return f"CASE WHEN {role} IS NOT NULL THEN {edits(f'coalesce({role}, [])', 'target')} END AS c_{role}"


@query(
    MERGED
    + f""", c AS (SELECT *, {_pwer("proxy_a")}, {_pwer("proxy_b")} FROM merged WHERE target IS NOT NULL),
    wide AS (SELECT coalesce(string_agg(DISTINCT l, '' ORDER BY l), '') AS letters FROM (SELECT unnest(string_split(reference_norm, '')) AS l FROM merged) WHERE octet_length(encode(l)) > 1),
    e AS (SELECT segment_id, (c_proxy_a // {1 << 42})::DOUBLE / greatest(len(proxy_a), 1) AS a, (c_proxy_b // {1 << 42})::DOUBLE / greatest(len(proxy_b), 1) AS b,
        CASE WHEN len(proxy_a) > 0 THEN levenshtein({_one_byte("proxy_a")}, {_one_byte("target")})::DOUBLE / length(array_to_string(proxy_a, ''))
            WHEN len(target) > 0 THEN 1.0 ELSE 0.0 END AS cer,
        ((c_proxy_a // {1 << 21}) % {1 << 21})::DOUBLE / greatest(len(proxy_a), 1) AS psub, len(target) AS n, array_to_string(target, ' ') AS text, duration, target FROM c, wide)
    SELECT segment_id, coalesce(a, 0) AS pwer_proxy_a, coalesce(b, 0) AS pwer_proxy_b, psub AS psub_proxy_a, cer AS pcer_proxy_a,
        CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN (a + b) / 2 ELSE coalesce(a, b, 0) END AS pwer_mean, coalesce(greatest(a, b) - least(a, b), 0) AS pwer_spread, n / greatest(duration, 1e-6) AS words_per_second,
        CASE WHEN n > 0 THEN length(text)::DOUBLE / n ELSE 0 END AS chars_per_word, CASE WHEN n > 0 THEN len(list_distinct(target))::DOUBLE / n ELSE 0 END AS type_token_ratio, ln(1 + greatest(duration, 1e-6)) AS log_duration FROM e"""
)
def f1_f2_features(spark, sf_dir):
    names = ["pwer_proxy_a", "pwer_proxy_b", "psub_proxy_a", "pcer_proxy_a", "pwer_mean", "pwer_spread", "words_per_second", "chars_per_word", "type_token_ratio", "log_duration"]
    rows = build_features(pool.merged(spark, sf_dir).where("hyp_target is not null"), names=names)
    return rows.select("segment_id", *(f"features.{n}" for n in names))


# --- resampling, models


@query()
def m13_cluster_bootstrap(spark, sf_dir):
    return resample.cluster_bootstrap(_predicted(spark, sf_dir), "label_wer", "pred", "group_id")


@query()
def m14_paired_bootstrap(spark, sf_dir):
    rows = _predicted(spark, sf_dir).withColumn("flat", F.lit(0.2))
    return resample.paired_bootstrap(rows, "label_wer", "flat", "pred", "group_id")


@query()
def m7_concordance_sample(spark, sf_dir):
    return resample.concordance_sample(_predicted(spark, sf_dir), "label_wer", "pred", "segment_id")


@query(
    PREDICTED
    + """, a AS (SELECT count(*)::DOUBLE AS c FROM predicted GROUP BY label_wer), b AS (SELECT count(*)::DOUBLE AS c FROM predicted GROUP BY pred),
    x AS (SELECT sum(c) AS n, sum(c * (c - 1) / 2) AS t, sum(c * (c - 1) * (c - 2)) AS u, sum(c * (c - 1) * (2 * c + 5)) AS v FROM a),
    z AS (SELECT sum(c * (c - 1) / 2) AS t, sum(c * (c - 1) * (c - 2)) AS u, sum(c * (c - 1) * (2 * c + 5)) AS v FROM b)
    SELECT n::BIGINT AS n, x.t AS tied_y, z.t AS tied_pred, (n * (n - 1) * (2 * n + 5) - x.v - z.v) / 18 + 2 * x.t * z.t / (n * (n - 1)) + x.u * z.u / (9 * n * (n - 1) * (n - 2)) AS variance FROM x, z"""
)
def m16_kendall_variance(spark, sf_dir):
    return resample.kendall_variance(_predicted(spark, sf_dir), "label_wer", "pred")


@query()
def m14_compare_models(spark, sf_dir):
    """All pairs of models on the same segments, groups drawn instead of rows."""
    result = models.run_protocol(_complete(spark, sf_dir), "group", ("mean", "pwer", "ridge"))
    return resample.compare_models(written(result, "result"), n_boot=200)


@query()
def m16_call_significance(spark, sf_dir):
    return resample.call_significance(summaries.call_metrics(_predicted(spark, sf_dir)), margin=0.1)


def _complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.labelled(spark, sf_dir).where(ids.complete(*ROLES))


def _protocol(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return models.summarize(models.run_protocol(_complete(spark, sf_dir), name))

    return run


for _name in models.PROTOCOLS:
    QUERIES[f"v4_protocol_{_name}"] = _protocol(_name)


_PROTOCOLS = {"lodo": "corpus", "lolo": "lang", "loco": "condition"}
_RATE = "CASE WHEN len({p}) > 0 THEN (" + f"{edits('{p}', 'target')} // {1 << 42}" + ")::DOUBLE / len({p}) WHEN len(target) > 0 THEN 1.0 ELSE 0.0 END"
_BASELINES = (
    LABELLED
    + f", rates AS (SELECT *, ({_RATE.replace('{p}', 'proxy_a')} + {_RATE.replace('{p}', 'proxy_b')}) / 2 AS pwer FROM labelled WHERE proxy_b IS NOT NULL), out_of_fold AS ("
    + " UNION ALL ".join(
        f"""SELECT '{p}' AS protocol, 'pwer' AS model, label_wer AS y, least(greatest(pwer, 0.0), 2.0) AS pred FROM rates UNION ALL
        SELECT '{p}', 'mean', label_wer, least(greatest((sum(label_wer) OVER () - sum(label_wer) OVER (PARTITION BY {k})) / (count(*) OVER () - count(*) OVER (PARTITION BY {k})), 0.0), 2.0) FROM rates"""
        for p, k in _PROTOCOLS.items()
    )
    + ")"
    + _regression_sql("out_of_fold", "y", "pred", "protocol, model").replace("\n    SELECT", ", res AS (SELECT", 1)
    + ") SELECT *, 1 - mae / nullif((SELECT mae FROM res x WHERE x.protocol = res.protocol AND x.model = 'pwer'), 0) AS gain FROM res"
)


@query(_BASELINES)
def v21_evaluate_pool_baselines(spark, sf_dir):
    return bundles.evaluate_pool(_complete(spark, sf_dir), tuple(_PROTOCOLS), ("mean", "pwer"))


@query(
    LABELLED
    + f", rates AS (SELECT *, ({_RATE.replace('{p}', 'proxy_a')} + {_RATE.replace('{p}', 'proxy_b')}) / 2 AS pwer FROM labelled WHERE proxy_b IS NOT NULL), "
    + """out_of_fold AS (SELECT lang, 'pwer' AS model, label_wer AS y, least(greatest(pwer, 0.0), 2.0) AS pred FROM rates UNION ALL
        SELECT lang, 'mean', label_wer, least(greatest((sum(label_wer) OVER () - sum(label_wer) OVER (PARTITION BY corpus)) / (count(*) OVER () - count(*) OVER (PARTITION BY corpus)), 0.0), 2.0) FROM rates)"""
    + _regression_sql("out_of_fold", "y", "pred", "lang, model")
)
def a21_metrics_by_stratum_baselines(spark, sf_dir):
    return reports.metrics_by_stratum(models.run_protocol(_complete(spark, sf_dir), "lodo", ("mean", "pwer")), "lang")


_GROUPS = """, groups AS (SELECT group_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, group_id) AS i FROM labelled WHERE proxy_b IS NOT NULL GROUP BY group_id),
    deal AS (
        SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0]::BIGINT[] AS loads, NULL::VARCHAR AS group_id, 0::BIGINT AS n, 0 AS fold
        UNION ALL SELECT g.i, list_transform(loads, lambda x, j: CASE WHEN j = list_position(loads, list_min(loads)) THEN x + g.n ELSE x END), g.group_id, g.n, list_position(loads, list_min(loads)) - 1
        FROM deal JOIN groups g ON g.i = deal.i + 1),
    folds AS MATERIALIZED (SELECT group_id, n, fold::INTEGER AS fold FROM deal WHERE group_id IS NOT NULL)"""


@query(LABELLED.replace("WITH", "WITH RECURSIVE", 1) + _GROUPS + " SELECT group_id, n, fold FROM folds")
def v1_grouped_folds(spark, sf_dir):
    """The largest group left goes to the lightest of five folds."""
    return folds.deal_groups(_complete(spark, sf_dir), "group_id", 5).withColumnRenamed("part", "fold")


@query(
    LABELLED.replace("WITH", "WITH RECURSIVE", 1)
    + _GROUPS
    + f""", rates AS MATERIALIZED (SELECT *, ({_RATE.replace('{p}', 'proxy_a')} + {_RATE.replace('{p}', 'proxy_b')}) / 2 AS pwer FROM labelled JOIN folds USING (group_id) WHERE proxy_b IS NOT NULL),
    out_of_fold AS (
        SELECT 'pwer' AS model, label_wer AS y, least(greatest(pwer, 0.0), 2.0) AS pred FROM rates UNION ALL
        SELECT 'mean', label_wer, least(greatest((sum(label_wer) OVER () - sum(label_wer) OVER (PARTITION BY fold)) / (count(*) OVER () - count(*) OVER (PARTITION BY fold)), 0.0), 2.0) FROM rates)"""
    + _regression_sql("out_of_fold", "y", "pred", "model").replace("\n    SELECT", ", res AS (SELECT", 1)
    + ") SELECT *, 1 - mae / nullif((SELECT mae FROM res x WHERE x.model = 'pwer'), 0) AS gain FROM res"
)
def v4_protocol_group_baselines(spark, sf_dir):
    return models.summarize(models.run_protocol(_complete(spark, sf_dir), "group", ("mean", "pwer")))


@query(
    LABELLED
    + """, done AS (SELECT * FROM labelled WHERE proxy_b IS NOT NULL), guessed AS (
        SELECT segment_id, (sum(label_errors) OVER () - sum(label_errors) OVER (PARTITION BY corpus))::DOUBLE / (count(*) OVER () - count(*) OVER (PARTITION BY corpus)) AS e, label_wer, len(target) AS n FROM done)
    SELECT segment_id, e AS pred_errors, least(e / greatest(n, 1), 2.0) AS pred, label_wer AS y FROM guessed"""
)
def v3_errors_target(spark, sf_dir):
    """Errors in place of rates as what is learnt: the mean of the other corpora."""
    return models.run_protocol(_complete(spark, sf_dir), "lodo", ("mean",), target="errors").select("segment_id", "pred_errors", "pred", "y")


_GIVEN = {
    "feature_names": ["pwer_mean", "words_per_second"],
    "scaler_mean": [0.2, 2.0],
    "scaler_scale": [0.1, 0.5],
    "coef": [0.08, -0.01],
    "intercept": 0.25,
    "clip": [0.0, 2.0],
    "blocks": ["proxy", "text"],
}


@query(
    LABELLED
    + f", rates AS (SELECT *, ({_RATE.replace('{p}', 'proxy_a')} + {_RATE.replace('{p}', 'proxy_b')}) / 2 AS pwer FROM labelled WHERE proxy_b IS NOT NULL), "
    + """scored AS (SELECT *, least(greatest(0.25 + (pwer - 0.2) / 0.1 * 0.08 - (len(target) / greatest(duration, 1e-6) - 2.0) / 0.5 * 0.01, 0.0), 2.0) AS pred FROM rates)
    SELECT sample_id, count(*) AS n_segments, sum(duration) AS duration, sum(pred * duration) / sum(duration) AS wer_estimate FROM scored GROUP BY 1 HAVING sum(duration) > 0"""
)
def v17_apply_given_export(spark, sf_dir):
    """A linear export with given numbers, applied to segments and summed up by calls."""
    return summaries.call_estimates(models.apply_export(json.dumps(_GIVEN), _complete(spark, sf_dir)))


@query()
def v21_evaluate_pool(spark, sf_dir):
    return bundles.evaluate_pool(_complete(spark, sf_dir))


@query()
def v19_evaluate_bundle(spark, sf_dir):
    rows = written(_complete(spark, sf_dir), "labelled")
    return bundles.evaluate_bundle(bundles.fit_bundle(rows), rows, thresholds=(0.2, 0.3))


@query()
def v6_boosted_trees(spark, sf_dir):
    return models.summarize(models.run_protocol(_complete(spark, sf_dir), "loco", ("pwer", "hgb", "xgb")))


@query()
def v8_ablation(spark, sf_dir):
    return models.ablation(_complete(spark, sf_dir))


@query()
def v9_single_proxy_ablation(spark, sf_dir):
    return models.single_proxy_ablation(_complete(spark, sf_dir))


@query()
def v13_importance_comparison(spark, sf_dir):
    rows = _complete(spark, sf_dir)
    return reports.importance_comparison(models.permutation_importance(rows, n_repeats=1), models.tree_gains(rows))


@query()
def v10_permutation_importance(spark, sf_dir):
    return models.permutation_importance(_complete(spark, sf_dir), n_repeats=1)


@query()
def v11_ridge_coefficients(spark, sf_dir):
    return models.ridge_coefficients(_complete(spark, sf_dir))


@query()
def a21_metrics_by_stratum(spark, sf_dir):
    return reports.metrics_by_stratum(models.run_protocol(_complete(spark, sf_dir), "lodo", ("mean", "pwer", "ridge")), "lang")


@query()
def v12_partial_dependence(spark, sf_dir):
    return models.partial_dependence(_complete(spark, sf_dir), "pwer_mean")


@query()
def v17_export_and_apply(spark, sf_dir):
    rows = _complete(spark, sf_dir)
    return summaries.call_estimates(models.apply_export(models.ridge_export(rows), rows))


# --- streaming, signals


@query("SELECT user_id AS segment_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS system FROM (SELECT user_id, ts, event_id, event_type FROM events) GROUP BY 1")
def st_incremental_cache(spark, sf_dir):
    """Events as lines of a cache that arrive in files; the state after all batches."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet")  # a pattern may stand for a file or a folder
    lines = stream.select(F.col("user_id").alias("segment_id"), F.struct("ts", "event_id").alias("seq"), "event_id", F.col("event_type").alias("system"))
    cache = shared_path(spark, "cache")
    ingest.ingest(lines, cache, shared_path(spark, "progress"))
    ingest.merge(spark, cache)
    return ingest.state(spark, cache).select("segment_id", "event_id", "system")


@query(
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 4) AS s FROM embeddings),
    m AS (SELECT vec_id, s, list_max(list_transform(s, lambda x: abs(x))) AS top FROM e)
    SELECT vec_id, list_sum(CASE WHEN top > 0.95 THEN list_transform(s, lambda x: x * (0.95 / top)) ELSE s END) AS total,
        list_sum(list_transform(s, lambda x: trunc(least(greatest(x, -1.0), 1.0) * 32767)))::BIGINT AS pcm FROM m"""
)
def d1_peak_normalize(spark, sf_dir):
    """Embeddings as samples."""
    rows = _table(spark, sf_dir, "embeddings").withColumn("s", F.transform("embedding", lambda x: x.cast("double") * 4))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)
    return rows.select("vec_id", total(signal.peak_normalize(F.col("s"))).alias("total"), total(signal.to_pcm(F.col("s")).cast("array<double>")).cast("long").alias("pcm"))


@query(
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS s FROM embeddings),
    h AS (SELECT vec_id, list_transform(s, lambda x, i: x + CASE WHEN i > 5 THEN s[i - 5] * 0.5 ELSE 0 END) AS t, s FROM e),
    m AS (SELECT *, list_max(list_transform(t, lambda x: abs(x))) AS top FROM h)
    SELECT vec_id, list_sum(CASE WHEN top > 0.95 THEN list_transform(t, lambda x: x * (0.95 / top)) ELSE t END) AS echo, list_sum(s[11:30]) AS cut FROM m"""
)
def d5_echo_and_extract(spark, sf_dir):
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)
    s = F.col("embedding").cast("array<double>")
    return _table(spark, sf_dir, "embeddings").select("vec_id", total(signal.echo(s, 5, 0.5)).alias("echo"), total(signal.extract(s, 10, F.lit(1.0), F.lit(3.0))).alias("cut"))
