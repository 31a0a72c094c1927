"""The queries op1_ to op13_ over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_model, toxicity, url_filters
from .common import doc_remainder, shared_path
from .decontamination import find_leaks
from .filter_audit import filter_audit
from .hamming_search import hamming_top_k
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .resampling import resample
from .sharding import Tree, shard_rows, text_crc32, text_size
from .substring_dedup import repeated_passages
from .token_counts import token_counts, word_piece_vocabulary
from .token_files import read_token_files, write_token_files



def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=2)


def op2_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return hamming_top_k(vectors, vectors.where("vec_id % 50 = 0"), k=10)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), word_piece_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = doc_remainder(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs, _table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filters.train(url_filters.labelled_urls(spark))
    return url_filters.judge_urls(_table(spark, sf_dir, "pages"), model)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_path(spark, "tokens")
    manifest = write_token_files(_table(spark, sf_dir, "documents"), out, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(manifest, out)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = doc_remainder(F.col("doc_id"), 10) == 0
    model = language_model.train(docs.where(~held_out))
    scored = language_model.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_rows(_table(spark, sf_dir, "documents"), Tree.of(40))
    text = F.col("doc.text")
    return rows.select("doc.doc_id", text_size(text).alias("size"), text_crc32(text).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_hamming_top_k": op2_hamming_top_k,
    "op3_token_counts": op3_token_counts,
    "op4_toxicity": op4_toxicity,
    "op5_decontamination": op5_decontamination,
    "op6_url_filters": op6_url_filters,
    "op7_token_files": op7_token_files,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_mixing": op9_mixing,
    "op10_language_model": op10_language_model,
    "op11_filter_audit": op11_filter_audit,
    "op12_sharding": op12_sharding,
    "op13_resampling": op13_resampling,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _crc32_sql(octets: str) -> str:
    """Unsigned CRC-32, by half bytes, of bytes that a column holds in hexadecimal digits."""
    table = list(range(16))
    for _ in range(4):
        table = [c >> 1 ^ (0xEDB88320 if c & 1 else 0) for c in table]
    digits = f"list_transform(range(len({octets})), lambda i: ('0x' || {octets}[2 * (i // 2) + 2 - i % 2])::BIGINT)"
    return f"xor(4294967295, list_reduce([4294967295] || {digits}, lambda c, x: xor(xor(c, x) >> 4, {table}[(xor(c, x) & 15) + 1])))"


def _draws_sql(level: str, names: str, below: str, weight: str) -> str:
    """The child with the least draw: names of a level's nodes for each row of `below` (key, ...), by a hash of node and key."""
    u = f"((('0x' || substr(md5('7:' || n.name || ':' || b.key), 1, 12))::BIGINT + 0.5) / 281474976710656)"
    return f"SELECT b.*, n.i AS {level} FROM {below} b, {names} n QUALIFY row_number() OVER (PARTITION BY b.key ORDER BY -ln({u}) / {weight}, n.name) = 1"


ORACLE_SQL = {
    "op1_minhash_near_dedup": rf"""
        WITH RECURSIVE words AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w
                ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
            FROM words WHERE len(w) > 0),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        pairs AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
            FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (
            SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
            WHERE 100 * c >= 80 * (p.n + q.n - c)),
        arcs AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach(node, other) AS (
            SELECT doc_id, doc_id FROM documents
            UNION SELECT r.node, b.y FROM reach r JOIN arcs b ON b.x = r.other)
        SELECT d.doc_id, CAST(coalesce(any_value(s.n), 0) AS BIGINT) AS n_shingles,
            min(r.other) AS component_id, d.doc_id = min(r.other) AS kept
        FROM documents d JOIN reach r ON r.node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
        GROUP BY d.doc_id
    """,
    "op2_hamming_top_k": """
        WITH pairs AS (
            SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(range(1, 65),
                lambda i: CASE WHEN (q.embedding[i] > 0) <> (v.embedding[i] > 0) THEN 1 ELSE 0 END)) AS INTEGER) AS distance
            FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM pairs)
        SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
    """,
    "op11_filter_audit": rf"""
        WITH words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
        firsts AS (SELECT t, min(doc_id) AS first FROM words GROUP BY t),
        marks AS (SELECT doc_id, coalesce(max(CASE WHEN quality = 1 THEN 1 END), 0) AS good, coalesce(max(CASE WHEN toxic = 1 THEN 1 END), 0) AS toxic FROM labels GROUP BY doc_id),
        judged AS (
            SELECT part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
                (CASE WHEN len(w) < 100 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END)
                || (CASE WHEN 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(t) THEN 'C' ELSE '' END)
                || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN doc_id > first THEN 'E' ELSE '' END) AS fails
            FROM words JOIN firsts USING (t) LEFT JOIN marks m USING (doc_id)),
        counts AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY ALL),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
        orders AS (
            SELECT a.l || b.l || c.l || d.l || e.l AS o FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
        gone AS (
            SELECT part, o, n, good, toxic, fails, list_position(list_transform(range(1, 6), lambda i: contains(fails, o[i])), true) AS place FROM counts, orders),
        steps AS (
            SELECT g.part, o AS filter_order, step, sum(CASE WHEN place > step OR place IS NULL THEN n ELSE 0 END) AS kept,
                sum(CASE WHEN place = step THEN n ELSE 0 END) AS removed,
                sum(CASE WHEN place < step AND contains(fails, o[step]) THEN n ELSE 0 END) AS redundant,
                sum(CASE WHEN fails = o[step] THEN n ELSE 0 END) AS unique_fails,
                sum(CASE WHEN place = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN place = step THEN toxic ELSE 0 END) AS toxic_lost
            FROM gone g, (SELECT unnest(range(1, 6)) AS step) GROUP BY ALL)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
            CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
            CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley
        FROM steps
    """,
    "op12_sharding": f"""
        WITH keys AS (SELECT DISTINCT coalesce(doc_id::VARCHAR, '') AS key FROM documents),
        regions AS (SELECT 'region' || i AS name, i, 10.0 AS weight FROM range(4) r(i)),
        grown AS (FROM regions UNION ALL SELECT 'grown40', 4, 1.0),
        racks AS (SELECT 'rack' || i AS name, i FROM range(8) r(i)),
        shards AS (SELECT 's' || i AS name, i FROM range(40) r(i)),
        in_region AS ({_draws_sql("region", "regions", "keys", "n.weight")}),
        in_rack AS ({_draws_sql("rack", "racks", "in_region", "5.0").replace("n QUALIFY", "n WHERE n.i // 2 = b.region QUALIFY")}),
        in_shard AS ({_draws_sql("shard", "shards", "in_rack", "1.0").replace("n QUALIFY", "n WHERE n.i // 5 = b.rack QUALIFY")}),
        after AS ({_draws_sql("region", "grown", "keys", "n.weight")}),
        placed AS (
            SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 16 AS BIGINT) AS size, CAST({_crc32_sql("h")} AS BIGINT) AS text_crc32,
                CAST(s.shard AS INTEGER) AS shard, CAST(CASE WHEN a.region = 4 THEN 40 ELSE s.shard END AS INTEGER) AS grown_shard
            FROM (SELECT doc_id, text, hex(encode(coalesce(text, ''))) AS h FROM documents) d JOIN in_shard s ON s.key = coalesce(d.doc_id::VARCHAR, '') JOIN after a ON a.key = s.key)
        SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32) - 1 AS slot, grown_shard
        FROM placed
    """,
    "op13_resampling": rf"""
        WITH texts AS (
            SELECT doc_id, false AS wanted, row_number() OVER () AS r, text FROM documents
            UNION ALL SELECT NULL, true, -row_number() OVER (), text FROM benchmark),
        words AS (SELECT doc_id, wanted, r, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
        features AS (
            SELECT r, wanted, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM words),
        hashed AS (SELECT f, {_crc32_sql("h")} % 10000 AS bucket FROM (SELECT DISTINCT f, hex(encode(f)) AS h FROM features)),
        buckets AS (
            SELECT bucket, count(*) FILTER (wanted)::DOUBLE AS t, count(*) FILTER (NOT wanted)::DOUBLE AS s FROM features JOIN hashed USING (f) GROUP BY bucket),
        gains AS (
            SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS gain FROM buckets),
        weights AS (SELECT r, count(*) AS n, floor(sum(gain) / count(*)) AS weight FROM features JOIN hashed USING (f) JOIN gains USING (bucket) WHERE NOT wanted GROUP BY r),
        scored AS (
            SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296))) AS BIGINT) AS score
            FROM words LEFT JOIN weights USING (r) WHERE NOT wanted),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place FROM scored)
        SELECT doc_id, n_features, weight, score,
            CASE WHEN n_words >= 20 AND place <= (SELECT 25 * count(*) // 100 FROM scored WHERE n_words >= 20) THEN place END AS rank
        FROM ranked
    """,
}
