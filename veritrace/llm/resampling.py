"""Importance resampling towards a target: documents are drawn by how much likelier their n-grams are in the target's texts.

Weights come from hashed n-gram counts of both sides, an array of as many entries as there are buckets. Gumbel noise from a hash
of the id turns "the k highest scores" into a draw without replacement in proportion to the weights.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, numbered, texts_of, tidy, written

BUCKETS = 10_000
#: Bits of a key that one pass of the selection looks at.
DIGIT_BITS = 12
MIN_WORDS, PERCENT = 20, 25
_COUNTED = "doc_id long, n_words long, n_features long, buckets binary"


def _plain_bytes() -> bytes:
    """For bytes.translate: A-Z in lower case, and what is part of no word as spaces. All bytes from 0x80 on are parts of words."""
    kept = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
    low = [ord(chr(b).lower()) if chr(b) in UPPER else b for b in range(256)]
    return bytes(b if b in kept else 32 for b in low)


_PLAIN = _plain_bytes()


def feature_buckets(text: bytes, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words of a text, and the buckets of its words and of its pairs of neighbouring words: CRC-32 of the bytes modulo `buckets`."""
    words = text.translate(_PLAIN).split()
    singles = [zlib.crc32(w) for w in words]
    pairs = [zlib.crc32(b" " + w, c) for w, c in zip(words[1:], singles, strict=False)]
    return len(words), (np.array(singles + pairs, dtype=np.uint32) % np.uint32(buckets)).astype(np.uint16)


def count_features(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, buckets: little-endian unsigned 16-bit integers) for each row of docs (doc_id, text)."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are numbered in 16 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary() if pa.types.is_string(batch.column(1).type) else pa.large_binary())
            found = [feature_buckets(t.as_py() or b"", buckets) for t in texts]
            sizes = pa.array([n for n, _ in found], pa.int64()), pa.array([len(b) for _, b in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *sizes, pa.array([b.astype("<u2").tobytes() for _, b in found], pa.binary())], ["doc_id", "n_words", "n_features", "buckets"])

    return texts_of(docs).mapInArrow(tidy(run), _COUNTED)


def bucket_totals(counted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows: every task adds up its own, one row of `buckets` counts each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for b in batch.column(0):
                sums += np.bincount(np.frombuffer(b.as_py(), dtype="<u2"), minlength=buckets)
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums[held])], ["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in counted.select("buckets").mapInArrow(tidy(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of smoothed shares) of each bucket, one added to every count."""
    s, t, buckets = source.astype(float), target.astype(float), len(source)
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def add_weights(counted: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the mean gain of a row's features, rounded down; 0 without features."""
    shared = counted.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (np.frombuffer(b.as_py(), dtype="<u2") for b in batch.column(3))
            weights = [int(shared.value[b].sum()) // len(b) if len(b) else 0 for b in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weights, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return counted.mapInArrow(tidy(run), "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = 7) -> Column:
    """floor(-1000 * ln(-ln(u))), u from the first 32 bits of the SHA-256 of seed:doc_id; a null id counts as the text ''."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def kth_key(rows: DataFrame, keys: list[Column], k: int, digit_bits: int = DIGIT_BITS) -> list[int] | None:
    """The k-th least of the composite keys (columns of longs that are never null), exactly; None if k is 0 or there are fewer rows.

    A radix selection: the keys' digits are looked at from the highest on. A pass counts the rows with each value of a digit among those that
    share the digits found so far, and finds the value that holds the k-th row. A pass gives the driver 2^digit_bits counts at most; there
    are only as many passes as the spans of the keys need, and a key's span is taken among the rows that are still in question.
    """
    left, found = rows.select(*(c.alias(f"k{i}") for i, c in enumerate(keys))), []

    def digit_of_kth(digit: Column) -> int:
        nonlocal k
        for value, n in sorted((r.digit, r["count"]) for r in left.groupBy(digit.alias("digit")).count().collect()):
            if k <= n:
                return value
            k -= n
        raise AssertionError("fewer rows than were counted")

    for key in left.columns:
        low, high, n = left.agg(F.min(key), F.max(key), F.count("*")).first()
        if not 0 < k <= n:
            return None
        if high - low >= 1 << 63:  # the sign is a digit of its own, so that differences fit a long
            left = left.where(F.col(key) >= 0 if digit_of_kth((F.col(key) >= 0).cast("int")) else F.col(key) < 0)
            low, high = left.agg(F.min(key), F.max(key)).first()
        bits = (high - low).bit_length()
        while bits:
            width = min(digit_bits, bits)
            bits -= width
            # from here on low is where the rows in question begin
            low += digit_of_kth(F.shiftright(F.col(key) - low, bits)) << bits
            left = left.where(F.col(key).between(low, min(low + (1 << bits) - 1, high)))
        left = left.where(F.col(key) == low)
        found.append(low)
    return found


def _at_most(keys: list[Column], bound: list[int]) -> Column:
    """Whether a composite key is not above a bound."""
    out = F.lit(True)
    for key, b in reversed(list(zip(keys, bound, strict=True))):
        out = (key < b) | ((key == b) & out)
    return out


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = 7) -> DataFrame:
    """Draw percent of the documents of min_words words or more, towards the texts of target; a row for every row of docs.

    docs: doc_id, text; target: text; other columns are ignored. Returns doc_id, n_words, n_features (words and pairs of words), weight (mean gain of
    the features), score (weight and Gumbel noise) and rank: 1, 2, 3... by score, ties to the smaller id (null last); null for what isn't drawn.
    Rows that tie in score and id stand in any order, and exactly as many as are asked for are drawn. A null or empty text has no features:
    weight 0, never drawn unless min_words is 0. Without target texts the gains tell only how frequent features are. Empty tables give
    empty results.
    """
    counted = written(count_features(docs, buckets), "features")
    wanted = bucket_totals(count_features(target.select(F.lit(0).alias("doc_id"), "text"), buckets), buckets)
    gains = bucket_gains(bucket_totals(counted, buckets), wanted)
    scored = written(add_weights(counted, gains).withColumn("score", (F.col("weight") + gumbel(F.col("doc_id"), seed)).cast("long")), "scored")

    able = scored.where(F.col("n_words") >= min_words)
    wanted_rows = able.count() * percent // 100
    keys = [-F.col("score"), F.col("doc_id").isNull().cast("long"), F.coalesce("doc_id", F.lit(0).cast("long"))]
    last = kth_key(able, keys, wanted_rows)
    unranked = F.lit(None).cast("long")
    if last is None:
        return scored.withColumn("rank", unranked)
    drawn = (F.col("n_words") >= min_words) & _at_most(keys, last)
    ranked = numbered(scored.where(drawn), [], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "place", "drawn")
    rank = F.when(F.col("place") < wanted_rows, F.col("place") + 1)  # more rows than wanted share the last key
    return ranked.withColumn("rank", rank).drop("place").unionByName(scored.where(~drawn).withColumn("rank", unranked))
