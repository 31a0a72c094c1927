"""Toxicity scores: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, _IS_WORD, _VALUES, discard, give_back, hash_sample, mix, small_batches, text_chunks, texts_of, tidy, written

#: Character n-grams (of UTF-8 bytes, A-Z lower-cased) of these lengths are features.
LENGTHS = (4, 5, 6)
BUCKETS = 1 << 20
#: Labelled rows that weights are fitted on at once, about: first those with the least hash of their id, then every part of all rows.
TRAIN_ROWS = 8000
#: Up to so many labels (12 MB) are sent to every executor; beyond that the texts are shuffled to them.
BROADCAST_LABELS = 1_000_000
#: A feature needs so many training texts that have it, and a log-count ratio of this size.
MIN_TEXTS, MIN_RATIO = 8, 1.0
SMOOTHING = 0.5
L2, STEPS = 1.0, 150
FIT_TEXTS = 500
#: Bytes of features that the driver fits weights on, at most; a part has a quarter of that, about.
FIT_BYTES = 256 << 20
#: Changes of weights are added as whole numbers of this unit: sums are the same in every order.
_UNIT = 2.0**-30
_MULTIPLIER = U64(0x9E3779B97F4A7C15)


def _features(offsets: np.ndarray, data: np.ndarray, useful: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the distinct n-grams of each text of a chunk, sorted; useful: mask of the buckets wanted.

    An n-gram has white space at its ends only, never inside, and all white space counts the same.
    """
    space = ~_IS_WORD[data]
    values = np.where(space, _VALUES[32], _VALUES[data])
    owner_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = np.zeros(len(data) + 1, dtype=np.int32)
    np.cumsum(space, out=inside[1:])
    found = []
    for n in LENGTHS:
        size = len(data) - n + 1
        if size <= 0:
            continue
        h = np.full(size, n, dtype=U64)
        for i in range(n):
            h = h * _MULTIPLIER + values[i : size + i]
        bucket = (mix(h) >> U64(44)).astype(np.int64)
        ok = (inside[n - 1 : size + n - 1] == inside[1 : size + 1]) & (owner_of[:size] == owner_of[n - 1 :])
        if useful is not None:
            ok &= useful[bucket]
        at = np.flatnonzero(ok)
        found.append(owner_of[at] * BUCKETS + bucket[at])
    keys = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    return keys // BUCKETS, keys % BUCKETS


@dataclass
class Model:
    """score = 1 / (1 + exp(-(bias + sum of weights of the distinct n-grams)))."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(BUCKETS, dtype=np.float64)
        out[self.buckets] = self.weights
        return out


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, BUCKETS), dtype=np.int32)
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        for row, offsets, data in text_chunks(batch.column("text")):
            owner, bucket = _features(offsets, data)
            for y in (0, 1):
                counts[y] += np.bincount(bucket[toxic[row + owner] == y], minlength=BUCKETS).astype(np.int32)
    seen = np.flatnonzero(counts.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[1][seen].astype(np.int64)), pa.array(counts[0][seen].astype(np.int64))], ["bucket", "toxic", "clean"])


def log_count_ratios(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Of each feature: log of its share of toxic texts by its share of clean ones, both smoothed."""
    return np.log((toxic + SMOOTHING) / (n_toxic + 2 * SMOOTHING)) - np.log((clean + SMOOTHING) / (n_clean + 2 * SMOOTHING))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learn from all labelled texts.

    docs: doc_id, text. labels: doc_id, toxic (0 or 1). Null ids and labels are ignored; an id
    with several labels is toxic if one says so; of an id with several texts the one of least hash counts, once. Ids without a
    text don't count. N-grams of all labelled texts are counted. The weights are first fitted on the driver, on as many of the `rows` texts with the least
    hash of their id, in that order, as have FIT_BYTES of features together (4 bytes for each distinct one of a text, whatever its length). If there are more,
    all labelled texts are dealt by hash into parts of about `rows` texts; the fit goes on from there on each part, in a task of its own, and the parts' changes
    are averaged by their texts: every labelled text is fitted on, and no process holds more than a part. Without both kinds of label, the model has no features and its bias is the smoothed share of toxic labels.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).cast("long").alias("toxic"))
    known = written(known, "known")
    texts = texts_of(docs).fillna("", ["text"]).join(F.broadcast(known) if known.count() <= BROADCAST_LABELS else known, "doc_id")
    if texts.count() > texts.select("doc_id").distinct().count():  # ids repeat: the texts are gathered by id
        least = F.min_by("text", F.xxhash64("text")).alias("text")
        texts = written(texts.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), least), "labelled")
    n_toxic, n_clean = texts.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in (F.col("toxic"), 1 - F.col("toxic")))).first()
    share = (n_toxic + SMOOTHING) / (n_toxic + n_clean + 2 * SMOOTHING)
    bias = float(np.log(share / (1 - share)))
    featureless = Model(np.empty(0, np.int64), np.empty(0), bias)
    if not n_toxic or not n_clean:
        discard(known, texts)
        return featureless
    log_share = lambda c, n: F.log((F.col(c) + SMOOTHING) / (n + 2 * SMOOTHING))
    counts = (
        texts.mapInArrow(tidy(_count_features), "bucket long, toxic long, clean long")
        .groupBy("bucket")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where((F.col("toxic") + F.col("clean") >= MIN_TEXTS) & (F.abs(log_share("toxic", n_toxic) - log_share("clean", n_clean)) >= MIN_RATIO - 1e-6))
        .toArrow()  # one row for each of BUCKETS at most
        .sort_by("bucket")
    )
    buckets, toxic, clean = (c.to_numpy() for c in counts.columns)
    ratio = log_count_ratios(toxic, clean, n_toxic, n_clean)
    wanted = np.abs(ratio) >= MIN_RATIO
    buckets, ratio = buckets[wanted], ratio[wanted]
    if not len(buckets):
        discard(known, texts)
        return featureless
    mask = np.zeros(BUCKETS, dtype=bool)
    mask[buckets] = True
    shared = spark.sparkContext.broadcast(mask)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, offsets, data in text_chunks(batch.column("text")):
                n = len(offsets) - 1
                owner, bucket = _features(offsets, data, shared.value)
                cuts = np.searchsorted(owner, np.arange(1, n))
                lists = [x.astype("<i4").tobytes() for x in np.split(bucket, cuts)] if n else []
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[row : row + n], batch.column("toxic")[row : row + n], pa.array(lists, pa.binary())], ["doc_id", "toxic", "features"])

    found = written(texts.mapInArrow(rows_of, "doc_id long, toxic long, features binary"), "features")
    n, size = found.agg(F.count("*"), F.sum(F.octet_length("features"))).first()
    in_order = Window.orderBy(F.xxhash64("doc_id", F.lit(42)), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # `rows` rows at most
    first = hash_sample(found.select("doc_id", F.octet_length("features").alias("size")), n, rows, "doc_id")
    within = first.select("doc_id", F.sum("size").over(in_order).alias("bytes")).where(F.col("bytes") <= FIT_BYTES)
    table = found.join(F.broadcast(within.select("doc_id")), "doc_id").select("toxic", "features").toPandas()
    shared.unpersist()
    position = np.zeros(BUCKETS, dtype=np.int32)
    position[buckets] = np.arange(len(buckets))
    fitted = len(table)
    weights, bias = _fit(*_as_lists(table.toxic.to_numpy(dtype=np.float64), list(map(bytes, table.features)), position), ratio, bias)
    del table
    if fitted < n:
        parts = max(-(-n // rows), -(-4 * size // FIT_BYTES))
        weights, bias = _fit_parts(found, n, parts, position, ratio, weights, bias)
    discard(known, texts, found)
    give_back()
    return Model(buckets, weights, bias)


def _as_lists(toxic: np.ndarray, features: list[bytes], position: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The places of each text's features, and what it is; in an order of their own, so that sums come in the same order in every run."""
    order = sorted(range(len(features)), key=lambda i: (toxic[i], features[i]))
    return [position[np.frombuffer(features[i], "<i4")] for i in order], toxic[order]


def _fit_parts(found: DataFrame, n: int, parts: int, position: np.ndarray, ratio: np.ndarray, weights: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
    """The fit goes on from `weights` on each part of all texts; the mean of its changes. A part tells those of the features it has, and of the bias (-1)."""
    spark = found.sparkSession
    shared = spark.sparkContext.broadcast((position, ratio, weights / ratio, bias))

    def run(part: pa.Table) -> pa.Table:
        position, ratio, start, start_bias = shared.value
        lists, y = _as_lists(part.column("toxic").to_numpy().astype(np.float64), part.column("features").to_pylist(), position)
        own, own_bias = _descend(lists, y, ratio, start, start_bias)
        has = np.unique(np.concatenate(lists))
        change = np.append((own - start)[has], own_bias - start_bias) * len(y)
        give_back()
        return pa.table({"place": np.append(has, -1).astype(np.int64), "change": np.rint(change / _UNIT).astype(np.int64)})

    dealt = found.select("toxic", "features", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(parts)).alias("part"))
    changes = dealt.groupBy("part").applyInArrow(run, "place long, change long").groupBy("place").agg(F.sum("change").alias("change")).toArrow()  # one row for each of BUCKETS at most
    shared.destroy()
    place, change = changes.column("place").to_numpy(), changes.column("change").to_numpy() * _UNIT / n
    told = place >= 0
    weights = weights.copy()
    weights[place[told]] += change[told] * ratio[place[told]]
    return weights, bias + float(change[~told].sum())


def _fit(lists: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression on features scaled by their ratios, from 0: the weights of the features as they are, and the bias."""
    w, b = _descend(lists, y, ratio, np.zeros(len(ratio)), bias)
    return w * ratio, b


def _descend(lists: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent from weights of the scaled features.

    Texts are taken FIT_TEXTS at a time, so that beside the features little is held.
    """
    parts = []
    for a in range(0, len(lists), FIT_TEXTS):
        part = lists[a : a + FIT_TEXTS]
        parts.append((a, len(part), np.concatenate(part), np.array([len(x) for x in part])))

    def along(weights: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(np.repeat(np.arange(n), sizes), weights=weights[columns], minlength=n) for _, n, columns, sizes in parts])

    def back(errors: np.ndarray) -> np.ndarray:
        return sum(np.bincount(columns, weights=np.repeat(errors[a : a + n], sizes), minlength=len(ratio)) for a, n, columns, sizes in parts)

    rate = 1 / (0.25 * np.percentile(along(ratio**2), 99) + 0.25 + L2 / len(lists))
    last, last_b = w, b
    for t in range(1, STEPS + 1):
        momentum = (t - 1) / (t + 2)
        at, at_b = w + momentum * (w - last), b + momentum * (b - last_b)
        error = (1 / (1 + np.exp(-np.clip(at_b + along(at * ratio), -30, 30))) - y) / len(lists)
        last, last_b = w, b
        w = at - rate * (back(error) * ratio + L2 / len(lists) * at)
        b = at_b - rate * error.sum()
    return w, float(b)


def _scores(model: Model, weights: np.ndarray, texts: pa.Array) -> np.ndarray:
    useful, out = weights != 0, []
    for _, offsets, data in text_chunks(texts):
        owner, bucket = _features(offsets, data, useful)
        out.append(model.bias + np.bincount(owner, weights=weights[bucket], minlength=len(offsets) - 1))
    z = np.concatenate(out) if out else np.empty(0)
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Score every text: doc_id, score (0 to 1), predicted (1 if score >= 0.5).

    Null and empty texts get the score of a text without features. Every input row gives one row;
    the whole text is read; other columns than doc_id and text are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value.table()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(shared.value, weights, batch.column("text")))], ["doc_id", "score"])

    rows = texts_of(docs)
    scored = rows.mapInArrow(tidy(run), "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose text scores below 0.5, with all their columns; null and empty texts count as in `score`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value.table()
        for batch in batches:
            yield batch.filter(pa.array(_scores(shared.value, weights, batch.column(at)) < 0.5))

    return docs.mapInArrow(tidy(run), docs.schema)
