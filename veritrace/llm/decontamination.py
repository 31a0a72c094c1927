"""Benchmark decontamination by latent semantic retrieval and longest-common-subsequence checks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, give_back, hash_sample, hash_words, text_chunks, texts_of, tidy, written

#: Words that are no term of an item are told apart by so many bits of their hash first.
_BITS = 20
#: Benchmark items are searched in blocks of about so many.
ITEMS_PER_BLOCK = 2_000
#: The decomposition is fitted on the items and on passages of so many documents of at most so many bytes (least hash of id and size first).
FIT_DOCS, FIT_BYTES, FIT_WORDS = 400, 16_384, 40
RANK, OVERSAMPLE, POWER_STEPS = 256, 8, 2
#: A passage is a candidate for an item from this latent cosine on.
MIN_COSINE = 0.2
#: Passages that are set against the items together.
BLOCK = 64
#: An item is leaked if a passage has this share of its words in order, or the lesser share and its answer.
LCS, LCS_WITH_ANSWER = 0.8, 0.6
#: An item's answer: its last sentence, its last third where that is more than half of it, or its last words where either is shorter.
ANSWER_WORDS = 5

#: Words are runs of letters and digits (and of any byte beyond ASCII).
WORD_BYTES = np.zeros(256, dtype=bool)
WORD_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Terms:
    """Places of words in a sorted table of hashes: 1 for the first, 0 for a word that is not in it."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.maybe = np.zeros(1 << _BITS, dtype=bool)
        self.maybe[keys >> U64(64 - _BITS)] = True

    def rows(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), dtype=np.int32)
        at = np.flatnonzero(self.maybe[words >> U64(64 - _BITS)])
        place = np.searchsorted(self.keys, words[at])
        place[place == len(self.keys)] = 0
        hit = self.keys[place] == words[at] if len(self.keys) else np.zeros(0, dtype=bool)
        out[at[hit]] = place[hit] + 1
        return out


def _width(n: int) -> int:
    """The least passage width of the scale that holds n words at a stride of an eighth, wherever they begin."""
    width = 8
    while width - max(1, width // 8) + 1 < n:
        width = max(width + 1, width * 5 // 4)
    return width


@dataclass
class Item:
    item_id: int
    words: np.ndarray
    answer: np.ndarray


@dataclass
class Group:
    """The items of one passage width, and what they have in common."""

    width: int
    members: np.ndarray
    rare_starts: np.ndarray  # of each row's items that have its word among their rarer ones
    rare_holders: np.ndarray  # members' numbers
    least: np.ndarray  # words that a leak of each member has of its rarer ones, at least
    starts: np.ndarray  # of each row's items
    holders: np.ndarray  # members' numbers
    counts: np.ndarray  # how often they have the row's word


@dataclass
class Index:
    """What every worker needs to look for a block of items: a few thousand items at most."""

    items: list[Item]
    terms: Terms
    latent: np.ndarray  # a vector for each row of the terms; 0: no term
    vectors: np.ndarray  # of the items, of length 1
    groups: list[Group]


def _items(rows: list) -> list[Item]:
    out = []
    for r in rows:
        data = np.frombuffer((r.text or "").encode(), dtype=np.uint8)
        words, _ = hash_words(np.array([0, len(data)]), data, WORD_BYTES)
        if r.item_id is None or not len(words):
            continue
        stem = (r.text or "").rstrip(" \t\r\n.!?")
        tail = stem[max(stem.rfind(c) for c in ".!?\n") + 1 :].encode()
        last, _ = hash_words(np.array([0, len(tail)]), np.frombuffer(tail, dtype=np.uint8), WORD_BYTES)
        answer = len(last) if 2 * len(last) <= len(words) else len(words) // 3
        out.append(Item(r.item_id, words, words[-min(len(words), max(answer, ANSWER_WORDS)) :]))
    return sorted(out, key=lambda x: x.item_id)


def _document_frequencies(texts: DataFrame, keys: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of texts, and of texts that have each of the words: over all texts."""
    shared = texts.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(shared.value)
        counts, n = np.zeros(len(terms.keys) + 1, dtype=np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, offsets, data in text_chunks(batch.column("text")):
                words, begins = hash_words(offsets, data, WORD_BYTES)
                rows = terms.rows(words)
                at = np.flatnonzero(rows)
                owner = np.searchsorted(begins, at, side="right") - 1
                pairs = np.unique(owner * len(counts) + rows[at])
                counts += np.bincount(pairs % len(counts), minlength=len(counts))
        counts[0] = n
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["term", "n"])

    found = dict(texts.mapInArrow(tidy(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect())
    return found.get(0, 0), np.array([found.get(i + 1, 0) for i in range(len(keys))], dtype=np.int64)


def _fit(texts: DataFrame, n_texts: int, items: list[Item], terms: Terms, idf: np.ndarray) -> np.ndarray:
    """Right singular vectors of the TF-IDF matrix of passages, by a distributed randomised decomposition.

    Rows: the items, and passages of a bounded sample of documents, which weigh as much as the items
    in all. Each power step is one Spark job that multiplies the Gram matrix with a thin matrix;
    what comes back has a row for each term of the items.
    """
    spark = texts.sparkSession
    sized = texts.withColumn("size", F.octet_length("text")).where(F.col("size").between(1, FIT_BYTES))
    sample = hash_sample(sized, n_texts, FIT_DOCS, "doc_id", "size", ties="text")
    keys = spark.sparkContext.broadcast(terms.keys)

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(keys.value)
        for batch in batches:
            for _, offsets, data in text_chunks(batch.column("text")):
                words, begins = hash_words(offsets, data, WORD_BYTES)
                at = terms.rows(words).astype(np.int64) - 1
                cuts = [at[i : min(i + FIT_WORDS, b)] for a, b in zip(begins[:-1], begins[1:], strict=True) for i in range(a, b, FIT_WORDS)]
                rows = [x[x >= 0].tolist() for x in cuts]
                yield pa.RecordBatch.from_arrays([pa.array([x for x in rows if x], pa.list_(pa.int64()))], ["terms"])

    own = [((terms.rows(x.words).astype(np.int64) - 1).tolist(), 1.0) for x in items]
    table = written(sample.select("text").mapInArrow(passages, "terms array<long>").withColumn("weight", F.lit(0.0)), "passages")
    share = len(own) / max(1, table.count())
    table = table.withColumn("weight", F.lit(share)).union(spark.createDataFrame(own, "terms array<long>, weight double")).repartition(8)
    rank = min(RANK, len(idf))
    basis = np.random.default_rng(0).standard_normal((len(idf), min(rank + OVERSAMPLE, len(idf))))
    for step in range(POWER_STEPS + 1):
        basis = np.linalg.qr(basis)[0]
        shared = spark.sparkContext.broadcast((basis, idf))

        def multiply(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            basis, idf = shared.value
            out, seen = np.zeros_like(basis), np.zeros(len(basis), dtype=bool)
            for batch in batches:
                for terms, weight in zip(batch.column("terms").to_pylist(), batch.column("weight").to_pylist(), strict=True):
                    distinct, n = np.unique(np.array(terms, dtype=np.int64), return_counts=True)
                    x = n * idf[distinct]
                    out[distinct] += weight * np.outer(x, x @ basis[distinct])
                    seen[distinct] = True
            for i in np.array_split(np.flatnonzero(seen), max(1, seen.sum() // 1000)):
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(list(out[i]), pa.list_(pa.float64()))], ["term", "row"])

        sums = table.mapInArrow(multiply, "term long, row array<double>").groupBy("term").agg(Summarizer.sum(array_to_vector("row")).alias("row"))
        product = np.zeros_like(basis)
        for r in sums.select("term", vector_to_array("row").alias("row")).toLocalIterator():
            product[r.term] = r.row
        shared.unpersist()
        if step == POWER_STEPS:
            values, turn = np.linalg.eigh(basis.T @ product)
            basis = (basis @ turn)[:, np.argsort(-values)[:rank]]
        else:
            basis = product
    return basis


def _group(width: int, members: np.ndarray, items: list[Item], terms: Terms, idf: np.ndarray) -> Group:
    least, rows, rare = [], [], []
    for j, i in enumerate(members):
        own = terms.rows(items[i].words).astype(np.int64)
        # a leak lacks so many of the item's words at most; of those and some more, the rarest, it has some
        lacking = len(own) - int(np.ceil(LCS_WITH_ANSWER * len(own) - 1e-9))
        some = max(1, len(own) // 10)
        least.append(min(some, len(own) - lacking))
        rare.append(np.unique(own[np.argsort(-idf[own - 1], kind="stable")[: lacking + some]]) * len(members) + j)
        rows.append(own * len(members) + j)
    place = np.arange(len(idf) + 2)
    rare = np.sort(np.concatenate(rare))
    pairs, counts = np.unique(np.concatenate(rows), return_counts=True)
    return Group(
        width, members, np.searchsorted(rare // len(members), place), rare % len(members), np.array(least), np.searchsorted(pairs // len(members), place), pairs % len(members), counts
    )


def build_index(texts: DataFrame, items: list[Item], n_texts: int, df: np.ndarray) -> Index:
    """df: in how many of the n_texts texts each word of the items is, in the order of the words' hashes."""
    own = np.unique(np.concatenate([x.words for x in items]))
    terms = Terms(own)
    idf = np.log1p(n_texts / (1 + df)) + 1e-3
    basis = _fit(texts, n_texts, items, terms, idf)
    latent = np.zeros((len(own) + 1, basis.shape[1]), dtype=np.float32)
    latent[1:] = basis * idf[:, None]
    vectors = np.stack([latent[terms.rows(x.words)].sum(axis=0) for x in items])
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    widths = np.array([_width(len(x.words)) for x in items])
    groups = [_group(int(w), np.flatnonzero(widths == w), items, terms, idf) for w in np.unique(widths)]
    return Index(items, terms, latent, vectors, groups)


def lcs_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit for each word of a."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    whole = (1 << len(a)) - 1
    state = whole
    for x in b.tolist():
        hit = state & masks.get(x, 0)
        state = ((state + hit) | (state - hit)) & whole
    return len(a) - state.bit_count()


def _contains(words: np.ndarray, part: np.ndarray) -> bool:
    starts = np.flatnonzero(words[: len(words) - len(part) + 1] == part[0]) if len(words) >= len(part) else []
    return any(np.array_equal(words[i : i + len(part)], part) for i in starts)


def _judge(item: Item, words: np.ndarray) -> tuple[int, bool]:
    """(longest common subsequence, leaked?)"""
    n = lcs_length(item.words, words)
    size = len(item.words)
    return n, n >= LCS * size and n >= min(size, ANSWER_WORDS) or n >= LCS_WITH_ANSWER * size and _contains(words, item.answer)


def _passages(group: Group, rows: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first, last, low, high) of the passages that have, with a margin (low to high), enough of the rarer words of one item.

    Passages begin at every eighth of their width. Only those around places where enough such words lie close together are made.
    """
    width, stride, margin = group.width, max(1, group.width // 8), group.width // 4
    n = group.rare_starts[rows + 1] - group.rare_starts[rows]
    hits = np.flatnonzero(n)
    n = n[hits]
    item = group.rare_holders[np.repeat(group.rare_starts[rows[hits]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    hits = np.repeat(hits, n)
    order = np.lexsort((hits, item))
    item, hits = item[order], hits[order]
    # the hit that makes them enough, from each on
    to = np.arange(len(hits)) + group.least[item] - 1
    reached = to < len(hits)
    reached[reached] = item[to[reached]] == item[reached]
    a, b = hits[reached], hits[to[reached]]
    owner = np.searchsorted(begins, a, side="right") - 1
    close = (b - a < width + 2 * margin) & (b < begins[owner + 1])
    a, b, owner = a[close], b[close], owner[close]
    start = begins[owner]
    final = np.maximum(begins[owner + 1] - width, start)  # where the last passage begins
    most = -(-(final - start) // stride)
    i = np.clip(-(-(b - width - margin + 1 - start) // stride), 0, most)
    n = np.clip((a + margin - start) // stride, 0, most) - i + 1
    # the last passage begins where the text allows, before its turn
    n = np.where((i + n - 1 == most - 1) & (final - margin <= a), n + 1, n)
    n = np.maximum(n, 0)
    turn = np.repeat(i, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    owner, final = np.repeat(owner, n), np.repeat(final, n)
    first = np.minimum(begins[owner] + turn * stride, final)
    first, at = np.unique(first, return_index=True)
    owner = owner[at]
    last = np.minimum(first + width, begins[owner + 1])
    return owner, first, last, np.maximum(first - margin, begins[owner]), np.minimum(last + margin, begins[owner + 1])


def _common(group: Group, rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each passage and item: the item's words that the passage has at all. No common subsequence is longer."""
    sizes = high - low
    passage = np.repeat(np.arange(len(low)), sizes)
    row = rows[np.repeat(low, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)].astype(np.int64)
    keep = group.starts[row + 1] > group.starts[row]
    keys = np.unique(passage[keep] * len(group.starts) + row[keep])
    passage, row = keys // len(group.starts), keys % len(group.starts)
    n = group.starts[row + 1] - group.starts[row]
    at = np.repeat(group.starts[row], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    cell = np.repeat(passage, n) * len(group.members) + group.holders[at]
    return np.bincount(cell, weights=group.counts[at], minlength=len(low) * len(group.members)).reshape(len(low), -1)


def _search(index: Index, words: np.ndarray, begins: np.ndarray) -> dict[tuple[int, int], tuple[float, int, int]]:
    """(text, item) -> (cosine, lcs, word where the passage begins) of the leaks in the texts of a chunk."""
    rows = index.terms.rows(words)
    found: dict[tuple[int, int], tuple[float, int, int]] = {}
    for group in index.groups:
        needed = np.array([LCS_WITH_ANSWER * len(index.items[i].words) for i in group.members]) - 1e-6
        owner, first, last, low, high = _passages(group, rows, begins)
        for s in range(0, len(first), BLOCK):
            o, f, e, a, b = (x[s : s + BLOCK] for x in (owner, first, last, low, high))
            possible = _common(group, rows, a, b) >= needed
            at = np.flatnonzero(possible.any(axis=1))
            if not len(at):
                continue
            latent = np.stack([index.latent[rows[f[p] : e[p]]].sum(axis=0) for p in at])
            cosines = latent @ index.vectors[group.members].T / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
            for p, q in zip(*np.nonzero(possible[at] & (cosines >= MIN_COSINE)), strict=True):
                n, leaked = _judge(index.items[group.members[q]], words[a[at[p]] : b[at[p]]])
                key = (int(o[at[p]]), int(group.members[q]))
                if leaked and (key not in found or n > found[key][1]):
                    found[key] = (float(cosines[p, q]), n, int(f[at[p]] - begins[o[at[p]]]))
    return found


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Find documents that hold a benchmark item, word for word or paraphrased.

    docs: doc_id, text. benchmark: item_id, text; other columns are ignored. Returns one row for each document
    and item found in it: doc_id, item_id, cosine, lcs (common words in order), item_words, word
    (where the passage begins). Words are runs of letters and digits, A-Z lower-cased. Whole texts are cut into
    overlapping passages of about an item's length. The candidates for an item are the passages with a latent cosine of MIN_COSINE or
    more; it isn't reckoned for passages that, with a margin, have too few of an item's words, or of its rarer ones, for any
    leak. A candidate is a leak with LCS of the item's words in order, or with LCS_WITH_ANSWER of them and
    the item's answer word for word. Null or
    empty texts and items match nothing; items without id are left out; repeated rows and ids are
    each looked at; empty tables give an empty result. Items are the query set: they are searched in blocks of about ITEMS_PER_BLOCK, so that what
    the driver and a worker hold is bounded. For each block, idf is counted over all texts in one pass and the texts are searched in another.
    """
    spark = docs.sparkSession
    texts = texts_of(docs).fillna("", ["text"])
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, cosine double, lcs int, item_words int, word long"
    blocks = -(-asked.count() // ITEMS_PER_BLOCK)
    out = spark.createDataFrame([], schema)
    for block in range(blocks):
        items = _items(asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect())
        if not items:
            continue
        keys = np.unique(np.concatenate([x.words for x in items]))
        index = build_index(texts, items, *_document_frequencies(texts, keys))
        shared = spark.sparkContext.broadcast(index)
        del index, items, keys
        give_back()

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id")
                for row, offsets, data in text_chunks(batch.column("text")):
                    found = _search(shared.value, *hash_words(offsets, data, WORD_BYTES))
                    items = [shared.value.items[q] for _, q in found]
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array([row + t for t, _ in found], pa.int64())),
                            pa.array([x.item_id for x in items], pa.int64()),
                            pa.array([x[0] for x in found.values()], pa.float64()),
                            pa.array([x[1] for x in found.values()], pa.int32()),
                            pa.array([len(x.words) for x in items], pa.int32()),
                            pa.array([x[2] for x in found.values()], pa.int64()),
                        ],
                        ["doc_id", "item_id", "cosine", "lcs", "item_words", "word"],
                    )

        found = texts.mapInArrow(tidy(run), schema)
        if blocks == 1:
            return found
        out = out.union(written(found, "leaks"))  # the block's index goes before the next one is made
        shared.destroy()
    return out
