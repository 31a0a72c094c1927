"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, kept as sorted hash arrays, memory-mapped.

Words get numbers: their place among the sorted 64-bit hashes of all words. N-grams of numbers are counted in parts; every
part writes sorted arrays of its n-grams' hashes (48 bits of each) to the shared folder, from where workers map what they look up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, discard, hash_words, mix, shared_path, small_batches, text_chunks, texts_of, tidy, written
from .ngram_arrays import Files, find, keys_of, narrow
from .token_files import _filesystem

ORDER = 3
#: Tokens that are counted together before rows leave a worker; training tokens, words, for each part of the arrays, about.
COUNT_TOKENS, PART_TOKENS, PART_WORDS = 1 << 21, 2_500_000, 1_000_000
#: Texts are scored together up to so many bytes.
SCORE_BYTES = 4_000_000
#: Words have numbers below this.
MOST_WORDS = (1 << 32) - 4
_FACTOR = U64(0xD6E8FEB86659FD93)
_U32, _32 = np.uint32, U64(32)


# --- words and their numbers


@dataclass
class Words:
    """The numbers of words: `offsets[k]` and on for those whose hash begins with the bits k. The end of a text, its start and unknown words come last."""

    out: str
    bits: int
    offsets: np.ndarray

    @property
    def end(self) -> int:
        return int(self.offsets[-1])

    def part_of(self, words: np.ndarray) -> np.ndarray:
        return (words >> U64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(words), dtype=np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0

    def flush():
        words, n = np.unique(np.concatenate(held), return_counts=True)
        for a in range(0, len(words), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(words[a : a + (1 << 16)].view(np.int64)), pa.array(n[a : a + (1 << 16)])], ["word", "n"])

    for batch in batches:
        for _, offsets, data in text_chunks(batch.column("text")):
            held.append(hash_words(offsets, data)[0])
            size += len(held[-1])
            if size >= COUNT_TOKENS:
                yield from flush()
                held, size = [], 0
    if size:
        yield from flush()


def _number_words(out: str):
    """Writes a part's words: sorted hashes and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(out)
        found = [[b.column(c).to_numpy() for c in ("part", "word", "n")] for b in batches if b.num_rows]
        if not found:
            return
        part, word, n = (np.concatenate(x) for x in zip(*found, strict=True))
        for k in np.unique(part).tolist():
            own, counts = word[part == k].view(U64), n[part == k]
            order = np.argsort(own)
            files.save(f"words-{k:06d}", words=own[order], counts=counts[order])
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([len(own)], pa.int64())], ["part", "n"])

    return run


class Numbers:
    """Looks up the numbers of words."""

    def __init__(self, words: Words):
        self.words, self.files = words, Files(words.out)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        w = self.words
        distinct, back = np.unique(hashes, return_inverse=True)
        out = np.full(len(distinct), w.end + 2, dtype=_U32)
        cuts = np.searchsorted(w.part_of(distinct), np.arange(len(w.offsets)))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            if w.offsets[k + 1] == w.offsets[k]:
                continue
            known, own = self.files.arrays(f"words-{k:06d}")["words"], distinct[cuts[k] : cuts[k + 1]]
            at = np.searchsorted(known, own)
            at[at == len(known)] = 0
            hit = known[at] == own
            out[cuts[k] : cuts[k + 1]][hit] = w.offsets[k] + at[hit]
        return out[back]

    def sequences(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(the token two before, the one before, token, text number) of all tokens of the texts; each ends with the end, and starts stand before it."""
        parts, texts, first = [], [], 0
        for _, offsets, data in text_chunks(column):
            words, begins = hash_words(offsets, data)
            parts.append(words)
            texts.append(np.repeat(np.arange(len(begins) - 1) + first, np.diff(begins)))
            first += len(begins) - 1
        if not first:
            return tuple(np.empty(0, dtype=np.int64) for _ in range(4))
        number, text = self.of(np.concatenate(parts)), np.concatenate(texts)
        ends = np.cumsum(np.bincount(text, minlength=first) + 1) - 1
        tokens = np.full(len(number) + first, self.words.end, dtype=_U32)
        inside = np.ones(len(tokens), dtype=bool)
        inside[ends] = False
        tokens[inside] = number
        start = np.append(0, ends[:-1] + 1)
        one, two = (np.full(len(tokens), self.words.end + 1, dtype=_U32) for _ in range(2))
        one[1:], two[2:] = tokens[:-1], tokens[:-2]
        one[start] = two[start] = self.words.end + 1
        second = start[start + 1 < len(tokens)] + 1
        two[second] = self.words.end + 1
        return two, one, tokens, np.repeat(np.arange(first), np.diff(np.append(start, len(tokens))))


# --- keys, parts, blocks


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(U64) << _32 | b.astype(U64)


def _key(*numbers: np.ndarray) -> np.ndarray:
    out = np.zeros(len(numbers[0]), dtype=U64)
    for x in numbers:
        out = mix(out * _FACTOR + x.astype(U64) + U64(1))
    return out


@dataclass
class Deal:
    """Which part holds an n-gram: that of its middle word; n-grams around a word of more than PART_TOKENS tokens are dealt by all their words."""

    parts: int
    hot: np.ndarray  # sorted

    def is_hot(self, word: np.ndarray) -> np.ndarray:
        return np.isin(word, self.hot)

    def top(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return (np.where(self.is_hot(v), _key(u, v, w), _key(v)) % U64(self.parts)).astype(np.int64)

    def pair(self, middle: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The part that holds what is known of a pair: of its middle word, or one of `parts` more for pairs of several parts."""
        hot = self.is_hot(middle)
        return np.where(hot, self.parts, 0) + (np.where(hot, _key(a, b), _key(middle)) % U64(self.parts)).astype(np.int64)


#: Columns of each kind of block: numbers of words, of 32 bits, and counts, of 64.
_WIDTH = {"top": (3, 1), "suffix": (2, 1), "context": (2, 4), "words": (1, 5)}


def _pack(kind: str, columns: list[np.ndarray]) -> bytes:
    """A block's columns, the first one sorted, byte plane by byte plane: the upper planes of small counts take hardly any room."""
    numbers, planes = _WIDTH[kind][0], []
    for i, x in enumerate([np.diff(columns[0].astype(np.int64), prepend=0), *columns[1:]]):
        wide = _U32 if i < numbers else U64
        planes.append(np.ascontiguousarray(x.astype(wide)).view(np.uint8).reshape(-1, wide().itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(kind: str, data: bytes) -> list[np.ndarray]:
    numbers, counts = _WIDTH[kind]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(4 * numbers + 8 * counts, -1)
    columns = [np.ascontiguousarray(planes[4 * i : 4 * i + 4].T).view(_U32).ravel() for i in range(numbers)]
    columns += [np.ascontiguousarray(planes[i : i + 8].T).view(U64).ravel().astype(np.int64) for i in range(4 * numbers, len(planes), 8)]
    columns[0] = np.cumsum(columns[0], dtype=np.int64).astype(_U32)
    return columns


BLOCKS = "kind string, part int, data binary, n1 long, n2 long, n3 long, n4 long"
_KINDS = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("data", pa.binary()), *((f"n{i}", pa.int64()) for i in range(1, 5))])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(_KINDS.names, r + (0,) * (7 - len(r)), strict=True)) for r in rows], schema=_KINDS)


def _blocks(kind: str, part: np.ndarray, columns: list[np.ndarray]) -> list[tuple]:
    """Rows with the columns of each part; columns are sorted within it."""
    cuts = np.flatnonzero(np.append(True, np.diff(part) != 0)) if len(part) else []
    return [(kind, int(part[a]), _pack(kind, [c[a:b] for c in columns])) for a, b in zip(cuts, np.append(cuts[1:], len(part)), strict=True)] if len(part) else []


def _gathered(batches: Iterator[pa.RecordBatch]) -> dict[tuple[str, int], list[np.ndarray]]:
    """The columns of each kind and part in a task's rows; a task has one part, or several if Spark has put small ones together."""
    held: dict[tuple[str, int], list] = {}
    for batch in batches:
        for kind, part, data in zip(batch.column("kind").to_pylist(), batch.column("part").to_pylist(), batch.column("data").to_pylist(), strict=True):
            held.setdefault((kind, part), []).append(_unpack(kind, data))
    return {k: [np.concatenate(c) for c in zip(*v, strict=True)] for k, v in held.items()}


def _merged(hi: np.ndarray, lo: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Rows with equal (hi, lo) as one, sorted, their values summed."""
    order = np.lexsort((lo, hi))
    hi, lo = hi[order], lo[order]
    new = np.flatnonzero(np.append(True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))) if len(hi) else np.empty(0, np.int64)
    sums = [np.add.reduceat(v[order].astype(np.int64), new) if len(new) else np.empty(0, np.int64) for v in values]
    return hi[new], lo[new], sums


def _by(groups: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """For sorted groups: where each begins; sum of n, and how many n are 1, 2, and 3 or more."""
    new = np.flatnonzero(np.append(True, groups[1:] != groups[:-1])) if len(groups) else np.empty(0, np.int64)
    sums = [np.add.reduceat(x.astype(np.int64), new) if len(new) else np.empty(0, np.int64) for x in (n, n == 1, n == 2, n >= 3)]
    return new, sums


# --- counting


def _count_grams(words: Words, deal: Deal, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held, size = Numbers(words), [], 0

        def flush():
            u, v, w = (np.concatenate(x) for x in zip(*held, strict=True))
            if order == 2:
                part = deal.pair(v, v, w)
                hi, lo, (n,) = _merged(part.astype(U64) << _32 | v.astype(U64), w, [np.ones(len(w), np.int64)])
                columns = [hi.astype(_U32), lo.astype(_U32), n]
            else:
                part = deal.top(u, v, w)
                hi, lo, (n,) = _merged(part.astype(U64) << _32 | v.astype(U64), _pair(u, w), [np.ones(len(w), np.int64)])
                columns = [hi.astype(_U32), (lo >> _32).astype(_U32), lo.astype(_U32), n]
            yield from map(lambda r: _rows([r]), _blocks("suffix" if order == 2 else "top", (hi >> _32).astype(np.int64), columns))

        for batch in batches:
            *grams, _ = numbers.sequences(batch.column("text"))
            held.append(grams)
            size += len(grams[0])
            if size >= COUNT_TOKENS:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return run


def _counts_of(n: np.ndarray) -> tuple[int, ...]:
    return tuple(int((n == k).sum()) for k in (1, 2, 3, 4))


def _save_suffixes(files: Files, words: Words, suffix_part: int, v: np.ndarray, w: np.ndarray, n: np.ndarray) -> list[tuple]:
    """Pairs (sorted) with their counts at the second level; gives the counts of counts, and what the pairs add to their words."""
    key = _key(v, w)
    order = np.argsort(key)
    once = n[order] == 1
    files.save(f"suffix-{suffix_part:06d}", **keys_of("once", key[order][once]), **keys_of("more", key[order][~once]), counts=narrow(n[order][~once]))
    new, (total, n1, n2, n3) = _by(v, n)
    second, types = np.unique(w, return_counts=True)
    numbers = np.union1d(v[new], second)
    columns = np.zeros((5, len(numbers)), dtype=np.int64)
    columns[:4, np.searchsorted(numbers, v[new])] = total, n1, n2, n3
    columns[4, np.searchsorted(numbers, second)] = types
    part = np.searchsorted(words.offsets, numbers, side="right") - 1
    return [("level2", suffix_part, None, *_counts_of(n)), *_blocks("words", part, [numbers, *columns])]


def _save_contexts(files: Files, name: str, u: np.ndarray, v: np.ndarray, total: np.ndarray, n1: np.ndarray, n2: np.ndarray, n3: np.ndarray) -> None:
    """Pairs as contexts: total, and how many counts are 1, 2, and 3 or more. Those of total 1 are known by that."""
    key = _key(u, v)
    order = np.argsort(key)
    once = total[order] == 1
    stats = np.stack([x[order][~once] for x in (total, n1, n2, n3)], axis=1)
    files.save(name, **keys_of("once", key[order][once]), **keys_of("more", key[order][~once]), stats=narrow(stats))


def _top_parts(words: Words, deal: Deal):
    """Of a part's trigrams: writes their arrays, those of the pairs that are in no other part, and gives what others need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(words.out)
        for (_, part), (v, u, w, n) in _gathered(batches).items():
            hi, w, (n,) = _merged(_pair(v, u), w, [n])
            v, u = (hi >> _32).astype(_U32), hi.astype(_U32)
            key = _key(u, v, w)
            order = np.argsort(key)
            once = n[order] == 1
            files.save(f"top-{part:06d}", **keys_of("once", key[order][once]), **keys_of("more", key[order][~once]), counts=narrow(n[order][~once]))
            yield _rows([("level3", part, None, *_counts_of(n))])
            new, stats = _by(hi, n)
            hot = deal.is_hot(v[new])
            _save_contexts(files, f"context-{part:06d}", u[new][~hot], v[new][~hot], *(x[~hot] for x in stats))
            yield from map(lambda r: _rows([r]), _elsewhere("context", deal, u[new][hot], v[new][hot], v[new][hot], [x[hot] for x in stats]))
            second, _, (types,) = _merged(_pair(v, w), np.zeros(len(v), dtype=_U32), [np.ones(len(v), np.int64)])
            a, b = (second >> _32).astype(_U32), second.astype(_U32)
            hot = deal.is_hot(a)
            yield _rows(_save_suffixes(files, words, part, a[~hot], b[~hot], types[~hot]))
            yield from map(lambda r: _rows([r]), _elsewhere("suffix", deal, a[hot], b[hot], a[hot], [types[hot]]))

    return run


def _elsewhere(kind: str, deal: Deal, a: np.ndarray, b: np.ndarray, middle: np.ndarray, values: list[np.ndarray]) -> list[tuple]:
    part = deal.pair(middle, a, b)
    order = np.lexsort((b, a, part))
    return _blocks(kind, part[order], [x[order] for x in (a, b, *values)])


def _pair_parts(words: Words):
    """Pairs whose counts come from several parts: summed and written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(words.out)
        for (kind, part), (a, b, *values) in _gathered(batches).items():
            hi, _, sums = _merged(_pair(a, b), np.zeros(len(a), dtype=_U32), values)
            a, b = (hi >> _32).astype(_U32), hi.astype(_U32)
            if kind == "context":
                _save_contexts(files, f"context-{part:06d}", a, b, *sums)
                yield _rows([("done", part, None)])
            else:
                yield _rows(_save_suffixes(files, words, part, a, b, sums[0]))

    return run


def _word_parts(words: Words):
    """Of each word: total, n1, n2, n3 as a context, and in how many pairs it is the second; gives totals of the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(words.out)
        for (_, part), (number, *values) in _gathered(batches).items():
            base = int(words.offsets[part])
            size = int(words.offsets[part + 1]) - base if part + 1 < len(words.offsets) else 2
            table = np.zeros((size, 5), dtype=np.uint64)
            for i, x in enumerate(values):
                np.add.at(table[:, i], number.astype(np.int64) - base, x.astype(U64))
            files.save(f"table-{part:06d}", table=table)
            types = table[:, 4]
            yield _rows([("level1", part, None, *_counts_of(types)), ("types", None, None, int(types.sum()), int((types >= 3).sum()))])

    return run


# --- the model


@dataclass
class Model:
    """Where the arrays are, and the numbers that all words share."""

    order: int
    words: Words
    deal: Deal
    n_tokens: int
    n_texts: int
    n_words: int
    n_types: int
    discounts: dict[int, tuple[float, float, float]]
    rest: float
    present: dict[str, np.ndarray] = field(default_factory=dict)  # for each kind of array: which parts have one


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and 3 or more, from the numbers of n-grams with counts 1 to 4.

    Where the data are too few for the estimate it is held within (0, count).
    """
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [k - (k + 1) * y * b / a if a else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw, strict=True))


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """Learn from all texts of a table (column text; null counts as empty). order: 2 or 3.

    Everything is counted in Spark. First the words: their sorted hashes give them numbers. Then n-grams of numbers, in blocks that
    are shuffled by part; a part writes its arrays, and gives its share of the statistics of words, and of pairs around words so
    frequent that several parts have them; these are summed and written in the same way. Only totals, the sizes of the parts of the words,
    and those frequent words reach the driver: there are fewer of both than parts.
    """
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = shared_path(spark, "ngrams")
    filesystem, root = _filesystem(out)
    filesystem.create_dir(root, recursive=True)
    counted = written(texts.mapInArrow(tidy(_count_words), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    n_texts = texts.count()
    n_words, n_tokens = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n_words >= MOST_WORDS:
        raise ValueError("more distinct words than numbers")
    bits = max(0, (n_words // PART_WORDS).bit_length())
    part = F.shiftrightunsigned("word", 64 - bits).cast("int") if bits else F.lit(0)
    sizes = dict(counted.select(part.alias("part"), "word", "n").repartitionById(1 << bits, "part").mapInArrow(_number_words(out), "part int, n long").collect())
    words = Words(out, bits, np.append(0, np.cumsum([sizes.get(k, 0) for k in range(1 << bits)])))
    hot = [r.word for r in counted.where(F.col("n") > PART_TOKENS).select("word").collect()]
    frequent = np.sort(Numbers(words).of(np.array(hot, dtype=np.int64).view(U64))) if hot else np.empty(0, _U32)
    if n_texts > PART_TOKENS:
        frequent = np.append(frequent, _U32(words.end + 1))
    parts = max(8, (n_tokens + n_texts) // PART_TOKENS + 1)
    deal = Deal(int(parts), frequent)
    discard(counted)

    grams = texts.mapInArrow(tidy(_count_grams(words, deal, order)), BLOCKS)
    if order == 2:
        first, merged = None, grams
    else:
        first = written(grams.repartitionById(deal.parts, "part").mapInArrow(tidy(_top_parts(words, deal)), BLOCKS), "trigrams")
        merged = first.where("kind in ('suffix', 'context')")
    pairs = written(merged.repartitionById(2 * deal.parts, "part").mapInArrow(tidy(_pair_parts(words)), BLOCKS), "pairs")
    shares = pairs if first is None else pairs.union(first)
    ended = shares.where("kind = 'words'").repartitionById(len(words.offsets), "part").mapInArrow(tidy(_word_parts(words)), BLOCKS)
    ended = written(ended, "ended")
    sums = {r.kind: (r.n1, r.n2, r.n3, r.n4) for r in shares.where("data is null").union(ended).groupBy("kind").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(1, 5))).collect()}
    present = _present(shares.union(ended), int(2 * deal.parts + len(words.offsets)))
    discard(pairs, ended, *([first] if first is not None else []))
    levels = {k: _discounts(*sums.get(f"level{k}", (0,) * 4)) for k in range(1, order + 1)}
    one, two, *_ = sums.get("level1", (0,) * 4)
    n_types, many, *_ = sums.get("types", (0,) * 4)
    rest = sum(d * n for d, n in zip(levels[1], (one, two, many), strict=True)) / n_types if n_types else 1.0
    return Model(order, words, deal, n_tokens + n_texts, n_texts, n_words + (n_texts > 0), n_types, levels, rest, present)


def _present(rows: DataFrame, n_parts: int) -> dict[str, np.ndarray]:
    """Which parts have a file of each kind, from what the tasks that wrote them gave back; the driver gets a bit for each."""
    place = F.col("part") + 1
    marks = rows.where("data is null and part is not null").groupBy("kind", F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    kinds = {"level3": ("top", "context"), "done": ("context",), "level2": ("suffix",), "level1": ("table",)}
    out = {k: np.zeros(n_parts, dtype=bool) for k in ("top", "context", "suffix", "table")}
    for r in marks.collect():
        bits = np.unpackbits(np.frombuffer(bytes(r.bits), dtype=np.uint8), bitorder="little").astype(bool)
        first = (r.bucket - 1) * len(bits)
        for kind in kinds[r.kind]:
            own = out[kind][first : first + len(bits)]
            own |= bits[: len(own)]
    return out


class Reader:
    """The model as a worker sees it: arrays mapped into memory, of which only the pages that are looked at are read."""

    def __init__(self, model: Model):
        self.model, self.numbers, self.files = model, Numbers(model.words), Files(model.words.out)

    def of_words(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Count in training, probability by the lowest level, total and weight left as a context, of sorted distinct words."""
        m = self.model
        count, table = np.zeros(len(number), dtype=np.int64), np.zeros((len(number), 5))
        part = np.searchsorted(m.words.offsets, number, side="right") - 1
        for k in np.unique(part).tolist():
            own = np.flatnonzero(part == k)
            at = number[own].astype(np.int64) - int(m.words.offsets[k])
            if k + 1 < len(m.words.offsets):
                count[own] = self.files.arrays(f"words-{k:06d}")["counts"][at]
            else:
                count[own] = np.where(at == 0, m.n_texts, 0)
                own, at = own[at < 2], at[at < 2]
            if m.present["table"][k]:
                table[own] = self.files.arrays(f"table-{k:06d}")["table"][at]
        types = table[:, 4]
        taken = np.array([0, *m.discounts[1]])[np.minimum(types, 3).astype(np.int64)]
        p = (types - taken) / max(m.n_types, 1) + m.rest / (m.n_words + 1)
        return count, p, table[:, 0], table[:, 1:4] @ np.array(m.discounts[2])

    def _each_part(self, kind: str, part: np.ndarray) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(part[order]) != 0)) if len(part) else []
        for own in np.split(order, cuts[1:]) if len(part) else []:
            if self.model.present[kind][part[own[0]]]:
                yield self.files.arrays(f"{kind}-{int(part[own[0]]):06d}"), own

    def counts(self, kind: str, part: np.ndarray, key: np.ndarray) -> np.ndarray:
        out = np.zeros(len(key), dtype=np.int64)
        for arrays, own in self._each_part(kind, part):
            at = find(arrays, "more", key[own])
            out[own[at >= 0]] = arrays["counts"][at[at >= 0]]
            own = own[at < 0]
            out[own] = find(arrays, "once", key[own]) >= 0
        return out

    def contexts(self, part: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Total and weight left of pairs as contexts."""
        total, left = np.zeros(len(key)), np.zeros(len(key))
        d = np.array(self.model.discounts[3])
        for arrays, own in self._each_part("context", part):
            at = find(arrays, "more", key[own])
            stats = arrays["stats"][at[at >= 0]].astype(float)
            total[own[at >= 0]], left[own[at >= 0]] = stats[:, 0], stats[:, 1:] @ d
            own = own[at < 0]
            hit = own[find(arrays, "once", key[own]) >= 0]
            total[hit], left[hit] = 1, d[0]
        return total, left

    def _level(self, level: int, n: np.ndarray, total: np.ndarray, left: np.ndarray, lower: np.ndarray) -> np.ndarray:
        taken = np.array([0, *self.model.discounts[level]])[np.minimum(n, 3)]
        safe = np.maximum(total, 1)
        return np.where(total > 0, (n - taken) / safe + left / safe * lower, lower)

    def scores(self, two: np.ndarray, one: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each token after those before it, and the tokens' counts in training."""
        m, deal = self.model, self.model.deal
        distinct, at = np.unique(np.concatenate([one, tokens]), return_inverse=True)
        count, lowest, total, left = self.of_words(distinct)
        first, last = at[: len(one)], at[len(one) :]
        pair, back = np.unique(first * len(distinct) + last, return_inverse=True)
        a, b = pair // len(distinct), pair % len(distinct)
        v, w = distinct[a], distinct[b]
        n = self.counts("suffix", deal.pair(v, v, w), _key(v, w))
        p = self._level(2, n, total[a], left[a], lowest[b])[back]
        if m.order == 3:
            n = self.counts("top", deal.top(two, one, tokens), _key(two, one, tokens))
            context, back = np.unique(_pair(two, one), return_inverse=True)
            u, v = (context >> _32).astype(_U32), context.astype(_U32)
            total, left = self.contexts(deal.pair(v, u, v), _key(u, v))
            p = self._level(3, n, total[back], left[back], p)
        return np.log10(p), count[last]


def _larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches together up to SCORE_BYTES, so that short texts share the opening of files."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= SCORE_BYTES:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Score every whole text: doc_id, n_tokens, n_known, base_score, score.

    Tokens are the words (A-Z lower-cased) and one end. n_known: tokens seen in training. base_score: sum of
    log10((c + 0.1) / (N + 0.1 * (V + 1))) with c the token's count. score: the model's log10
    probability of the text. A null or empty text is its end alone. One row for each
    input row; other columns than doc_id and text are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, reader = shared.value, Reader(shared.value)
        floor = np.log10(m.n_tokens + 0.1 * (m.n_words + 1))
        for table in _larger(batches):
            two, one, tokens, text = reader.numbers.sequences(table.column("text"))
            if not len(tokens):
                continue
            scores, count = reader.scores(two, one, tokens)
            n, base = table.num_rows, np.log10(count + 0.1) - floor
            columns = [np.bincount(text, minlength=n), np.bincount(text[count > 0], minlength=n), np.bincount(text, weights=base, minlength=n), np.bincount(text, weights=scores, minlength=n)]
            ids = table.column("doc_id").combine_chunks()
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return texts_of(docs).mapInArrow(tidy(run), "doc_id long, n_tokens long, n_known long, base_score double, score double")
