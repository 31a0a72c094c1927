"""Edit distance between transcripts, by words and by characters, over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bitparallel import edit_distances

#: A cell of the alignment holds errors, substitutions and deletions in one integer, which orders them in this order.
_ERROR, _SUB, _DEL = 1 << 42, (1 << 42) + (1 << 21), (1 << 42) + 1
_MASK = (1 << 21) - 1
#: Cells of a row of the alignments that advance together.
_CELLS = 1 << 16
#: Characters of a batch that are taken apart at once, about; each becomes an integer of 8 bytes.
CHUNK_CHARS = 1 << 19

COUNTS = T.StructType([T.StructField(c, T.IntegerType()) for c in ("errors", "s", "d", "i", "n_ref", "n_hyp")] + [T.StructField("wer", T.DoubleType())])


def _costs(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Least cost of each pair (reference, hypothesis) of a batch, in order of falling lengths of the references: a row of all tables at a time."""
    n_ref, n_hyp = (np.array([len(p[i]) for p in pairs]) for i in (0, 1))
    refs, hyps = (np.full((len(pairs), int(n.max())), -1 - i, dtype=np.int64) for i, n in enumerate((n_ref, n_hyp)))
    for k, (ref, hyp) in enumerate(pairs):
        refs[k, : len(ref)] = ref
        hyps[k, : len(hyp)] = hyp
    steps = np.arange(hyps.shape[1] + 1, dtype=np.int64) * _ERROR
    rows = np.repeat(steps[None], len(pairs), axis=0)
    active = len(pairs) - np.searchsorted(n_ref[::-1], np.arange(refs.shape[1]), side="right")
    for i, k in enumerate(active.tolist()):
        row = rows[:k]
        best = row + _DEL
        np.minimum(best[:, 1:], row[:, :-1] + np.where(hyps[:k] == refs[:k, i, None], 0, _SUB), out=best[:, 1:])
        best -= steps
        np.minimum.accumulate(best, axis=1, out=best)
        rows[:k] = best + steps
    return rows[np.arange(len(pairs)), n_hyp]


def alignments(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A row (errors, substitutions, deletions, insertions) for each pair of integer sequences (reference, hypothesis).

    Of all alignments with least errors the one with fewest substitutions, then deletions. Pairs of like lengths are aligned together.
    """
    cost = np.zeros(len(pairs), dtype=np.int64)
    order = sorted(range(len(pairs)), key=lambda k: (-len(pairs[k][0]), len(pairs[k][1])))
    batch: list[int] = []
    width = 0
    for k in [*order, None]:
        wider = max(width, len(pairs[k][1]) + 1) if k is not None else 0
        if batch and (k is None or wider * (len(batch) + 1) > _CELLS):
            cost[batch] = _costs([pairs[j] for j in batch])
            batch, wider = [], len(pairs[k][1]) + 1 if k is not None else 0
        if k is not None:
            batch.append(k)
            width = wider
    errors, s, d = cost >> 42, cost >> 21 & _MASK, cost & _MASK
    return np.column_stack([errors, s, d, errors - s - d])


def _numbered(texts: list[str], split: Callable[[str], list[str]]) -> Iterator[np.ndarray]:
    """Each text as an array: every distinct part gets a number."""
    ids: dict[str, int] = {}
    for text in texts:
        yield np.array([ids.setdefault(w, len(ids)) for w in split(text)], dtype=np.int64)


def _code_points(texts: list[str]) -> Iterator[np.ndarray]:
    for text in texts:
        yield np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)


def _chunks(a: pd.Series, b: pd.Series) -> Iterator[slice]:
    """Runs of rows of CHUNK_CHARS or a row each, however many rows a batch has."""
    size = (a.str.len().fillna(0) + b.str.len().fillna(0)).to_numpy(dtype=np.int64) if len(a) else np.empty(0, np.int64)
    cuts = [0]
    total = 0
    for i, n in enumerate(size.tolist()):
        if total and total + n > CHUNK_CHARS:
            cuts.append(i)
            total = 0
        total += n
    return (slice(x, y) for x, y in zip(cuts, [*cuts[1:], len(size)], strict=True))


def _known(a: pd.Series, b: pd.Series, parts: Callable[[list[str]], Iterator[np.ndarray]]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Where neither side is null, and the pairs there."""
    known = (a.notna() & b.notna()).to_numpy()
    sides = [x[known].tolist() for x in (a, b)]
    both = list(parts(sides[0] + sides[1]))
    return known, list(zip(both[: len(sides[0])], both[len(sides[0]) :], strict=True))


def _words(texts: list[str]) -> Iterator[np.ndarray]:
    return _numbered(texts, str.split)


@F.pandas_udf(COUNTS)
def _align_udf(refs: pd.Series, hyps: pd.Series) -> pd.DataFrame:
    out = {c: pd.array([None] * len(refs), dtype="Int32") for c in COUNTS.names[:-1]} | {"wer": pd.array([None] * len(refs), dtype="Float64")}
    for rows in _chunks(refs, hyps):
        known, pairs = _known(refs.iloc[rows], hyps.iloc[rows], _words)
        at = np.arange(len(refs))[rows][known]
        counts = alignments(pairs)
        n_ref, n_hyp = (np.array([len(p[i]) for p in pairs], dtype=np.int64) for i in (0, 1))
        for c, values in zip(COUNTS.names, [*counts.T, n_ref, n_hyp], strict=False):
            out[c][at] = values
        out["wer"][at] = np.where(n_ref > 0, counts[:, 0] / np.maximum(n_ref, 1), n_hyp > 0)
    return pd.DataFrame(out)


def _distances(a: pd.Series, b: pd.Series, parts: Callable[[list[str]], Iterator[np.ndarray]]) -> pd.Series:
    out = pd.array([None] * len(a), dtype="Int32")
    for rows in _chunks(a, b):
        known, pairs = _known(a.iloc[rows], b.iloc[rows], parts)
        out[np.arange(len(a))[rows][known]] = edit_distances(pairs)
    return pd.Series(out)


@F.pandas_udf(T.IntegerType())
def _word_distance(refs: pd.Series, hyps: pd.Series) -> pd.Series:
    return _distances(refs, hyps, _words)


@F.pandas_udf(T.IntegerType())
def _char_distance(refs: pd.Series, hyps: pd.Series) -> pd.Series:
    return _distances(refs, hyps, _code_points)


def edit_counts(reference: Column, hypothesis: Column) -> Column:
    """Errors, substitutions, deletions, insertions, lengths and word error rate; null where either is null.

    An empty reference has a rate of 1 if the hypothesis has words, else 0.
    """
    return _align_udf(reference, hypothesis)


def rate(errors: Column, n_ref: Column, n_hyp: Column) -> Column:
    return F.when(n_ref > 0, errors / n_ref).otherwise(F.when(n_hyp > 0, 1.0).otherwise(0.0))


def word_errors(reference: Column, hypothesis: Column) -> Column:
    """Word-level edit distance of texts of any length and vocabulary; null where either is null."""
    return _word_distance(reference, hypothesis)


def char_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Character edit distance by reference length, spaces left out; null where either is null."""
    ref, hyp = (F.replace(x, F.lit(" "), F.lit("")) for x in (reference, hypothesis))
    return F.when(ref.isNotNull() & hyp.isNotNull(), rate(_char_distance(ref, hyp), F.length(ref), F.length(hyp)))
