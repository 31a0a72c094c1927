"""Edit distances of many pairs of sequences at once, by bit vectors.

A column of the table of distances is kept as differences between neighbouring rows, 64 of them in a machine word: a word of
bits for +1 and one for -1 (Myers; in blocks, after Hyyrö). A block needs of the one above it only the difference at their border, so
the blocks of a pair run one step after each other, and all blocks of all pairs of a batch advance together in NumPy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
#: Blocks that advance together, and words of match tables that are held at once, about.
LANES, TABLE_WORDS = 16_384, 1 << 22
#: Symbols of the sequences of a batch, and words of its match tables, unless one pair alone has more: some ten arrays of that length are held at once.
SYMBOLS, BATCH_WORDS = 1 << 19, 1 << 20

Pair = tuple[np.ndarray, np.ndarray]


def _trimmed(a: np.ndarray, b: np.ndarray) -> Pair:
    """Without what both begin and end with; the longer one first."""
    if len(a) < len(b):
        a, b = b, a
    differ = a[: len(b)] != b
    if not differ.any():
        return a[len(b) :], b[:0]
    begin = int(differ.argmax())
    a, b = a[begin:], b[begin:]
    differ = a[len(a) - len(b) :][::-1] != b[::-1]
    end = int(differ.argmax()) if differ.any() else len(b)
    return a[: len(a) - end], b[: len(b) - end]


def _by_rows(a: np.ndarray, b: np.ndarray) -> int:
    """Row by row, in memory that grows with the lengths only: for pairs whose table of matches would be too large."""
    steps = np.arange(len(b) + 1)
    row = steps.copy()
    for x in a:
        best = row + 1
        np.minimum(best[1:], row[:-1] + (b != x), out=best[1:])
        row = np.minimum.accumulate(best - steps) + steps
    return int(row[-1])


def _together(pairs: list[Pair]) -> np.ndarray:
    """Distances of pairs (pattern, text), neither empty, in order of falling numbers of steps."""
    m, n = (np.array([len(p[i]) for p in pairs]) for i in (0, 1))
    blocks = (m + 63) // 64
    steps = n + blocks - 1
    ids = np.arange(len(pairs))
    lane_end = np.cumsum(blocks)
    block = np.arange(lane_end[-1]) - np.repeat(lane_end - blocks, blocks)

    # matches: for each distinct symbol of a pattern, a bit for each of its places; nothing matches in the first words
    codes = np.unique(np.concatenate([x for p in pairs for x in p]), return_inverse=True)[1].astype(np.int64)
    sizes = np.column_stack([m, n]).ravel()
    is_pattern = np.repeat(np.tile([True, False], len(pairs)), sizes)
    keys = np.repeat(np.repeat(ids, 2), sizes) * (int(codes.max()) + 1) + codes
    symbols, of_place = np.unique(keys[is_pattern], return_inverse=True)
    owner = symbols // (int(codes.max()) + 1)
    widest = int(blocks.max())
    row_at = widest + np.cumsum(blocks[owner]) - blocks[owner]
    matches = np.zeros(widest + int(blocks[owner].sum()), dtype=U64)
    place = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
    np.add.at(matches, row_at[of_place] + place // 64, U64(1) << (place % 64).astype(U64))
    # the texts as rows of matches, with room for blocks that have not begun or are done
    found = np.minimum(np.searchsorted(symbols, keys[~is_pattern]), len(symbols) - 1)
    room = n + 2 * (blocks - 1)
    text_at = np.cumsum(room) - room + blocks - 1
    text = np.zeros(int(room.sum()), dtype=np.int64)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    text[np.repeat(text_at, n) + at] = np.where(symbols[found] == keys[~is_pattern], row_at[found], 0)

    pointer = np.repeat(text_at, blocks) - block
    up = np.full(lane_end[-1], ~U64(0))
    down = np.zeros(lane_end[-1], dtype=U64)
    in_up, in_down = np.zeros(lane_end[-1], dtype=U64), np.zeros(lane_end[-1], dtype=U64)
    first, last, bit = lane_end - blocks, lane_end - 1, ((m - 1) % 64).astype(U64)
    in_up[first] = U64(1)
    score = m.astype(np.int64)
    one, top = U64(1), U64(63)
    active = len(pairs) - np.searchsorted(steps[::-1], np.arange(int(steps[0])), side="right")
    k = 0
    for t in range(int(steps[0])):
        if active[t] != k:
            k = int(active[t])
            size = int(lane_end[k - 1])
            up, down, in_up, in_down, pointer, block = up[:size], down[:size], in_up[:size], in_down[:size], pointer[:size], block[:size]
            heads, tails, shift = first[:k], last[:k], bit[:k]
        eq = matches.take(text.take(pointer) + block)
        pointer += 1
        x = eq | down
        eq |= in_down
        h = (((eq & up) + up) ^ up) | eq
        plus = down | ~(h | up)
        minus = up & h
        score[:k] += ((plus[tails] >> shift) & one).astype(np.int64)
        score[:k] -= ((minus[tails] >> shift) & one).astype(np.int64)
        plus_out, minus_out = plus >> top, minus >> top
        plus = (plus << one) | in_up
        minus = (minus << one) | in_down
        up = minus | ~(x | plus)
        down = plus & x
        in_up[1:], in_down[1:] = plus_out[:-1], minus_out[:-1]
        in_up[heads], in_down[heads] = one, U64(0)
    return score


def _batches(pairs: list[tuple[int, Pair]]) -> Iterator[list[tuple[int, Pair]]]:
    """Runs of pairs that fit together."""
    batch, lanes, words, symbols = [], 0, 0, 0
    for i, pair in pairs:
        width = (len(pair[0]) + 63) // 64
        own = width * min(len(pair[0]), len(np.unique(pair[0])))
        # a text has room for blocks that have not begun or are done
        size = len(pair[0]) + len(pair[1]) + 2 * width
        if batch and (lanes + width > LANES or words + own > BATCH_WORDS or symbols + size > SYMBOLS):
            yield batch
            batch, lanes, words, symbols = [], 0, 0, 0
        batch.append((i, pair))
        lanes += width
        words += own
        symbols += size
    if batch:
        yield batch


def edit_distances(pairs: list[Pair]) -> np.ndarray:
    """Least insertions, deletions and substitutions between the two sequences (arrays of integers) of each pair."""
    out = np.zeros(len(pairs), dtype=np.int64)
    rest = []
    for i, (a, b) in enumerate(pairs):
        a, b = _trimmed(np.asarray(a), np.asarray(b))
        if not len(b):
            out[i] = len(a)
        elif (len(a) + 63) // 64 * len(np.unique(a)) > TABLE_WORDS:
            out[i] = _by_rows(b, a)
        else:
            rest.append((i, (a, b)))
    rest.sort(key=lambda r: -(len(r[1][1]) + (len(r[1][0]) + 63) // 64))
    for batch in _batches(rest):
        out[[i for i, _ in batch]] = _together([p for _, p in batch])
    return out
