"""Balanced grouped folds: the largest group left goes to the lightest fold.

Dealing one group after the other would need all groups in one place. But groups of the same size are dealt in a pattern that
follows from the loads before them, so the driver only sees how many groups there are of each size (fewer sizes than the square
root of twice the rows), and each group finds its fold from its place among those of its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import running_sums, same_keys
from ..store import written

#: Up to so many groups are sent to every executor; beyond that rows are shuffled to them.
BROADCAST_GROUPS = 500_000


def picks(loads: np.ndarray, size: int, places: np.ndarray) -> np.ndarray:
    """Which fold each of a run of groups of one size goes to, by its place in the run (from 0).

    A fold's loads before its next groups are load, load + size, load + 2 size, ...; the i-th group takes the i-th least of all folds' values,
    of equal ones that of the first fold.
    """
    low = np.full(len(places), loads.min(), dtype=np.int64)
    high = low + (places + 1) * size
    up_to = lambda v: np.maximum((v[:, None] - loads[None, :]) // size + 1, 0)  # noqa: E731 - values of each fold that are v or less
    while (low < high).any():
        middle = (low + high) // 2
        enough = up_to(middle).sum(axis=1) > places
        low, high = np.where(enough, low, middle + 1), np.where(enough, middle, high)
    rest = places - up_to(low - 1).sum(axis=1)  # how many folds with this very value come before
    at_value = (low[:, None] >= loads[None, :]) & ((low[:, None] - loads[None, :]) % size == 0)
    return (np.cumsum(at_value, axis=1) > rest[:, None]).argmax(axis=1)


def loads_after(loads: np.ndarray, size: int, n: int) -> np.ndarray:
    """The folds' loads once a run of n groups of one size is dealt."""
    low, high = int(loads.min()), int(loads.min()) + n * size
    up_to = lambda v: np.maximum((v - loads) // size + 1, 0)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if up_to(middle).sum() >= n else (middle + 1, high)
    taken = up_to(low - 1)
    last = np.flatnonzero(up_to(low) > taken)[: n - int(taken.sum())]
    taken[last] += 1
    return loads + taken * size


def deal_counts(groups: DataFrame, group: str, n_folds: int, *within: str) -> DataFrame:
    """Adds `part`, the fold from 0, to a written table (within, group, n) that has each group once."""
    sizes = groups.groupBy(*within, "n").agg(F.count("*").alias("m")).collect()
    runs: dict[tuple, dict[int, np.ndarray]] = {}
    for key in sorted({tuple(r[c] for c in within) for r in sizes}, key=str):
        loads = np.zeros(n_folds, dtype=np.int64)
        for n, m in sorted(((r.n, r.m) for r in sizes if tuple(r[c] for c in within) == key), reverse=True):
            runs.setdefault(key, {})[n] = loads
            loads = loads_after(loads, n, m)
    shared = groups.sparkSession.sparkContext.broadcast(runs)
    placed = running_sums(groups.withColumn("one", F.lit(1)), group, ["one"], *within, "n")
    names = [*within, group, "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in within), strict=True)) if within else [()] * len(batch)
            n, at = batch.column("n").to_numpy(), batch.column("at").to_numpy()
            out = np.zeros(len(batch), dtype=np.int32)
            of_run: dict[tuple, list[int]] = {}
            for i, key in enumerate(keys):
                of_run.setdefault((key, int(n[i])), []).append(i)
            for (key, size), rows_of in of_run.items():
                out[rows_of] = picks(shared.value[key][size], size, at[rows_of])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out)], [*names, "part"])

    schema = ", ".join(f"`{c}` {t}" for c, t in placed.select(*names).dtypes)
    return placed.select(*names, F.col("before_one").cast("long").alias("at")).mapInArrow(run, f"{schema}, part int")


def deal_groups(rows: DataFrame, group: str, n_folds: int, *within: str) -> DataFrame:
    """(within, group, n, part): the fold, from 0, of each group, within each value of `within` if given.

    Groups go by falling size, those of a size by their key; each to the fold with the fewest rows so far, the first of several. With as few groups as
    folds every group is a fold. A null key is a group.
    """
    return deal_counts(written(rows.groupBy(*within, group).agg(F.count("*").alias("n")), "groups"), group, n_folds, *within)


def with_parts(rows: DataFrame, dealt: DataFrame, group: str) -> DataFrame:
    """Adds what a table of groups says to their rows."""
    dealt = written(dealt, "folds")
    return same_keys(rows, F.broadcast(dealt) if dealt.count() <= BROADCAST_GROUPS else dealt, group)
