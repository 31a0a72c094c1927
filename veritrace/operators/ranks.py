"""Ranks, running sums and ordered pairs over whole tables, without a task that holds a whole group.

A running sum within a group needs its order, and one group may be the whole table. Distinct values are counted first, then dealt
by range into partitions; sums over partitions are small, and give each partition what lies before it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import written

#: Distinct values that one task orders, at least; and blocks of values that one side of pairs is cut into, at most about.
BLOCK, BLOCKS = 50_000, 500


def same_keys(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Inner join on keys, null being equal to null; without keys, right is one row."""
    if not keys:
        return left.join(F.broadcast(right), F.lit(True))
    renamed = right.select(*(F.col(k).alias(f"_{k}_") for k in keys), *(c for c in right.columns if c not in keys))
    condition = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_{k}_"))
        condition = one if condition is None else condition & one
    return left.join(renamed, condition).drop(*(f"_{k}_" for k in keys))


def running_sums(points: DataFrame, value: str, columns: list[str], *keys: str) -> DataFrame:
    """For rows that are distinct in keys and value: before_c, the sum of c over lesser values of the keys, and total_c, that over all. Null comes first."""
    placed = points.repartitionByRange(*(F.col(k) for k in keys), F.col(value).asc_nulls_first()).withColumn("_part", F.spark_partition_id())
    placed = written(placed, "ordered")
    sums = placed.groupBy(*keys, "_part").agg(*(F.sum(c).alias(f"_s_{c}") for c in columns))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    every = Window.partitionBy(*keys)
    offsets = sums.select(
        *keys, "_part", *(F.coalesce(F.sum(f"_s_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in columns), *(F.sum(f"_s_{c}").over(every).alias(f"total_{c}") for c in columns)
    )
    inside = Window.partitionBy(*keys, "_part").orderBy(F.col(value).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    joined = same_keys(placed, offsets, *keys, "_part")
    before = {f"before_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_o_{c}") for c in columns}
    return joined.withColumns(before).drop("_part", *(f"_o_{c}" for c in columns))


def average_ranks(rows: DataFrame, value: str, name: str, *keys: str) -> DataFrame:
    """(keys, value, name, total_n): the rank of each distinct value, ties averaged; rows: keys, value, n."""
    counts = rows.groupBy(*keys, value).agg(F.sum("n").alias("n"))
    ranked = running_sums(counts, value, ["n"], *keys)
    return ranked.select(*keys, value, (F.col("before_n") + (F.col("n") + 1) / 2.0).alias(name), "total_n")


def quantiles(rows: DataFrame, value: str, ps: list[float], *keys: str) -> DataFrame:
    """(keys, quantiles): the exact quantiles of a column's values that are not null, interpolated linearly; null for a group without any.

    Selection by counted ranges: distinct values are counted and placed (`running_sums`), and the values at the two places beside each
    quantile are picked out by a sum that tasks begin on their own; no task holds the values of a group.
    """
    v = F.col(value).cast("double")
    placed = running_sums(rows.groupBy(*keys, v.alias("_v")).agg(F.count(v).alias("n")), "_v", ["n"], *keys)
    picked, out = [], []
    for i, p in enumerate(ps):
        at = (F.col("total_n") - 1) * F.lit(float(p))
        for name, place in (("low", F.floor(at)), ("high", F.ceil(at))):
            held = (F.col("before_n") <= place) & (place < F.col("before_n") + F.col("n"))
            picked.append(F.max(F.when(held, F.col("_v"))).alias(f"_{name}{i}"))
        picked.append(F.max(at - F.floor(at)).alias(f"_part{i}"))
        low, high = F.col(f"_low{i}"), F.col(f"_high{i}")
        out.append(low + (high - low) * F.col(f"_part{i}"))
    return placed.groupBy(*keys).agg(*picked).select(*keys, F.array(*out).alias("quantiles"))


def rank_correlation(rows: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """(keys, spearman): correlation of the ranks; null where one side is constant."""
    points = rows.groupBy(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").alias("n"))
    ranked = same_keys(points, average_ranks(points, "_x", "_rx", *keys).withColumnRenamed("total_n", "_total"), *keys, "_x")
    ranked = same_keys(ranked, average_ranks(points, "_y", "_ry", *keys).drop("total_n"), *keys, "_y")
    a, b = (F.col(c) - (F.col("_total") + 1) / 2.0 for c in ("_rx", "_ry"))
    dot = lambda u, v: F.sum(F.col("n") * u * v)
    return ranked.groupBy(*keys).agg((dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))).alias("spearman"))


def rising_pairs(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> int:
    """Pairs of rows with a < a' and b < b', each counting n n': by merging blocks of doubled size."""
    order = np.lexsort((-b, a))  # of equal a the greater b comes first, so that such pairs never rise
    rank, n = np.unique(b, return_inverse=True)[1][order], n[order].astype(np.int64)
    size, width, total = len(n), 1, 0
    place = np.arange(size)
    while width < size:
        block, right = place // (2 * width), place // width % 2 == 1
        key = block * (size + 1) + rank
        by_key = np.argsort(key, kind="stable")
        weight = np.append(0, np.cumsum(np.where(right, 0, n)[by_key]))
        ordered = key[by_key]
        # what the left half of the same block has below
        below = weight[np.searchsorted(ordered, key[right], side="left")] - weight[np.searchsorted(ordered, block[right] * (size + 1), side="left")]
        total += int((below * n[right]).sum())
        width *= 2
    return total


def _blocks(points: DataFrame, value: str) -> DataFrame:
    """(value, block): values in order, some BLOCK of them or more to a block; a value of more rows than that has its own, an odd one."""
    counts = points.groupBy(value).agg(F.count("*").alias("m"))
    placed = running_sums(counts, value, ["m"])
    size = F.greatest(F.lit(BLOCK), F.ceil(F.col("total_m") / BLOCKS))
    return placed.select(value, (2 * F.floor(F.col("before_m") / size) + (F.col("m") > size).cast("long")).alias(f"{value}_block"))


def concordant_pairs(points: DataFrame) -> int:
    """Pairs of distinct points (y, p, n) with lesser y and lesser p, each counting n n'.

    Both sides are cut into blocks. Pairs in different blocks of both follow from the counts of cells (BLOCKS squared at most, which
    the driver sums); pairs within a block of y, and those within a block of p but not of y, are counted in one task each.
    """
    placed = written(same_keys(same_keys(points, _blocks(points, "y"), "y"), _blocks(points, "p"), "p"), "points")

    def counted(a: str, b: str):
        def run(table: pa.Table) -> pa.Table:
            x, y, n = (table.column(c).to_numpy() for c in (a, b, "n"))
            return pa.table({"pairs": pa.array([str(rising_pairs(x, y, n))])})

        return run

    sums = lambda df: int(df.agg(F.coalesce(F.sum(F.col("pairs").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()[0])
    total = sums(placed.where("y_block % 2 = 0").groupBy("y_block").applyInArrow(counted("y", "p"), "pairs string"))
    narrow = placed.where("p_block % 2 = 0").groupBy("p_block", "y_block", "p").agg(F.sum("n").alias("n"))
    total += sums(narrow.groupBy("p_block").applyInArrow(counted("y_block", "p"), "pairs string"))
    cells = placed.groupBy("y_block", "p_block").agg(F.sum("n").alias("n")).toPandas()
    if len(cells):
        ys, i = np.unique(cells.y_block, return_inverse=True)
        ps, j = np.unique(cells.p_block, return_inverse=True)
        grid = np.zeros((len(ys), len(ps)))
        grid[i, j] = cells.n
        below = np.zeros_like(grid)
        below[1:, 1:] = np.cumsum(np.cumsum(grid, axis=0), axis=1)[:-1, :-1]
        total += int(round(float((grid * below).sum())))
    return total
