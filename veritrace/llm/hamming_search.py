"""Exact top-k search of binary codes by incremental multi-index hashing."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Radii whose probes of all segments are fewer than this go in one step; beyond that each segment is a step.
PROBES_AT_ONCE = 4_000


def _segment(i: int, dims: int, m: int) -> Column:
    """Bits [i * dims / m, (i + 1) * dims / m) of the sign code: 1 where a component is above 0 (NaN is not)."""
    start, end = i * dims // m, (i + 1) * dims // m
    part = F.slice(F.col("embedding").cast("array<double>"), start + 1, end - start)
    bits = F.transform(part, lambda x: F.when((x > 0) & ~F.isnan(x), 1).otherwise(0))
    value = F.aggregate(bits, F.lit(0), lambda acc, x: acc * 2 + x)
    # a shorter vector has no components here: its bits are 0
    return value * F.pow(F.lit(2), (end - start) - F.size(part)).cast("int")


def _distance(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)


def hamming_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, bits: int | None = None) -> DataFrame:
    """The k nearest vectors of each query by the Hamming distance of their sign codes, exactly.

    vectors, queries: vec_id, embedding (array of numbers); other columns are ignored. Returns query_id,
    rank (1 to k), vec_id, distance; ties go by vec_id, nulls first. A query that is among the vectors
    finds itself too. Null embeddings are neither found nor looked for, repeated rows each count, a shorter vector
    has 0 bits at its end; with fewer than k vectors there are fewer rows; an empty table gives none.

    Codes are cut into segments of about log2(vectors) bits (or `bits`). Vectors of equal code are one entry with
    its k least ids, so a code that many share costs no more than others. In step (r, i) the queries
    that are still open probe segment i with all values at distance r. After it, every code
    within 4 r + i (for four segments) has been seen, so a query closes when its kth distance is
    no more than that. A candidate counts at the first step that reaches it, and only if it
    is no farther than the kth found so far. Only the number of open queries reaches the driver.
    """
    n, dims = vectors.where("embedding is not null").agg(F.count("*"), F.max(F.size("embedding"))).first()
    n_queries = queries.where("embedding is not null").count()
    schema = "query_id long, rank int, vec_id long, distance int"
    if not n or not n_queries or not dims:
        return vectors.sparkSession.createDataFrame([], schema)
    width = bits or min(max(round(math.log2(n + 1)), 6), 24)
    m = max(1, -(-dims // width))
    width = max((i + 1) * dims // m - i * dims // m for i in range(m))
    code = F.array(*(_segment(i, dims, m) for i in range(m)))

    coded = vectors.where("embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), code.alias("code"))
    least = coded.withColumn("place", F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))).where(F.col("place") <= k)
    entries = written(least.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("vec_id"))).alias("ids"), F.count("*").alias("n")), "codes")
    asked = queries.where("embedding is not null").select(F.col("vec_id").cast("long").alias("query_id"), code.alias("query"))
    open_queries = written(asked.select("query").distinct().withColumn("bound", F.lit(dims)), "queries")
    index = entries.select(F.posexplode("code").alias("segment", "value"), "code", "ids", "n")

    steps: list[tuple[int, list[int]]] = []
    for r in range(width + 1):
        whole = math.comb(width, r) * m <= PROBES_AT_ONCE
        steps += [(r, list(range(m)))] if whole else [(r, [i]) for i in range(m)]
    wanted = min(k, n)
    nearest = Window.partitionBy("query").orderBy("distance", F.col("ids")[0]["vec_id"].asc_nulls_first())
    found = None
    for r, segments in steps:
        masks = ",".join(str(sum(1 << b for b in bits)) for bits in combinations(range(width), r))
        probes = (
            open_queries.withColumn("segment", F.explode(F.array(*map(F.lit, segments))))
            .withColumn("mask", F.explode(F.split(F.lit(masks), ",").cast("array<int>")))
            .select("query", "bound", F.col("segment").alias("at"), F.get("query", F.col("segment")).bitwiseXOR(F.col("mask")).alias("probe"))
        )
        # reached by no step before: segments ahead of this one differ by more than r, the others by r at least
        apart = F.zip_with("query", "code", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
        first_seen = F.forall(F.transform(apart, lambda x, j: x >= r + F.when(j < F.col("at"), 1).otherwise(0)), lambda ok: ok)
        # each query stands for thousands of probes, which the planner does not foresee: no broadcast
        new = probes.hint("merge").join(index, (F.col("at") == F.col("segment")) & (F.col("probe") == F.col("value")) & first_seen & (_distance("query", "code") <= F.col("bound")))
        new = new.select("query", "code", "ids", "n", _distance("query", "code").alias("distance"))
        every = new if found is None else found.union(new)
        found = written(every.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= k).drop("place"), "found")
        covered = m * r + segments[-1]
        state = found.groupBy("query").agg(F.sum(F.when(F.col("distance") <= covered, F.col("n")).otherwise(0)).alias("sure"), F.count("*").alias("got"), F.max("distance").alias("far"))
        still = open_queries.select("query").join(state, "query", "left").where(F.coalesce("sure", F.lit(0)) < wanted)
        open_queries = written(still.select("query", F.when(F.col("got") >= k, F.col("far")).otherwise(dims).alias("bound")), "queries")
        if open_queries.isEmpty():
            break
    ranked = found.select("query", "distance", F.explode("ids").alias("id")).select("query", "distance", "id.vec_id")
    by_rank = Window.partitionBy("query").orderBy("distance", F.col("vec_id").asc_nulls_first())
    best = ranked.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k)
    return asked.join(best, "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("distance").cast("int").alias("distance"))
