"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, written

#: Words in a block.
BLOCK = 16
#: Words in a shard, about; a source has no more than MAX_SHARDS shards.
SHARD_WORDS, MAX_SHARDS = 65_536, 100_000
#: No source's target is above this many times its size.
MAX_REPEATS = 3


def capped_targets(sources: DataFrame, cap: float = MAX_REPEATS) -> DataFrame:
    """Add `target` to a table of sources with `source_size` and `weight`.

    Targets share the sum of all sizes by weight; none is above cap times its source's size, and what is
    above goes to the others by weight until none is above. In order of size / weight, the sources
    that end at their cap come first: a source is capped if its cap is below what its weight
    would get of all that the sources before it leave over. One row per source: the windows here
    and in `apportion` run over sources or shards, never over documents.
    """
    in_order = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    most = F.lit(float(cap)) * F.col("source_size")
    table = (
        sources.withColumn("most", most)
        .withColumn("all_words", F.sum("source_size").over(ahead))
        .withColumn("all_weight", F.sum("weight").over(ahead))
        .withColumn("left_words", F.col("all_words") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("left_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("share", F.col("left_words") / F.col("left_weight"))
        .withColumn("capped", F.col("most") < F.col("share") * F.col("weight"))
    )
    # the share of one unit of weight is the one at the first source that is not capped
    unit = F.first(F.when(~F.col("capped"), F.col("share")), ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return table.withColumn("target", F.when(F.col("capped"), F.col("most")).otherwise(unit * F.col("weight"))).select(*sources.columns, "target")


def apportion(parties: DataFrame, group: list[str], votes: str, total: str, order: list[str]) -> DataFrame:
    """Sainte-Laguë: give `total` seats (a column, equal within a group) to a group's parties; adds `seats`.

    Seats go one by one to the highest quotient votes / (2 * seats so far + 1). All but a few seats of each
    party follow from a divisor that gives out too few; only quotients near the last seat are
    listed and ranked, about three for each party. Ties go by `order`. Groups without votes
    get none.
    """
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    n, votes_of_all = F.count("*").over(whole), F.sum(votes).over(whole)
    sized = parties.withColumn("_n", n).withColumn("_v", votes_of_all.cast("double"))
    share = F.col(votes).cast("double") / F.when(F.col("_v") > 0, F.col("_v"))
    low = F.floor(share * F.greatest(F.col(total) - F.col("_n"), F.lit(0)) + 0.5) - 1
    high = F.ceil(share * (F.col(total) + F.col("_n")) + 0.5) + 1
    sized = sized.withColumn("_low", F.coalesce(F.greatest(low, F.lit(0)), F.lit(0)).cast("long")).withColumn("_high", F.coalesce(high, F.lit(0)).cast("long"))
    sized = sized.withColumn("_rest", F.col(total) - F.sum("_low").over(whole))
    # the next quotients of each party; the `rest` highest of a group win a seat each
    listed = sized.where("_high > _low").select("*", F.explode(F.sequence("_low", F.col("_high") - 1)).alias("_seat"))
    quotient = F.col(votes) / (2 * F.col("_seat") + 1)
    best = Window.partitionBy(*(group or [F.lit(0)])).orderBy(quotient.desc(), *order, "_seat")
    won = listed.withColumn("_place", F.row_number().over(best)).where("_place <= _rest").groupBy(*group, *order).agg(F.count("*").alias("_won"))
    keys = [F.col(f"p.{c}").eqNullSafe(F.col(f"w.{c}")) for c in [*group, *order]]
    joined = sized.alias("p").join(won.alias("w"), keys, "left")
    return joined.select(*(f"p.{c}" for c in parties.columns), (F.col("_low") + F.coalesce("_won", F.lit(0))).cast("long").alias("seats"))


def _within(start: Column, end: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.least(end, high) - F.greatest(start, low), F.lit(0))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 7, block: int = BLOCK) -> DataFrame:
    """Say how many words of each document a mix takes.

    docs: doc_id, text, source; other columns are ignored. Size: number of words (0 for null). Sources by
    code point, a null source last, weigh `weights`, repeating. Each source's target (`capped_targets`) is
    cut into blocks of `block` words: Sainte-Laguë gives whole blocks to sources, and each source's
    blocks to its shards, by their words. Shards are made by a seeded hash of the document, so that
    a source with a third of all rows is spread. A shard's documents stand in a seeded order; it gives all its words
    as often as its quota holds them, and the rest as a run of blocks from a seeded place on. So no
    word is taken more than 3 times, and a source's taken words differ from its target by
    a block or two and what empty shards can't give. Returns one row per input row: doc_id, size, source_size,
    target, taken, copies (how often the document's first word is taken; 0 for empty ones). Reruns agree. Repeated
    rows count each; a null id or text does no harm; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text").cast("string")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", F.length("text")).alias("order"))
    sized = written(rows, "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # code points order as UTF-8 bytes do
    rank = F.row_number().over(Window.orderBy(F.col("source").cast("binary").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("rank", rank).withColumn("weight", weight)
    targets = capped_targets(ranked).withColumn("blocks", F.round(F.sum("source_size").over(Window.partitionBy(F.lit(0))) / block).cast("long"))
    seats = apportion(targets.withColumn("votes", F.col("target")), [], "votes", "blocks", ["rank"])
    n_shards = F.greatest(F.least(F.ceil(F.col("source_size") / SHARD_WORDS), F.lit(MAX_SHARDS)), F.lit(1))
    plan = written(seats.select("source", "source_size", "target", "seats", n_shards.alias("n_shards")), "sources")

    placed = sized.alias("d").join(F.broadcast(plan).alias("s") if plan.count() <= 100_000 else plan.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    placed = placed.select("doc_id", "d.source", "size", "order", "source_size", "target", "seats", F.pmod(F.xxhash64(F.lit(seed + 1), "order"), F.col("n_shards")).alias("shard"))
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("seats").alias("seats"))
    quotas = apportion(shards.withColumnRenamed("seats", "blocks"), ["source"], "shard_size", "blocks", ["shard"])
    quotas = quotas.select("source", "shard", "shard_size", F.least(F.col("seats") * block, MAX_REPEATS * F.col("shard_size")).alias("quota"))

    in_shard = Window.partitionBy("source", "shard").orderBy("order", "size", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lined = placed.withColumn("end", F.sum("size").over(in_shard)).alias("d")
    joined = lined.join(quotas.alias("q"), F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d.shard") == F.col("q.shard")))
    full = F.floor(F.col("quota") / F.greatest("shard_size", F.lit(1)))
    rest = F.col("quota") - full * F.col("shard_size")
    first = F.pmod(F.xxhash64(F.lit(seed + 2), "d.source", "d.shard"), F.greatest(F.ceil(F.col("shard_size") / block), F.lit(1))) * block
    begin, end, wrapped = F.col("end") - F.col("size"), F.col("end"), first + rest - F.col("shard_size")
    part = _within(begin, end, first, first + rest) + _within(begin, end, F.lit(0), F.greatest(wrapped, F.lit(0)))
    chosen = ((begin >= first) & (begin < first + rest)) | (begin < wrapped)
    return joined.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (full * F.col("size") + part).cast("long").alias("taken"),
        F.when(F.col("size") > 0, full + chosen.cast("int")).otherwise(0).cast("int").alias("copies"),
    )
