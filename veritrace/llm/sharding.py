"""Sharding by a tree of regions, racks and shards: each row descends it by weighted hash draws.

At every node a row draws -ln(u) / weight for each child, u being a hash of the row's key and the child's name, and takes the child
with the least draw. So a child gets rows in proportion to its weight, and a draw depends on nothing but key, name and weight: if a
child's weight grows, rows move only into it, if it shrinks only out of it, and rows that stay in another child see the same
tree below them. What moves is thus confined to the subtrees whose weights change.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered

#: Shards of a rack and racks of a region in a tree that is made for a number of shards.
SHARDS_PER_RACK, RACKS_PER_REGION = 5, 2
#: Bytes that a row counts beside its text.
ROW_BYTES = 16
_BITS = 48


@dataclass(frozen=True)
class Tree:
    """regions -> racks -> shards, each a dict of name -> what is below it; a shard's is its weight."""

    regions: dict[str, dict[str, dict[int, float]]]

    @staticmethod
    def of(n_shards: int, shards_per_rack: int = SHARDS_PER_RACK, racks_per_region: int = RACKS_PER_REGION) -> Tree:
        """Shards 0 to n - 1 of weight 1: racks and regions are filled one after the other."""
        regions: dict[str, dict[str, dict[int, float]]] = {}
        for shard in range(n_shards):
            rack = shard // shards_per_rack
            regions.setdefault(f"region{rack // racks_per_region}", {}).setdefault(f"rack{rack}", {})[shard] = 1.0
        return Tree(regions)

    def shards(self) -> dict[int, float]:
        return {s: w for racks in self.regions.values() for shards in racks.values() for s, w in shards.items()}

    def grown(self, weight: float = 1.0) -> Tree:
        """One more shard, in a new region of its own: the root is the only node whose children change, so rows move into the new shard alone."""
        shard = max(self.shards(), default=-1) + 1
        name = f"grown{shard}"
        if name in self.regions:
            raise ValueError(f"there is a region {name}")
        return Tree(self.regions | {name: {name: {shard: weight}}})

    def weighted(self, region: str, rack: str, shard: int, weight: float) -> Tree:
        """Another weight (0: the shard is given up) for a shard, or a new shard in a rack: rows move into or out of that region only."""
        racks = self.regions.get(region, {})
        return Tree(self.regions | {region: racks | {rack: racks.get(rack, {}) | {shard: weight}}})

    def column(self) -> Column:
        """array<(name, weight, racks: array<(name, weight, shards: array<(name, weight, shard)>)>)>, without what has no weight."""
        regions = []
        for region, racks in self.regions.items():
            below = []
            for rack, shards in racks.items():
                leaves = [F.struct(F.lit(f"s{s}").alias("name"), F.lit(float(w)).alias("weight"), F.lit(s).alias("shard")) for s, w in shards.items() if w > 0]
                if leaves:
                    below.append((sum(w for w in shards.values() if w > 0), F.struct(F.lit(rack).alias("name"), F.lit(float(sum(w for w in shards.values() if w > 0))).alias("weight"), F.array(*leaves).alias("below"))))
            if below:
                regions.append(F.struct(F.lit(region).alias("name"), F.lit(float(sum(w for w, _ in below))).alias("weight"), F.array(*(b for _, b in below)).alias("below")))
        if not regions:
            raise ValueError("a tree without shards of any weight")
        return F.array(*regions)


def _draw(key: Column, node: Column, seed: int) -> Column:
    """-ln(u) / weight; u from the first 48 bits of an MD5, so that any engine can repeat it."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), node["name"], F.lit(":"), key).cast("binary"))
    u = (F.conv(F.substring(digest, 1, _BITS // 4), 16, 10).cast("double") + 0.5) / float(1 << _BITS)
    return -F.log(u) / node["weight"]


def _descend(key: Column, nodes: Column, seed: int, use) -> Column:
    """use(the child with the least draw); each draw is made once."""
    best = F.array_min(F.transform(nodes, lambda n: F.struct(_draw(key, n, seed).alias("draw"), n.alias("node"))))
    return F.transform(F.array(best), lambda b: use(b["node"]))[0]


def shard_of(key: Column, tree: Tree, seed: int = 7) -> Column:
    """The shard of a key (a string, never null): a draw among regions, one among the region's racks, one among the rack's shards."""
    return _descend(key, tree.column(), seed, lambda region: _descend(key, region["below"], seed, lambda rack: _descend(key, rack["below"], seed, lambda leaf: leaf["shard"])))


def shard_rows(docs: DataFrame, tree: Tree, seed: int = 7) -> DataFrame:
    """Write the documents in shards, in order of their ids; returns (doc: all columns of docs as a struct, shard, slot, grown_shard).

    The written rows lie sorted by shard and id, so that a shard is a run of row groups. The doc_id alone decides: a null id is a
    key like any other ('' as text); rows that repeat an id are in one shard. slot: place in the shard from 0, without gaps, by doc_id
    (null first), then the text's CRC-32; rows equal in both stand in any order. grown_shard: where the row goes when the tree has one
    more shard (`Tree.grown`). Shards are as near each other as hash draws make them. Texts may be null, empty or long; columns of any name are kept; an
    empty table gives no rows.
    """
    key = F.coalesce(F.col("doc.doc_id").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    rows = rows.select("doc", shard_of(key, tree, seed).alias("shard"), shard_of(key, tree.grown(), seed).alias("grown_shard"))
    order = [F.col("doc.doc_id").asc_nulls_first(), text_crc32(F.col("doc.text"))]
    return numbered(rows, ["shard"], order, "slot", "shards")


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of a text's UTF-8 bytes; a null text is an empty one."""
    return F.crc32(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def text_size(text: Column) -> Column:
    """Bytes of a text as UTF-8 (null: none) and those of a row."""
    return (F.coalesce(F.octet_length(text.cast("string")), F.lit(0)) + ROW_BYTES).cast("long")
