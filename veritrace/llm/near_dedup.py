"""Near-duplicate documents by SuperMinHash signatures, banding, verification and union-find."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, _GOLDEN, discard, hash_shingles, hash_words, list_column, mix, text_chunks, texts_of, tidy, written
from .components import connected_components

_LOW = U64(0xFFFFFFFF)
_FAR = U64(0xFFFFFFFFFFFFFFFF)
#: Up to so many ids (16 MB) are sent to every executor; beyond that the texts are shuffled to them.
BROADCAST_IDS = 1_000_000


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures (m values) of sets of 64-bit elements, one row per set.

    Every element gets a random permutation of the m slots, drawn by Fisher-Yates from a
    generator seeded with the element. In round j it offers j + r (r in [0, 1)) to the
    slot that its permutation ranks j-th; each slot keeps its least offer. As later
    rounds offer more, a set is done when no slot holds over j + 1: large sets stop
    after a round or two. Values are 32 bits of round and 32 bits of r. All elements
    of a chunk go through a round together. The row of an empty set is all ones.
    """
    out = np.full((len(sets), m), _FAR, dtype=U64)
    if not any(map(len, sets)):
        return out
    flat = out.reshape(-1)
    elements = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    slots = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(elements), 1))
    rows = np.arange(len(elements))
    step = np.full(1, _GOLDEN)
    for j in range(m):
        drawn = mix(elements + step * U64(j + 1))
        k = j + ((drawn & _LOW) * U64(m - j) >> U64(32)).astype(np.int64)
        slot = slots[rows, k].astype(np.int64)
        slots[rows, k] = slots[rows, j]
        np.minimum.at(flat, owner * m + slot, (U64(j) << U64(32)) | (drawn >> U64(32)))
        more = out.max(axis=1) >= U64(j + 1) << U64(32)
        keep = more[owner]
        if not keep.all():
            elements, owner, rows = elements[keep], owner[keep], rows[keep]
            if not len(elements):
                break
    return out


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of each signature; the band's number is part of it."""
    rows = signatures.shape[1] // bands
    parts = signatures.reshape(len(signatures), bands, rows)
    key = np.arange(1, bands + 1, dtype=U64)[None, :] * _GOLDEN
    for i in range(rows):
        key = mix(key ^ parts[:, :, i])
    return key


def _set_keys(sets: list[np.ndarray]) -> tuple[list[int | None], list[int | None]]:
    """Two 64-bit keys of each set: its class, and what tells apart sets whose class is the same by chance; null for empty ones."""
    digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
    return tuple([d and int.from_bytes(d[a : a + 8], "little", signed=True) for d in digests] for a in (0, 8))


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for row, offsets, data in text_chunks(batch.column("text")):
        yield row, hash_shingles(*hash_words(offsets, data), k)


def _fingerprints(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in _sets(batch, k):
                keys = band_keys(super_minhash(sets, bands * rows), bands)
                own, check = (pa.array(x, pa.int64()) for x in _set_keys(sets))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[row : row + len(sets)],
                        pa.array([len(s) for s in sets], pa.int64()),
                        own,
                        check,
                        list_column([keys[i] if len(s) else keys[i][:0] for i, s in enumerate(sets)]),
                    ],
                    ["doc_id", "n_shingles", "class", "check", "bands"],
                )

    return run


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _sets(batch, k):
                full = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in _set_keys(full)), list_column(full)], ["class", "check", "items"])

    return run


def _told_apart(rows: DataFrame, clashes: DataFrame | None) -> DataFrame:
    """Give sets of a class that others have by chance a class of their own (one of 64 more bits)."""
    if clashes is None:
        return rows
    own = F.when(F.col("clash").isNotNull(), F.xxhash64("class", "check")).otherwise(F.col("class"))
    return rows.join(clashes, "class", "left").withColumn("class", own).drop("clash")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with the exact sizes of their sets and of the intersection."""
    left = sets.select(F.col("class").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("class").alias("b"), F.col("items").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    return both.select("a", "b", F.size("x").alias("na"), F.size("y").alias("nb"), F.size(F.array_intersect("x", "y")).alias("common"))


def _edges(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))


def _known_edges(roots: DataFrame) -> DataFrame:
    """What is known of components, as edges: far fewer rounds from here than from all links."""
    return roots.select(F.col("node").alias("u"), F.col("root").alias("v"))


def _open(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Of rows (key, class, ...) those of buckets that hold several components, with the component's root."""
    placed = rows.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    several = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
    return placed.join(several, "key", "left_semi")


def _support(rows: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """How many items of each class in an open bucket are in another such class too (class, shared).

    A set has no more in common with any other than that.
    """
    classes = _open(rows, roots).select("class").distinct()
    items = sets.join(classes, "class", "left_semi")
    alone = items.select("class", F.explode("items").alias("item")).groupBy("item").agg(F.min("class").alias("class"), F.count("*").alias("n")).where("n = 1")
    lonely = alone.groupBy("class").agg(F.count("*").alias("alone"))
    return items.select("class", F.size("items").alias("all")).join(lonely, "class", "left").select("class", (F.col("all") - F.coalesce("alone", F.lit(0))).alias("shared"))


def _prefix_pairs(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes of different components that may be linked, by prefix filtering.

    rows: key, class, n, root of open buckets. Two linked sets of sizes n1 <= n2 have at least
    c = percent * (n1 + n2) / (100 + percent) items in common; so if the items of each stand in order of
    rarity, one of the first n - c + 1 of both is the same. The lesser set needs only as many as if the other were no larger (a ninth
    of it, at 80 percent), the greater as if the other were as small as it may be (a fifth). Edited copies that are too
    far from all others, or fill a common template, begin with items of their own and meet nobody. One side of a pair is
    not in the component with most of a bucket's classes: of any pair across components one is such.
    """
    whole, part = 100 + int(percent), int(percent)
    sizes = rows.groupBy("key", "root").agg(F.count("*").alias("classes")).groupBy("key").agg(F.max(F.struct("classes", "root"))["root"].alias("main"))
    minor = rows.join(sizes, "key").where("root <> main").select("class").distinct().withColumn("minor", F.lit(True))
    classes = rows.select("class", "n", "root").distinct().join(minor, "class", "left")
    items = sets.join(classes, "class").select("class", "n", "root", F.coalesce("minor", F.lit(False)).alias("minor"), F.explode("items").alias("item"))
    counts = written(items.groupBy("item").agg(F.count("*").alias("holders")).where("holders > 1"), "holders")
    # items that only one class has stand first and match nothing
    ordered = items.join(counts, "item", "left").withColumn(
        "rank", F.row_number().over(Window.partitionBy("class").orderBy(F.col("holders").asc_nulls_first(), "item"))
    )
    prefix = written(ordered.where(f"holders > 1 and 100L * (n - rank + 1) >= {part}L * n").withColumn("short", F.expr(f"{whole}L * (n - rank + 1) >= {2 * part}L * n")), "prefixes")
    x, y = (prefix.select("item", "short", *(F.col(c).alias(c + side) for c in ("class", "n", "root", "rank", "minor"))) for side in "12")
    x, y = x.where("short").drop("short"), y.drop("short")
    found = x.where("minor1").join(y, "item").union(x.where("not minor1").join(y.where("minor2"), "item"))
    found = found.where(f"(n1 < n2 or n1 = n2 and class1 < class2) and root1 <> root2 and 100L * n1 >= {part}L * n2")
    for side in "12":
        found = found.where(f"{whole}L * (n{side} - rank{side} + 1) >= {part}L * (n1 + n2)")
    return found.select(F.least("class1", "class2").alias("a"), F.greatest("class1", "class2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 32, rows: int = 5) -> DataFrame:
    """Group near-duplicate documents.

    docs: doc_id (long), text; other columns are ignored. Words are runs of non-white-space,
    A-Z lower-cased. Two documents are linked if 100 * common >= percent * union for their
    sets of `shingle`-word shingles; a document of fewer words has its whole sequence
    as one shingle; one without words, or with null text, has an empty set and is
    linked with nothing. Returns one row per input row: doc_id, n_shingles, component_id
    (least doc_id reachable over links), kept (doc_id = component_id). Rows that repeat a
    doc_id are judged each by its own text; a null doc_id never leads a group
    unless all ids of its group are null (then component_id is null and kept false). Ties
    go to the least id. An empty table gives an empty result.

    Documents with equal sets (by 128 bits of hash) are one class from the start, so copies cost one row each. Classes that
    share a band key are candidates. In a bucket every class is compared with one hub
    (its least class), not with all others. Buckets that hold several components after that get
    a second hub, the class whose items are shared most: in a family of edited copies, the one that
    all others come from. Classes that are still apart are compared across components if they share one
    of their rarest items (prefix filtering, which loses no link). All links are confirmed on the full sets of 64-bit hashes. With 32 bands of 5
    rows a pair at exactly 0.8 is missed with probability 3e-6, a closer one with less.
    """
    spark = docs.sparkSession
    texts = texts_of(docs)
    prints = written(
        texts.mapInArrow(tidy(_fingerprints(shingle, bands, rows)), "doc_id long, n_shingles long, class long, check long, bands array<long>"), "fingerprints"
    )
    clashes = prints.where("class is not null").groupBy("class").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high")
    clashes = written(clashes.select("class", F.lit(True).alias("clash")), "clashes")  # hardly ever any
    clashes = None if clashes.isEmpty() else clashes
    prints = _told_apart(prints, clashes)
    classes = prints.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands"))
    keyed = written(classes.select("class", "n", "doc_id", F.explode("bands").alias("key")), "bands")
    buckets = keyed.groupBy("key").agg(F.min("class").alias("hub"), F.count("*").alias("members")).where("members > 1")
    members = written(
        keyed.join(buckets, "key").select("key", "hub", "members", "class", "n", "doc_id"), "members"
    )
    first = members.where("class <> hub").select(F.col("hub").alias("a"), F.col("class").alias("b")).distinct()
    wanted = written(members.select("class", "doc_id").distinct(), "wanted")
    leaders = wanted.where("doc_id is not null").select("doc_id").distinct()
    if leaders.count() <= BROADCAST_IDS:
        leaders = F.broadcast(leaders)
    # rows that repeat a leader's id with another text come along and go at the join of the classes
    led = texts.join(leaders, "doc_id", "left_semi").select("text").union(texts.where("doc_id is null").select("text"))
    sets = written(
        _told_apart(led.mapInArrow(tidy(_full_sets(shingle)), "class long, check long, items array<long>"), clashes)
        .select("class", "items")
        .join(wanted.select("class"), "class", "left_semi")
        .dropDuplicates(["class"]),
        "sets",
    )
    tested = written(_verified(first, sets), "tested")
    linked = F.expr(f"100L * common >= {int(percent)}L * (na + nb - common)")
    roots = connected_components(_edges(tested.where(linked)))

    # Buckets that hold several components now: their most supported class is a second hub.
    crowded = members.where("members > 2").select("key", "class", "n")
    still_open = written(_open(crowded, roots).join(_support(crowded, roots, sets), "class"), "open")
    hubs = still_open.groupBy("key").agg(F.max(F.struct(F.col("shared") / F.col("n"), "class", "root")).alias("hub"))
    again = still_open.join(hubs, "key").where("root <> hub.root")
    again = again.select(F.least("class", "hub.class").alias("a"), F.greatest("class", "hub.class").alias("b")).distinct()
    again = written(_verified(again.join(tested.select("a", "b"), ["a", "b"], "left_anti"), sets), "tested")
    roots = connected_components(_known_edges(roots).union(_edges(again.where(linked))))

    # What is open even so is compared across components where a prefix of rare items is shared.
    left = written(_open(still_open.select("key", "class", "n"), roots), "open")
    last = _prefix_pairs(left, sets, percent)
    done = tested.select("a", "b").union(again.select("a", "b"))
    last = written(_verified(last.join(done, ["a", "b"], "left_anti"), sets), "tested")
    more = written(_edges(last.where(linked)), "links")
    if not more.isEmpty():
        roots = connected_components(_known_edges(roots).union(more))
    discard(keyed, members, wanted, sets, tested, still_open, again, left, last, more)
    named = prints.select("doc_id", "n_shingles", "class").join(roots.withColumnRenamed("node", "class"), "class", "left")
    named = named.withColumn("root", F.coalesce("root", "class"))
    least = named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    # rows without words find no partner; a key of their own spreads them over the tasks
    spread = named.withColumn("root", F.coalesce("root", F.xxhash64("doc_id"))).withColumn("empty", F.col("n_shingles") == 0)
    out = spread.join(least, "root", "left").withColumn("component_id", F.when(F.col("empty"), F.col("doc_id")).otherwise(F.col("least")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))

