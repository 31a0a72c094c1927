"""Shared pieces of the corpus operators: words, hashes, shared tables."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch of texts.
BATCH_ROWS = 1_000
#: A chunk of texts that is hashed at once holds about this many bytes.
CHUNK_BYTES = 1 << 18

U64 = np.uint64
_GOLDEN = U64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of BATCH_ROWS at most: buffers for Spark's default of 10,000 would grow to hundreds of MB."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id as long and text as string, without the other columns, whatever their names."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def doc_remainder(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a session on a single machine (as in tests) uses a folder of its own; on a cluster it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="veritrace-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/veritrace-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it: cuts the lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Up to so many rows of a looked-up table go to every executor. Keys of more than a row in so many have their own way beyond that.
BROADCAST_ROWS, HOT_KEYS = 500_000, 10_000


def looked_up(rows: DataFrame, table: DataFrame, key: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Left join of written rows with a written table that has each key once; null finds nothing.

    A table of few rows is broadcast. A larger one is shuffled, but for the keys that more than one of HOT_KEYS rows has: there are
    fewer than HOT_KEYS of these, and their rows stay where they are.
    """
    if table.count() <= broadcast_rows:
        return rows.join(F.broadcast(table), key, "left")
    least = max(rows.count() // HOT_KEYS, 1)
    often = written(rows.groupBy(F.col(key).alias("_often")).count().where(F.col("count") > least).select("_often"), "often")
    same = F.col(key).eqNullSafe(F.col("_often"))
    apart = rows.join(F.broadcast(often), same, "left_semi").join(F.broadcast(table.join(F.broadcast(often), same, "left_semi")), key, "left")
    return rows.join(F.broadcast(often), same, "left_anti").join(table, key, "left").unionByName(apart)


def numbered(rows: DataFrame, group: list[str], order: list[Column], name: str, table: str) -> DataFrame:
    """Write rows in order and add `name`: their place within the group from 0, without gaps. Group columns are no part of a struct.

    Rows are dealt by ranges of (group, order, row), so that a group or a value with a third of all rows is spread; a range's rows are numbered where
    they lie, and what lies before a range comes from one count for each range and group. Rows equal in group and order stand in any order.
    """
    ranged = rows.withColumn("_row", F.monotonically_increasing_id())
    keys = [*(F.col(c).asc_nulls_first() for c in group), *order, F.col("_row")]
    ranged = ranged.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row")
    placed = written(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()), table)
    same = [*group, "_part"]
    counts = placed.groupBy(*same).agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = counts.select(*(F.col(c).alias(f"_{c}_") for c in group), F.col("_part").alias("_part_"), (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_from")).alias("_shift"))
    found = F.col("_part") == F.col("_part_")
    for c in group:
        found = found & F.col(c).eqNullSafe(F.col(f"_{c}_"))
    # as many rows as there are ranges, and a few more where a range holds several groups
    return placed.join(F.broadcast(starts), found).withColumn(name, F.col("_at") + F.col("_shift")).select(*rows.columns, name)


def hash_sample(rows: DataFrame, total: int, n: int, *keys: str, ties: str | None = None) -> DataFrame:
    """The n rows with the least hash of their keys, of about `total`: the same in every run. Rows of equal keys go by `ties`.

    A threshold on the hash goes first, so that tasks don't each send n rows to be merged.
    """
    place = F.xxhash64(*keys, F.lit(42))
    if total > 16 * n:
        rows = rows.where(place < int(-(2**63) + 2**64 * (8 * n / total)))
    return rows.orderBy(place, *keys, *([ties] if ties else [])).limit(n)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no result reads any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if "/veritrace-" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Memory that has been freed goes back to the system."""
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def tidy(run):
    """Wrap a function of batches: when a task is done, it gives back memory, as Python workers live on for later tasks."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _byte_values() -> np.ndarray:
    codes = np.arange(256, dtype=U64)
    codes[65:91] += U64(32)
    return mix((codes + U64(1)) * _GOLDEN)


_VALUES = _byte_values()
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_POWERS = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES * 2)
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def text_chunks(column: pa.Array):
    """Yield (first row, byte offsets from 0, bytes) for runs of rows of about CHUNK_BYTES; null is ''."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, side="right")) - 1)
        end = min(end, len(column), row + 4096)
        yield row, offsets[row : end + 1] - offsets[row], data[offsets[row] : offsets[end]]
        row = end


def hash_words(offsets: np.ndarray, data: np.ndarray, word_bytes: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Hash the words of the texts of a chunk, A-Z lower-cased.

    Returns the 64-bit hashes of all words in order, and for each text where its words begin
    (one entry more than texts). A word's hash depends only on its bytes: a polynomial
    over byte values, taken as a difference of prefix sums. word_bytes: which bytes are part of a word.
    """
    word = word_bytes[data]
    before = np.empty(len(data) + 1, dtype=bool)
    before[0] = False
    before[1:] = word
    before[offsets] = False
    starts = np.flatnonzero(word & ~before[:-1])
    after = np.empty(len(data) + 1, dtype=bool)
    after[-1] = False
    after[:-1] = word
    after[offsets] = False
    ends = np.flatnonzero(word & ~after[1:]) + 1
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_VALUES[data] * power[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts]), np.searchsorted(starts, offsets)


def hash_shingles(words: np.ndarray, begins: np.ndarray, k: int) -> list[np.ndarray]:
    """Distinct hashes of the k-word shingles of each text, sorted.

    A text of fewer than k words has its whole sequence as one shingle; one without words has none.
    """
    factor = U64(0xD6E8FEB86659FD93)
    n = len(words)
    joined = np.zeros(max(n - k + 1, 0), dtype=U64)
    for i in range(k if len(joined) else 0):
        joined = joined * factor + words[i : n - k + 1 + i]
    joined = mix(joined + U64(k))
    out = []
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(joined[a : b - k + 1]))
        elif b > a:
            one = np.zeros(1, dtype=U64)
            for x in words[a:b]:
                one = one * factor + x
            out.append(mix(one + U64(b - a)))
        else:
            out.append(np.empty(0, dtype=U64))
    return out


def list_column(arrays: list[np.ndarray], kind: pa.DataType = pa.int64()) -> pa.ListArray:
    """An Arrow list column of 64-bit hashes as signed longs."""
    lengths = np.fromiter((len(x) for x in arrays), dtype=np.int64, count=len(arrays))
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.empty(0, dtype=U64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64) if flat.dtype == U64 else flat, type=kind))
