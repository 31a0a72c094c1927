"""Tables on disk that are replaced, packed or compacted so that a job that dies half-way does no harm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import regroup


class Folders:
    """What is needed of Hadoop's file system, for any scheme that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._path(path))) if self.exists(path) else []

    def rename(self, old: str, new: str) -> None:
        if not self._fs.rename(self._path(old), self._path(new)):
            raise OSError(f"{old} can't be renamed to {new}")

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)


# --- swaps


def recover(spark: SparkSession, path: str) -> None:
    """End a swap that died: a table that is written aside completely takes its place if that is empty; what is half-written goes."""
    folders, aside = Folders(spark, path), f"{path}.next"
    if folders.exists(path):
        folders.delete(aside)
    elif folders.exists(f"{aside}/_SUCCESS"):
        folders.rename(aside, path)
    elif former := _formers(folders, path):
        folders.rename(former[-1], path)


def _formers(folders: Folders, path: str) -> list[str]:
    """Former versions, the latest last."""
    parent, _, name = path.rstrip("/").rpartition("/")
    numbers = sorted(int(n.removeprefix(f"{name}.bak")) for n in folders.names(parent) if n.startswith(f"{name}.bak") and n.removeprefix(f"{name}.bak").isdigit())
    return [f"{parent}/{name}.bak{i}" for i in numbers]


def swap(rows: DataFrame, path: str) -> str:
    """Replace a JSON Lines table by rows that may have been read from it; returns where the former version is kept.

    The rows are written aside (path.next), the former table becomes path.bak1, .bak2, ..., the new one takes its place. Between the two renames there
    is no table at the path: `recover` ends what died there. Both renames are single steps where the file system has such (HDFS, local disks).
    """
    spark = rows.sparkSession
    folders, aside = Folders(spark, path), f"{path}.next"
    rows.write.mode("overwrite").json(aside)
    formers = _formers(folders, path)
    former = f"{path}.bak{int(formers[-1].rpartition('.bak')[2]) + 1 if formers else 1}"
    folders.rename(path, former)
    folders.rename(aside, path)
    return former


def regroup_files(spark: SparkSession, path: str, mapping: DataFrame, dry_run: bool = True) -> dict[str, int]:
    """Give the segments of a records table on disk the calls that a mapping (sample_id, call) names; segment ids stay.

    Returns rows, how many of them change, and calls before and after. A dry run writes nothing. Running it again changes nothing:
    the first sample_id is kept as original_sample_id.
    """
    recover(spark, path)
    rows = spark.read.json(path)
    new = regroup(rows, mapping)
    about = new.agg(F.count("*").alias("rows"), F.countDistinct("sample_id").alias("calls")).first()
    before = rows.select("segment_id", F.col("sample_id").alias("_before"))
    changed = new.join(before, "segment_id").where("not (sample_id <=> _before)").count()
    calls_before = rows.select("sample_id").distinct().count()
    if not dry_run and changed:
        swap(new, path)
    return {"rows": about.rows, "changed": changed, "calls_before": calls_before, "calls": about.calls}


# --- packs

TAG = ["corpus", "lang", "condition"]
MANIFEST = "corpus string, lang string, condition string, files long, rows long, bytes long"


def read_manifest(spark: SparkSession, dest: str) -> DataFrame:
    """What a pack holds: a row for each complete tag."""
    if not Folders(spark, dest).exists(f"{dest}/_manifest"):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(f"{dest}/_manifest")


def pack_pool(pool: DataFrame, dest: str) -> DataFrame:
    """Copy a pool to `dest`/data, a folder for each corpus, language and condition; returns the manifest.

    A tag's files, rows and bytes enter the manifest when all its rows are written, so tags that it names are left alone in the next run, and
    what a run that died has half written is replaced. One job writes all tags that are missing.
    """
    spark = pool.sparkSession
    done = read_manifest(spark, dest).select(*(F.col(c).alias(f"_{c}") for c in TAG))
    same = F.lit(True)
    for c in TAG:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    missing = pool.join(F.broadcast(done), same, "left_anti")  # a row for each tag
    missing.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*TAG).parquet(f"{dest}/data")
    # tags are read as what they are in the pool, whatever their folders' names look like
    kinds = {f.name: f.dataType for f in pool.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in pool.columns)
    held = spark.read.schema(schema).parquet(f"{dest}/data").select(*TAG, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    files = held.groupBy(*TAG, "file").agg(F.count("*").alias("rows"), F.max("size").alias("size"))
    tags = files.groupBy(*TAG).agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), F.sum("size").alias("bytes"))
    tags.join(F.broadcast(done), same, "left_anti").coalesce(1).write.mode("append").json(f"{dest}/_manifest")
    return read_manifest(spark, dest)


def pack_size(manifest: DataFrame) -> DataFrame:
    """Files, rows and megabytes of a pack."""
    return manifest.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.round(F.coalesce(F.sum("bytes"), F.lit(0)) / 1e6, 2).alias("size_mb"))
