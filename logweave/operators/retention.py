"""Retention as a job: whole day partitions of log tables are deleted, by age or by size, from names and sizes of files alone.

A table is a folder with partitions `day=…` at any depth, as append_logs, stream_append and ingest write it. No row is
read and no file is written, so what stays are the same files.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .stats import parse_size

FOLDERS = "kind string, folder string, day date, files long, bytes long"


def day_folders(spark: SparkSession, path: str, kind: str = "index") -> DataFrame:
    """kind, folder, day, files, bytes of each day partition of a table, listed by Spark's own file index.

    A folder of rows without a day has a null day. Files outside any day partition are not listed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    folder, day = (F.regexp_extract("path", r"^(.*/day=([^/]+))/", k) for k in (1, 2))
    found = files.select(folder.alias("folder"), day.alias("day"), "length").where("folder <> ''")
    by_folder = found.groupBy("folder", "day").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    return by_folder.select(F.lit(kind).alias("kind"), "folder", F.try_to_date("day", "yyyy-MM-dd").alias("day"), "files", "bytes")


def older_than(folders: DataFrame, days: int, now: dt.date) -> DataFrame:
    """Folders of days more than `days` before now; those without a day have no age and stay."""
    return folders.where(F.col("day") < F.date_sub(F.lit(now), days))


def beyond(folders: DataFrame, limit: int, sizes: DataFrame | None = None) -> DataFrame:
    """Folders of the oldest days, as many as must go until the rest holds at most `limit` bytes.

    sizes: day, bytes, used instead of the files' sizes where given; a day it lacks counts as 0. Folders without a day count
    in full and stay. The running sum is over one row a day.
    """
    per_day = folders.groupBy("day").agg(F.sum("bytes").alias("bytes"))
    if sizes is not None:
        known = sizes.groupBy(F.col("day").alias("_d")).agg(F.sum("bytes").alias("_b"))
        per_day = per_day.join(known, F.col("day").eqNullSafe(F.col("_d")), "left").select("day", F.coalesce("_b", F.lit(0)).alias("bytes"))
    newest = Window.orderBy(F.desc_nulls_first("day")).rowsBetween(Window.unboundedPreceding, 0)
    gone = per_day.withColumn("sum", F.sum("bytes").over(newest)).where((F.col("sum") > limit) & F.col("day").isNotNull())
    return folders.join(gone.select("day"), "day", "left_semi").select("kind", "folder", "day", "files", "bytes")


def drop_folders(folders: DataFrame) -> DataFrame:
    """Deletes the folders and gives the list of them, one row a folder; one that is gone already is passed over, so a job that was stopped can run again."""
    spark = folders.sparkSession
    rows = folders.orderBy("kind", "day", "folder").collect()  # names of partitions to go, no data
    conf, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    for r in rows:
        at = jvm.org.apache.hadoop.fs.Path(r.folder)
        at.getFileSystem(conf).delete(at, True)
    return spark.createDataFrame(rows, FOLDERS)


def drop_days(spark: SparkSession, days: dict[str, int], now: dt.date) -> DataFrame:
    """Drops day partitions by age: table path to days kept, for logs, archive and statistics each its own. Gives what went."""
    gone = None
    for path, kept in days.items():
        part = older_than(day_folders(spark, path, path), kept, now)
        gone = part if gone is None else gone.unionAll(part)
    return drop_folders(gone) if gone is not None else spark.createDataFrame([], FOLDERS)


def capacity(spark: SparkSession, path: str) -> int:
    """Bytes of the file system that holds the path, of which limits in percent are parts."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getStatus(at).getCapacity()


def drop_bytes(
    spark: SparkSession, limit: int | str, index: str, archive: str | None = None, imports: str | None = None, archive_percent: float = 33, import_limit: int | str | None = None, sizes: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Drops the oldest day partitions of tables that have outgrown their share of `limit` (bytes, 500M, 2G, 1T, or 90% of the disk).

    Nothing goes while index and archive together are below the limit. Otherwise the archive keeps `archive_percent` of
    it, the index the rest, and imports `import_limit`, or half the limit. sizes: kind to a table day, bytes that counts instead
    of the files' sizes. Gives what went.
    """
    whole = parse_size(limit, capacity(spark, index) if str(limit).strip().endswith("%") else 0)
    if whole <= 0:
        raise ValueError(f"limit {limit} leaves nothing")
    share = int(whole * archive_percent / 100) if archive else 0
    tables = {"index": (index, whole - share), "archive": (archive, share), "import": (imports, parse_size(import_limit if import_limit is not None else "50%", whole))}
    sizes = sizes or {}
    known = {kind: day_folders(spark, path, kind) for kind, (path, _) in tables.items() if path}
    used = 0
    for kind in ("index", "archive"):
        if kind in known:
            of = sizes.get(kind, known[kind])
            used += of.join(known[kind].select("day").distinct(), "day", "left_semi").agg(F.sum("bytes")).first()[0] or 0 if kind in sizes else of.agg(F.sum("bytes")).first()[0] or 0
    if used < whole:
        return spark.createDataFrame([], FOLDERS)
    gone = None
    for kind, folders in known.items():
        part = beyond(folders, tables[kind][1], sizes.get(kind))
        gone = part if gone is None else gone.unionAll(part)
    return drop_folders(gone)


__all__ = [k for k in dir() if not k.startswith("_")]
