"""Scheduled searches that remember how far they came: results and a bookmark by run, in one folder.

A run writes its results under its number, then its bookmark under the same number. Results count once their bookmark stands, and
the next run starts where the last bookmark ends and takes the next number, so a run that stopped between the two writes
is written over by the one that follows, and time that no run covered is covered by the next. One scheduler at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .streams import run_schedule

BOOKMARK = 'run long, "from" long, "to" long'.replace('"', "`")
RESULTS = "schedule long, start long, end long, count long, run long"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What a folder of runs holds; nothing where there is none yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def bookmarks(spark: SparkSession, folder: str) -> DataFrame:
    """run, from, to of each run that ended."""
    return _table(spark, f"{folder}/bookmarks", BOOKMARK)


def results(spark: SparkSession, folder: str) -> DataFrame:
    """schedule, start, end, count, run of all runs that ended."""
    return _table(spark, f"{folder}/results", RESULTS).join(bookmarks(spark, folder).select("run"), "run", "left_semi").select("schedule", "start", "end", "count", "run")


def _write_bookmark(spark: SparkSession, folder: str, run: int, begin: int, now: int) -> None:
    spark.createDataFrame([(begin, now)], "`from` long, `to` long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/bookmarks/run={run}")


def run_due(df: DataFrame, schedule: DataFrame, conditions: dict[int, Column], folder: str, now: int, first: int) -> DataFrame:
    """Runs every enabled schedule's searches that came due since the last bookmark (`first` before there is one), up to now, and keeps them.

    See run_schedule for the columns. Gives the results of this run; a time at or before the bookmark gives none and writes nothing.
    """
    spark = df.sparkSession
    last = bookmarks(spark, folder).agg(F.max("run").alias("run"), F.max("to").alias("to")).first()
    run, begin = (0, first) if last["run"] is None else (last["run"] + 1, last["to"])
    if now <= begin:
        return spark.createDataFrame([], RESULTS)
    path = f"{folder}/results/run={run}"
    run_schedule(df, schedule, conditions, begin, now).write.mode("overwrite").parquet(path)
    _write_bookmark(spark, folder, run, begin, now)
    return results(spark, folder).where(F.col("run") == run)


def expired(schedule: DataFrame, now: int) -> DataFrame:
    """The schedule with those past their end disabled, to be written back."""
    return schedule.withColumn("enabled", F.col("enabled") & (F.col("end") >= now))


__all__ = [k for k in dir() if not k.startswith("_")]
