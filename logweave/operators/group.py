"""Counts and sums by one key, zero-filled histograms, top groups, merging, paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import UNITS, bucket, epoch_to_iso, seconds
from ..model import META, Catalogue
from .search import OPERATORS


def _top(groups: DataFrame, limit: int, asc: bool = False) -> DataFrame:
    """The first groups by count, equal counts by key; limit 0 means all."""
    ordered = groups.orderBy(F.asc("_count") if asc else F.desc("_count"), "_groupby")
    return ordered.limit(limit) if limit else ordered


def group_count(df: DataFrame, field: str, limit: int = 100, asc: bool = False, catalogue: Catalogue | None = None) -> DataFrame:
    """_groupby, _count of the most frequent values of a field, over rows of the classes that have it."""
    if catalogue and field not in META and catalogue.having(field):
        df = df.where(F.col("class").isin(catalogue.having(field)))
    counts = df.groupBy(F.col(field).cast("string").alias("_groupby")).agg(F.count("*").alias("_count"))
    return _top(counts, limit, asc)


CHUNK = 1 << 16


def _filled(counts: DataFrame, step: int, limit: int, tz: str) -> DataFrame:
    """Buckets (b, _count) with zeros between the first and last, as _groupby (label), intval, _count, ascending.

    The buckets between the two ends are generated by chunks of 65536: the chunks' numbers are dealt over the tasks, which write
    out their own, so that seconds over many years are neither one array nor one task.
    """
    spark = counts.sparkSession
    ends = counts.where("b is not null").agg(F.min("b").alias("low"), F.max("b").alias("high")).where("low is not null")
    chunks = ends.select("low", "high", F.explode(F.expr(f"sequence(low div {CHUNK} - 1, high div {CHUNK} + 1)")).alias("chunk"))
    dealt = chunks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk")
    first, last = F.greatest(F.col("chunk") * CHUNK, F.col("low")), F.least(F.col("chunk") * CHUNK + (CHUNK - 1), F.col("high"))
    every = dealt.where(first <= last).select(F.explode(F.sequence(first, last)).alias("b"))
    out = every.join(counts, "b", "left").select((F.col("b") * step).alias("intval"), F.coalesce("_count", F.lit(0)).cast("long").alias("_count"))
    out = out.select(epoch_to_iso(F.col("intval"), tz).alias("_groupby"), "intval", "_count").orderBy("intval")
    return out.limit(limit) if limit else out


def time_histogram(df: DataFrame, unit: str, limit: int = 0, tz: str = "UTC", ts: str = "ts") -> DataFrame:
    """Count for each second, minute, hour, day, week, month or year (fixed lengths) with empty ones as 0; first `limit` buckets.

    Labels show UTC from days on, and the zone tz below.
    """
    counts = df.groupBy(bucket(F.col(ts), unit).alias("b")).agg(F.count("*").alias("_count"))
    return _filled(counts, UNITS[unit], limit, tz if UNITS[unit] < 86400 else "UTC")


def group_sum(df: DataFrame, field: str, measure: str, limit: int = 100) -> DataFrame:
    """_groupby, _count with the sum of a count column in place of a count of rows."""
    return _top(df.groupBy(F.col(field).cast("string").alias("_groupby")).agg(F.sum(measure).cast("long").alias("_count")), limit)


def group_by_date(df: DataFrame, column: str, bucket_days: int = 30, limit: int = 0) -> DataFrame:
    """Count for each bucket of so many days of a date column, zero-filled."""
    step = bucket_days * 86400
    number = F.floor(F.unix_seconds(F.col(column).cast("timestamp")) / step).cast("long")
    return _filled(df.groupBy(number.alias("b")).agg(F.count("*").alias("_count")), step, limit, "UTC")


def having_count(grouped: DataFrame, n: int, op: str = ">=") -> DataFrame:
    """Groups whose count passes the test, by count; an unknown operator counts as >."""
    test = OPERATORS.get(op, OPERATORS[">"])
    return grouped.where(test(F.col("_count"), F.lit(n))).orderBy(F.desc("_count"), "_groupby")


def merge_groups(parts: Sequence[DataFrame], limit: int = 100) -> DataFrame:
    """Groups of several sources with equal keys added. Exact where the parts are whole."""
    every = parts[0].select("_groupby", "_count")
    for p in parts[1:]:
        every = every.unionByName(p.select("_groupby", "_count"))
    return _top(every.groupBy("_groupby").agg(F.sum("_count").alias("_count")), limit)


def chart_series(df: DataFrame, series: dict[str, Column], unit: str = "hour", key: Column | None = None) -> DataFrame:
    """x and one count column for each labelled condition over a shared x axis, in one pass; x by time unit, or by `key`."""
    x = key if key is not None else (bucket(F.col("ts"), unit) * UNITS[unit])
    counts = [F.count_if(c).alias(label) for label, c in series.items()]
    any_ = F.lit(False)
    for c in series.values():
        any_ = any_ | F.coalesce(c, F.lit(False))
    return df.where(any_).groupBy(x.alias("x")).agg(*counts).orderBy("x")


def label_groups(grouped: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Group keys extended by their attributes: `key attr=value …`; empty attributes are left out."""
    parts = [F.when(F.col(a).isNotNull(), F.concat(F.lit(f"{a}="), F.col(a).cast("string"))) for a in attributes]
    return grouped.withColumn("_groupby", F.concat_ws(" ", "_groupby", *parts)).drop(*attributes)


def result_totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("records_returned"), F.count_distinct("id").alias("total_records"))


def order_by(df: DataFrame, field: str = "ts", desc: bool = False) -> DataFrame:
    """By a field, equal values by id."""
    return df.orderBy(F.desc(field) if desc else F.asc(field), "id")


def page(df: DataFrame, limit: int = 100, offset: int = 0, field: str = "ts", desc: bool = False) -> DataFrame:
    """Rows offset … offset + limit in order; limit 0 means all. Deep pages: see page_after and page_at."""
    if offset and not limit and dict(df.dtypes)[field] in TIMES:
        return page_at(df, range_counts(df, field), offset, 0, field, desc=desc)
    out = order_by(df, field, desc).offset(offset) if offset else order_by(df, field, desc)
    return out.limit(limit) if limit else out


TIMES = ("timestamp", "timestamp_ntz", "date")


def _behind(field: str, desc: bool, value: object, id_: object) -> Column:
    """Whether a row stands behind (value, id) in order_by; null values come first, last if descending."""
    f, later = F.col(field), F.col("id") > F.lit(id_)
    if value is None:
        return f.isNull() & later if desc else f.isNotNull() | later
    beyond = f < F.lit(value) if desc else f > F.lit(value)
    return (beyond | f.isNull() if desc else beyond) | ((f == F.lit(value)) & later)


def page_after(df: DataFrame, mark: tuple | None, limit: int = 100, field: str = "ts", desc: bool = False) -> DataFrame:
    """The next `limit` rows behind a mark, the (field, id) of the last row shown, or the first rows; ids are unique.

    The mark is a filter, which reaches the scan, so a deep page costs no more than the first.
    """
    rows = df if mark is None else df.where(_behind(field, desc, *mark))
    return order_by(rows, field, desc).limit(limit)


def range_counts(df: DataFrame, field: str = "ts", step: int = 3600) -> DataFrame:
    """low, _count: rows in each range of `step` seconds of a time (number of the range times step); low is null for rows without one.

    One row for each range with rows: a table to keep beside the log and to add to as it grows.
    """
    return df.groupBy((F.floor(seconds(F.col(field)) / step) * step).cast("long").alias("low")).agg(F.count("*").alias("_count"))


def page_at(df: DataFrame, counts: DataFrame, offset: int, limit: int = 100, field: str = "ts", step: int = 3600, desc: bool = False) -> DataFrame:
    """Rows offset … offset + limit in order by the counts of their ranges, reading the ranges that hold them; limit 0 means all that follow.

    The running sum is over one row a range. With a limit only ranges that the page touches are read; without one the first
    range gives the mark behind which all rows follow, in a distributed sort.
    """
    order = Window.orderBy(F.desc("low") if desc else F.asc("low"))
    upto = counts.withColumn("end", F.sum("_count").over(order)).withColumn("begin", F.col("end") - F.col("_count")).where(F.col("end") > offset)
    touched = upto.where(F.col("begin") < offset + limit) if limit else upto.orderBy("begin").limit(1)
    ranges = touched.orderBy("begin").collect()  # as many as the page has rows, at most
    if not ranges:
        return df.where("false")
    at, skip = seconds(F.col(field)), offset - ranges[0]["begin"]
    inside = lambda r: at.isNull() if r["low"] is None else (at >= r["low"]) & (at < r["low"] + step)
    if not limit:
        first = order_by(df.where(inside(ranges[0])), field, desc)
        last = first.select(field, "id").offset(skip - 1).limit(1).first() if skip else None
        if last is not None:
            return order_by(df.where(_behind(field, desc, last[0], last[1])), field, desc)
        low = ranges[0]["low"]
        rest = F.lit(True) if low is None and not desc else at.isNull() if low is None else (at < low + step) | at.isNull() if desc else at >= low
        return order_by(df.where(rest), field, desc)
    bounds = [r["low"] for r in ranges if r["low"] is not None]
    test = (at >= min(bounds)) & (at < max(bounds) + step) if bounds else F.lit(False)
    if len(bounds) < len(ranges):
        test = test | at.isNull()
    return order_by(df.where(test), field, desc).offset(skip).limit(limit)


def merge_results(parts: Sequence[DataFrame], field: str = "ts", limit: int = 100, desc: bool = False) -> DataFrame:
    """Records of several peers in one order."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    return page(every, limit, 0, field, desc)


def union_tables(parts: Sequence[DataFrame], limit: int = 100, offset: int = 0, field: str = "ts") -> DataFrame:
    """Distinct rows of several tables, paged."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return page(every.distinct(), limit, offset, field)


__all__ = [k for k in dir() if not k.startswith("_")]
