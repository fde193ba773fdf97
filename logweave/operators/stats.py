"""Statistics over logs, loads and queries; other sources; retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as fn


def host_stats(df: DataFrame, batch_ts: Column) -> DataFrame:
    """timestamp, host, class, count of one batch."""
    return df.groupBy("host", "class").agg(F.count("*").alias("count")).select(F.unix_seconds(batch_ts).alias("timestamp"), "host", "class", "count")


ROLLUP = dict(fn.UNITS) | {"quarter": 90 * 86400}


def rollup_stats(stats: DataFrame, unit: str) -> DataFrame:
    """Host statistics by hour, day, week, month, quarter or year of fixed length."""
    step = ROLLUP[unit]
    return stats.groupBy((F.floor(F.col("timestamp") / step) * step).cast("long").alias("timestamp"), "host", "class").agg(F.sum("count").alias("count"))


def queries_per_user(query_log: DataFrame, users: DataFrame, now: Column, days: int = 7, limit: int = 20) -> DataFrame:
    """Users with most queries in the last days. query_log: uid, timestamp; users: uid, username."""
    recent = query_log.where(F.col("timestamp") >= now - F.expr(f"interval {days} days"))
    counts = recent.groupBy("uid").agg(F.count("*").alias("count")).join(users, "uid")
    return counts.select("username", "count").orderBy(F.desc("count"), "username").limit(limit)


def daily_stats(query_log: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Per day number of queries, mean time, sum and mean of results."""
    recent = query_log.where(F.col("timestamp") >= now - F.expr(f"interval {days} days"))
    day = F.date_format("timestamp", "yyyy-MM-dd").alias("day")
    return recent.groupBy(day).agg(
        F.count("*").alias("count"), F.avg("milliseconds").alias("avg_time"), F.sum("num_results").alias("sum_results"), F.avg("num_results").alias("avg_results")
    )


def rate_series(stats: DataFrame, intervals: int = 100) -> DataFrame:
    """bucket, count and bytes per second in equal parts of the table's time range. stats: timestamp (epoch), count, bytes."""
    ends = stats.agg(F.min("timestamp").alias("low"), F.max("timestamp").alias("high"))
    size = F.greatest(F.ceil((F.col("high") - F.col("low") + 1) / intervals), F.lit(1))
    both = stats.crossJoin(F.broadcast(ends.withColumn("size", size)))  # ends is one row
    number = F.floor((F.col("timestamp") - F.col("low")) / F.col("size")).cast("long")
    return both.groupBy(number.alias("bucket")).agg(
        F.sum("count").alias("count"), (F.sum("count") / F.max("size")).alias("per_second"), (F.sum("bytes") / 1024 / F.max("size")).alias("kib_per_second")
    )


def rate_summary(series: DataFrame, column: str = "per_second") -> DataFrame:
    return series.agg(F.min(column).alias("min"), F.avg(column).alias("avg"), F.max(column).alias("max"))


def combine_series(parts: Sequence[DataFrame]) -> DataFrame:
    """Series of several nodes added bucket by bucket."""
    every = parts[0].select("bucket", "count")
    for p in parts[1:]:
        every = every.unionByName(p.select("bucket", "count"))
    return every.groupBy("bucket").agg(F.sum("count").alias("count"))


def coverage(df: DataFrame, kind: str = "class") -> DataFrame:
    """First and last time and number of records for each kind."""
    at = fn.seconds(F.col("ts"))
    return df.groupBy(kind).agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("records"))


def partition_counts(spark: SparkSession, path: str, kind: str = "class") -> DataFrame:
    """Records of a log table by a partition column and day, from the footers of its files: the scan counts, no row is read.

    A session of its own holds the two settings under which Parquet scans take over aggregates.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own.read.parquet(path).groupBy(kind, "day").agg(F.count("*").alias("records"))


def coverage_table(spark: SparkSession, path: str, kind: str = "class") -> DataFrame:
    """coverage of a stored log table by a partition column: counts from footers, times from each kind's first and last day alone.

    Footers keep no ends of times, so those two days are scanned, chosen by partition. One row for each kind and day comes to the
    driver. Of a column that is no partition the table is scanned, as coverage does.
    """
    log = spark.read.parquet(path)
    parts = {f.split("=")[0] for file in log.limit(1).select("_metadata.file_path").collect() for f in file[0].removeprefix(path).split("/") if "=" in f}
    if not {kind, "day"} <= parts:
        return coverage(log, kind)
    totals: dict = {}
    for r in partition_counts(spark, path, kind).collect():
        n, days = totals.setdefault(r[kind], [0, set()])
        totals[r[kind]] = [n + r["records"], {min(known), max(known)} if (known := days | ({r["day"]} - {None})) else set()]
    test = F.lit(False)
    for k, (_, days) in totals.items():
        test = test | (F.col(kind).eqNullSafe(F.lit(k)) & F.col("day").isin(sorted(days)))
    at = fn.seconds(F.col("ts"))
    ends = log.where(test).groupBy(F.col(kind).alias("_k")).agg(F.min(at).alias("start"), F.max(at).alias("end"))
    counts = spark.createDataFrame([(k, n) for k, (n, _) in totals.items()], f"{kind} {log.schema[kind].dataType.simpleString()}, records long")
    return counts.join(ends, F.col(kind).eqNullSafe(F.col("_k")), "left").select(kind, "start", "end", "records")


def batch_summary(good: DataFrame, rejected: DataFrame, text: str = "msg") -> DataFrame:
    """Rows, errors, error rate, time range and bytes of a batch."""
    at = fn.seconds(F.col("ts"))
    g = good.agg(F.count("*").alias("rows"), F.min(at).alias("start"), F.max(at).alias("end"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes"))
    r = rejected.agg(F.count("*").alias("errors"))
    rate = F.when(F.col("rows") + F.col("errors") > 0, F.col("errors") / (F.col("rows") + F.col("errors"))).otherwise(0.0)
    return g.crossJoin(r).withColumn("error_rate", rate)  # one row each


def top_tokens(df: DataFrame, column: str = "msg", n: int = 100, whitelist: Sequence[str] = ()) -> DataFrame:
    """The most frequent tokens but those of the whitelist."""
    words = df.select(F.explode(fn.tokens(F.col(column))).alias("token"))
    return words.where(~F.col("token").isin(list(whitelist)) if whitelist else F.lit(True)).groupBy("token").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "token").limit(n)


# Other sources


def source_search(
    df: DataFrame, kinds: dict[str, str], terms: dict[str, str] | None = None, start: Column | None = None, end: Column | None = None, group: str | None = None, measure: str | None = None, timestamp: str = "timestamp", limit: int = 100,
) -> DataFrame:
    """Search of a user's table. kinds: column to '' (text, fuzzy), int, float or ip_int (shown dotted); terms: column to value.

    Without a group: timestamp and msg, the sorted `column=value` pairs. With one: _groupby, _count, or the sum of `measure`.
    """
    test = F.lit(True)
    for c, v in (terms or {}).items():
        kind = kinds[c]
        if kind == "":
            test = test & F.contains(F.lower(F.col(c)), F.lit(v.lower()))
        elif kind == "ip_int":
            test = test & (F.col(c) == fn.ip_to_long(F.lit(v)))
        else:
            test = test & (F.col(c) == F.lit(v).cast("double" if kind == "float" else "long"))
    if start is not None:
        test = test & (F.col(timestamp) >= start)
    if end is not None:
        test = test & (F.col(timestamp) <= end)
    shown = lambda c: fn.long_to_ip(F.col(c)) if kinds.get(c) == "ip_int" else F.col(c).cast("string")
    rows = df.where(test)
    if group:
        counts = rows.groupBy(shown(group).alias("_groupby")).agg((F.sum(measure) if measure else F.count("*")).cast("long").alias("_count"))
        return counts.orderBy(F.desc("_count"), "_groupby").limit(limit)
    pairs = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), shown(c))) for c in sorted(kinds)]
    return rows.select(F.unix_seconds(F.col(timestamp).cast("timestamp")).alias("timestamp"), F.concat_ws(" ", *pairs).alias("msg"))


def union_sources(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def event_rates(stats: DataFrame, classes: DataFrame) -> DataFrame:
    """Events by class name. stats: class_id, count; classes: id, class."""
    return stats.join(classes.withColumnRenamed("id", "class_id"), "class_id").groupBy("class").agg(F.sum("count").alias("count"))


def query_usage(query_log: DataFrame, users: DataFrame) -> DataFrame:
    """Number of queries and their whole time by user name."""
    used = query_log.groupBy("uid").agg(F.count("*").alias("queries"), F.sum("milliseconds").alias("milliseconds"))
    return used.join(users, "uid").select("username", "queries", "milliseconds")


def extract_recent(alerts: DataFrame, dimensions: dict[str, DataFrame], since: Column, time: str, exclude: tuple[str, str] | None = None) -> DataFrame:
    """Alerts since a time joined with their dimension tables (by key column), without one excluded value, newest first."""
    out = alerts.where(F.col(time) >= since)
    for key, table in dimensions.items():
        out = out.join(table, key)
    if exclude:
        out = out.where(~F.col(exclude[0]).eqNullSafe(F.lit(exclude[1])))
    return out.orderBy(F.desc(time))


# Retention


def retain_days(df: DataFrame, days: int, now: Column, ts: str = "ts") -> DataFrame:
    """Rows of the last days; on a table written by day (a date column `day`) the days prune its partitions."""
    first = F.date_sub(F.to_date(now), days)
    return df.where((F.to_date(ts) >= first) & (F.col("day") >= first) if dict(df.dtypes).get("day") == "date" else F.to_date(ts) >= first)


SIZES = {"": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30, "T": 1 << 40}


def parse_size(limit: int | str, total: int = 0) -> int:
    """Bytes of a limit such as 500M, 2G or 33%."""
    text = str(limit).strip().upper()
    if text.endswith("%"):
        return int(total * float(text[:-1]) / 100)
    unit = text[-1] if text[-1] in SIZES else ""
    return int(float(text[: len(text) - len(unit)]) * SIZES[unit])


def retain_bytes(df: DataFrame, limit: int | str, size: Column, total: int = 0, ts: str = "ts") -> DataFrame:
    """Rows of the newest days whose sizes add up to at most the limit. The running sum is over one row a day."""
    by_day = df.groupBy(F.to_date(ts).alias("_day")).agg(F.sum(size).alias("_n"))
    running = F.sum("_n").over(Window.orderBy(F.desc("_day")))
    kept = by_day.withColumn("_sum", running).where(F.col("_sum") <= parse_size(limit, total)).select("_day")
    return df.withColumn("_day", F.to_date(ts)).join(kept, "_day", "left_semi").drop("_day")


__all__ = [k for k in dir() if not k.startswith("_")]
