"""Searches that take their terms from other results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from .bloom import may_be_in, members


def subsearch(df: DataFrame, grouped: DataFrame, field: str | None = None) -> DataFrame:
    """Rows whose field, or any token of whose msg, is a key of the grouped result; no keys, no rows.

    Tokens pass a filter of the keys inside the scan's stage, so only those likely to be keys are joined, with their record.
    """
    keys = grouped.select(F.col("_groupby").cast("string").alias("_k")).where("_k is not null").distinct()
    if field:
        return df.join(keys, df[field].cast("string") == keys["_k"], "left_semi")
    keys = keys.select(F.lower("_k").alias("_k")).distinct()
    rows = df.select(F.monotonically_increasing_id().alias("_row"), F.struct(*df.columns).alias("_r"))
    found = _likely(rows, ["_row", "_r"], F.array_distinct(fn.tokens(F.col("_r.msg"))), keys).join(keys, "_k", "left_semi")
    return found.dropDuplicates(["_row"]).select("_r.*")


def _likely(df: DataFrame, columns: list[str], words: Column, keys: DataFrame) -> DataFrame:
    """The columns with each word (_k) that passes the filter of the keys (_k): what leaves a scan's stage grows with the hits, not with the text."""
    return df.select(*columns, F.explode(words).alias("_k")).where(may_be_in(F.col("_k"), members(keys, "_k")))


def for_each_key(grouped: DataFrame, df: DataFrame, field: str, group: str | None = None) -> DataFrame:
    """For each key of a grouped result the rows that have it (parent_key), or their counts by another field."""
    keys = grouped.select(F.col("_groupby").cast("string").alias("parent_key")).where("parent_key is not null").distinct()
    rows = df.join(keys, df[field].cast("string") == keys["parent_key"])
    return rows.groupBy("parent_key", F.col(group).cast("string").alias("_groupby")).agg(F.count("*").alias("_count")) if group else rows


def _near(df: DataFrame, other: DataFrame, equal: dict[str, str], offset: int, prefix: str) -> DataFrame:
    """Inner join on equal columns and times at most `offset` seconds apart; buckets of that length make the time an equi key too."""
    step = max(1, offset)
    left = df.withColumn("_b", F.explode(F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: F.floor(fn.seconds(F.col("ts")) / step) + d)))
    right = other.select(*[F.col(c).alias(f"{prefix}{c}") for c in other.columns], F.floor(fn.seconds(F.col("ts")) / step).alias("_b2"))
    test = F.col("_b") == F.col("_b2")
    for a, b in equal.items():
        test = test & (F.col(a) == F.col(f"{prefix}{b}"))
    out = left.join(right, test)
    return out.where(F.abs(fn.seconds(F.col("ts")) - fn.seconds(F.col(f"{prefix}ts"))) <= offset).drop("_b", "_b2")


def for_each_record(df: DataFrame, other: DataFrame, field: str, offset: int = 120) -> DataFrame:
    """For each record the records of `other` (columns m_…) of equal field within ±offset seconds."""
    return _near(df, other, {field: field}, offset, "m_")


def match_sessions(df: DataFrame, sessions: DataFrame, regex: str, offset: int = 120, ports: bool = False) -> DataFrame:
    """For each record the sessions (columns s_…) on the same addresses within ±offset seconds whose content matches. sessions: ts, srcip, dstip, content."""
    equal = {"srcip": "srcip", "dstip": "dstip"} | ({"srcport": "srcport", "dstport": "dstport"} if ports else {})
    hits = sessions.where(F.col("content").rlike(regex))
    return _near(df.where("srcip is not null and dstip is not null"), hits, equal, offset, "s_")


def silent_hosts(df: DataFrame, expected: DataFrame, now: Column, grace: int = 60) -> DataFrame:
    """Expected hosts (host, interval in seconds) without a record in their interval plus grace before now."""
    last = df.groupBy("host").agg(F.max("ts").alias("_last"))
    seen = expected.join(last, "host").where(fn.seconds(F.col("_last")) >= F.unix_seconds(now) - F.col("interval") - grace)
    return expected.join(seen.select("host"), "host", "left_anti")


def sweep_terms(df: DataFrame, terms: DataFrame, columns: tuple[str, ...] = ("msg",)) -> DataFrame:
    """Records that hold any of the terms (column term) as a token: id and its sorted terms. Spark picks the join; terms may be many, see subsearch."""
    wanted = terms.select(F.lower("term").alias("_k")).where("_k is not null").distinct()
    words = F.array_distinct(F.flatten(F.array(*[F.coalesce(fn.tokens(F.col(c)), F.array().cast("array<string>")) for c in columns])))
    hits = _likely(df, ["id"], words, wanted).join(wanted, "_k")
    return hits.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("_k")), " ").alias("terms"))


__all__ = [k for k in dir() if not k.startswith("_")]
