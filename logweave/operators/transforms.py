"""Transforms of result sets, each a function from DataFrame to DataFrame, and their pipeline."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as fn
from .search import OPERATORS

# The shipped extraction patterns.
PATTERNS = {
    "tld": [
        {"field": "domain", "pattern": r"\.([a-zA-Z]+)$", "extractions": ["tld"]},
        {"field": "site", "pattern": r"\.([a-zA-Z]+)$", "extractions": ["tld"]},
        {"field": "uri", "pattern": r"\.([a-zA-Z]+)(:|/|$)", "extractions": ["tld"]},
    ],
    "url": [
        {
            "field": "uri",
            "pattern": r"(?:([a-zA-Z]+)://)?(?:([^/]+):([^/]+)@)?(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}|[^/]+\.([a-zA-Z]+))(?::(\d+))?(/[^?]*)?(?:\?(.*))?$",
            "extractions": ["proto", "username", "password", "domain", "tld", "port", "resource", "query_string"],
        }
    ],
    "mimetype": [
        {
            "field": "msg",
            "pattern": r"[\"'(\[\s|;:]((application|audio|chemical|image|message|model|multipart|text|video)/([\w_-]+))[\"')\]\s|;:]",
            "extractions": ["mime", "type", "subtype"],
        }
    ],
}


def _hit(df: DataFrame, value: str | int, field: str, op: str | None) -> Column:
    """Whether a value matches in a column (but id and ts) whose name does, or in an entry of `fields`; columns are chosen when the plan is made."""

    def good(v: Column) -> Column:
        if op and op in OPERATORS:
            return F.coalesce(OPERATORS[op](v.try_cast("long"), F.lit(int(value))), F.lit(False))
        return F.coalesce(v.rlike(f"(?i){value}"), F.lit(False))

    out = F.lit(False)
    for c in df.columns:
        if c not in ("id", "ts", "fields") and re.search(field, c, re.IGNORECASE):
            out = out | good(F.col(c).cast("string"))
    if "fields" in df.columns:
        out = out | F.coalesce(F.exists(F.map_entries("fields"), lambda e: e["key"].rlike(f"(?i){field}") & good(e["value"])), F.lit(False))
    return out


def grep(df: DataFrame, value: str | int, field: str = ".", op: str | None = None) -> DataFrame:
    """Rows with a value that matches, in a field whose name matches; with an operator, an integer comparison."""
    return df.where(_hit(df, value, field, op))


def drop_matching(df: DataFrame, value: str | int, field: str = ".", op: str | None = None) -> DataFrame:
    """The rows that grep would not keep."""
    return df.where(~_hit(df, value, field, op))


def local_ips(df: DataFrame, subnets: Sequence[tuple[str, str]], columns: Sequence[str] = ("msg",), remote: bool = False) -> DataFrame:
    """One column `<column>_local` (or `_remote`) for each text column: the first address inside (outside) the subnets."""
    side = "remote" if remote else "local"
    inside = lambda ip: ~fn.is_local(ip, subnets) if remote else fn.is_local(ip, subnets)
    return df.withColumns({f"{c}_{side}": F.try_element_at(F.filter(fn.all_ips(F.col(c)), inside), F.lit(1)) for c in columns})


def remote_ips(df: DataFrame, subnets: Sequence[tuple[str, str]], columns: Sequence[str] = ("msg",)) -> DataFrame:
    return local_ips(df, subnets, columns, remote=True)


def parse_fields(df: DataFrame, patterns: str | Sequence[dict]) -> DataFrame:
    """Captures of each pattern as columns `field.name`, null where the pattern doesn't match; patterns of fields that df lacks are left out."""
    out = {}
    for p in PATTERNS[patterns] if isinstance(patterns, str) else patterns:
        if p["field"] not in df.columns:
            continue
        source = F.col(p["field"])
        for i, name in enumerate(p["extractions"]):
            got = F.regexp_extract(source, p["pattern"], i + 1)
            out[f"{p['field']}.{name}"] = F.when(source.rlike(p["pattern"]) & (got != ""), got)
    return df.withColumns(out)


def highlight(df: DataFrame, terms: Sequence[str], column: str = "msg", before: str = "<b>", after: str = "</b>") -> DataFrame:
    return df.withColumn(column, fn.highlight(F.col(column), terms, before, after))


def format_records(df: DataFrame, catalogue) -> DataFrame:
    """Records with `_fields`, an array of (field, value, class) of the fields that each record's class has."""
    wanted = [(c, f) for c, fs in sorted(catalogue.fields.items()) for f in fs if f in df.columns]
    named = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), F.lit(c).alias("class")) for c, f in wanted])
    return df.withColumn("_fields", F.filter(named, lambda x: (x["class"] == F.col("class")) & x["value"].isNotNull()))


def reference_urls(df: DataFrame, templates: dict[str, list[tuple]]) -> DataFrame:
    """`urls`: for each class its (column, pattern, template) rows, %s being the pattern's first capture; unmatched ones left out.

    A fourth entry is a condition (Column) under which the template is used, such as an address range.
    """
    out = []
    for cls, rows in sorted(templates.items()):
        for column, pattern, template, *only in rows:
            got = F.regexp_extract(F.col(column).cast("string"), pattern, 1)
            test = F.coalesce(only[0], F.lit(False)) if only else F.lit(True)
            out.append(F.when((F.col("class") == cls) & (got != "") & test, F.format_string(template, got)))
    return df.withColumn("urls", F.filter(F.array(*out), lambda u: u.isNotNull()))


def anonymise(df: DataFrame, subnets: Sequence[tuple[str, str]], text: str = "msg", columns: Sequence[str] = ("srcip", "dstip")) -> DataFrame:
    """Local addresses as ?.?.?.N in the text and the columns, N by first appearance (time, then address).

    Numbers are given over the distinct local addresses only, minute by minute of their first appearance: inside a
    minute by a window of its own, on top of the number of addresses of the minutes before, so that the only window over
    all of them has one row a minute. Each record's own addresses are then looked up by a join and put in as whole addresses.
    """
    every = df.select("id", "ts", F.explode(F.array_distinct(F.concat(fn.all_ips(F.col(text)), F.array(*[F.col(c) for c in columns])))).alias("ip"))
    local = every.where(fn.is_local(F.col("ip"), subnets))
    first = local.groupBy("ip").agg(F.min("ts").alias("at"))
    first = first.withColumn("minute", fn.bucket(F.col("at"), "minute"))
    before = first.groupBy("minute").agg(F.count("*").alias("k")).withColumn("before", F.sum("k").over(Window.orderBy("minute")) - F.col("k")).select("minute", "before")
    own = F.row_number().over(Window.partitionBy("minute").orderBy("at", "ip")) - 1
    numbers = first.withColumn("own", own).join(before, "minute").select("ip", (F.col("own") + F.col("before")).cast("long").alias("n"))
    pairs = local.join(numbers, "ip").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("ip", F.concat(F.lit("?.?.?."), F.col("n").cast("string")))))
                                                        .alias("names"))
    out = df.join(pairs, "id", "left")
    name = lambda ip: F.coalesce(F.col("names")[ip], ip)
    between, found = F.split(F.col(text), fn.IPV4), fn.all_ips(F.col(text))
    joined = F.array_join(F.transform(between, lambda s, i: F.concat(s, F.coalesce(name(F.get(found, i)), F.lit("")))), "")
    return out.withColumns({text: joined} | {c: name(F.col(c)) for c in columns}).drop("names")


def _values(df: DataFrame, field: str) -> DataFrame:
    """The field's non-null values as text (column v), arrays by element."""
    one = F.explode(field) if dict(df.dtypes)[field].startswith("array") else F.col(field)
    return df.select(one.alias("v")).select(F.col("v").cast("string").alias("v")).where("v is not null")


def sum_field(df: DataFrame, field: str, numeric_total: bool = True, count: str = "count") -> DataFrame:
    """_groupby, _count, by count: all whole numbers add up under the field's name, other values count 1 each; arrays count by element.

    Where the record has a `count` other than 0, a text adds that instead of 1: under the field's name too, but an array's
    elements each under their own. With numeric_total off all values stand for themselves.
    """
    array = dict(df.dtypes)[field].startswith("array")
    weight = F.nullif(F.col(count).try_cast("long"), F.lit(0)) if count in df.columns and count != field else F.lit(None).cast("long")
    rows = df.select((F.explode(field) if array else F.col(field)).alias("v"), weight.alias("n"))
    values = rows.select(F.col("v").cast("string").alias("v"), "n").where("v is not null")
    digit = F.col("v").rlike("^[0-9]+$") & F.lit(numeric_total)
    total = digit | (F.lit(numeric_total and not array) & F.col("n").isNotNull() & (F.col("v") != ""))
    keys = values.groupBy(F.when(total, F.lit(field)).otherwise(F.col("v")).alias("_groupby"))
    added = F.when(digit, F.col("v").try_cast("long")).otherwise(F.coalesce("n", F.lit(1)))
    return keys.agg(F.sum(added).alias("_count")).orderBy(F.desc("_count"), "_groupby")


def count_field(df: DataFrame, field: str, numeric_total: bool = True) -> DataFrame:
    """_groupby, _count of each value, arrays by element, whole numbers together under the field's name."""
    values = _values(df, field)
    key = F.when(F.col("v").rlike("^[0-9]+$") & F.lit(numeric_total), F.lit(field)).otherwise(F.col("v"))
    return values.groupBy(key.alias("_groupby")).agg(F.count("*").alias("_count")).orderBy(F.desc("_count"), "_groupby")


def interval(df: DataFrame, partition: Sequence[str], order: str = "ts") -> DataFrame:
    """`interval`: seconds since the record before in its partition; the first has the gap behind it, a lone one 0."""
    w = Window.partitionBy(*partition).orderBy(order, "id")
    at = fn.seconds(F.col(order))
    gap = F.coalesce(at - F.lag(at).over(w), F.lead(at).over(w) - at, F.lit(0))
    return df.withColumn("interval", gap.cast("long"))


def cluster(df: DataFrame, field: str, k: int = 10, seed: int = 1) -> DataFrame:
    """`cluster` from 1: k-means on one number field, by Spark's distributed KMeans; rows without the number have none."""
    rows = df.withColumn("_x", F.col(field).cast("double"))
    vectors = VectorAssembler(inputCols=["_x"], outputCol="_features").transform(rows.where("_x is not null"))
    if vectors.isEmpty():
        return df.withColumn("cluster", F.lit(None).cast("int"))
    model = KMeans(k=k, seed=seed, tol=0.001, featuresCol="_features", predictionCol="_p").fit(vectors)
    found = model.transform(vectors).withColumn("cluster", (F.col("_p") + 1).cast("int")).drop("_x", "_features", "_p")
    return found.unionByName(rows.where("_x is null").drop("_x").withColumn("cluster", F.lit(None).cast("int")))


def _best_groups(x: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    """Group (from 1) of each of the sorted numbers x of weights w in the k groups of least squares, by dynamic programming.

    The best last group of the first j numbers starts no earlier for a greater j, so each round halves its ranges.
    """
    x = x - np.average(x, weights=w)
    n, sums = len(x), [np.concatenate([[0.0], np.cumsum(w * x**p)]) for p in (0, 1, 2)]

    def cost(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b, c = (s[j] - s[i] for s in sums)
        return np.maximum(c - b * b / a, 0)

    best = np.concatenate([[0.0], cost(np.zeros(n, np.int64), np.arange(1, n + 1))])
    starts = []
    for g in range(2, k + 1):
        now, start = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        ranges = np.array([[g, n, g - 1, n - 1]])
        while len(ranges):
            low, high, first, last = ranges.T
            mid = (low + high) // 2
            size = np.minimum(mid - 1, last) - first + 1
            of = np.repeat(np.arange(len(mid)), size)
            i = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + first[of]
            value = best[i] + cost(i, mid[of])
            least = np.minimum.reduceat(value, np.cumsum(size) - size)
            hit = np.flatnonzero(value == least[of])
            _, once = np.unique(of[hit], return_index=True)
            at = i[hit[once]]
            now[mid], start[mid] = least, at
            ranges = np.concatenate([np.stack([low, mid - 1, first, at], 1), np.stack([mid + 1, high, at, last], 1)])
            ranges = ranges[ranges[:, 0] <= ranges[:, 1]]
        best = now
        starts.append(start)
    out, j = np.ones(n, np.int64), n
    for g, start in zip(range(k, 1, -1), starts[::-1], strict=True):
        out[start[j] : j] = g
        j = start[j]
    return out


def natural_breaks(counts: DataFrame, column: str = "_count", k: int = 6) -> DataFrame:
    """`shade` from 1 for each row: its count's group among at most k, ordered by count, of least squares within groups.

    The grouping is the best one, over the distinct counts and how often each occurs. These are collected: counts that
    add up to N records have at most sqrt(2 N) distinct values. A null count has no shade.
    """
    x = F.col(column).cast("double")
    distinct = counts.where(F.col(column).isNotNull()).groupBy(x.alias("x")).agg(F.count("*").cast("double").alias("w")).toPandas().sort_values("x")
    shades = _best_groups(distinct["x"].to_numpy(), distinct["w"].to_numpy(), min(k, len(distinct))) if len(distinct) else []
    ranked = counts.sparkSession.createDataFrame(list(zip(distinct["x"].tolist(), map(int, shades), strict=True)), "_x double, shade int")
    return counts.join(F.broadcast(ranked) if len(distinct) <= 10_000 else ranked, x == F.col("_x"), "left").drop("_x")


def map_groups(df: DataFrame, key: str, fn_: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """The user's own reducer: fn_ over each group as a pandas frame. Groups must be bounded by the user's key."""
    return df.groupBy(key).applyInPandas(fn_, schema)


Frames = Iterator[pd.DataFrame]


def fold_groups(
    df: DataFrame, key: str, part: Callable[[pd.DataFrame], pd.DataFrame], merge: Callable[[pd.DataFrame], pd.DataFrame], finish: Callable[[pd.DataFrame], pd.DataFrame], partial: str, schema: str, salts: int = 32, most_keys: int = 10_000,
) -> DataFrame:
    """The user's own reducer for groups of any size, which need not fit into memory.

    part: rows of one group to one row of the columns `partial`; merge: several such rows to one, whatever way they are
    grouped and ordered; finish: the last one to rows of `schema`. Rows are dealt by ranges of (key, salt), `salts` for each key, so that a
    key of very many is shared by tasks and one of few lies in one; a task streams them sorted by key and calls part once for each
    key of a batch. Partials, one or a few for each key, are merged by key as sorted streams that hold one key at a time. Rows
    are handed on by `most_keys`. The key is a column of the frames that part and finish get, null as None.
    """
    of_key = f"{key} {df.schema[key].dataType.simpleString()}"
    columns = [f.name for f in df.sparkSession.createDataFrame([], partial).schema]

    def named(keys: list, frame: pd.DataFrame) -> pd.DataFrame:
        frame[key] = pd.Series(keys, index=frame.index, dtype=object)
        return frame

    def runs(frame: pd.DataFrame) -> Iterator[tuple[object, pd.DataFrame]]:
        """The keys of a frame sorted by key, each with its rows."""
        codes = pd.factorize(frame[key], use_na_sentinel=False)[0]
        ends = [*(np.flatnonzero(np.diff(codes)) + 1), len(frame)] if len(frame) else []
        for low, high in zip([0, *ends], ends):
            k = frame[key].iat[low]
            yield (None if pd.isna(k) else k), frame.iloc[low:high]

    def folded(frames: Frames, own: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[tuple[object, pd.DataFrame]]:
        """Each key of a stream sorted by key with its partial, own giving that of the rows of one frame."""
        now, have = None, None
        for frame in frames:
            for k, rows in runs(frame):
                if have is not None and k == now:
                    have = merge(pd.concat([have, own(rows)[columns]], ignore_index=True))
                else:
                    if have is not None:
                        yield now, have
                    now, have = k, own(rows)[columns]
        if have is not None:
            yield now, have

    def together(pairs: Iterator[tuple[object, pd.DataFrame]]) -> Iterator[tuple[list, pd.DataFrame]]:
        """Keys and small frames as larger ones, each of frames of the same types, so that no value changes its own."""
        held: list[tuple[object, pd.DataFrame]] = []
        n = 0
        for k, frame in pairs:
            if held and (n >= most_keys or not frame.dtypes.equals(held[-1][1].dtypes)):
                yield [x for x, _ in held], pd.concat([f for _, f in held], ignore_index=True)
                held, n = [], 0
            held.append((k, frame))
            n += len(frame)
        if held:
            yield [x for x, _ in held], pd.concat([f for _, f in held], ignore_index=True)

    def first(frames: Frames) -> Frames:
        for keys, rows in together(folded(frames, part)):
            yield named(keys, rows)

    def last(frames: Frames) -> Frames:
        one = lambda rows: rows[columns] if len(rows) == 1 else merge(rows[columns].reset_index(drop=True))
        for _, rows in together((k, finish(named([k] * len(have), have.reset_index(drop=True)))) for k, have in folded(frames, one)):
            yield rows

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    dealt = salted.repartitionByRange(n, key, "_salt").drop("_salt").sortWithinPartitions(key)
    partials = dealt.mapInPandas(first, f"{partial}, {of_key}").repartition(n, key).sortWithinPartitions(key)
    return partials.mapInPandas(last, schema)


TRANSFORMS: dict[str, Callable[..., DataFrame]] = {
    "grep": grep, "filter": drop_matching, "local": local_ips, "remote": remote_ips, "parse": parse_fields, "anonymize": anonymise,
    "sum": sum_field, "count": count_field, "interval": interval, "cluster": cluster,
}


def pipeline(df: DataFrame, steps: Sequence[tuple[str, dict]]) -> DataFrame:
    """Transforms by name with their arguments, left to right."""
    for name, arguments in steps:
        df = TRANSFORMS[name](df, **arguments)
    return df


__all__ = [k for k in dir() if not k.startswith("_")]
