"""Results and log batches written out, or shaped for it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import functions as fn


def append_logs(df: DataFrame, path: str, batch: int | None = None) -> DataFrame:
    """Appends a batch to the log table, by day and class; gives count and time range of the batch. A ts over 10000 is epoch.

    The figures are taken while the batch is written, which is computed once. With a batch number the batch has its own
    folder, which a second run overwrites.
    """
    if dict(df.dtypes)["ts"] in ("bigint", "int"):
        df = df.withColumn("ts", F.timestamp_seconds("ts"))
    elif dict(df.dtypes)["ts"] == "string":
        df = df.withColumn("ts", F.timestamp_seconds(fn.parse_time(F.col("ts"))))
    at, seen = fn.seconds(F.col("ts")), Observation()
    watched = df.observe(seen, F.count("*").alias("count"), F.min(at).alias("start"), F.max(at).alias("end"))
    writer = watched.withColumn("day", F.to_date("ts")).write.partitionBy("day", "class")
    if batch is None:
        writer.mode("append").parquet(path)
    else:
        writer.mode("overwrite").parquet(f"{path}/batch={batch}")
    got = seen.get
    return df.sparkSession.createDataFrame([(got["count"], got["start"], got["end"])], "count long, start long, end long")


def stream_append(sdf: DataFrame, path: str, checkpoint: str, every: str | None = "60 seconds") -> StreamingQuery:
    """Appends a stream to the log table; without an interval it takes what is there and ends. Nulls become 0 or ''."""
    ts = F.col("ts").cast("timestamp")
    full = sdf.withColumn("ts", ts).fillna(0).fillna("").withColumns({"day": F.to_date("ts"), "hour": fn.bucket(F.col("ts"), "hour"), "minute": fn.bucket(F.col("ts"), "minute")})
    writer = full.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("day", "class")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _pairs(df: DataFrame, fields: Sequence[str], text: str = "=") -> list[Column]:
    return [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}{text}"), F.col(c).cast("string"))) for c in fields]


def to_tsv(df: DataFrame, fields: Sequence[str] = ()) -> DataFrame:
    """Lines: `_groupby \\t _count`, or `timestamp class host program msg` with `field=value` pairs."""
    if "_groupby" in df.columns:
        return df.select(F.concat_ws("\t", "_groupby", F.col("_count").cast("string")).alias("value"))
    at = fn.epoch_to_iso(fn.seconds(F.col("ts")))
    return df.select(F.concat_ws("\t", at, "class", "host", "program", "msg", F.concat_ws(" ", *_pairs(df, fields))).alias("value"))


def to_flat_json(df: DataFrame, fields: Sequence[str] = ()) -> DataFrame:
    """Lines of JSON with keys `Class.field`; class ANY and absent fields are left out."""
    meta = [(c, F.col(c).cast("string")) for c in ("host", "program", "class", "msg") if c in df.columns]
    prefix = F.when(F.upper("class") == "ANY", F.lit("")).otherwise(F.concat("class", F.lit(".")))
    entries = [F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in meta]
    entries += [F.struct(F.concat(prefix, F.lit(f)).alias("key"), F.col(f).cast("string").alias("value")) for f in fields]
    kept = F.filter(F.array(*entries), lambda e: e["value"].isNotNull())
    return df.select(F.to_json(F.map_from_entries(kept)).alias("value"))


def to_json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


MOST_KEYS = 10_000


def record_keys(df: DataFrame) -> list[str]:
    """All keys of the records' `fields` (map) or `_fields` (array of field, value, class), sorted; at most 10 000, as many as a grid may have columns."""
    keys = F.map_keys("fields") if "fields" in df.columns else F.transform("_fields", lambda x: x["field"])
    found = [r[0] for r in df.select(F.explode(keys).alias("k")).distinct().limit(MOST_KEYS + 1).collect()]
    if len(found) > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} keys")
    return sorted(found)


def _last(pairs: str, key: str) -> Column:
    return F.try_element_at(F.filter(pairs, lambda x: x["key"] == key), F.lit(-1))["value"]


def to_csv_grid(df: DataFrame, fields: Sequence[str] | None = ()) -> DataFrame:
    """Columns timestamp, epoch_time, the fields, msg; groups as groupby, values. Write it with write.csv(header=True), which quotes.

    fields None: a column for every key that any record has, found by a pass of its own; of a key that a record has more
    than once the last value counts. What a record lacks is ''.
    """
    if "_groupby" in df.columns:
        return df.select(F.col("_groupby").alias("groupby"), F.col("_count").alias("values"))
    at = fn.seconds(F.col("ts"))
    if fields is None:
        fields = [k for k in record_keys(df) if k not in ("timestamp", "epoch_time", "msg")]
        pairs = F.map_entries("fields") if "fields" in df.columns else F.transform("_fields", lambda x: F.struct(x["field"].alias("key"), x["value"].alias("value")))
        df = df.withColumn("_pairs", pairs)
        named = [_last("_pairs", f) for f in fields]
    else:
        named = [F.col(f).cast("string") for f in fields]
    return df.select(fn.epoch_to_iso(at).alias("timestamp"), at.alias("epoch_time"), *[F.coalesce(v, F.lit("")).alias(f) for f, v in zip(fields, named, strict=True)], "msg")


def to_group_grid(groups: dict[str, DataFrame]) -> DataFrame:
    """groupby, values: a row for each named grouped result with its keys, most frequent first, joined by commas. Results are cut to their limit before."""
    out = None
    for name, grouped in sorted(groups.items()):
        keys = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_count")).alias("n"), "_groupby"))), lambda x: F.coalesce(x["_groupby"], F.lit("")))
        row = grouped.agg(F.array_join(keys, ",").alias("values")).select(F.lit(name).alias("groupby"), "values")
        out = row if out is None else out.unionAll(row)
    return out


def save_results(df: DataFrame, path: str, qid: int, comment: str, uid: int) -> None:
    """Keeps a result under its query number, as JSON rows in one table."""
    rows = to_json_lines(df).withColumns({"qid": F.lit(qid), "comment": F.lit(comment), "uid": F.lit(uid), "saved": F.current_timestamp()})
    rows.write.mode("append").partitionBy("qid").parquet(path)


def load_results(spark: SparkSession, path: str, qid: int, schema: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("qid") == qid).select(F.from_json("value", schema).alias("r")).select("r.*")


def list_saved(saved: DataFrame, uid: int, offset: int = 0, limit: int = 50) -> DataFrame:
    """A user's saved results, newest first, with their number of rows and the total of results."""
    own = saved.where(F.col("uid") == uid).groupBy("qid", "comment").agg(F.max("saved").alias("saved"), F.count("*").alias("rows"))
    total = own.agg(F.count("*").alias("total"))
    return own.crossJoin(total).orderBy(F.desc("saved"), F.desc("qid")).offset(offset).limit(limit)  # total is one row


def query_history(query_log: DataFrame, uid: int, offset: int = 0, limit: int = 50) -> DataFrame:
    """A user's past queries but those of the system, newest first, with their total."""
    own = query_log.where((F.col("uid") == uid) & ~F.coalesce(F.col("system").cast("boolean"), F.lit(False)))
    total = own.agg(F.count("*").alias("total"))
    return own.crossJoin(total).orderBy(F.desc("timestamp"), F.desc("qid")).offset(offset).limit(limit)


def forward_batch(df: DataFrame, path: str, batch: int | None = None) -> None:
    """A closed batch, copied to another folder; with a number, to its own part of it, which a second run overwrites."""
    if batch is None:
        df.write.mode("append").parquet(path)
    else:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def geo_features(df: DataFrame) -> DataFrame:
    """kind (point or line), name, latitude, longitude, and a line's end: one point for each side with a place, a line between two."""
    point = lambda s: F.struct(F.lit("point").alias("kind"), F.col(f"{s}ip").alias("name"), F.col(f"{s}ip_geo.latitude").alias("lat"), F.col(f"{s}ip_geo.longitude").alias("lon"),
                               F.lit(None).cast("double").alias("lat2"), F.lit(None).cast("double").alias("lon2"))
    line = F.struct(
        F.lit("line").alias("kind"), F.concat_ws(" ", "srcip", "dstip").alias("name"), F.col("srcip_geo.latitude").alias("lat"), F.col("srcip_geo.longitude").alias("lon"),
        F.col("dstip_geo.latitude").alias("lat2"), F.col("dstip_geo.longitude").alias("lon2"),
    )
    every = F.filter(F.array(point("src"), point("dst"), line), lambda p: p["lat"].isNotNull() & ((p["kind"] == "point") | p["lat2"].isNotNull()))
    return df.select("id", F.explode(every).alias("p")).select("id", "p.*")


__all__ = [k for k in dir() if not k.startswith("_")]
