"""Operators on streams, and their batch forms."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import functions as fn
from ..operators.search import search
from ..operators.stats import batch_summary
from ..sources.sinks import append_logs


def live_tail(sdf: DataFrame, all: Sequence = (), any: Sequence = (), none: Sequence = (), permitted: Column | None = None) -> DataFrame:
    """A standing search over arriving rows, with the time of their arrival."""
    rows = sdf.where(permitted) if permitted is not None else sdf
    return search(rows, all, any, none).withColumn("arrived", F.current_timestamp())


def tail_for(stream: DataStreamWriter, seconds: int = 3600) -> StreamingQuery:
    """Starts a standing search and ends it after its time, or earlier where it ends by itself; gives the query, for its progress or error."""
    query = stream.start()
    if not query.awaitTermination(seconds):
        query.stop()
    return query


def ingest(lines: DataFrame, parse: Callable[[DataFrame], tuple[DataFrame, DataFrame]], path: str, summary: str, checkpoint: str, every: str | None = "60 seconds") -> StreamingQuery:
    """Micro-batches of lines: parsed, appended to the log table at `path`, each summed up at `summary` under its number.

    A batch that runs again after a failure overwrites its own files, so none counts twice.
    """

    def one(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        good, rejected = parse(batch)
        good = good.withColumn("ts", F.timestamp_seconds("ts"))
        good.withColumn("day", F.to_date("ts")).write.mode("overwrite").partitionBy("day", "class").parquet(f"{path}/batch={number}")
        batch_summary(good, rejected).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{summary}/batch={number}")
        batch.unpersist()

    writer = lines.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def run_schedule(df: DataFrame, schedule: DataFrame, conditions: dict[int, Column], bookmark: int, now: int) -> DataFrame:
    """schedule, start, end, count of matching rows in [start, end) for each run due since the bookmark, missed ones included.

    schedule: id, frequency (seconds), enabled, start, end; runs are at multiples of the frequency, of enabled schedules,
    inside their dates. Schedules are few and set by users, and are collected; all their runs are one job, and a row
    finds its run of each schedule by arithmetic.
    """
    at = fn.seconds(F.col("ts"))
    hits, spans = [], []
    for r in schedule.where("enabled").collect():
        step, first, last = r["frequency"], bookmark - bookmark % r["frequency"], now - now % r["frequency"]
        begin = at - F.pmod(at, F.lit(step))
        hit = conditions[r["id"]] & (at >= first) & (at < last) & (begin + step).between(r["start"], r["end"])
        hits.append(F.struct(F.lit(r["id"]).cast("long").alias("schedule"), begin.alias("start"), (begin + step).alias("end"), F.coalesce(hit, F.lit(False)).alias("hit")))
        spans.append((first, last))
    if not hits:
        return df.sparkSession.createDataFrame([], "schedule long, start long, end long, count long")
    rows = df.where((at >= min(a for a, _ in spans)) & (at < max(b for _, b in spans))).select(F.explode(F.array(*hits)).alias("h")).where("h.hit")
    return rows.groupBy("h.schedule", "h.start", "h.end").agg(F.count("*").alias("count")).select("schedule", "start", "end", "count")


def throttle_stream(sdf: DataFrame, threshold: int, key: str = "schedule", at: str = "at", late: str | None = None) -> DataFrame:
    """Alerts (key, at in epoch seconds) but those within `threshold` seconds of the last one let through, for each key.

    late: how far an alert may be behind the newest one seen, such as "10 minutes". Alerts then wait as state of their key until the
    watermark has passed them, and leave in the order of their times, however they arrived; those behind the watermark
    (at first, those before 1970) are dropped. What waits is distinct seconds of that span, without those that the last alert let through silences
    already. Without `late` nothing waits: the alerts of a key are put in order inside a micro-batch, and one that arrives in a
    later micro-batch than a later alert is measured against that one.
    """
    if late is not None:
        return _throttle_in_order(sdf, threshold, key, at, late)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        kept = []
        for t in np.unique(np.concatenate([frame[at].to_numpy() for frame in frames])).tolist():
            if last is None or t - last >= threshold:
                kept.append(t)
                last = t
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: [k[0]] * len(kept), at: kept})

    return sdf.select(F.col(key).cast("long"), F.col(at).cast("long")).where(F.col(at).isNotNull()).groupBy(key).applyInPandasWithState(step, f"{key} long, {at} long", "last long", "append", GroupStateTimeout.NoTimeout)


def _throttle_in_order(sdf: DataFrame, threshold: int, key: str, at: str, late: str) -> DataFrame:
    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = state.get if state.exists else (None, [])
        waiting = np.array(waiting, np.int64)
        if not state.hasTimedOut:
            for frame in frames:
                waiting = np.union1d(waiting, frame["second"].to_numpy())
                waiting = waiting if last is None else waiting[waiting >= last + threshold]
        passed, kept = state.getCurrentWatermarkMs(), []
        while len(waiting) and waiting[0] * 1000 <= passed:
            last = int(waiting[0])
            kept.append(last)
            waiting = waiting[np.searchsorted(waiting, last + threshold) :]
        if last is None and not len(waiting):
            return
        state.update((last, waiting.tolist()))
        if len(waiting):
            state.setTimeoutTimestamp(max(int(waiting[0]) * 1000, passed + 1))
        yield pd.DataFrame({key: pd.Series([k[0]] * len(kept), dtype="Int64"), at: np.array(kept, np.int64)})

    rows = sdf.select(F.col(key).cast("long").alias(key), F.col(at).cast("long").alias("second")).where("second is not null")
    rows = rows.withColumn("moment", F.timestamp_seconds("second")).withWatermark("moment", late)
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} long, {at} long", "last long, waiting array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def throttle_alerts(df: DataFrame, threshold: int, key: str = "schedule", at: str = "at") -> DataFrame:
    """The batch form: a fold along each schedule's alerts, streamed in order through each partition, none held whole."""
    ordered = df.select(F.col(key).cast("long"), F.col(at).cast("long")).repartition(key).sortWithinPartitions(key, at)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, None
        for frame in frames:
            keep = []
            for k, t in zip(frame[key], frame[at], strict=True):
                good = k != now or t - last >= threshold
                if good:
                    now, last = k, t
                keep.append(good)
            yield frame[keep]

    return ordered.mapInPandas(fold, f"{key} long, {at} long")


def pair_http(df: DataFrame, key: str, kind: str, timeout: int = 10) -> DataFrame:
    """Requests with the response that follows on the same key within the timeout, else with none; lone responses are dropped.

    df: id, ts, key, kind (`request` or `response`). A new request on a key closes the one before.
    """
    w = Window.partitionBy(key).orderBy("ts", "id")
    ahead = lambda c: F.lead(c).over(w)
    rows = df.select(key, "id", "ts", kind, ahead(kind).alias("_k"), ahead("ts").alias("_t"), ahead("id").alias("_i"))
    answered = (F.col("_k") == "response") & (fn.seconds(F.col("_t")) - fn.seconds(F.col("ts")) <= timeout)
    out = rows.where(F.col(kind) == "request")
    return out.select(key, F.col("id").alias("request_id"), F.when(answered, F.col("_i")).alias("response_id"), F.when(answered, fn.seconds(F.col("_t")) - fn.seconds(F.col("ts"))).cast("long").alias("wait"))


def pair_http_stream(requests: DataFrame, responses: DataFrame, key: str, timeout: int = 10, late: str = "1 minute") -> DataFrame:
    """The stream form: key, request_id, response_id, asked, answered of each request with the response that follows on its key.

    The open request of a key is its state. It leaves with the response that comes within the timeout, alone when a new
    request or a later response comes, and alone when the watermark (`late`) is past its time; lone responses are
    dropped. Rows of a key are put in order inside a micro-batch, by microseconds; the timeout is in whole seconds, as in pair_http.
    """
    columns = lambda df, kind: df.select(F.col(key).cast("string").alias("key"), F.col("id").cast("long").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.lit(kind).alias("kind"))
    both = columns(requests, "request").unionByName(columns(responses, "response")).withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = tuple(state.get) if state.exists else None
        out = []
        if state.hasTimedOut:
            out.append((*waiting, None, None))
            waiting = None
        else:
            for us, _, i, kind in sorted((r.us, r.kind == "response", r.id, r.kind) for frame in frames for r in frame.itertuples()):
                if kind == "request":
                    out += [(*waiting, None, None)] if waiting else []
                    waiting = (i, us)
                elif waiting:
                    good = us // 1_000_000 - waiting[1] // 1_000_000 <= timeout
                    out.append((*waiting, i if good else None, us if good else None))
                    waiting = None
        if waiting:
            state.update(waiting)
            state.setTimeoutTimestamp(max((waiting[1] // 1_000_000 + timeout + 1) * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        frame = pd.DataFrame(out, columns=["request_id", "asked", "response_id", "answered"]).astype("Int64")
        frame.insert(0, "key", k[0])
        yield frame

    schema = "key string, request_id long, asked long, response_id long, answered long"
    pairs = both.groupBy("key").applyInPandasWithState(step, schema, "id long, asked long", "append", GroupStateTimeout.EventTimeTimeout)
    return pairs.select("key", "request_id", "response_id", F.timestamp_micros("asked").alias("asked"), F.timestamp_micros("answered").alias("answered"))


def stream_histogram(sdf: DataFrame, unit: str, watermark: str = "1 hour") -> DataFrame:
    """intval, _count of each fixed-length unit as rows arrive; late rows count until the watermark passes."""
    length = f"{fn.UNITS[unit]} seconds"
    rows = sdf.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return rows.groupBy(F.window("ts", length)).agg(F.count("*").alias("_count")).select(F.unix_seconds("window.start").alias("intval"), "_count")


__all__ = [k for k in dir() if not k.startswith("_")] + ["append_logs"]
