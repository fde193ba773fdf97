"""Contiguous shards of near equal byte size, from global prefix sums.

Rows are put into one global order and dealt to partitions by ranges of it. Each partition sums its own sizes as it is
sorted; the partitions' totals (one row each) are summed up in turn, so that a row's place on the line of all bytes is the
total of the partitions before its own and its place inside. The line is cut at equal targets, and a row goes to the shard in
which its middle byte lies: a shard departs from the target by half its first and half its last row at most.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import forget, keep

ROW_BYTES = 16
MOST_SHARDS = 1 << 20
ORDER = ("doc_id", "size", "text_crc32", "tie")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition's number, and the bytes and rows before each row in it."""
    part, bytes_, rows = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        size = batch.column("size").to_numpy()
        upto = bytes_ + np.cumsum(size)
        more = [pa.array(np.full(len(size), part, np.int32)), pa.array(upto - size), pa.array(rows + np.arange(len(size)))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "part", "before", "nth"])
        bytes_, rows = (int(upto[-1]) if len(size) else bytes_), rows + len(size)


def place(docs: DataFrame, shards: int = 40, partitions: int | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of docs (doc_id, text), and `row`, a struct of the columns in `carry`.

    size is the UTF-8 length of the text plus 16 bytes, a null text having none; text_crc32 is its checksum. The order is by
    doc_id (nulls first), then size, then checksum; rows equal in all three are alike in the result, whichever comes first, and
    are spread over partitions like others, so one doc_id may hold any share of the rows. Shards are numbered in that order from
    0, slots inside a shard from 0 without gaps. A shard on whose target no row's middle lies stays empty: with fewer rows
    than shards, or about a text that is longer than a shard. Equal texts are placed like any others. An empty table gives an
    empty one. Other columns are not looked at. 2 * bytes * shards must stay under 2^63.
    """
    if not 0 < shards <= MOST_SHARDS:
        raise ValueError(f"shards must be from 1 to {MOST_SHARDS}")
    text = F.coalesce("text", F.lit("")).cast("binary")
    columns = ["doc_id", (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("tie")]
    row = [F.struct(*[docs[c] for c in carry]).alias("row")] if carry else []
    narrow = keep(docs.select(*columns, *row), "sizes")  # the ranges are chosen by a pass of their own, which need not read texts
    partitions = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = narrow.repartitionByRange(partitions, *ORDER).sortWithinPartitions(*ORDER).drop("tie")
    schema = T.StructType([*dealt.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType()), T.StructField("nth", T.LongType())])
    summed = keep(dealt.mapInArrow(_sums, schema), "summed")
    forget(narrow)

    # One row for each partition: their prefix sums are a window over as many rows.
    totals = summed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("part_bytes"),
        F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("part_rows"),
        F.sum("bytes").over(every).alias("all_bytes"),
    )
    placed = summed.join(F.broadcast(starts), "part")
    placed = placed.withColumn("shard", F.expr(f"((2 * (part_bytes + before) + size) * {shards}L) div (2 * all_bytes)").cast("int"))
    placed = placed.withColumn("nth", F.col("part_rows") + F.col("nth"))
    firsts = placed.groupBy("shard").agg(F.min("nth").alias("first"))
    out = placed.join(F.broadcast(firsts), "shard")
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("nth") - F.col("first")).alias("slot"), *(["row"] if carry else []))


def write_shards(docs: DataFrame, path: str, shards: int = 40, partitions: int | None = None) -> None:
    """Writes all columns of docs as Parquet under path/shard=<k>, with the row's slot as `slot` (`slot_`, ... where docs has one).

    Rows pass the network once, in the order of place(); what is written follows it, so no second shuffle is needed and a
    shard is a few files of neighbouring rows.
    """
    slot, shard = "slot", "shard"
    while slot in docs.columns:
        slot += "_"
    while shard in docs.columns:
        shard += "_"
    placed = place(docs, shards, partitions, carry=docs.columns)
    placed.select(F.col("shard").alias(shard), F.col("slot").alias(slot), *[F.col("row")[c].alias(c) for c in docs.columns]).write.partitionBy(shard).parquet(path)
