"""Embedding near-duplicates: Euclidean p-stable hashing of normalised vectors, then exact cosines.

Datar et al., "Locality-Sensitive Hashing Scheme Based on p-Stable Distributions" (2004): each of several tables
keys a vector by `PROJECTIONS` quantised Gaussian projections. Unit vectors of cosine c are sqrt(2 - 2c) apart, so
at 0.98 the distance is 0.2 and one projection agrees with probability 0.80 for cells of four times that width:
a pair at the threshold shares one of 24 tables with probability 0.98, a closer one more likely. Vectors that are
equal component by component are one node with a count, so copies are not expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import mix
from ._store import forget, keep
from .components import connected_components

TABLES = 24
PROJECTIONS = 8
SMALL_CELL = 64
BLOCK = 512


def _usable(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows whose vectors are neither null nor zero and have finite components only, and these vectors."""
    rows, out = [], []
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64) if column.values.null_count == 0 else None
    offsets = column.offsets.to_numpy()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(valid):
        if values is not None:
            v = values[offsets[i] : offsets[i + 1]]
        else:
            v = np.array([np.nan if x is None else x for x in column[int(i)].as_py()], np.float64)
        size = np.sqrt(v @ v) if len(v) and np.isfinite(v).all() else 0.0
        if size > 0 and np.isfinite(size):
            rows.append(i)
            out.append(v)
    return np.array(rows, np.int64), out


def _keys(vectors: np.ndarray, tables: int, width: float) -> np.ndarray:
    """Key of each vector in each table."""
    random = np.random.default_rng(vectors.shape[1])
    direction = random.normal(size=(vectors.shape[1], tables * PROJECTIONS))
    shift = random.uniform(0, width, tables * PROJECTIONS)
    unit = vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))
    cells = np.floor((unit @ direction + shift) / width).astype(np.int64).view(np.uint64).reshape(len(unit), tables, PROJECTIONS)
    key = np.broadcast_to(np.arange(tables, dtype=np.uint64), (len(unit), tables))
    for j in range(PROJECTIONS):
        key = mix(key) + cells[:, :, j]
    return mix(key).view(np.int64)


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of x and y, in double precision."""
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def _table_keys(column: pa.Array, tables: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, tables)


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, tables: int = TABLES) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label; other columns are not looked at).

    Vectors of equal, non-null label and equal dimension are linked if their cosine, in double precision, is at
    least `cosine`. n_links counts the other rows linked directly; component_id is the least vec_id reachable,
    kept says that it is the row's own. Vectors that are null, zero, empty, or hold a null or non-finite
    component, and rows without label, have no links. Repeated rows are linked as any equal vectors are; a row
    without vec_id takes no part and is kept. An empty table gives an empty one.
    """
    width = 4 * np.sqrt(2 - 2 * cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = _usable(batch.column(2))
            keys: list = [None] * len(rows)
            length = np.array([len(v) for v in found], np.int64)
            for n in np.unique(length):
                of = np.flatnonzero(length == n)
                for i, k in zip(of, _keys(np.stack([found[i] for i in of]), tables, width), strict=True):
                    keys[i] = k
            part = batch.take(pa.array(rows))
            values = pa.array([v.astype("<f8").tobytes() for v in found], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), values, pa.array(keys, pa.list_(pa.int64()))], ["vec_id", "label", "v", "keys"])

    base = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>"))
    usable = base.where("label is not null and vec_id is not null").mapInArrow(run, "vec_id long, label string, v binary, keys array<bigint>")
    usable = keep(usable, "vectors")
    nodes = usable.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("keys").alias("keys"))
    nodes = keep(nodes, "nodes")
    # A pair counts in the first table in which its keys agree. Cells of up to SMALL_CELL nodes are written as pairs, which
    # is at most SMALL_CELL rows a node and table; larger ones are compared in blocks, of which only counts and links leave.
    cells = nodes.select("id", "label", F.posexplode("keys").alias("t", "key"))
    sizes = keep(cells.groupBy("label", "t", "key").agg(F.count("*").alias("n")).where("n > 1"), "cells")
    few = cells.join(sizes.where(F.col("n") <= SMALL_CELL).drop("n"), ["label", "t", "key"])
    pairs = few.select(F.col("id").alias("u"), "label", "t", "key").join(few.select(F.col("id").alias("v"), "label", "t", "key"), ["label", "t", "key"])
    pairs = keep(pairs.where("u < v").groupBy("u", "v").agg(F.min("t").alias("t")), "pairs")
    own = nodes.select("id", "v", "keys", "copies")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = (_table_keys(batch.column(5), tables) == _table_keys(batch.column(6), tables)).argmax(1)
            good = first == batch.column(2).to_numpy()
            a, b = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            size = np.array([len(x) if len(x) == len(y) else 0 for x, y in zip(a, b, strict=True)], np.int64)
            cosines = np.full(len(size), -2.0)
            for n in np.unique(size[size > 0]):
                of = np.flatnonzero(size == n)
                for part in np.array_split(of, 1 + len(of) // 4096):
                    cosines[part] = _cosines(*(np.frombuffer(b"".join([z[i] for i in part]), "<f8").reshape(len(part), -1) for z in (a, b)))
            yield batch.select(["u", "v"]).filter(pa.array(good & (cosines >= cosine)))

    both = pairs.join(own.select(F.col("id").alias("u"), F.col("v").alias("vu"), F.col("keys").alias("ku")), "u")
    both = both.join(own.select(F.col("id").alias("v"), F.col("v").alias("vv"), F.col("keys").alias("kv")), "v").select("u", "v", "t", "vu", "vv", "ku", "kv")
    links = keep(both.mapInArrow(exact, "u long, v long"), "links")

    members = cells.join(sizes.where(F.col("n") > SMALL_CELL), ["label", "t", "key"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    members = members.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("label", "t", "key", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "own", "id")

    def compare(table: pa.Table) -> pa.Table:
        """Rows (u, v, n): n copies linked to u in this pair of blocks, or with n null a link that joins u and v."""
        ids, copies, block = (table[k].to_numpy() for k in ("id", "copies", "own"))
        keys, t = _table_keys(table["keys"].combine_chunks(), tables), table["t"][0].as_py()
        raw = table["v"].to_pylist()
        cross = table["b1"][0].as_py() != table["b2"][0].as_py()
        root, counts, links = np.arange(len(ids)), np.zeros(len(ids), np.int64), []
        size = np.array([len(x) for x in raw])
        for length in np.unique(size):
            of = np.flatnonzero(size == length)
            x = np.frombuffer(b"".join([raw[i] for i in of]), "<f8").reshape(len(of), -1)
            for k, i in enumerate(of[:-1]):
                rest = of[k + 1 :]
                rest = rest[(block[rest] != block[i]) | (not cross)]
                rest = rest[(keys[rest] == keys[i]).argmax(1) == t]
                if len(rest):
                    rest = rest[_cosines(x[k : k + 1], x[np.searchsorted(of, rest)]) >= cosine]
                counts[i] += copies[rest].sum()
                counts[rest] += copies[i]
                for j in rest[root[rest] != root[i]].tolist():
                    if root[j] != root[i]:
                        links.append((ids[i], ids[j]))
                        root[root == root[j]] = root[i]
        some = np.flatnonzero(counts)
        columns = [[*ids[some], *(a for a, _ in links)], [*[None] * len(some), *(b for _, b in links)], [*counts[some], *[None] * len(links)]]
        return pa.table({k: pa.array(c, pa.int64()) for k, c in zip("uvn", columns, strict=True)})

    grouped = members.join(own, "id").groupBy("label", "t", "key", "b1", "b2")
    inside = keep(grouped.applyInArrow(compare, "u long, v long, n long"), "inside")
    spanning = inside.where("v is not null").select("u", "v")

    copies = own.select("id", "copies")
    two_way = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    others = two_way.join(copies.select(F.col("id").alias("v"), "copies"), "v").select("u", "copies").unionAll(inside.where("v is null").select("u", "n"))
    others = others.groupBy("u").agg(F.sum("copies").alias("others"))
    component = connected_components(links.unionAll(spanning))
    facts = copies.join(others.withColumnRenamed("u", "id"), "id", "left").join(component, "id", "left")
    facts = facts.select("id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    facts = keep(facts, "facts")
    of_node = nodes.select("label", "v", "id")
    known = usable.select("vec_id", "label", "v").join(of_node, ["label", "v"]).select("vec_id", "id").join(facts, "id")
    linked = known.select(F.col("vec_id").alias("known_id"), "n_links", "component_id").groupBy("known_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    linked = keep(linked, "linked")
    for table in (usable, nodes, sizes, pairs, links, inside, facts):
        forget(table)
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(linked, F.col("vec_id") == F.col("known_id"), "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
