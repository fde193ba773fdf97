"""Sharding, fill-in-the-middle and whitening against brute force, their SQL, and the cases that their docstrings define."""

import hashlib
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.llm import fim, registry, sharding, whitening

DATA = "/root/testdata/sf0.001"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def rows_of(df):
    columns = sorted(df.columns)
    return sorted(str([r[c] for c in columns]) for r in df.collect())


@pytest.mark.parametrize("name", ["op11_sharding", "op12_fim"])
def test_sql(spark, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got = duck.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in got.description]
    wanted = sorted(str([r[names.index(c)] for c in sorted(names)]) for r in got.fetchall())
    assert rows_of(registry.QUERIES[name](spark, DATA)) == wanted


# 11


def brute_shards(rows, shards):
    items = sorted(((i is not None, i or 0), len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), i) for i, t in rows)
    total, before, out, slots = sum(x[1] for x in items), 0, [], {}
    for _, size, crc, i in items:
        k = (2 * before + size) * shards // (2 * total)
        slots[k] = slots.get(k, -1) + 1
        out.append((i, size, crc, k, slots[k]))
        before += size
    return sorted(map(str, out))


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_shards(spark, shards):
    texts = ["é" * (k % 7) + "x" * (k * k % 501) for k in range(300)] + [None, "", "y" * 20_000]
    rows = [(k if k % 10 else None, t) for k, t in enumerate(texts)] + [(5, "same")] * 150 + [(5, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"size": F.lit("z"), "shard": F.lit(1), "part": F.lit(2)}).repartition(5)
    got = sharding.place(df, shards)
    assert sorted(str((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot)) for r in got.collect()) == brute_shards(rows, shards)


def test_shards_are_even(spark):
    placed = registry.QUERIES["op11_sharding"](spark, "/root/testdata/sf0.01")
    per = placed.groupBy("shard").agg(F.sum("size").alias("b"), F.max("slot").alias("m"), F.count("*").alias("n")).collect()
    largest, mean = placed.agg(F.max("size")).first()[0], sum(r.b for r in per) / 40
    assert len(per) == 40 and all(abs(r.b - mean) <= largest and r.m + 1 == r.n for r in per)


def test_shards_edges(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    assert sharding.place(none).count() == 0
    one = sharding.place(spark.createDataFrame([("a", None)], "doc_id string, text string"), 4).collect()
    assert [(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in one] == [("a", 16, 0, 2, 0)]
    with pytest.raises(ValueError):
        sharding.place(none, 0)


def test_shards_written(spark, tmp_path):
    rows = [(k, "t" * (k % 50), str(k)) for k in range(500)] + [(7, "again", "x")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, slot string")
    sharding.write_shards(df, f"file://{tmp_path}/s", 6)
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert set(back.columns) == {"doc_id", "text", "slot", "slot_", "shard"}
    placed = sharding.place(df, 6).select("shard", F.col("slot").alias("slot_"), "doc_id")
    assert rows_of(back.select("shard", "slot_", "doc_id")) == rows_of(placed)
    assert sorted((r.doc_id, r.text, r.slot) for r in back.collect()) == sorted(rows)


# 12


def brute_fim(i, t):
    t = t or ""
    w = TOKEN.findall(t)
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(w) + 1), h2 % (len(w) + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return i, len(w), "plain", None, None, t
    if h4 % 100 < 80:
        return i, len(w), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, len(w), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim(spark):
    texts = ["", None, " ", "\t\n x", "a", "a ", "a<S b <P c", "x <M> y", "<P>", "é　ü \x0b\x0c\x1c z", "𝒳 " * 9, "w " * 70_000, "ab\n" * 30_000 + "  ", "long" * 50_000, " " * 90_000, "q r"]
    rows = [(k, texts[k % len(texts)]) for k in range(160)] + [(None, "a b c d e f g")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("x"), "hash": F.lit("y"), "output": F.lit("z")})
    made = fim.transform(df)
    got = made.select("*", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert sorted(str(tuple(r)[:6]) for r in got) == sorted(str(brute_fim(*x)) for x in rows)
    assert sorted((str(r.doc_id), r.back) for r in got) == sorted((str(i), t or "") for i, t in rows)
    assert {r.form for r in got} == {"plain", "spm", "psm"}
    assert fim.transform(df.where("false")).count() == 0


def test_boundary_set():
    random = np.random.default_rng(7)
    sparse = np.unique(random.integers(0, 65_536, 300))
    dense = np.unique(random.integers(131_072, 196_608, 40_000))
    runs = np.concatenate([np.arange(200_000, 214_000), np.arange(220_000, 221_500)])
    far = np.array([1 << 33, (1 << 33) + 70_000])
    members = np.concatenate([sparse, dense, runs, far])
    known = fim.BoundarySet(members)
    assert [type(p).__name__ for p in known.parts] == ["Array", "Bitmap", "Runs", "Array", "Array"]
    assert len(known) == len(members)
    assert (known.select(np.arange(len(members))) == members).all()
    asked = np.concatenate([members, members + 1, [0, 70_000, 199_999, 1 << 34]])
    assert (known.rank(asked) == np.searchsorted(members, asked)).all()
    assert len(fim.BoundarySet(np.array([0]))) == 1


# 13


def brute_whitened(vectors, k):
    x = np.floor(1024 * np.array(vectors, float)).astype(int) + 100_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-e)[:k]
    return n, ((n * x - s) ** 2).sum(1), c @ v[:, order] / np.sqrt(e[order]), e[order] / e.sum()


def frame(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, None if v is None else [None if c is None else float(c) for c in v], 0.5) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, whitened double")


@pytest.mark.parametrize("d", [1, 2, 5, 24])
def test_whitening(spark, d):
    random = np.random.default_rng(d)
    vectors = random.normal(size=(120, d)) * np.arange(1, d + 1) @ np.linalg.qr(random.normal(size=(d, d)))[0]
    odd = [None, [np.nan] * d, [np.inf] + [0] * (d - 1), [None] * d, [1e300] * d, [0.5] * (d + 1), []]
    got = whitening.whiten(frame(spark, [*vectors, *odd])).collect()
    k = min(8, d)
    n, deviation, w, share = brute_whitened(vectors, k)
    assert len(got) == 120 * k and {r.n for r in got} == {n}
    assert max(r.identity_error for r in got) < 1e-9
    mine = np.zeros((120, k))
    for r in got:
        assert r.deviation == deviation[r.vec_id] and abs(r.explained / share[r.component - 1] - 1) < 1e-9
        mine[r.vec_id, r.component - 1] = r.whitened
    assert np.abs(mine * np.sign((mine * w).sum(0)) - w).max() < 1e-7


def test_whitening_repeated_roots(spark):
    """Four equal eigenvalues, two more equal ones, one of 0: the coordinates are still white."""
    scale = [3, 3, 3, 3, 1, 1, 0]
    vectors = [[s * scale[i] if j == i else 0 for j in range(7)] for i in range(7) for s in (-1, 1)]
    got = whitening.whiten(frame(spark, vectors)).toPandas()
    assert sorted(got.component.unique()) == [1, 2, 3, 4, 5, 6] and got.identity_error.max() < 1e-9
    table = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(table.T @ table / 14 - np.eye(6)).max() < 1e-9
    share = got.groupby("component").explained.first().to_numpy()
    assert np.allclose(share, np.array([9, 9, 9, 9, 1, 1]) / 38, rtol=1e-9)


def test_whitening_edges(spark):
    none = frame(spark, [[1.0]]).where("false")
    assert whitening.whiten(none).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(none).count() == 0
    assert whitening.whiten(frame(spark, [[1.0, 2.0]] * 4)).count() == 0  # no variance
    assert whitening.whiten(frame(spark, [None, [np.nan]])).count() == 0
    twice = whitening.whiten(frame(spark, [[1.0, 0], [0, 1], [3, 1]]).union(frame(spark, [[1.0, 0]]))).collect()
    assert len(twice) == 8 and {r.n for r in twice} == {4}
    huge = whitening.whiten(frame(spark, [[1e15, 1.0], [-1e15, 2.0], [3e14, -5.0]])).collect()  # sums beyond 64 bits
    assert {r.deviation for r in huge} == {None} and max(r.identity_error for r in huge) < 1e-4
    with pytest.raises(ValueError):
        whitening.whiten(frame(spark, [[0.0] * 3000] * 2))


def test_characteristic(spark):
    random = np.random.default_rng(3)
    a = random.integers(-50, 50, (9, 6)).astype(object)
    m = (a.T @ a).tolist()
    poly = whitening.characteristic(spark, m)
    assert poly[-1] == 1 and poly[-2] == -sum(m[i][i] for i in range(6))
    for x in range(7):  # det(x - m) by fractions at more places than the degree
        b = [[Fraction((x if i == j else 0) - v) for j, v in enumerate(row)] for i, row in enumerate(m)]
        det = Fraction(1)
        for k in range(6):
            p = next(i for i in range(k, 6) if b[i][k])
            if p != k:
                b[k], b[p], det = b[p], b[k], -det
            det *= b[k][k]
            for i in range(k + 1, 6):
                f = b[i][k] / b[k][k]
                b[i] = [u - f * v for u, v in zip(b[i], b[k])]
        assert sum(c * x**i for i, c in enumerate(poly)) == det
    roots = whitening.Roots(poly).largest(6, sum(m[i][i] for i in range(6)))
    assert np.allclose([float(r) for r, _ in roots], np.linalg.eigvalsh(np.array(m, float))[::-1], rtol=1e-9)


def test_roots_that_repeat():
    poly = [1]
    for r in (0, 0, 2, 5, 5, 5, 7):
        poly = [(poly[i - 1] if i else 0) - r * (poly[i] if i < len(poly) else 0) for i in range(len(poly) + 1)]
    found = whitening.Roots(poly).largest(8, 24)
    assert [(round(float(r), 12), size) for r, size in found] == [(7, 1), (5, 3), (2, 1)]
