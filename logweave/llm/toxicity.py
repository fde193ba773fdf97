"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Wang and Manning, "Baselines and Bigrams" (ACL 2012), with n-grams of characters of the lower-cased text.
The classifier is fitted on a bounded sample of labelled documents (`max_docs`). Its features are all n-grams of
the sample whose share among toxic documents differs from that among others by more than chance (a test of two
shares, `least_z`); their number is not bounded otherwise. Log-count ratios are drawn towards 0 by SMOOTH documents of the
sample's own mixture, without which n-grams of few documents have the greatest ones; the bias is set on rows
that parts of the fit have not seen. Scoring reads whole texts in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import blocks, row_of, texts
from ._store import forget, keep

BITS = 20
ORDERS = (4, 5, 6)
TEXT_BLOCK = 1 << 18  # bytes of texts looked at at once; arrays over their n-grams are some hundred times as large
LEAST_Z = 3.0  # of half a million n-grams over a thousand pass it by chance, with small ratios
SMOOTH = 10.0
FOLDS = 3
PART = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class ToxicityModel:
    """weights: one float for each n-gram bucket, 0 where the n-gram is not a feature; bias: the intercept."""

    weights: np.ndarray
    bias: float


def _grams(code: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of the n-grams inside one text, for each order."""
    text = row_of(offsets)
    rolled = code.astype(np.uint64) + np.uint64(1)
    for n in range(2, max(ORDERS) + 1):
        rolled = rolled[:-1] * MIX + code[n - 1 :]
        if n in ORDERS:
            whole = text[: len(rolled)] == text[n - 1 :]
            bucket = (rolled + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
            bucket ^= bucket >> np.uint64(29)
            yield text[: len(rolled)][whole], ((bucket[whole] * MIX) >> np.uint64(64 - BITS)).astype(np.int64)


def _texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, code points, offsets) of successive blocks of lower-cased whole texts, lowered block by block."""
    for low, high, _, _ in blocks(column, TEXT_BLOCK):
        data, offsets = texts(pc.utf8_lower(pc.fill_null(column.slice(low, high - low), "")))
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        raw = data.tobytes()
        if not raw.isascii():
            starts = np.flatnonzero(data & 0xC0 != 0x80)
            offsets = np.searchsorted(starts, offsets)
            data = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        yield low, high, data, offsets


def _present(code: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs, of the wanted buckets if given."""
    found = [np.zeros(0, np.int64)]
    for text, bucket in _grams(code, offsets):
        if wanted is not None:
            hit = wanted[bucket]
            text, bucket = text[hit], bucket[hit]
        found.append((text << BITS) | bucket)
    pairs = np.unique(np.concatenate(found))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _summed(key: np.ndarray, size: int, value: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Sums of value[of[i]] over the places i of each key, by parts of a million so that no array of doubles is as long as `key`."""
    out = np.zeros(size)
    for at in range(0, len(key), PART):
        out += np.bincount(key[at : at + PART], value[of[at : at + PART]], size)
    return out


def ratios(row: np.ndarray, col: np.ndarray, y: np.ndarray, width: int, smooth: float = SMOOTH) -> np.ndarray:
    """Log ratio of each feature's shares among texts of label 1 and of label 0, each with `smooth` texts of both labels' mixture added."""
    n1, n0 = (y > 0).sum(), (y == 0).sum()
    c1, c0 = (_summed(col, width, of, row) for of in ((y > 0).astype(float), (y == 0).astype(float)))
    mixed = smooth / len(y)
    return np.log((c1 + mixed * n1) / (n1 + smooth) / ((c0 + mixed * n0) / (n0 + smooth)))


def _balance(y: np.ndarray) -> np.ndarray:
    """How much each text counts: halfway, on a log scale, between all alike and both labels alike."""
    n, n1 = len(y), (y > 0).sum()
    return np.where(y > 0, n / (2 * n1), n / (2 * (n - n1))) ** 0.5


def _weights(row: np.ndarray, col: np.ndarray, y: np.ndarray, ratio: np.ndarray, rounds: int, l2: float) -> tuple[np.ndarray, float]:
    """Weight of each feature, its ratio included, and bias: logistic loss of the texts with labels y, text row[i] having feature col[i]."""
    length, width = len(y), len(ratio)
    weight = _balance(y)
    w, b, m, v, mb, vb = np.zeros(width), 0.0, np.zeros(width), np.zeros(width), 0.0, 0.0
    for t in range(1, rounds + 1):  # Adam on the whole sample
        z = _summed(row, length, ratio * w, col) + b
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / length
        g = ratio * _summed(col, width, error, row) + l2 * w
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = 0.02 / (1 - 0.9**t)
        w -= step * m / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= step * mb / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return w * ratio, float(b)


def fewest_errors(z: np.ndarray, y: np.ndarray) -> float:
    """A cut between the numbers z at which fewest texts are on the wrong side, by their weights; of several cuts the middle one."""
    order = np.argsort(z, kind="stable")
    at, hit, weight = z[order], y[order] > 0, _balance(y)[order]
    missed, false = np.append(0, np.cumsum(weight * hit)), np.append(0, np.cumsum(weight * ~hit))
    wrong = missed + false[-1] - false
    cuts = np.concatenate([[at[0] - 1], (at[1:] + at[:-1]) / 2, [at[-1] + 1]])
    best = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    return float(cuts[best[len(best) // 2]])


def fit(row: np.ndarray, col: np.ndarray, y: np.ndarray, buckets: np.ndarray, rounds: int = 120, l2: float = 5e-3, folds: int = FOLDS) -> ToxicityModel:
    """The classifier for texts with labels y, text row[i] having feature col[i], which is bucket buckets[col[i]].

    The texts of each label are dealt into `folds` parts by their order; each is scored by ratios and weights of the others, and the bias is
    moved so that a score of one half lies where fewest of them are wrong. With fewer than 10 texts of a label it stays as fitted.
    """
    width = len(buckets)
    w, b = _weights(row, col, y, ratios(row, col, y, width), rounds, l2)
    if min((y > 0).sum(), (y == 0).sum()) >= 10:
        unseen, fold = np.zeros(len(y)), np.where(y > 0, np.cumsum(y > 0), np.cumsum(y == 0)) % folds
        for k in range(folds):
            kept = fold != k
            of, place = kept[row], (np.cumsum(kept) - 1).astype(np.int32)
            own = place[row[of]], col[of], y[kept]
            part, bias = _weights(*own, ratios(*own, width), rounds, l2)
            unseen[~kept] = bias + _summed(row, len(y), part, col)[~kept]
        b -= fewest_errors(unseen, y)
    weights = np.zeros(1 << BITS, np.float32)
    weights[buckets] = w
    return ToxicityModel(weights, float(b))


def _constant(rate: float) -> ToxicityModel:
    return ToxicityModel(np.zeros(1 << BITS, np.float32), float(np.log((rate + 1e-6) / (1 - rate + 1e-6))))


def score_texts(model: ToxicityModel, column: pa.Array) -> np.ndarray:
    """Score of each text, 0 to 1."""
    wanted = model.weights != 0
    z = np.full(len(column), model.bias)
    for low, high, code, offsets in _texts(column):
        text, bucket = _present(code, offsets, wanted)
        z[low:high] += np.bincount(text, model.weights[bucket], high - low)
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 6000, learn_from: str = "true", least_z: float = LEAST_Z) -> ToxicityModel:
    """Fits on at most `max_docs` labelled documents, half of each label where there are so many.

    docs: doc_id, text. labels: doc_id, toxic (rows with null toxic are not used). learn_from: a SQL
    condition over doc_id for rows to learn from. The sample is the first rows by a hash of doc_id, so it
    does not depend on partitioning. Null texts count as empty, texts of any length are read whole, rows of docs that repeat
    a doc_id are one example each, of differing labels of one document the greater counts. N-grams are counted on the
    executors; the driver gets the numbers of those with |z| of at least `least_z`
    (or half of what a perfect n-gram has, if that is less, as with under 82 texts) and which of them each document of the sample has.
    Without both labels (an empty table too) every text gets the rate of label 1.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and doc_id is not null").where(learn_from)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = None
    for label in (1, 0):
        some = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs // 2)
        ids = some if ids is None else ids.unionAll(some)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    sample = keep(sample.select("doc_id", "text", "toxic"), "labelled")
    sizes = {r["toxic"] > 0: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(True, 0), sizes.get(False, 0)
    if not n1 or not n0:
        forget(sample)
        return _constant(n1 / max(1, n1 + n0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(2).to_numpy() > 0
            for low, _, code, offsets in _texts(batch.column(1)):
                text, bucket = _present(code, offsets)
                of = np.unique(bucket)
                place = np.searchsorted(of, bucket)
                hit = toxic[low + text]
                yield pa.RecordBatch.from_arrays([pa.array(of), *(pa.array(np.bincount(place[x], minlength=len(of))) for x in (hit, ~hit))], ["bucket", "n1", "n0"])

    seen = sample.mapInArrow(count, "bucket long, n1 long, n0 long").groupBy("bucket").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    share, other, whole = F.col("n1") / n1, F.col("n0") / n0, (F.col("n1") + F.col("n0")) / (n1 + n0)
    z = F.abs(share - other) / F.sqrt(whole * (1 - whole) * (1 / n1 + 1 / n0))
    enough = min(least_z, (n1 + n0) ** 0.5 / 2)  # no z of so few texts can be greater than the square root of their number
    best = seen.where((F.col("n1") + F.col("n0") < n1 + n0) & (z >= enough)).select("bucket").toArrow()
    if not best.num_rows:
        forget(sample)
        return _constant(n1 / (n1 + n0))
    buckets = np.sort(best["bucket"].to_numpy())
    wanted = np.zeros(1 << BITS, bool)
    wanted[buckets] = True

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, code, offsets in _texts(batch.column(1)):
                text, bucket = _present(code, offsets, wanted)
                cuts = np.searchsorted(text, np.arange(high - low + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.searchsorted(buckets, bucket).astype(np.int32)))
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), lists], ["doc_id", "toxic", "features"])

    rows = sample.mapInArrow(used, "doc_id long, toxic int, features array<int>").toArrow()
    forget(sample)
    rows = rows.sort_by("doc_id")
    lists = rows["features"].combine_chunks()
    y = (rows["toxic"].to_numpy() > 0).astype(float)
    del rows
    return fit(row_of(lists.offsets.to_numpy()).astype(np.int32), lists.flatten().to_numpy(), y, buckets)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score for each row of docs. A null or empty text gets the score of no n-gram, texts of any length are read whole by blocks
    of whole texts, repeated ids keep their rows, other columns are not looked at, an empty table gives an empty table."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_texts(shared.value, batch.column(1)))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def flag(docs: DataFrame, model: ToxicityModel, column: str) -> DataFrame:
    """docs with the score in the column of that name, replacing an earlier one; null and empty texts get the score of no n-gram,
    repeated rows are each scored, an empty table gives an empty table."""
    base = docs.drop(column) if column in docs.columns else docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = base.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score_texts(shared.value, batch.column(at)))], [*batch.schema.names, column])

    return base.mapInArrow(run, base.select("*", F.lit(0.0).cast("double").alias(column)).schema)


__all__ = ["ToxicityModel", "fit", "flag", "score", "score_texts", "train"]
