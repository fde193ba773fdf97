"""Language identification: words first, then ever shorter character n-grams for words that are not known.

Jauhiainen et al., "HeLI, a Word-Based Backoff Method for Language Identification" (2016). A known word scores
its log relative frequency in each language; a word that no language knows scores the mean of its longest
n-grams of which any is known, from `ORDERS[0]` characters down to single ones, with a space at either end of
the word. A text's language is the one with the greatest mean over its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import blocks, mix, row_of, span_hashes, word_spans
from ._store import forget, keep

ORDERS = (5, 4, 3, 2, 1)
PENALTY = 7.0  # minus log10 of the frequency that an entry unknown in one language gets there
BLOCK_CHARS = 1 << 19
SURE_WORDS = 20
PART_BITS = 12

_TABLES: dict[str, np.ndarray] = {}


@dataclass
class LanguageModel:
    """languages in order; for words (0) and each n-gram order the sorted hashes and their scores by language."""

    languages: list[str]
    hashes: dict[int, np.ndarray]
    scores: dict[int, np.ndarray]


def _letters() -> np.ndarray:
    if "letters" not in _TABLES:
        _TABLES["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        _TABLES["symbols"] = mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(1)) | np.uint64(1)
    return _TABLES["letters"]


def _chars(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts with a line end before and behind each, and where each text starts and ends."""
    low = pc.utf8_lower(texts)
    joined = "\n" + "\n".join(low.to_pylist()) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    return code, np.concatenate([[0], ends[:-1]]) + 1, ends


def _hash(code: np.ndarray) -> np.ndarray:
    """A symbol for each code point, for span_hashes."""
    return _TABLES["symbols"][code & 0xFFFF] + (code >> 16).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _find(model: LanguageModel, order: int, hashes: np.ndarray) -> np.ndarray:
    """Place of each hash in the model's table, -1 where it isn't."""
    table = model.hashes[order]
    if not len(table):
        return np.full(len(hashes), -1)
    place = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    return np.where(table[place] == hashes, place, -1)


def word_scores(model: LanguageModel, code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Score of each word for each language; nan for words of which no n-gram is known either."""
    plain = np.where(_letters()[code], code, 32)
    symbols = _hash(plain)
    out = np.full((len(starts), len(model.languages)), np.nan, np.float32)
    place = _find(model, 0, span_hashes(symbols, starts, ends))
    out[place >= 0] = model.scores[0][place[place >= 0]]
    left = np.flatnonzero(place < 0)
    for n in ORDERS:
        counts = np.maximum(ends[left] - starts[left] + 3 - n, 0)
        word = np.repeat(np.arange(len(left)), counts)
        at = starts[left][word] - 1 + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        place = _find(model, n, span_hashes(symbols, at, at + n))
        word, place = word[place >= 0], place[place >= 0]
        known = np.bincount(word, minlength=len(left))
        got = known > 0
        for g in range(len(model.languages)):
            total = np.bincount(word, model.scores[n][place, g], len(left))
            out[left[got], g] = total[got] / known[got]
        left = left[~got]
    return out


def identify_texts(model: LanguageModel, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score (0 to 1) of each text: `und` and 0 without a letter, or where nothing was learnt."""
    lang, score = ["und"] * len(texts), np.zeros(len(texts))
    if not model.languages:
        return lang, score
    texts = pc.fill_null(texts, "")
    letters = _letters()
    size = np.concatenate([[0], np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))])
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(size, size[low] + BLOCK_CHARS, "right")) - 1)
        code, first, end = _chars(texts.slice(low, high - low))
        starts, ends, _ = word_spans(letters[code], np.array([0, len(code)]))
        at = np.searchsorted(starts, np.concatenate([first, end[-1:]]))
        marks = word_scores(model, code, starts, ends)
        row = row_of(at)
        known = ~np.isnan(marks[:, 0])
        n = np.bincount(row[known], minlength=high - low)
        total = np.stack([np.bincount(row[known], marks[known, g], high - low) for g in range(marks.shape[1])], 1)
        mean = total / np.maximum(n, 1)[:, None]
        best = mean.argmax(1)
        gap = (mean - mean.max(1, keepdims=True)) * np.log(10) * np.minimum(np.maximum(n, 1), SURE_WORDS)[:, None]
        sure = 1 / np.exp(gap).sum(1)
        for i in np.flatnonzero(np.diff(at) > 0):
            lang[low + i], score[low + i] = model.languages[best[i]], sure[i]
        low = high
    return lang, score


def _counted(texts: pa.Array, langs: pa.Array) -> Iterator[tuple[int, str, np.ndarray, np.ndarray]]:
    """(order, language, hashes, how often) of the words (order 0) and n-grams of texts, padded as word_scores looks them up."""
    letters = _letters()
    names = np.array(langs.to_pylist(), object)
    code, first, end = _chars(texts)
    starts, ends, _ = word_spans(letters[code], np.array([0, len(code)]))
    of = names[row_of(np.searchsorted(starts, np.concatenate([first, end[-1:]])))]
    symbols = _hash(np.where(letters[code], code, 32))
    for lang in sorted(set(of.tolist())):
        a, b = starts[of == lang], ends[of == lang]
        yield 0, lang, *np.unique(span_hashes(symbols, a, b), return_counts=True)
        for n in ORDERS:
            counts = np.maximum(b - a + 3 - n, 0)
            at = np.repeat(a - 1 - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            yield n, lang, *np.unique(span_hashes(symbols, at, at + n), return_counts=True)


def fit(counts: pa.Table, languages: list[str]) -> LanguageModel:
    """The model for counted words and n-grams (order, lang, hash, n), each once for a language."""
    model = LanguageModel(languages, {}, {})
    order, hashes, n = counts["order"].to_numpy(), counts["hash"].to_numpy().view(np.uint64), counts["n"].to_numpy().astype(float)
    lang = np.searchsorted(np.array(languages), np.array(counts["lang"].to_pylist(), str)) if len(order) else np.zeros(0, np.int64)
    for k in (0, *ORDERS):
        mine = order == k
        total = np.bincount(lang[mine], n[mine], len(languages))
        model.hashes[k], place = np.unique(hashes[mine], return_inverse=True)
        model.scores[k] = np.full((len(model.hashes[k]), len(languages)), -PENALTY, np.float32)
        model.scores[k][place, lang[mine]] = np.maximum(np.log10(n[mine] / total[lang[mine]]), -PENALTY)
    return model


def train(docs: DataFrame, learn_from: str = "true", max_docs: int = 1500) -> LanguageModel:
    """Fits on at most `max_docs` documents of each language, the first by a hash of doc_id.

    docs: doc_id, text, lang; rows without lang, and rows that the SQL condition `learn_from` excludes, are not
    used; equal hashes are told apart by doc_id, and repeated rows of a chosen doc_id all count. Every word and n-gram of
    the sample is kept; they are counted on the executors, and what the driver and the model hold is bounded by max_docs
    times the number of languages. Without such rows (an empty table) the model knows no language.
    """
    known = docs.where("lang is not null and text is not null").where(learn_from)
    # Counts by the hash's first bits say which of its ranges hold a language's first max_docs, so that only these are put in order.
    place = F.shiftright(F.xxhash64("doc_id"), 64 - PART_BITS)
    rows = known.select("doc_id", "lang", place.alias("part"))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("part")) - F.col("n")  # over at most 2^PART_BITS rows a language
    first = rows.groupBy("lang", "part").agg(F.count("*").alias("n")).withColumn("before", upto).where(F.col("before") < max_docs).select("lang", "part")
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = rows.join(first, ["lang", "part"]).withColumn("r", order).where(F.col("r") <= max_docs).select("doc_id").distinct()
    sample = keep(known.select(F.col("doc_id"), "text", "lang").join(F.broadcast(ids), "doc_id").select("text", "lang"), "languages")
    languages = sorted(r[0] for r in sample.select("lang").distinct().collect())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, _, _ in blocks(batch.column(0)):
                for n, lang, hashes, times in _counted(batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low)):
                    columns = [pa.array(np.full(len(hashes), n, np.int32)), pa.array([lang] * len(hashes), pa.string()), pa.array(hashes.view(np.int64)), pa.array(times.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["order", "lang", "hash", "n"])

    counts = sample.mapInArrow(count, "order int, lang string, hash long, n long").groupBy("order", "lang", "hash").agg(F.sum("n").alias("n")).toArrow()
    forget(sample)
    return fit(counts, languages)


def identify(docs: DataFrame, model: LanguageModel, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its score; only the column text is looked at.

    Null texts and texts without a letter are `und` with score 0, as is every text where nothing was learnt;
    ties go to the first language by name. Texts of any length are read whole, repeated rows each by itself, an empty
    table gives an empty table. Earlier columns of these names are replaced.
    """
    base = docs.drop(lang, score)
    at = base.columns.index("text")
    out = base.withColumns({lang: F.lit("").cast("string"), score: F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sure = identify_texts(shared.value, batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(found, pa.string()), pa.array(sure)], batch.schema.names)

    return out.mapInArrow(run, out.schema)
