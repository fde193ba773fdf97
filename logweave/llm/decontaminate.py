"""Benchmark decontamination with suffix arrays over shards of the training text.

Each block of whole documents is a shard. Words (maximal runs of digits, letters and non-ASCII bytes of
the text with A-Z lower-cased) become ids of the benchmark's vocabulary; since a match consists of such
words only, the shard's suffix array holds the suffixes inside runs that are long enough to hold a window.
Every test suffix is binary-searched in each shard's array; its interval gives all verbatim occurrences,
which are then extended to the longest match.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import LOWER, blocks, row_of, span_hashes, word_spans
from ._store import forget, keep

WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True

SHARD_BYTES = 4 << 20
MOST_ROWS = 1 << 18
MATCHES = "array<struct<item_id:string,first_word:int,end_word:int,longest:int>>"


@dataclass
class TestSet:
    """vocabulary: sorted word hashes, a word's id being its place + 1; text: the items' ids with a 0 behind each item;
    suffixes: for each window length the first words of its distinct windows as a matrix; items: (window, item) pairs."""

    vocabulary: np.ndarray
    seen: np.ndarray
    text: np.ndarray
    suffixes: list[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]
    item_ids: list[str]
    shortest: int


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of a block and each text's offset among them."""
    low = LOWER[data]
    starts, ends, at = word_spans(WORD[low], offsets)
    return span_hashes(low, starts, ends), at


def test_set(item_ids: list, texts: list[str | None], window: int) -> TestSet:
    """The windows of `window` consecutive words of each item; an item of fewer words is one window, one without words none."""
    hashes, at = [], []
    for text in texts:
        column = pa.array([text], pa.string())
        for _, _, data, offsets in blocks(column):
            h, _ = words_of(data, offsets)
            hashes.append(h)
        if len(hashes) == len(at):
            hashes.append(np.zeros(0, np.uint64))
        at.append(len(hashes[-1]))
    vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
    seen = np.zeros(1 << 16, bool)
    seen[(vocabulary >> np.uint64(48)).astype(np.int64)] = True
    by_length: dict[int, list[tuple[int, int]]] = {}
    parts, base = [], 0
    for k, h in enumerate(hashes):
        if len(h):
            ids = np.searchsorted(vocabulary, h) + 1
            n = min(window, len(h))
            by_length.setdefault(n, []).extend((base + i, k) for i in range(len(h) - n + 1))
            parts += [ids, [0]]
            base += len(h) + 1
    text = np.concatenate([*parts, [0]]).astype(np.int32) if parts else np.zeros(1, np.int32)
    suffixes = []
    for n, places in sorted(by_length.items()):
        where, item = np.array(places).T
        rows = text[where[:, None] + np.arange(n)]
        distinct, of = np.unique(rows, axis=0, return_inverse=True)
        of = of.reshape(-1)
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(len(distinct) + 1))
        suffixes.append((n, distinct, cuts, [where[order], item[order]]))
    return TestSet(vocabulary, seen, text, suffixes, [str(x) for x in item_ids], min(by_length, default=0))


def _suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of `text` in the order of the next `depth` words at least, by prefix doubling."""
    rank, h = text.astype(np.int64), 1
    n = len(text)
    while h < depth:
        ahead = np.zeros(n, np.int64)
        ahead[: n - h] = rank[h:] + 1
        _, rank = np.unique(rank * (int(ahead.max()) + 1) + ahead, return_inverse=True)
        h *= 2
    return np.argsort(rank, kind="stable")


def _bound(text: np.ndarray, order: np.ndarray, wanted: np.ndarray, upper: bool) -> np.ndarray:
    """Lower or upper bounds, in the suffix array `order`, of the rows of `wanted`, all searched in step."""
    width = np.arange(wanted.shape[1])
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(order))
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        there = text[np.minimum(order[np.minimum(mid, len(order) - 1)][:, None] + width, len(text) - 1)]
        differ = there != wanted
        first = differ.argmax(1)
        pick = np.arange(len(wanted))
        less = np.where(differ.any(1), there[pick, first] < wanted[pick, first], upper)
        low = np.where(open_ & less, mid + 1, low)
        high = np.where(open_ & ~less, mid, high)
    return low


def shard_matches(test: TestSet, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[tuple]]]:
    """Words of each text of a shard, and each text's matches (item, first word, end word, longest match)."""
    hashes, at = words_of(data, offsets)
    found: list[list[tuple]] = [[] for _ in range(len(offsets) - 1)]
    counts = np.diff(at)
    if not test.shortest or not len(hashes):
        return counts, found
    ids = np.zeros(len(hashes), np.int32)
    maybe = np.flatnonzero(test.seen[(hashes >> np.uint64(48)).astype(np.int64)])
    place = np.minimum(np.searchsorted(test.vocabulary, hashes[maybe]), len(test.vocabulary) - 1)
    ids[maybe] = np.where(test.vocabulary[place] == hashes[maybe], place + 1, 0)
    starts, ends, _ = word_spans(ids > 0, at)
    long = ends - starts >= test.shortest
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return counts, found
    lengths = ends - starts + 1  # each run and a 0 behind it
    head = np.cumsum(lengths) - lengths
    source = np.repeat(starts - head, lengths) + np.arange(lengths.sum())
    text = np.where(np.arange(len(source)) == np.repeat(head + lengths - 1, lengths), 0, ids[np.minimum(source, len(ids) - 1)])
    widest = max(n for n, *_ in test.suffixes)
    order = _suffix_array(text, widest)
    document = row_of(at)
    hits, size, most = [], 0, MOST_ROWS
    for n, windows, cuts, (where, item) in test.suffixes:
        low, high = _bound(text, order, windows, False), _bound(text, order, windows, True)
        for w in np.flatnonzero(high > low):
            here = np.sort(order[low[w] : high[w]])  # places in the shard's text, so in its documents' order
            of, at_item = item[cuts[w] : cuts[w + 1]], where[cuts[w] : cuts[w + 1]]
            for k in np.unique(of):
                longest = np.full(len(here), n)
                for j in at_item[of == k]:
                    grow, step = np.arange(len(here)), n
                    while len(grow):  # the occurrence goes on as far as item and document agree
                        a, b = here[grow] + step, j + step
                        if b >= len(test.text) or not test.text[b]:
                            break
                        grow = grow[(a < len(text)) & (text[np.minimum(a, len(text) - 1)] == test.text[b])]
                        step += 1
                        longest[grow] = np.maximum(longest[grow], step)
                first = source[here]
                d = document[first]
                hits.append(_merged(np.stack([d, np.full(len(here), k), first - at[d], first - at[d] + n, longest], 1)))
                size += len(hits[-1])
                if size > most:  # what is held grows with the merged matches, not with the windows' occurrences
                    hits = [_merged(np.concatenate(hits))]
                    size = len(hits[0])
                    most = max(MOST_ROWS, 2 * size)  # each merge halves at least what it reads, or the next comes at twice the size
    if hits:
        for d, k, f, e, m in _merged(np.concatenate(hits)).tolist():
            found[d].append((test.item_ids[k], f, e, m))
    return counts, found


def _merged(rows: np.ndarray) -> np.ndarray:
    """(document, item, first word, end word, longest) rows with overlapping or adjoining ones of one item in one document made one."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    pair = np.concatenate([[0], np.cumsum((rows[1:, :2] != rows[:-1, :2]).any(1))]) << 40
    end = np.maximum.accumulate(rows[:, 3] + pair) - pair
    same = np.zeros(len(rows), bool)
    same[1:] = (pair[1:] == pair[:-1]) & (rows[1:, 2] <= end[:-1])
    cut = np.flatnonzero(~same)
    return np.stack([*rows[cut, :3].T, np.maximum.reduceat(rows[:, 3], cut), np.maximum.reduceat(rows[:, 4], cut)], 1)


def _blocks_of(benchmark: DataFrame, limit: int) -> Iterator[tuple[int, list]]:
    """How many blocks come behind it, and its rows, for each block of about `limit` bytes of the benchmark's text."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // limit))
    for k in range(n):
        yield n - 1 - k, rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_block_bytes: int = 16 << 20) -> DataFrame:
    """docs with n_words (long) and matches (array of item_id, first_word, end_word, longest): the words covered by windows of each item.

    docs: text and any other columns, all returned (earlier n_words and matches columns are replaced);
    benchmark: item_id, text. The benchmark goes to the executors in blocks of at most `max_block_bytes` of
    text, one pass over docs each, written before the next, so its size is bounded however large it is. Null texts have
    no words, an empty benchmark or one without words matches nothing, items of equal text all match, repeated rows of
    docs are treated each by itself, texts of any length are searched whole, an empty table gives an empty table.
    """
    out = docs.drop("n_words", "matches").withColumns({"n_words": F.lit(0).cast("long"), "matches": F.lit(None).cast(MATCHES)})
    kind = pa.list_(pa.struct([("item_id", pa.string()), ("first_word", pa.int32()), ("end_word", pa.int32()), ("longest", pa.int32())]))
    at, written = out.columns.index("text"), None
    for left, rows in _blocks_of(benchmark, max_block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(test_set([r[0] for r in rows], [r[1] for r in rows], window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low, high, data, offsets in blocks(batch.column(at), SHARD_BYTES):
                    part = batch.slice(low, high - low)
                    counts, found = shard_matches(shared.value, data, offsets)
                    before = part.column(part.num_columns - 1).to_pylist()
                    merged = [(x or []) + [dict(zip(("item_id", "first_word", "end_word", "longest"), y, strict=True)) for y in new] for x, new in zip(before, found, strict=True)]
                    yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(counts, pa.int64()), pa.array(merged, kind)], part.schema.names)

        out = out.mapInArrow(run, out.schema)
        if left:  # written before the next block is sent, so that one block at a time lies on an executor
            written, last = keep(out, "matches"), written
            out = written
            if last is not None:
                forget(last)
            shared.unpersist()
    return out


def covered_words(matches: F.Column) -> F.Column:
    """Words inside any of the matches."""
    start = F.struct(F.lit(0).cast("long").alias("covered"), F.lit(0).alias("end"))
    by_place = F.array_sort(F.transform(matches, lambda m: F.struct(m["first_word"].alias("f"), m["end_word"].alias("e"))))
    step = lambda s, m: F.struct((s["covered"] + F.greatest(m["e"] - F.greatest(m["f"], s["end"]), F.lit(0))).cast("long").alias("covered"), F.greatest(s["end"], m["e"]).alias("end"))
    return F.aggregate(by_place, start, step)["covered"]


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of docs in which no window of any benchmark item occurs, with the columns of docs."""
    names = {c: f"kept_{i}" for i, c in enumerate(docs.columns) if c in ("n_words", "matches")}
    found = find_matches(docs.withColumnsRenamed(names), benchmark, window).where(F.size("matches") == 0).drop("n_words", "matches")
    return found.withColumnsRenamed({v: k for k, v in names.items()}).select(docs.columns)
