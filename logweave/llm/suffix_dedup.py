"""Suffix-array dedup: bytes of repeated strings, by column-wise construction of a collection's BWT.

Bauer, Cox and Rosone, "Lightweight Algorithms for Constructing and Inverting the BWT of String Collections" (2013),
with common prefixes as in Cox et al. (2016): each round puts one more symbol in front of one suffix of every
string, and updates the collection's BWT, common prefixes and suffix ids, which lie in files that a round reads
and writes in order.

A whole corpus has strings of any length, so the collection is made of segments. Each window of `width` bytes
belongs to one segment, that of its least-hashed gram of 32 bytes (its anchor), so equal windows lie in segments of
equal anchors, at equal distance from it. A segment is shorter than two windows, so rounds are bounded. Segments
whose anchor occurs once hold no repeat; equal segments, cut to what
others of their anchor can share, are one string of the collection; segments that agree with no other are left out; anchors with very many different segments are
cut anew by longer grams.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bits import bit_table, maybe
from ._bytes import blocks, mix, span_hashes, texts
from ._store import forget, keep

GRAMS = (32, 60)
SLICE = 1 << 15  # segments in a batch
MOST_SEGMENTS = 1000  # different segments of an anchor that go into one collection
COLLECTION_BYTES = 1 << 20
LONG_BYTES = 1 << 22

OCCURRENCE = "anchor long, key long, more long, around int, segment binary, doc_id long, start long"


def _periodic(data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, first: np.ndarray, anchor: np.ndarray, width: int) -> np.ndarray:
    """Windows that equal the one a period before in their text, where their anchors come so soon again.

    They repeat an earlier string whatever else the corpus holds, and no string has one of them as its first place.
    Gram hashes say which windows may be such; the bytes decide.
    """
    out = np.zeros(len(starts), bool)
    change = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    upto = np.append(change[1:], len(starts))
    now, before = anchor[change], anchor[change - 1]
    again = (now >> np.uint64(24) == before >> np.uint64(24)) & (now > before) & (first[change] == first[change - 1])
    step = now - before
    again[1:] &= again[:-1] & (step[1:] == step[:-1])  # twice at least at the same distance, as in any longer run
    again[:1] = False
    size = (upto - change)[again]
    if not len(size):
        return out
    w = np.repeat(change[again] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    period = np.repeat(step.astype(np.int64)[again], size)
    ok = starts[w] - period >= first[w]
    w, period = w[ok], period[ok]
    gram = len(data) - len(hashes) + 1
    for at in (*range(0, width - gram, gram), width - gram):
        ok = hashes[starts[w] + at] == hashes[starts[w] - period + at]
        w, period = w[ok], period[ok]
    for q in np.unique(period).tolist():
        mine = w[period == q]
        at = starts[mine] - q
        if len(mine) * width < len(data):
            span = at[:, None] + np.arange(width)
            out[mine] = (data[span] == data[span + q]).all(1)
        else:
            differ = np.concatenate([[0], np.cumsum(data[q:] != data[:-q])])
            out[mine] = differ[at + width] == differ[at]
    return out


def _spans(starts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of consecutive window starts of one text begin, and the last of each."""
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] != starts[:-1] + 1) | (first[1:] != first[:-1])
    cut = np.flatnonzero(new)
    return cut, np.append(cut[1:], len(starts))[: len(cut)] - 1


def segments(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """First and last window start of each segment of a block's texts, its anchor's hash and its anchor's place;
    then first and last start of runs of windows that repeat the one a period before, which are in no segment."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < width:
        return none, none, np.zeros(0, np.uint64), none, none, none
    if n > LONG_BYTES and len(offsets) == 2:  # one very long text: piece by piece, each window in one of them
        parts = []
        for at in range(0, n - width + 1, LONG_BYTES - width):
            piece = data[at : at + LONG_BYTES - 1]
            low, high, anchor, place, *runs = segments(piece, np.array([0, len(piece)]), width, gram)
            parts.append((low + at, high + at, anchor, place + at, *(x + at for x in runs)))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    at = np.arange(n - gram + 1)
    hashes = span_hashes(data, at, at + gram)
    packed = (hashes & ~np.uint64((1 << 24) - 1)) | (at & ((1 << 24) - 1)).astype(np.uint64)
    span, least = 1, packed
    while span * 2 <= width - gram + 1:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - gram + 1 - span
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    length = np.diff(offsets)
    first = np.repeat(offsets[:-1], np.maximum(length - width + 1, 0))
    starts = first + np.arange(len(first)) - np.repeat(np.cumsum(np.maximum(length - width + 1, 0)) - np.maximum(length - width + 1, 0), np.maximum(length - width + 1, 0))
    if not len(starts):
        return none, none, np.zeros(0, np.uint64), none, none, none
    anchor = least[starts]
    gone = _periodic(data, hashes, starts, first, anchor, width)
    runs = none, none
    if gone.any():
        a, b = _spans(starts[gone], first[gone])
        runs = starts[gone][a], starts[gone][b]
        starts, first, anchor = starts[~gone], first[~gone], anchor[~gone]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)  # between two texts lies no window, so their starts jump
    cut = np.flatnonzero(new)
    last = np.append(cut[1:], len(starts))[: len(cut)] - 1
    place = (anchor[cut] & np.uint64((1 << 24) - 1)).astype(np.int64)
    return starts[cut], starts[last], mix(hashes[place] + np.uint64(gram)), place, *runs


class _Columns:
    """BWT symbols, common prefixes and suffix ids of a collection, in files that are read and written in order.

    A round writes over what the round before wrote, which is never longer; the files have no name and go when closed.
    """

    KINDS = (np.uint8, np.uint8, np.int32)

    def __enter__(self) -> _Columns:
        self.files = [tempfile.TemporaryFile() for _ in self.KINDS]
        return self

    def __exit__(self, *_: object) -> None:
        for file in self.files:
            file.close()

    def read(self) -> list[np.ndarray]:
        for file in self.files:
            file.seek(0)
        return [np.frombuffer(file.read(), kind) for file, kind in zip(self.files, self.KINDS, strict=True)]

    def write(self, *columns: np.ndarray) -> None:
        for file, kind, column in zip(self.files, self.KINDS, columns, strict=True):
            file.seek(0)
            file.write(np.ascontiguousarray(column, kind))
            file.flush()


def build(strings: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix ids (place in the strings, joined with one byte in front of each) in order, and common prefixes with the suffix before, up to `depth`.

    Strings hold no byte 255 (UTF-8 has none) and depth is under 255.
    """
    joined = np.frombuffer(b"".join(b"\xff" + s for s in strings), np.uint8) + np.uint8(1)  # 0 in front of each string
    ends = np.cumsum([len(s) + 1 for s in strings])
    with _Columns() as files:
        files.write(joined[ends - 1], np.zeros(len(ends)), ends)  # the empty suffix of each string
        empty, last = len(strings), np.ones(len(strings), bool)  # last: what the last round put in
        while True:
            bwt, lcp, ids = files.read()
            order = np.argsort(bwt, kind="stable")[len(bwt) - np.count_nonzero(bwt) :]  # a whole string has no symbol in front
            at = np.flatnonzero(last[order])  # the new suffixes' places behind the empty ones
            if not len(at):
                break
            source = order[at]
            old = np.ones(len(bwt) + len(at), bool)
            old[at + empty] = False
            more = []
            for column, new in ((bwt, joined[ids[source] - 2]), (lcp, 0), (ids, ids[source] - 1)):
                wider = np.empty(len(old), column.dtype)
                wider[old] = column
                wider[at + empty] = new
                more.append(wider)
            # Common prefixes change at the new suffixes and right behind them: one more than the least between
            # the suffixes that they extend, where both begin with the same symbol.
            touched = np.union1d(at, at + 1)
            touched = touched[(touched > 0) & (touched < len(order))]
            before, here = order[touched - 1], order[touched]
            common = np.zeros(len(touched), np.uint8)
            same = np.flatnonzero(bwt[before] == bwt[here])
            by = same[np.argsort(before[same], kind="stable")]
            if len(by):
                ends_of = np.stack([before[by] + 1, here[by] + 1], 1).reshape(-1)
                least = np.minimum.reduceat(np.append(lcp, np.uint8(0)), ends_of)[::2]
                common[by] = np.minimum(least, depth - 1) + np.uint8(1)
            more[1][touched + empty] = common
            files.write(*more)
            last = ~old
        _, lcp, ids = files.read()
    return ids, lcp


def repeats(strings: list[bytes], place: np.ndarray, width: int) -> Iterator[tuple[int, int, int]]:
    """(string, first, end) of byte runs covered by windows that also start earlier; place: (doc_id, start) of each string."""
    ids, lcp = build(strings, width)
    heads = np.cumsum([0] + [len(s) + 1 for s in strings])
    string = np.searchsorted(heads, ids, "right") - 1
    whole = heads[np.minimum(string + 1, len(strings))] - ids >= width
    group = np.cumsum(lcp < width)[whole]
    string, at = string[whole], (ids - heads[string] - 1)[whole]
    document, start = place[string, 0], place[string, 1] + at
    order = np.lexsort((start, document, group))
    later = np.zeros(len(order), bool)
    later[1:] = group[order][1:] == group[order][:-1]
    string, at = string[order][later], at[order][later]
    order = np.lexsort((at, string))
    string, at = string[order], at[order]
    if len(at):
        new = np.ones(len(at), bool)
        new[1:] = (string[1:] != string[:-1]) | (at[1:] > at[:-1] + width)
        cut = np.flatnonzero(new)
        last = np.concatenate([cut[1:], [len(at)]]) - 1
        yield from zip(string[cut].tolist(), at[cut].tolist(), (at[last] + width).tolist(), strict=True)


def _cut(data: np.ndarray, offsets: np.ndarray, document: np.ndarray, shift: np.ndarray, width: int, gram: int, bits: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Segments of a block as occurrences; bits: only anchors whose bit is set. Runs of periodic windows are rows without segment, from start to `more`."""
    low, high, anchor, place, first, last = segments(data, offsets, width, gram)
    names = [x.split()[0] for x in OCCURRENCE.split(", ")]
    if len(first):
        text = np.searchsorted(offsets, first, "right") - 1
        back = shift[text] - offsets[text]
        zero, n = pa.array(np.zeros(len(first), np.int64)), len(first)
        yield pa.RecordBatch.from_arrays([zero, zero, pa.array(last + width + back), zero.cast(pa.int32()), pa.nulls(n, pa.binary()), pa.array(document[text]), pa.array(first + back)], names)
    if bits is not None and len(anchor):
        hit = maybe(bits, anchor.view(np.int64))
        low, high, anchor, place = low[hit], high[hit], anchor[hit], place[hit]
    text = np.searchsorted(offsets, low, "right") - 1
    for part in np.array_split(np.arange(len(low)), 1 + len(low) // SLICE):
        found = [data[i : j + width].tobytes() for i, j in zip(low[part].tolist(), high[part].tolist(), strict=True)]
        keys = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in found), np.int64).reshape(-1, 2)
        of = text[part]
        columns = [anchor[part].view(np.int64), keys[:, 0], keys[:, 1], (place - low)[part].astype(np.int32), pa.array(found, pa.binary()), document[of], low[part] - offsets[of] + shift[of]]
        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names)


def _repeated_anchors(docs: DataFrame, width: int) -> np.ndarray:
    """Bits of anchors that occur more than once: a fixed number of words, whatever the input's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(1)):
                anchor, n = np.unique(segments(data, offsets, width, GRAMS[0])[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(n)], ["anchor", "n"])

    counts = docs.mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    return bit_table(counts, "anchor")


def _with_segments(found: DataFrame, firsts: DataFrame, same: list[str]) -> DataFrame:
    """firsts with the bytes of their segments; others are left out before anything is shuffled."""
    shared = found.sparkSession.sparkContext.broadcast(bit_table(firsts, "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(maybe(shared.value, batch.column(1).to_numpy())))

    some = found.select(*same, "around", "segment", "doc_id", "start")
    return some.mapInArrow(run, some.schema).join(firsts, [*same, "doc_id", "start"])


def _promising(anchor: np.ndarray, around: np.ndarray, strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments that agree with others of their anchor over `width` bytes around it, and the part of each that can lie in a common window.

    Equal windows lie at equal distance from equal anchors, so their bytes before and behind the anchor's start agree;
    what is sorted here are only these contexts, to leave out what no other segment can share.
    """
    name = [a.tobytes() for a in anchor.astype(">i8")]
    reach = []
    for side in (1, -1):
        context = np.zeros((len(strings), 8 + width), np.uint8)
        size = np.zeros(len(strings), np.int64)
        for i, (x, k) in enumerate(zip(strings, around.tolist(), strict=True)):
            part = (x[k:] if side > 0 else x[:k][::-1])[:width]
            row = name[i] + part
            context[i, : len(row)] = np.frombuffer(row, np.uint8)
            size[i] = len(part)
        order = np.argsort(context.view(f"S{8 + width}").reshape(-1), kind="stable")
        agree = (context[order[1:]] != context[order[:-1]]).argmax(1)
        agree[(context[order[1:]] == context[order[:-1]]).all(1)] = 8 + width
        both = np.zeros(len(strings) + 1, np.int64)
        both[1:-1] = np.maximum(agree - 8, 0)
        best = np.empty(len(strings), np.int64)
        best[order] = np.maximum(both[:-1], both[1:])
        reach.append(np.minimum(best, size))
    ahead, behind = reach
    good = np.flatnonzero(ahead + behind >= width)
    return good, (around - behind)[good], (around + ahead)[good]


def _resolve(every: DataFrame, width: int, level: int, tables: list[DataFrame]) -> DataFrame:
    """doc_id, first, end of runs of `every` (occurrences of segments, and runs of periodic windows) whose windows also start earlier in it.

    tables gets what was written on the way and is read by the result.
    """
    same = ["anchor", "key", "more"]
    found = every.where("segment is not null")
    decided = every.where("segment is null").select("doc_id", F.col("start").alias("first"), F.col("more").alias("end"))
    distinct = keep(found.groupBy(*same).agg(F.min(F.struct("doc_id", "start")).alias("least")), "segments")
    tables += [every, distinct]
    at = lambda df: df.select(*same, "least.doc_id", "least.start")
    copies = found.select(*same, F.col("doc_id").alias("d"), F.col("start").alias("s"), F.octet_length("segment").alias("n")).join(at(distinct), same)
    copies = copies.where((F.col("d") != F.col("doc_id")) | (F.col("s") != F.col("start")))
    runs = decided.unionAll(copies.select(F.col("d").alias("doc_id"), F.col("s").alias("first"), (F.col("s") + F.col("n")).alias("end")))
    if level > len(GRAMS):  # a segment is one window here: equal anchors are equal segments
        return runs
    groups = keep(distinct.groupBy("anchor").agg(F.count("*").alias("different")).where("different > 1"), "anchors")
    firsts = keep(distinct.join(groups, "anchor").select(*same, "least.doc_id", "least.start", "different"), "firsts")
    open_ = keep(_with_segments(found, firsts, same), "open")
    forget(firsts)
    forget(groups)
    tables.append(open_)
    few = open_.where(F.col("different") <= MOST_SEGMENTS)
    size = few.agg(F.sum(F.octet_length("segment"))).first()[0] or 0
    spark = every.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (2 * COLLECTION_BYTES)))

    def collections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        whole, anchor = table["segment"].to_pylist(), table["anchor"].to_numpy()
        good, low, high = _promising(anchor, table["around"].to_numpy(), whole, width)
        document, start = table["doc_id"].to_numpy()[good], table["start"].to_numpy()[good] + low
        groups: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
        for a, i, x, y, d, s in zip(anchor[good].tolist(), good.tolist(), low.tolist(), high.tolist(), document.tolist(), start.tolist(), strict=True):
            groups.setdefault(a, {}).setdefault(whole[i][x:y], []).append((d, s))
        runs: list[tuple[int, int, int]] = []
        strings: list[bytes] = []
        place: list[tuple[int, int]] = []

        def flush() -> None:
            at = np.array(place, np.int64)
            runs.extend((place[k][0], place[k][1] + i, place[k][1] + j) for k, i, j in repeats(strings, at, width))
            strings.clear()
            place.clear()

        for parts in groups.values():
            for part, places in parts.items():  # equal parts are one string of the collection, the earliest; the others repeat it
                first = min(places)
                runs += [(d, s, s + len(part)) for d, s in places if (d, s) != first]
                if len(parts) > 1:
                    strings.append(part)
                    place.append(first)
            if len(strings) * width >= COLLECTION_BYTES:
                flush()
        if strings:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*runs, strict=True)) or [()] * 3], ["doc_id", "first", "end"])

    runs = runs.unionAll(few.repartition(parts, "anchor").mapInArrow(collections, "doc_id long, first long, end long"))
    many = open_.where(F.col("different") > MOST_SEGMENTS).select("segment", "doc_id", "start")
    if many.isEmpty():
        return runs
    gram = GRAMS[level] if level < len(GRAMS) else width

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                data, offsets = texts(part.column(0))
                data = data[offsets[0] : offsets[-1]]
                yield from _cut(data, offsets - offsets[0], part.column(1).to_numpy(), part.column(2).to_numpy(), width, gram)

    return runs.unionAll(_resolve(keep(many.mapInArrow(finer, OCCURRENCE), "finer"), width, level + 1, tables))


def repeated_runs(docs: DataFrame, width: int = 100, tables: list[DataFrame] | None = None) -> DataFrame:
    """doc_id, first, end (bytes) of runs covered by strings of `width` bytes that also start earlier: in a document of smaller
    doc_id, or earlier in the same one. Runs of a document may overlap; together they cover all such bytes and no others.

    docs: doc_id, text, the UTF-8 of whole texts; null counts as empty. Rows without doc_id take no part; rows that
    repeat a doc_id with equal text are one document. A text of any length is read whole, and a run of one character or
    another period is decided where it stands. width: more than the longest gram and under 255 (UTF-8 has no such byte,
    and common prefixes are single bytes). tables, if given, gets the written tables that the result reads, for forget()
    once the result is written itself.
    """
    if not max(GRAMS) < width < 255:
        raise ValueError(f"width must lie between {max(GRAMS) + 1} and 254")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    shared = docs.sparkSession.sparkContext.broadcast(_repeated_anchors(base, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            document = batch.column(0).to_numpy()
            for low, high, data, offsets in blocks(batch.column(1)):
                yield from _cut(data, offsets, document[low:high], np.zeros(high - low, np.int64), width, GRAMS[0], shared.value)

    return _resolve(keep(base.mapInArrow(run, OCCURRENCE), "occurrences"), width, 1, [] if tables is None else tables)


def dedup(docs: DataFrame, width: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) for each row of docs; see repeated_runs.

    Spans are maximal: runs that overlap or adjoin are one. A row without doc_id keeps its bytes. An empty table
    gives an empty table; other columns are not looked at.
    """
    # A document has fewer runs than windows, so a row of its runs grows with its text, which stands in the same row.
    tables: list[DataFrame] = []
    found = keep(repeated_runs(docs, width, tables), "runs")
    for table in tables:
        forget(table)
    runs = found.groupBy("doc_id").agg(F.collect_set(F.struct("first", "end")).alias("runs"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(runs.withColumnRenamed("doc_id", "run_doc"), F.col("doc_id") == F.col("run_doc"), "left").select("doc_id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = (text or "").encode()
                kept, at, removed, spans = [], 0, 0, 0
                end = -1
                for r in sorted(found or [], key=lambda r: (r["first"], r["end"])):
                    if r["first"] > end:
                        kept.append(raw[at : r["first"]])
                        spans += 1
                        end = r["first"]
                    removed += max(0, r["end"] - max(end, r["first"]))
                    end = at = max(end, r["end"])
                out.append((len(raw), removed, spans, b"".join([*kept, raw[at:]])))
            columns = [pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
