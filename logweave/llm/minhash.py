"""MinHash near-duplicates: universal hash minima, banding, signature check, exact confirmation, components.

Documents with equal shingle sets are one node. Nodes that share a band are candidates: a bucket first links its
members to the one with most copies; only buckets that still hold members of different components are compared
further, block by block, with nothing but links leaving a block. So no bucket is expanded into rows of all its
pairs, none is held whole by one task, and the components are those that all pairs of all buckets would give.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bits import bit_table, maybe
from ._bytes import LOWER, blocks, mix, row_of, span_hashes, word_spans
from ._bytes import texts as texts_of
from ._store import forget, keep
from .components import connected_components

MINIMA = 128
BANDS = 32
BLOCK = 512
FEW_PAIRS = 100_000

WORD = np.ones(256, bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False

_RANDOM = np.random.default_rng(7)
_FACTOR = _RANDOM.integers(1, 1 << 32, MINIMA, dtype=np.uint32) | np.uint32(1)
_SHIFT = _RANDOM.integers(0, 1 << 32, MINIMA, dtype=np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text of a block, and each text's offset among them."""
    low = LOWER[data]
    starts, ends, at = word_spans(WORD[low], offsets)
    hashes = span_hashes(low, starts, ends)
    n = len(hashes)
    rolled = np.zeros(n, np.uint64)
    left = np.repeat(at[1:], np.diff(at)) - np.arange(n)  # words from here to the text's end
    for j in range(words):
        here = np.zeros(n, np.uint64)
        here[: max(n - j, 0)] = hashes[j:]
        more = left > j
        rolled[more] = mix(rolled[more]) + here[more]
    counts = np.diff(at)
    whole = left >= np.minimum(words, np.repeat(counts, counts))
    row, rolled = row_of(at)[whole], mix(rolled[whole])
    order = np.lexsort((rolled, row))
    row, rolled = row[order], rolled[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (rolled[1:] != rolled[:-1])
    return rolled[fresh], np.searchsorted(row[fresh], np.arange(len(offsets)))


def signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MINIMA minima (multiply-add modulo 2^32) of each non-empty set."""
    x = (sets >> np.uint64(32)).astype(np.uint32)
    starts = at[:-1][np.diff(at) > 0]
    out = np.empty((len(starts), MINIMA), np.uint32)
    for k in range(MINIMA):
        out[:, k] = np.minimum.reduceat(x * _FACTOR[k] + _SHIFT[k], starts) if len(starts) else 0
    return out


def _summaries(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, h (hash of the text), n (set size), f1 and f2 (a 128-bit fingerprint of the set), sig (the minima; null for the empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in blocks(batch.column(1)):
                sets, at = shingle_sets(data, offsets, words)
                n = np.diff(at)
                sums = np.zeros((2, len(sets) + 1), np.uint64)
                np.cumsum(mix(sets), out=sums[0, 1:])
                np.cumsum(mix(sets ^ np.uint64(0xA0761D6478BD642F)), out=sums[1, 1:])
                f1, f2 = (sums[:, at[1:]] - sums[:, at[:-1]]).view(np.int64)
                minima, sig = signatures(sets, at).astype("<u4"), np.full(high - low, None, object)
                sig[n > 0] = [x.tobytes() for x in minima]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(low, high - low) for k in (0, 2)), pa.array(n), pa.array(f1), pa.array(f2), pa.array(sig, pa.binary())],
                    ["doc_id", "h", "n", "f1", "f2", "sig"],
                )

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text, F.xxhash64(text).alias("h")).mapInArrow(run, "doc_id long, h long, n long, f1 long, f2 long, sig binary")


def _differing(summary: DataFrame) -> DataFrame:
    """doc_id and the least hash of the texts of each doc_id whose rows hold different texts."""
    found = summary.where("doc_id is not null").groupBy("doc_id").agg(F.min("h").alias("least"), F.max("h").alias("most"))
    return found.where("least < most").select("doc_id", "least")


def _band_keys(sig: np.ndarray) -> np.ndarray:
    """Key of each band of each signature."""
    rows = sig.reshape(len(sig), BANDS, -1).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2])
    for j in range(rows.shape[2]):
        key = mix(key) + rows[:, :, j]
    return mix(key).view(np.int64)


def _least_agreement(threshold: float) -> float:
    """Share of minima in which sets of that similarity agree but for a chance under 1e-5."""
    return threshold - 4.5 * (threshold * (1 - threshold) / MINIMA) ** 0.5


def _bands(nodes: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """key, id, copies for each band of each node; wanted: a bit table of keys, others are left out."""
    shared = nodes.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key = _band_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, MINIMA))
            key, rest = key.reshape(-1), [np.repeat(batch.column(k).to_numpy(), BANDS) for k in (0, 2)]
            hit = np.ones(len(key), bool) if shared.value is None else maybe(shared.value, key)
            out = [pa.array(x[hit]) for x in (key, *rest)]
            yield pa.RecordBatch.from_arrays(out, ["key", "id", "copies"])

    return nodes.select("id", "sig", "copies").mapInArrow(run, "key long, id long, copies long")


def _named(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of table (id, ...) that the pairs name. Few pairs go to the table, so that it isn't shuffled for them."""
    ids = pairs.select(F.col("u").alias("id")).unionAll(pairs.select(F.col("v").alias("id"))).distinct()
    return table.join(F.broadcast(ids) if pairs.count() <= FEW_PAIRS else ids, "id", "left_semi")


def _likely(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose signatures agree as far as sets of that similarity do but for a chance under 1e-5."""
    least = _least_agreement(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u4").reshape(-1, MINIMA) for k in (2, 3))
                yield batch.select(["u", "v"]).filter(pa.array((a == b).mean(1) >= least))

    sig = _named(nodes.select("id", "sig"), pairs)
    both = pairs.join(sig.select(F.col("id").alias("v"), F.col("sig").alias("sv")), "v")
    both = both.join(sig.select(F.col("id").alias("u"), F.col("sig").alias("su")), "u").select("u", "v", "su", "sv")
    return both.mapInArrow(run, "u long, v long")


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets have 100 * intersection >= percent * union."""
    some = _named(texts, pairs)
    both = pairs.join(some.select(F.col("id").alias("v"), F.col("text").alias("tv")), "v")
    both = both.join(some.select(F.col("id").alias("u"), F.col("text").alias("tu")), "u").select("u", "v", "tu", "tv")

    def sets_of(column: pa.Array) -> list[np.ndarray]:
        out = []
        for _, _, data, offsets in blocks(column):
            sets, at = shingle_sets(data, offsets, words)
            out += [sets[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                u = part.column(0).to_numpy()
                new = np.ones(len(u), bool)
                new[1:] = u[1:] != u[:-1]  # neighbouring pairs mostly share u
                left = sets_of(part.column(2).filter(pa.array(new)))
                of = np.cumsum(new) - 1
                good = []
                for k, b in enumerate(sets_of(part.column(3))):
                    a = left[of[k]]
                    common = np.intersect1d(a, b, assume_unique=True).size
                    good.append(common > 0 and 100 * common >= percent * (a.size + b.size - common))
                yield part.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "u long, v long")


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, text (of different ones the one of least hash) of the documents named; the others' texts are left out before anything is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(ids, "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(maybe(shared.value, batch.column(0).to_numpy())))

    some = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null")
    return some.mapInArrow(run, some.schema).join(ids, "id", "left_semi").groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def _labelled(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """id, c (component) of each node that the pairs name."""
    ids = pairs.select(F.col("u").alias("id")).unionAll(pairs.select(F.col("v").alias("id"))).distinct()
    return ids.join(connected_components(links), "id", "left").select("id", F.coalesce("component", "id").alias("c"))


def _merged(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Labels after further links: only components that these join move."""
    c = labels.select("id", "c")
    between = more.join(c.select(F.col("id").alias("u"), F.col("c").alias("cu")), "u").join(c.select(F.col("id").alias("v"), F.col("c").alias("cv")), "v")
    moved = connected_components(between.select(F.col("cu").alias("u"), F.col("cv").alias("v")))
    return labels.join(moved.select(F.col("id").alias("c"), F.col("component").alias("now")), "c", "left").select("id", F.coalesce("now", "c").alias("c"))


def _agreeing(table: pa.Table, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """(row, later rows) of a group of _within that agree by signature, lie in different components and share this band first."""
    sig = np.frombuffer(b"".join(table["sig"].to_pylist()), "<u4").reshape(-1, MINIMA)
    keys, key = _band_keys(sig), table["key"][0].as_py()
    c, block = table["c"].to_numpy(), table["own"].to_numpy()
    cross = table["b1"][0].as_py() != table["b2"][0].as_py()
    for i in range(len(sig)):
        rest = np.arange(i + 1, len(sig))
        rest = rest[(c[rest] != c[i]) & ((block[rest] != block[i]) | (not cross))]
        if len(rest):
            shared = keys[rest] == keys[i]
            first = shared.argmax(1)
            rest = rest[shared[np.arange(len(rest)), first] & (keys[i][first] == key)]
            rest = rest[(sig[rest] == sig[i]).mean(1) >= least]
        if len(rest):
            yield i, rest


def _within(here: DataFrame, mixed: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, percent: int, put: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Links between members of different components in the buckets `mixed`, found block by block.

    A bucket's members are dealt into blocks of about BLOCK; each pair of blocks is one group, in which a pair of
    members is compared if this is the first band that they share: by signature, and where any agree, the members
    concerned once more on full sets. So texts go only to groups in which their signature agrees with another's,
    and only members and links leave a group. put writes a table that the result reads.
    """
    blocks_in = F.ceil(F.col("n") / BLOCK).cast("int")
    own = here.join(mixed, "key").withColumn("blocks", blocks_in).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = own.select("key", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "own", "id", "c")
    least = _least_agreement(percent / 100)
    columns = ["key", "b1", "b2", "own", "id", "c"]

    def concerned(table: pa.Table) -> pa.Table:
        hit = np.zeros(table.num_rows, bool)
        for i, rest in _agreeing(table, least):
            hit[i] = hit[rest] = True
        return table.select(columns).filter(pa.array(hit))

    sigs = nodes.select("id", "sig")
    asked = own.join(sigs, "id").select(*columns, "sig").groupBy("key", "b1", "b2").applyInArrow(concerned, "key long, b1 int, b2 int, own int, id long, c long")
    rows = put(asked, "concerned").join(sigs, "id").join(texts, "id").select(*columns, "sig", "text")

    def compare(table: pa.Table) -> pa.Table:
        ids, root, column = table["id"].to_numpy(), table["c"].to_numpy().copy(), table["text"].combine_chunks()
        sets: dict[int, np.ndarray] = {}

        def set_of(i: int) -> np.ndarray:
            if i not in sets:
                data, offsets = texts_of(column.slice(i, 1))
                sets[i] = shingle_sets(data[offsets[0] : offsets[1]], offsets - offsets[0], words)[0]
            return sets[i]

        u, v = [], []
        for i, rest in _agreeing(table, least):
            rest = rest[root[rest] != root[i]]  # what this group has joined already needs no more links
            if not len(rest):
                continue
            a, others = set_of(i), [set_of(int(j)) for j in rest]
            size = np.array([len(x) for x in others])
            every = np.concatenate(others)
            hit = a[np.minimum(np.searchsorted(a, every), len(a) - 1)] == every
            common = np.add.reduceat(hit, np.cumsum(size) - size)
            for j in rest[100 * common >= percent * (len(a) + size - common)].tolist():
                if root[j] != root[i]:
                    u.append(ids[i])
                    v.append(ids[j])
                    root[root == root[j]] = root[i]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return rows.groupBy("key", "b1", "b2").applyInArrow(compare, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text; other columns are not looked at).

    Two documents are linked if their sets of shingles of `words` words have 100 * intersection >= percent *
    union; a text of fewer words is one shingle, a null text or one without words has the empty set and is
    linked with nothing. component_id is the least doc_id reachable, kept says that it is the row's own.
    Rows that repeat a doc_id are one document, whose rows share a component; where their texts differ, the one of
    least xxhash64 is compared for all of them, and each row has its own n_shingles. A row without doc_id has no
    component and is kept. An empty table gives an empty one.
    """
    written: list[DataFrame] = []

    def put(df: DataFrame, name: str) -> DataFrame:
        written.append(keep(df, name))
        return written[-1]

    summary = keep(_summaries(docs, words), "summaries")
    known = summary.where("doc_id is not null and n > 0").join(put(_differing(summary), "differing"), "doc_id", "left").where("least is null or h = least")
    sets = put(known.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.count("*").alias("copies")), "sets")
    nodes = put(sets.select("id", "sig", "copies").dropDuplicates(["id"]), "nodes")
    bands = _bands(nodes)
    # The text with most copies leads: it is likeliest the one that the others were made from.
    lead = F.max_by("id", F.struct("copies", -F.col("id")))
    buckets = put(bands.groupBy("key").agg(lead.alias("lead"), F.count("*").alias("n")).where("n > 1").select("key", "lead"), "buckets")
    members = _bands(nodes, bit_table(buckets, "key")).select("key", "id").join(buckets, "key").where("id <> lead")
    members = put(members, "members")
    pairs = put(members.select(F.col("lead").alias("u"), F.col("id").alias("v")).distinct(), "pairs")
    ids = pairs.select(F.col("u").alias("id")).unionAll(pairs.select(F.col("v").alias("id"))).distinct()
    texts = put(_texts_of(docs, put(ids, "ids")), "texts")
    links = put(_confirmed(put(_likely(pairs, nodes, percent / 100), "likely"), texts, words, percent), "links")
    labels = keep(_labelled(pairs, links), "labels")
    here = members.select("key", "id").join(labels, "id").select("key", "id", "c")
    mixed = here.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n")).where("low < high").select("key", "n")
    more = put(_within(here, put(mixed, "mixed"), nodes, texts, words, percent, put), "more")
    if not more.isEmpty():
        written.append(labels)
        labels = keep(_merged(labels, more), "labels")
    # A copy takes the component of the document that stands for its set.
    stands = known.join(sets.select("f1", "f2", "n", "id"), ["f1", "f2", "n"]).where("doc_id <> id").select(F.col("doc_id").alias("v"), "id")
    stands = keep(stands, "stands")
    for table in written:  # the result reads summary, labels and stands alone
        forget(table)
    stands = stands.join(labels, "id", "left").select(F.col("v").alias("doc_id"), F.coalesce("c", "id").alias("component"))
    id_of = labels.select(F.col("id").alias("doc_id"), F.col("c").alias("component")).unionAll(stands).groupBy("doc_id").agg(F.min("component").alias("component"))
    out = summary.select("doc_id", "n").join(id_of, "doc_id", "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with the columns of docs; of rows that repeat a doc_id all stay."""
    gone = near_duplicates(docs, words, percent).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone_id"], "left_anti").select(docs.columns)


__all__ = ["near_duplicates", "one_of_each", "shingle_sets", "signatures"]
