"""Fill-in-the-middle: each document's token boundaries as a compressed set, from which both cuts are selected.

The boundaries of a block of whole texts are one set in the manner of Roaring bitmaps (Lemire et al., 2016): offsets are
grouped by their upper bits into containers of 2^16 places, each stored as a sorted array, a bitmap or a list of runs,
whichever is smallest, with cumulative cardinalities over the containers. A cut is the k-th boundary after its document's
start: the container is found by binary search in the cardinalities, the offset by a select inside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import blocks, word_spans

PLACES = 1 << 16
WORDS = PLACES // 64
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class Array:
    """Sorted low bits."""

    def __init__(self, low: np.ndarray) -> None:
        self.low = low.astype(np.uint16)

    def select(self, k: np.ndarray) -> np.ndarray:
        return self.low[k].astype(np.int64)

    def rank(self, low: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, low)


class Bitmap:
    """One bit for each place, with the set bits before each word."""

    def __init__(self, low: np.ndarray) -> None:
        bits = np.zeros(PLACES, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def _bits(self, word: np.ndarray) -> np.ndarray:
        return np.unpackbits(self.words[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")

    def select(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.before, k, "right") - 1
        upto = np.cumsum(self._bits(word), axis=1, dtype=np.int64)
        return word * 64 + (upto > (k - self.before[word])[:, None]).argmax(1)

    def rank(self, low: np.ndarray) -> np.ndarray:
        word = low >> 6
        return self.before[word] + (self._bits(word) * (np.arange(64) < (low & 63)[:, None])).sum(1, dtype=np.int64)


class Runs:
    """First places and lengths of runs of neighbouring places."""

    def __init__(self, low: np.ndarray) -> None:
        first = np.flatnonzero(np.diff(low, prepend=-2) != 1)
        self.first = low[first].astype(np.uint16)
        self.before = np.append(first, len(low)).astype(np.int32)

    def select(self, k: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.before, k, "right") - 1
        return self.first[run].astype(np.int64) + k - self.before[run]

    def rank(self, low: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.first, low, "right") - 1
        inside = np.minimum(low - self.first[run].astype(np.int64), self.before[run + 1] - self.before[run])
        return np.where(run < 0, 0, self.before[run] + inside)


def container(low: np.ndarray) -> Array | Bitmap | Runs:
    """The smallest of the three for these sorted, distinct low bits."""
    runs = 1 + int(np.count_nonzero(np.diff(low) != 1))
    kinds = ((2 * len(low), Array), (PLACES // 8, Bitmap), (4 * runs + 2, Runs))
    return min(kinds, key=lambda k: k[0])[1](low)


class BoundarySet:
    """A set of offsets, built from its members in rising order."""

    def __init__(self, members: np.ndarray) -> None:
        self.keys, first = np.unique(members >> 16, return_index=True)
        self.before = np.append(first, len(members))
        self.parts = [container(members[a:b] & (PLACES - 1)) for a, b in zip(self.before[:-1], self.before[1:], strict=True)]

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: np.ndarray) -> np.ndarray:
        """The members of these ranks, from 0."""
        at, out = np.searchsorted(self.before, k, "right") - 1, np.zeros(len(k), np.int64)
        for p in np.unique(at):
            of = at == p
            out[of] = (self.keys[p] << 16) + self.parts[p].select(k[of] - self.before[p])
        return out

    def rank(self, offsets: np.ndarray) -> np.ndarray:
        """How many members are below each offset."""
        at = np.searchsorted(self.keys, offsets >> 16)
        out = self.before[at].astype(np.int64)
        same = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == offsets >> 16))
        for p in np.unique(at[same]):
            of = same[at[same] == p]
            out[of] += self.parts[p].rank(offsets[of] & (PLACES - 1))
        return out


def boundaries(data: np.ndarray, offsets: np.ndarray) -> BoundarySet:
    """Byte offsets at which tokens end, and 0, of texts laid end to end.

    A token is white space and the word behind it, or the white space that ends a text. The end of a text that is not empty is
    a boundary, and so the start of the next.
    """
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    _, ends, _ = word_spans(~blank, offsets)
    last = offsets[1:][np.diff(offsets) > 0]
    return BoundarySet(np.union1d(np.append(ends, 0), last[blank[last - 1]]))


def transform(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for each row of docs (doc_id, text; other columns are not looked at).

    n is the number of tokens of the whole text. The numbers that decide come from the hash of `seed` and doc_id: two cuts among
    the n + 1 boundaries, whether a text is transformed (`percent` of them), and if so whether the suffix goes first
    (`spm_percent`). Texts that are empty or hold one of the three marks stay as they are (form plain, chars null); a null text
    counts as empty, a null doc_id as no digits. Repeated rows give repeated results; an empty table gives an empty one. Memory
    is that of a block of 1 MB of texts, or of one text that is longer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.stack([batch.column(i).to_numpy() for i in range(2, 6)])
            for low, high, data, offsets in blocks(batch.column(1)):
                known = boundaries(data, offsets)
                first = known.rank(offsets[:-1])
                n = known.rank(offsets[1:]) - first
                cuts = np.sort(h[:2, low:high] % (n + 1), axis=0)
                a, b = (known.select(first + k) for k in cuts)
                lead = (data & 0xC0) != 0x80
                form, prefix, middle, output = [], [], [], []
                for i in range(high - low):
                    s, e = int(offsets[i]), int(offsets[i + 1])
                    text = data[s:e].tobytes()
                    if not text or h[2, low + i] % 100 >= percent or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE)):
                        form.append("plain"), prefix.append(None), middle.append(None), output.append(text)
                        continue
                    p, m = int(a[i]) - s, int(b[i]) - s
                    head = (PREFIX.encode(), text[:p]), (SUFFIX.encode(), text[m:])
                    spm = h[3, low + i] % 100 < spm_percent
                    form.append("spm" if spm else "psm")
                    prefix.append(int(np.count_nonzero(lead[s : s + p])))
                    middle.append(int(np.count_nonzero(lead[s + p : s + m])))
                    output.append(b"".join([*sum(head[:: -1 if spm else 1], ()), MIDDLE.encode(), text[p:m]]))
                columns = [pa.array(n), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring("hash", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select("doc_id", "text", hashed.alias("hash")).select("doc_id", "text", *numbers)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text of an output: plain as it is, others cut at their marks, which no transformed text holds itself."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
