"""BPE encoding and decoding by a tokenization automaton compiled from a public tokenizer's merges.

Berglund, Martens and van der Merwe, "Constructing a BPE Tokenization DFA" (2024): start with one state and an arc
for each byte; the gadget of the merge (a, b) -> c redirects the arcs labelled a to a state without an arc b, and
adds, wherever a could be followed by b, an arc c to where b led. The gadgets are applied in the order of the
merges to a table of states and arcs: the state that an arc leads to depends on its label only, and labels that
leave from the same states share a column, so the finished table is one bit for each state and column. It is
compiled once on the driver and sent to the executors as arrays; its size depends on the tokenizer alone.

A word is encoded by running the automaton along its bytes: a second table steps from byte to byte through the
labels, and of the labels that lead to a place in the word exactly one is an arc of the state reached at its
start, since each start of a word has one encoding. So every place is reached in one state, left to right, with
no search and nothing taken back. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import blocks, span_hashes

# The white space of byte-level BPE's split pattern, and its contractions.
SPACE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

BLOCK = 1 << 19
CHUNK = 4096  # places of a word that are looked at together
OTHER, WHITE, LETTER, NUMBER = range(4)


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _kinds() -> np.ndarray:
    """OTHER, WHITE, LETTER or NUMBER for each code point."""
    out = np.zeros(0x110000, np.uint8)
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    text = "".join(map(chr, points.tolist()))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, text):
            out[points[m.start() : m.end()]] = kind
    out[list(SPACE)] = WHITE
    return out


class Labels:
    """What each token id spells, as one buffer."""

    def __init__(self, labels: list[bytes]):
        self.data = np.frombuffer(b"".join(labels), np.uint8)
        self.size = np.array([len(x) for x in labels], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def spell(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the texts whose ids lie between the offsets; ids outside the vocabulary emit nothing."""
        known = (ids >= 0) & (ids < len(self.size))
        size = np.where(known, self.size[np.where(known, ids, 0)], 0)
        ends = np.cumsum(size)
        start = self.start[np.where(known, ids, 0)]
        total = int(ends[-1]) if len(ends) else 0
        data = self.data[np.repeat(start - (ends - size), size) + np.arange(total)]
        return data, np.concatenate([[0], ends])[offsets]


class Table:
    """States and arcs while the gadgets are applied: row and column of each label, one bit for each row and column."""

    def __init__(self, labels: int):
        self.row, self.column = np.full(labels, -1, np.int32), np.full(labels, -1, np.int32)
        self.bits = np.zeros((1024, 128), np.uint8)
        self.bits[0, 0] = 1
        self.rows, self.columns = [1], [0]  # labels that share each; the first row is also where a word begins

    def byte(self, label: int) -> None:
        self.row[label] = self.column[label] = 0
        self.rows[0] += 1
        self.columns[0] += 1

    def follows(self, a: int, b: int) -> bool:
        r, c = self.row[a], self.column[b]
        return r >= 0 and c >= 0 and bool(self.bits[r, c >> 3] >> (c & 7) & 1)

    def _own_row(self, a: int, always: bool) -> None:
        """A row that no other label shares; always: a new one, for the old one to stay as it is."""
        old, new = self.row[a], len(self.rows)
        if self.rows[old] > 1 or always:
            if new == len(self.bits):
                self.bits = np.concatenate([self.bits, np.zeros_like(self.bits)])
            self.bits[new] = self.bits[old]
            self.rows[old] -= 1
            self.rows.append(1)
            self.row[a] = new

    def _own_column(self, b: int) -> None:
        old, new = self.column[b], len(self.columns)
        if self.columns[old] > 1:
            if new == 8 * self.bits.shape[1]:
                self.bits = np.concatenate([self.bits, np.zeros_like(self.bits)], 1)
            used = self.bits[: len(self.rows)]
            used[:, new >> 3] |= (used[:, old >> 3] >> np.uint8(old & 7) & np.uint8(1)) << np.uint8(new & 7)
            self.columns[old] -= 1
            self.columns.append(1)
            self.column[b] = new

    def gadget(self, a: int, b: int, c: int) -> None:
        if not self.follows(a, b):  # no path has an arc b behind an arc a any more
            return
        if self.row[c] >= 0:
            raise ValueError("two merges make the same token in the same place")
        led = self.row[b]
        self._own_row(a, always=a == b)
        self._own_column(b)
        r, k = self.row[a], self.column[b]
        self.bits[r, k >> 3] &= np.uint8(255 ^ 1 << (k & 7))
        self.row[c], self.column[c] = led, self.column[a]
        self.rows[led] += 1
        self.columns[self.column[a]] += 1

    def finished(self) -> np.ndarray:
        return self.bits[: len(self.rows), : (len(self.columns) + 7) // 8].copy()


@dataclass
class Automaton:
    """The compiled tables: arcs (bits by state and column), row (state behind a label), column, and the steps from byte to byte.

    steps: sorted node << 8 | byte, with the node that each leads to; token: the label that a node completes, -1 for none.
    """

    arcs: np.ndarray
    row: np.ndarray
    column: np.ndarray
    size: np.ndarray
    steps: np.ndarray
    leads: np.ndarray
    token: np.ndarray
    kinds: np.ndarray
    special: dict[str, int]

    def _labels_at(self, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into at, label) of each label that stands at a place of the data and ends by `end`."""
        which, labels = [], []
        live, node, depth = np.arange(len(at)), np.zeros(len(at), self.leads.dtype), 0
        while len(live):
            inside = at[live] + depth < end[live]
            live, node = live[inside], node[inside]
            key = node << 8 | data[at[live] + depth]
            place = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
            on = self.steps[place] == key
            live, node = live[on], self.leads[place[on]]
            whole = self.token[node] >= 0
            which.append(live[whole])
            labels.append(self.token[node[whole]])
            depth += 1
        return np.concatenate([*which, np.zeros(0, np.int64)]), np.concatenate([*labels, np.zeros(0, np.int32)])

    def paths(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Labels along the path of each word data[start:end], one behind the other, and each word's offset among them."""
        length = ends - starts
        order = np.argsort(-length, kind="stable")
        start, size = starts[order], length[order]
        head = np.cumsum(size + 1) - size - 1  # each word has a place in front of each byte and one at its end
        state, came = np.zeros(int((size + 1).sum()), np.int32), np.full(int((size + 1).sum()), -1, np.int32)
        for low in range(0, int(size[0]) if len(size) else 0, CHUNK):
            n = int(np.searchsorted(-size, -low, "left"))  # words longer than low
            count = np.minimum(size[:n] - low, CHUNK)
            word = np.repeat(np.arange(n), count)
            inside = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) + low
            which, label = self._labels_at(data, start[word] + inside, start[word] + size[word])
            begin = (inside[which] - low).astype(np.uint16)
            by = np.argsort(begin, kind="stable")
            which, label = which[by], label[by]
            source = head[word[which]] + inside[which]
            to, column, leads = source + self.size[label], self.column[label], self.row[label]
            place, bit = column >> 3, (column & 7).astype(np.uint8)
            cuts = np.searchsorted(begin[by], np.arange(int(count.max()) + 1))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                good = np.flatnonzero(self.arcs[state[source[a:b]], place[a:b]] >> bit[a:b] & 1) + a
                state[to[good]], came[to[good]] = leads[good], label[good]
        return self._back(came, head, size, order)

    def _back(self, came: np.ndarray, head: np.ndarray, size: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The labels along each path, read off from its end."""
        word, at = np.arange(len(size)), head + size
        found, of = [], []
        while (more := at > head[word]).any():
            word, at = word[more], at[more]
            t = came[at]
            if (t < 0).any():
                raise ValueError("a byte has no arc")
            found.append(t)
            of.append(order[word])
            at = at - self.size[t]
        if not found:
            return np.zeros(0, np.int32), np.zeros(len(size) + 1, np.int64)
        labels, of = np.concatenate(found[::-1]), np.concatenate(of[::-1])
        by = np.argsort(of, kind="stable")
        return labels[by], np.searchsorted(of[by], np.arange(len(size) + 1))

    def words(self, code: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where the words of the texts begin that start at the places `first` of the code points: byte-level BPE's split pattern.

        That is: a contraction; letters, numbers or other marks with one space in front; white space up to the last of
        it before a word; white space.
        """
        n = len(code)
        kind = self.kinds[code]
        begins = np.zeros(n, bool)
        begins[first[first < n]] = True
        run = begins.copy()
        run[1:] |= kind[1:] != kind[:-1]
        behind = np.flatnonzero(run & (kind != WHITE) & ~begins)  # runs that something of the same text stands before
        behind = behind[kind[behind - 1] == WHITE]
        start = run
        start[behind - 1] = True
        start[behind[code[behind - 1] == 32]] = False
        mark = np.flatnonzero((code == 39) & start)
        for text in CONTRACTIONS:
            at = mark[mark + len(text) < n]
            for j, c in enumerate(text, 1):
                at = at[(code[at + j] == ord(c)) & ~begins[at + j]]
            start[at + 1] = False
            after = at + 1 + len(text)
            start[after[after < n]] = True
        return np.flatnonzero(start)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the UTF-8 texts of a block, one behind the other, and each text's offset among them."""
        raw = data.tobytes()
        if not any(s.encode() in raw for s in self.special):
            return self._encode(raw, data, offsets)
        cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        parts, rows, known = [], [0], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            for part in cut.split(raw[a:b].decode()):
                known.append(self.special.get(part, -1))
                parts.append(b"" if known[-1] >= 0 else part.encode())
            rows.append(len(parts))
        ends = np.cumsum([0, *map(len, parts)])
        raw, known = b"".join(parts), np.array(known)
        ids, at = self._encode(raw, np.frombuffer(raw, np.uint8), ends)
        put = np.flatnonzero(known >= 0)
        return np.insert(ids, at[put], known[put]), (at + np.concatenate([[0], np.cumsum(known >= 0)]))[rows]

    def _encode(self, raw: bytes, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        if raw.isascii():
            start = self.words(data, offsets[:-1])
        else:
            code = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
            place = np.flatnonzero(data & 0xC0 != 0x80)  # where each code point starts
            start = place[self.words(code, np.searchsorted(place, offsets[:-1]))]
        ends = np.append(start[1:], len(data))
        _, one, of = np.unique(span_hashes(data, start, ends), return_index=True, return_inverse=True)
        if not _alike(data, start, ends, one[of]):  # two words of one hash: each is encoded for itself
            one = of = np.arange(len(start))
        labels, at = self.paths(data, start[one], ends[one])
        count = np.diff(at)[of]
        upto = np.cumsum(count)
        ids = labels[np.repeat(at[of] - (upto - count), count) + np.arange(upto[-1])]
        return ids, np.concatenate([[0], upto])[np.searchsorted(start, offsets)]


def _alike(data: np.ndarray, start: np.ndarray, ends: np.ndarray, other: np.ndarray, words: int = 1 << 16) -> bool:
    """Whether each word has the bytes of the word `other` names for it; words lie one behind the other."""
    size = ends - start
    if (size != size[other]).any():
        return False
    for a in range(0, len(start), words):
        part = slice(a, a + words)
        low, high = start[part][0], ends[part][-1]
        if (data[low:high] != data[np.arange(low, high) + np.repeat(start[other[part]] - start[part], size[part])]).any():
            return False
    return True


_PLAIN = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def _check(spec: dict) -> None:
    """Refuses files whose settings this module does not follow."""
    split = spec.get("pre_tokenizer") or {}
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError("only byte-level pre-tokenizers with the regular split pattern and no prefix space")
    if spec.get("normalizer"):
        raise ValueError("only tokenizers without a normalizer")
    if spec["model"].get("type", "BPE") != "BPE" or any((spec["model"].get(k) or v) != v for k, v in _PLAIN.items()):
        raise ValueError(f"only BPE models with {_PLAIN}")
    if any(x.get(k) for x in spec.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("only added tokens that are found as they are written")


def compiled(path: str) -> tuple[Automaton, Labels]:
    """The automaton of a byte-level BPE in a tokenizers JSON file, and what its arcs spell."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    _check(spec)
    vocabulary, letters = spec["model"]["vocab"], byte_letters()
    special = {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
    labels = [b""] * (max(*vocabulary.values(), *special.values(), 0) + 1)
    for s, i in vocabulary.items():
        if all(c in letters for c in s):
            labels[i] = bytes(letters[c] for c in s)
    table = Table(len(labels))
    for i in vocabulary.values():
        if len(labels[i]) == 1:
            table.byte(i)
    for pair in spec["model"]["merges"]:
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        table.gadget(vocabulary[a], vocabulary[b], vocabulary[a + b])
    nodes: dict[int, int] = {}
    token = [-1]
    for i in np.flatnonzero(table.row >= 0).tolist():
        node = 0
        for byte in labels[i]:
            key = node << 8 | byte
            node = nodes.get(key, 0)
            if not node:
                node = nodes[key] = len(token)
                token.append(-1)
        token[node] = i
    steps = np.array(sorted(nodes), np.int64 if len(token) >> 23 else np.int32)
    size = np.array([len(x) for x in labels], np.int64)
    for s, i in special.items():
        labels[i] = s.encode()
    leads = np.array([nodes[k] for k in steps.tolist()], steps.dtype)
    return Automaton(table.finished(), table.row, table.column, size, steps, leads, np.array(token, np.int32), _kinds(), special), Labels(labels)


_COMPILED: dict[str, tuple[Automaton, Labels]] = {}


def automaton(path: str) -> tuple[Automaton, Labels]:
    """The compiled tables of a tokenizer file, made once on the driver."""
    if path not in _COMPILED:
        _COMPILED[path] = compiled(path)
    return _COMPILED[path]


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the token ids (array<int>) of the column `text`; a null or empty text has no ids, repeated rows are each encoded.

    path: a byte-level BPE in tokenizers JSON, readable on the driver; one with other settings than the plain ones is
    refused. A string of an added token inside a text gives that token's id. Texts of any length are encoded whole.
    Other columns pass through; an earlier column `ids` is replaced, which must not be the text itself. An empty
    table gives an empty table.
    """
    if ids == text:
        raise ValueError("ids and text need different names")
    base = df.drop(ids)
    at = base.columns.index(text)
    out = base.withColumn(ids, F.lit(None).cast("array<int>"))
    shared = df.sparkSession.sparkContext.broadcast(automaton(path)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in blocks(batch.column(at), BLOCK):
                part = batch.slice(low, high - low)
                found, cuts = shared.value.encode(data, offsets)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], _lists(found, cuts)], part.schema.names)

    return out.mapInArrow(run, out.schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text that the ids spell; null ids give the empty text, null entries and ids outside the vocabulary emit nothing,
    bytes that are not UTF-8 become U+FFFD. An earlier column `text` is replaced, which must not be the ids themselves.
    Repeated rows are each decoded, an empty table gives an empty table."""
    if ids == text:
        raise ValueError("ids and text need different names")
    base = df.drop(text)
    at = base.columns.index(ids)
    out = base.withColumn(text, F.lit(None).cast("string"))
    shared = df.sparkSession.sparkContext.broadcast(automaton(path)[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(at)
            sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for low, high in _runs(sizes):
                part = batch.slice(low, high - low)
                flat = lists.slice(low, high - low).flatten().fill_null(-1).to_numpy()
                texts = _spelled(shared.value, flat, np.concatenate([[0], np.cumsum(sizes[low:high])]))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], texts], part.schema.names)

    return out.mapInArrow(run, out.schema)


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """What decode(encode(df)) gives, a block of texts encoded and its ids decoded in the same task.

    Nulls, empty and long texts, repeated rows, empty tables and earlier columns are treated as the two functions do.
    """
    if len({text, ids, decoded}) < 3:
        raise ValueError("text, ids and decoded need different names")
    base = df.drop(ids, decoded)
    at = base.columns.index(text)
    out = base.withColumns({ids: F.lit(None).cast("array<int>"), decoded: F.lit(None).cast("string")})
    shared = df.sparkSession.sparkContext.broadcast(automaton(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, labels = shared.value
        for batch in batches:
            for low, high, data, offsets in blocks(batch.column(at), BLOCK):
                part = batch.slice(low, high - low)
                found, cuts = machine.encode(data, offsets)
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], _lists(found, cuts), _spelled(labels, found, cuts)], part.schema.names)

    return out.mapInArrow(run, out.schema)


def _lists(ids: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids.astype(np.int32, copy=False)))


def _spelled(labels: Labels, ids: np.ndarray, cuts: np.ndarray) -> pa.Array:
    data, at = labels.spell(ids, cuts)
    raw = data.tobytes()
    return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())


def _runs(sizes: np.ndarray, limit: int = BLOCK // 2) -> Iterator[tuple[int, int]]:
    """Row ranges with at most `limit` ids each, or of one row."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    low = 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(upto, upto[low] + limit, "right")) - 1)
        yield low, high
        low = high
