"""Secret scans: fixed rules, and a character convolutional network over every candidate and its context.

The rules' findings always stay. The network (numpy) sees each candidate, a run of 16 token characters or
more or of 6 or more with a digit, together with the characters around it; it is fitted on labelled findings, calibrated on
held-back ones, and its threshold is
the highest that keeps the recall asked for. It adds the candidates that reach the threshold, also those that
hold a rule's finding and more.

Labels that the rules alone cannot give: besides the rules' findings, the same findings with their key word or prefix
masked, and tokens of other shapes (SHAPES) planted in place of ordinary words, count as secrets; candidates that no rule
found and ordinary words count as none.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import blocks, word_spans
from ._store import forget, keep

# The rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_ANYWHERE = r"""(?i)(password|passwd|secret|token|api_?key)["']? *[:=]"""
KINDS = ("assign", "access", "hex", "model")

LONG, SHORT = 16, 6  # token characters of a candidate without and with a digit
RUN = re.compile(r"[A-Za-z0-9+/_=.-]+")
LONG_RUN = re.compile(r"[A-Za-z0-9+/_=.-]{%d,}" % LONG)
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"[^\W\d_]{6,}")
TOKEN = np.zeros(256, bool)
TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_=.-"]] = True
_TOKEN = frozenset(map(chr, np.flatnonzero(TOKEN)))

LEFT, WIDTH, STEP, REACH = 24, 80, 40, 5
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 _-=:\"'/+.,\n"
_CODE = {c: i + 2 for i, c in enumerate(ALPHABET)}  # 0: outside the text, 1: any other character
_SYMBOLS = len(ALPHABET) + 2

# Shapes of access tokens as their issuers publish them, in literal parts and (characters, number) parts.
ALNUM = string.ascii_letters + string.digits
SAFE = ALNUM + "_-"
SHAPES: dict[str, tuple] = {
    "code host": ("ghp_", (ALNUM, 36)),
    "chat": ("xoxb-", (string.digits, 12), "-", (string.digits, 12), "-", (ALNUM, 24)),
    "payment": ("sk_live_", (ALNUM, 24)),
    "maps": ("AIza", (SAFE, 35)),
    "web token": ("eyJ", (SAFE, 33), ".", (SAFE, 60), ".", (SAFE, 43)),
    "cloud": ((ALNUM + "+/", 40),),
    "build": ("glpat-", (SAFE, 20)),
    "package": ("npm_", (ALNUM, 36)),
    "mail": ("SG.", (SAFE, 22), ".", (SAFE, 43)),
}

FINDINGS = "array<struct<kind:string,start:int,end:int,score:double>>"


@dataclass
class SecretModel:
    """Filters over REACH symbols, the weights over their maxima and means, calibration (scale, shift) and threshold.
    Without filters the model adds nothing."""

    filters: np.ndarray | None = None
    bias: np.ndarray | None = None
    dense: np.ndarray | None = None
    offset: float = 0.0
    calibration: tuple[float, float] = (1.0, 0.0)
    threshold: float = 1.1
    recall: float = field(default=0.0)


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules' findings by start, then kind, in code points."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of LONG token characters or more, and of SHORT or more that hold a digit, in order."""
    out = {m.span() for m in LONG_RUN.finditer(text)}
    done = 0
    for m in DIGIT.finditer(text):
        if (start := m.start()) >= done:
            end = RUN.match(text, start).end()
            while start > done and text[start - 1] in _TOKEN:
                start -= 1
            done = end
            if end - start >= SHORT:
                out.add((start, end))
    return sorted(out)


def _suspects(column: pa.Array) -> np.ndarray:
    """Rows that can hold a finding or a candidate, by whole-column tests."""
    out = pc.fill_null(pc.match_substring_regex(column, ASSIGN_ANYWHERE), False).to_numpy(zero_copy_only=False).copy()
    for low, _, data, offsets in blocks(column):
        starts, ends, _ = word_spans(TOKEN[data], offsets)
        size = ends - starts
        digits = np.flatnonzero((data >= 48) & (data <= 57))
        hit = (size >= LONG) | (size >= SHORT) & (np.searchsorted(digits, starts) < np.searchsorted(digits, ends))
        out[low + np.searchsorted(offsets, starts[hit], "right") - 1] = True
    return out


def windows(text: str, start: int, end: int) -> np.ndarray:
    """Symbols of the windows over text[start:end] and its context; a long candidate has several, none is cut off."""
    rows = []
    for at in range(start - LEFT, max(start - LEFT + 1, end - WIDTH + LEFT + STEP), STEP):
        rows.append([_CODE.get(text[i], 1) if 0 <= i < len(text) else 0 for i in range(at, at + WIDTH)])
    return np.array(rows, np.int64)


def _patches(x: np.ndarray) -> np.ndarray:
    """One-hot REACH-grams (rows, places, REACH * symbols)."""
    hot = np.zeros((*x.shape, _SYMBOLS), np.float32)
    np.put_along_axis(hot, x[:, :, None], 1, 2)
    return np.concatenate([hot[:, j : WIDTH - REACH + 1 + j] for j in range(REACH)], 2)


def _forward(model: SecretModel, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    places = _patches(x)
    active = np.maximum(places @ model.filters + model.bias, 0)
    pooled = np.concatenate([active.max(1), active.mean(1)], 1)
    return places, active, pooled


def logits(model: SecretModel, x: np.ndarray) -> np.ndarray:
    return np.concatenate([_forward(model, x[i : i + 64])[2] @ model.dense + model.offset for i in range(0, len(x), 64)]) if len(x) else np.zeros(0)


def probability(model: SecretModel, text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Calibrated probability of each span, the greatest over its windows."""
    parts = [windows(text, *s) for s in spans]
    z = logits(model, np.concatenate(parts)) * model.calibration[0] + model.calibration[1]
    at = np.cumsum([0, *map(len, parts)])[:-1]
    return np.maximum.reduceat(1 / (1 + np.exp(-np.clip(z, -50, 50))), at)


class _Descent:
    """A model under Adam, by batches of windows."""

    def __init__(self, filters: int, random: np.random.Generator):
        self.model = SecretModel(random.normal(0, 0.1, (REACH * _SYMBOLS, filters)).astype(np.float32), np.zeros(filters, np.float32), np.zeros(2 * filters, np.float32) + 0.05)
        self.moment = [[np.zeros_like(p), np.zeros_like(p)] for p in self._params()]
        self.off, self.t = [0.0, 0.0], 0

    def _params(self) -> list[np.ndarray]:
        return [self.model.filters, self.model.bias, self.model.dense]

    def _arrays(self) -> list[np.ndarray]:
        return self._params() + [x for pair in self.moment for x in pair]

    def state(self) -> np.ndarray:
        """All numbers as one vector; the mean of such vectors is a state too."""
        return np.concatenate([*[x.ravel().astype(np.float64) for x in self._arrays()], [self.model.offset, *self.off, self.t]])

    def load(self, state: np.ndarray) -> None:
        at = 0
        for x in self._arrays():
            x[...] = state[at : at + x.size].reshape(x.shape)
            at += x.size
        self.model.offset, *self.off = map(float, state[at : at + 3])
        self.t = round(float(state[at + 3]))

    def step(self, x: np.ndarray, y: np.ndarray, share: float) -> None:
        """One batch, each label weighted as if it were half; share: that of label 1."""
        model, filters = self.model, len(self.model.bias)
        self.t += 1
        t, off = self.t, self.off
        places, active, pooled = _forward(model, x)
        p = 1 / (1 + np.exp(-np.clip(pooled @ model.dense + model.offset, -30, 30)))
        g = (p - y) * np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)
        down = g[:, None] * model.dense
        n = places.shape[1]
        back = np.repeat(down[:, None, filters:] / n, n, 1)
        top = active.argmax(1)
        np.put_along_axis(back, top[:, None, :], np.take_along_axis(back, top[:, None, :], 1) + down[:, None, :filters], 1)
        back *= active > 0
        grads = [np.tensordot(places, back, ((0, 1), (0, 1))), back.sum((0, 1)), g @ pooled]
        for value, grad, (m, v) in zip(self._params(), grads, self.moment, strict=True):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad**2 - v)
            value -= (0.005 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
        off[0] += 0.1 * (g.sum() - off[0])
        off[1] += 0.001 * (g.sum() ** 2 - off[1])
        model.offset -= 0.005 * (off[0] / (1 - 0.9**t)) / ((off[1] / (1 - 0.999**t)) ** 0.5 + 1e-7)


def fit(x: np.ndarray, y: np.ndarray, recall: float = 0.98, filters: int = 24, epochs: int = 8) -> SecretModel:
    """train over windows x in memory, y: 1 for a finding. A fifth is held back for calibration and threshold. With under 20 of either label nothing is learnt."""
    if min((y == 1).sum(), (y == 0).sum()) < 20:
        return SecretModel()
    random = np.random.default_rng(3)
    order = random.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    descent = _Descent(filters, random)
    model = descent.model
    share = (y[used] == 1).mean()
    for _ in range(epochs):
        for batch in np.array_split(random.permutation(used), max(1, len(used) // 64)):
            descent.step(x[batch], y[batch], share)
    z, yh = logits(model, x[held]), y[held]
    a, b = 1.0, 0.0
    for _ in range(400):  # Platt scaling
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        a -= 0.05 * (((p - yh) * z).mean() + 1e-3 * a)
        b -= 0.05 * (p - yh).mean()
    p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
    found = np.sort(p[yh == 1])
    model.calibration = (float(a), float(b))
    if len(found):
        model.threshold = float(found[int((1 - recall) * len(found))])
        model.recall = float((found >= model.threshold).mean())
    return model


def token_of(shape: tuple, random: np.random.Generator) -> str:
    """A random token of a shape."""
    return "".join(part if isinstance(part, str) else "".join(random.choice(list(part[0]), part[1])) for part in shape)


def _masked(text: str, start: int, kind: int, end: int) -> tuple[str, int, int] | None:
    """A finding without what the rule knows it by: its key word made an ordinary one, its prefix made part of the token; None for what has neither."""
    if KINDS[kind] == "assign":
        value = ASSIGN.match(text, start).start(2)
        return text[:start] + ("item is " * (value - start))[: value - start] + text[value:], value, end
    if KINDS[kind] == "access":
        return text[:start] + text[start + 4 : start + 8] + text[start + 4 :], start, end
    return None


def _examples(text: str, words: int, shapes: Mapping[str, tuple] = SHAPES) -> Iterator[tuple[int, int, bytes]]:
    """(place, label, window): every window of every candidate and finding, 1 where it shows a part that a rule found; of texts with findings
    also the findings masked (1), ordinary words (0), and for each of these a token planted in its place (1)."""
    base = base_findings(text)
    found = lambda s, e: int(any(s < be and bs < e for bs, _, be in base))
    for s, e in candidates(text) + [(s, e) for s, _, e in base]:
        for k, window in enumerate(windows(text, s, e).astype(np.uint8)):
            at = s - LEFT + k * STEP
            yield at, found(max(s, at), min(e, at + WIDTH)), window.tobytes()
    if not base:
        return
    around = LEFT + WIDTH
    for s, kind, e in base:
        low = max(0, s - around)
        if made := _masked(text[low : e + around], s - low, kind, e - low):
            for k, window in enumerate(windows(*made).astype(np.uint8)):
                yield (1 << 40) + s + k, 1, window.tobytes()
    plain = [m.span() for m in WORD.finditer(text) if not found(*m.span())]
    for s, e in plain[:: max(1, len(plain) // words)][:words]:
        yield s, 0, windows(text, s, e)[0].astype(np.uint8).tobytes()
        if shapes:
            low, random = max(0, s - around), np.random.default_rng(zlib.crc32(f"{s} {text[s:e]}".encode()))
            token = token_of(list(shapes.values())[random.integers(len(shapes))], random)
            for k, window in enumerate(windows(text[low:s] + token + text[e : e + around], s - low, s - low + len(token)).astype(np.uint8)):
                yield (1 << 41) + s + k, 1, window.tobytes()


def train(docs: DataFrame, recall: float = 0.98, words: int = 3, shapes: Mapping[str, tuple] = SHAPES, filters: int = 24, epochs: int = 8, workers: int = 32, least: int = 4000) -> SecretModel:
    """Fits on every labelled window, dealt by hash to up to `workers` tasks of about `least` windows or more.

    Each epoch is a job: a task streams its windows through the network from the last epoch's state, and the mean of the tasks'
    states, weighted by their windows, starts the next. A fifth of all windows is held back by hash; calibration (logistic regression) and the threshold, which
    is the exact order statistic, come from all of these. One task adds up the states,
    and the driver holds their mean only.

    docs: doc_id, text. Examples are the windows of all candidates, long ones whole, and of each text with a finding its
    findings masked, `words` ordinary words, and as many tokens of the given shapes. Null texts hold no examples; repeated windows
    add nothing; an empty table, or one with under 20 examples of either label, gives a model that adds nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            column = batch.column(1)
            for i in np.flatnonzero(_suspects(column)):
                text = column[int(i)].as_py()
                rows += [x[1:] for x in _examples(text, words, shapes)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 2, (pa.int32(), pa.binary()), strict=True)], ["label", "window"])

    every = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "label int, window binary").distinct()
    some = keep(every.withColumn("held", F.pmod(F.xxhash64("window"), F.lit(5)) == 0), "examples")
    try:
        return _train(some, recall, filters, epochs, workers, least)
    finally:
        forget(some)


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and labels of rows label, window."""
    x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, WIDTH).astype(np.int64)
    return x, batch.column(0).to_numpy(zero_copy_only=False).astype(np.float32)


def _train(some: DataFrame, recall: float, filters: int, epochs: int, workers: int, least: int) -> SecretModel:
    """train over a table of label, window, held."""
    counts = {(r["held"], r["label"]): r["n"] for r in some.groupBy("held", "label").agg(F.count("*").alias("n")).collect()}
    of = lambda label, *held: sum(counts.get((h, label), 0) for h in held)
    if min(of(1, True, False), of(0, True, False)) < 20 or not (of(1, False) and of(0, False)):
        return SecretModel()
    n = of(1, False) + of(0, False)
    share, tasks = of(1, False) / n, min(workers, -(-n // least))
    descent = _Descent(filters, np.random.default_rng(3))
    dealt = some.where("not held").select("label", "window").repartition(tasks, F.xxhash64("window")).sortWithinPartitions(F.xxhash64("window", F.lit(1)), "window", "label")
    spark = some.sparkSession

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for seen, state in zip(batch.column(1), batch.column(2), strict=True):
                own = seen.as_py() / n * np.frombuffer(state.as_py())
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["state"])

    for epoch in range(epochs):
        start = spark.sparkContext.broadcast(descent.state())

        def run(batches: Iterator[pa.RecordBatch], epoch: int = epoch, start=start) -> Iterator[pa.RecordBatch]:
            random = np.random.default_rng((3, epoch))
            own, seen = _Descent(filters, random), 0
            own.load(start.value)
            for batch in batches:
                if batch.num_rows:
                    x, y = _arrays(batch)
                    seen += len(y)
                    for rows in np.array_split(random.permutation(len(y)), max(1, len(y) // 64)):
                        own.step(x[rows], y[rows], share)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([seen], pa.int64()), pa.array([own.state().tobytes()], pa.binary())], ["part", "n", "state"])

        states = dealt.mapInArrow(run, "part int, n long, state binary").repartition(1).sortWithinPartitions("part")  # one state a task, of fixed size
        descent.load(np.frombuffer(states.mapInArrow(mean, "state binary").first()["state"]))
        start.destroy()
    model = descent.model
    if not (of(1, True) and of(0, True)):
        return model
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = logits(shared.value, _arrays(batch)[0]) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z.astype(np.float64))], ["label", "z"])

    held = keep(some.where("held").select("label", "window").mapInArrow(score, "label int, z double"), "scores")
    platt = LogisticRegression(labelCol="label", regParam=0.001, standardization=False).fit(VectorAssembler(inputCols=["z"], outputCol="features").transform(held))
    a, b = float(platt.coefficients[0]), float(platt.intercept)
    found = held.where("label = 1")
    model.calibration = (a, b)
    cut = found.orderBy(F.asc("z") if a > 0 else F.desc("z")).offset(int((1 - recall) * of(1, True))).limit(1).first()["z"]  # keeps the share 1 - recall at most
    model.threshold = float(1 / (1 + np.exp(-np.clip(a * cut + b, -50, 50))))
    model.recall = found.where(F.col("z") >= cut if a > 0 else F.col("z") <= cut).count() / of(1, True)
    forget(held)
    return model


def findings(model: SecretModel, text: str) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, score) of all findings of a text, by start, then kind; rules score 1."""
    base = base_findings(text)
    out = [(s, k, e, 1.0) for s, k, e in base]
    if model.filters is not None and (spans := [c for c in candidates(text) if not any(s <= c[0] and c[1] <= e for s, _, e in base)]):
        out += [(s, 3, e, float(p)) for (s, e), p in zip(spans, probability(model, text, spans), strict=True) if p >= model.threshold]
    return sorted(out)


def scan(docs: DataFrame, model: SecretModel) -> DataFrame:
    """docs with findings (array of kind, start, end, score), by start, then kind, in code points, end exclusive.

    docs: text and any other columns, all returned (an earlier findings column is replaced). Null and empty
    texts have no findings; texts of any length are scanned whole; spans of different kinds may overlap; repeated rows
    are each scanned; an empty table gives an empty table.
    """
    base = docs.drop("findings")
    at = base.columns.index("text")
    out = base.withColumn("findings", F.lit(None).cast(FINDINGS))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for i in np.flatnonzero(_suspects(batch.column(at))):
                found[i] = [{"kind": KINDS[k], "start": s, "end": e, "score": p} for s, k, e, p in findings(shared.value, batch.column(at)[int(i)].as_py())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind)], batch.schema.names)

    return out.mapInArrow(run, out.schema)


def redact(docs: DataFrame, model: SecretModel, mark: str = "<SECRET>") -> DataFrame:
    """docs with each finding replaced by `mark` (overlapping ones by a single one) and n_chars, where there is such a column, counted anew."""
    names = {"findings": "kept_findings"} if "findings" in docs.columns else {}
    found = scan(docs.withColumnsRenamed(names), model)
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("end"))

    def step(s: F.Column, f: F.Column) -> F.Column:
        inside = f["start"] < s["end"]
        between = F.substring(F.col("text"), s["end"] + 1, f["start"] - s["end"])
        return F.struct(F.when(inside, s["text"]).otherwise(F.concat(s["text"], between, F.lit(mark))).alias("text"), F.greatest(s["end"], f["end"]).alias("end"))

    done = F.aggregate("findings", start, step)
    text = F.when(F.size("findings") > 0, F.concat(done["text"], F.substring(F.col("text"), done["end"] + 1, F.length("text")))).otherwise(F.col("text"))
    out = found.withColumn("text", text).drop("findings").withColumnsRenamed({v: k for k, v in names.items()})
    if "n_chars" in docs.columns:
        kept = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text"))
        out = out.withColumn("n_chars", kept.cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
