"""HTML extraction: the maximum-scoring run of blocks, words scoring for and tags against.

A page is a sequence of tags and text blocks. Each word scores by where it stands (names, classes and ids of the
open elements), each tag scores against by its name; these weights are learnt from labelled pages, whose label is
their one article or main element, over counts that a list of names seeds. One linear scan finds the best contiguous region; no word
scores below 0, so only tags part regions, and blocks whose names speak against them are left out of the region afterwards.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<", re.S)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^<]*)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME = re.compile(r"[a-z]+")

# Elements by kind, as HTML defines them, and names that pages give to what is not the article.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style template textarea iframe svg".split())
SHUT = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
AGAINST = (
    "head title nav aside footer form button menu menubar toolbar sidebar side ad ads advert adverts advertisement banner promo sponsor sponsored cookie cookies "
    "consent notice notification alert popup modal newsletter subscribe signup login share sharing social related recommended comment comments commentlist "
    "disqus pageheader reply respond breadcrumb breadcrumbs pagination pager footer masthead navigation navbar complementary contentinfo search widget copyright"
).split()
FOR = "article main post entry content story body text".split()

PRIOR = 8.0
OUTER = 0.25  # weight of an element's names against those of the next named element inside it
_AGAINST = frozenset([f".{x}" for x in AGAINST] + [f"<{x}>" for x in AGAINST])
_NAMED = frozenset(f"<{x}>" for x in (*AGAINST, *FOR))
_EVERYWHERE = ("<html>", "<body>")
INSIDE = 0.15  # share of a tag's cost in front of a block whose words score for


@dataclass
class HtmlModel:
    """log-odds of each context feature, cost of each tag; default values for those never met."""

    context: dict[str, float] = field(default_factory=dict)
    cost: dict[str, float] = field(default_factory=dict)
    usual_cost: float = 0.5
    met: frozenset[str] = frozenset()  # names that the labelled pages hold


@dataclass
class Block:
    elements: list[tuple[str, ...]]  # the features of each element around it, from the outermost in
    text: str
    words: int
    tags: list[str]  # since the block before

    @property
    def features(self) -> frozenset[str]:
        return frozenset(_name(f) for e in self.elements for f in e)


def _name(feature: str) -> str:
    return "." + feature[1:] if feature[0] == "-" else feature


def _features(name: str, attributes: str) -> tuple[str, ...]:
    """<tag>, and .name for each name in its classes, ids and roles, or -name where it stands beside one that the list lacks, as in share-price."""
    out = [f"<{name}>"]
    if attributes:
        for key, a, b, c in ATTRIBUTE.findall(attributes):
            for word in (a or b or c).lower().split():
                parts = NAME.findall(word)
                mark = "-" if len(parts) > 1 and any(f".{x}" not in _AGAINST for x in parts) else "."
                out += [f"{mark}{x}" for x in parts]
    return tuple(out)


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order, with the features of the elements around each; raw elements hold none.

    A raw element ends at its own closing tag, whatever its body looks like; an unclosed script, style, textarea or
    iframe takes the rest of the page, as in browsers, an unclosed template or svg only its tag.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    tags: list[str] = []
    unclosed: set[str] = set()
    at = 0

    def flush() -> None:
        nonlocal tags
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append(Block([fs for _, fs in stack if fs[0] not in _EVERYWHERE], text, text.count(" ") + 1, tags))
            tags = []

    while at < len(page):
        m = TOKEN.match(page, at)
        token, at = m[0], m.end()
        if token[0] != "<" or token == "<":
            parts.append(token)
            continue
        if token[1] in "!?":
            continue
        t = TAG.match(token)
        name = t[2].lower()
        if token[-1] != ">":  # the page ends inside a tag
            break
        if name == "br":
            parts.append(" ")
            continue
        if name in INLINE:
            continue
        flush()
        tags.append(name)
        if t[1]:
            if any(n == name for n, _ in stack):
                while stack.pop()[0] != name:
                    pass
            continue
        if name in RAW:
            if name not in unclosed and not token[:-1].rstrip().endswith("/"):
                if shut := SHUT[name].search(page, at):
                    at = shut.start()
                elif name in ("template", "svg"):
                    unclosed.add(name)
                else:
                    break
            continue
        if name in VOID:
            continue
        if name in CLOSES_P and any(n == "p" for n, _ in stack):
            while stack.pop()[0] != "p":
                pass
        if name in SIBLINGS and stack and stack[-1][0] in SIBLINGS[name]:
            stack.pop()
        features = _features(name, t[3])
        if ("<header>" in features or any(_name(f) == ".header" for f in features)) and not any(n in ("article", "main") for n, _ in stack):
            features += (".pageheader",)  # not an article's own heading
        stack.append((name, features))
    flush()
    return out


def _weight(model: HtmlModel, block: Block) -> float:
    """What speaks for each word of a block: the sum of its elements' log-odds, at most 1 either way; below 0 it scores nothing.

    The nearest element that has a name with a weight counts in full, each one around it OUTER times the one before,
    and plain tags such as p after all names.
    """
    odds, share, plain = 0.25, 1.0, 0.0
    inside = _labelled(block)
    for features in reversed(block.elements):
        named = 0.0
        for f in features:
            if f[0] == "-":
                f = _name(f)
                if inside and f not in model.met:
                    continue  # known from the list alone, and not by itself
            if f[0] == "." or f in _NAMED:
                named += model.context.get(f, 0.0)
            else:
                plain += model.context.get(f, 0.0)
        if named:
            odds += share * named
            share *= OUTER
    return max(-1.0, min(1.0, odds + share * plain))


def _labelled(block: Block) -> bool:
    return any(features[0] == "<article>" for features in block.elements)


def extract(model: HtmlModel, page: str | None) -> str:
    """Main text of a page: its blocks in the best region, one a line; empty where no region scores above 0."""
    found = blocks_of(page or "")
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    weights = [_weight(model, b) for b in found]
    for k, (b, w) in enumerate(zip(found, weights, strict=True)):
        share = INSIDE if w > 0 else 0 if _labelled(b) else 1  # what is left out of an article doesn't part it
        total -= share * sum(model.cost.get(t, model.usual_cost) for t in b.tags)
        if total <= 0:
            total, start = 0.0, k
        total += max(w, 0.0) * b.words
        if total > best:
            best, best_at = total, (start, k + 1)
    return "\n".join(b.text for b, w in zip(found[slice(*best_at)], weights[slice(*best_at)], strict=True) if w > 0)


def fit(pages: list[str]) -> HtmlModel:
    """Weights from the pages that label themselves by exactly one article or main element; the named priors count as PRIOR words."""
    inside: dict[str, float] = defaultdict(float)
    outside: dict[str, float] = defaultdict(float)
    tags = [defaultdict(float), defaultdict(float)]
    sizes = [1.0, 1.0]
    met: set[str] = set()
    for name in AGAINST:
        outside[f".{name}"] += PRIOR
        outside[f"<{name}>"] += PRIOR
    for name in FOR:
        inside[f".{name}"] += PRIOR
        inside[f"<{name}>"] += PRIOR
    for page in pages:
        marks = re.findall(r"<(article|main)[\s>]", page, re.I)
        if len(marks) != 1:
            continue
        label = f"<{marks[0].lower()}>"
        seen: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for b in blocks_of(page):
            features = b.features
            good = label in features
            for f in features if good else features & _AGAINST or features:  # a name against the article explains words outside it alone
                seen[f][good] += b.words
            for t in b.tags:
                tags[good][t] += 1
            sizes[good] += b.words
        met |= seen.keys()
        for f, (bad, good) in seen.items():  # a page counts once for a feature
            inside[f] += good / (bad + good)
            outside[f] += bad / (bad + good)
    model = HtmlModel(met=frozenset(met))
    for f in {*inside, *outside}.difference(_EVERYWHERE):
        model.context[f] = float(np.log((inside[f] + 0.5) / (outside[f] + 0.5)))
    for t in {*tags[0], *tags[1]}:
        model.cost[t] = 0.1 + 0.9 * tags[0][t] / (tags[0][t] + tags[1][t])
    return model


def train(pages: DataFrame, max_pages: int = 400) -> HtmlModel:
    """Fits on at most `max_pages` of the pages that label themselves, the first by a hash of page_id."""
    rows = pages.select("page_id", "html").where(F.regexp_count("html", F.lit(r"(?i)<(article|main)[\s>]")) == 1)
    ids = rows.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(max_pages)
    sample = rows.join(F.broadcast(ids.distinct()), "page_id").orderBy("page_id", "html").toArrow()
    return fit(sample["html"].to_pylist())


def main_text(pages: DataFrame, model: HtmlModel, text: str = "text") -> DataFrame:
    """pages with the main text of the column html, whole, one block a line.

    A null or empty page, and one without a block that scores above 0, gives the empty text; an unfinished tag at
    a page's end is dropped, an unfinished element is closed; a tag with a quote that nothing closes ends at its first
    `>`. Of equally good regions the first counts. Pages of any length are read whole, repeated rows each by itself, an
    empty table gives an empty table. Earlier columns of that name are replaced.
    """
    base = pages.drop(text)
    at = base.columns.index("html")
    out = base.withColumn(text, F.lit("").cast("string"))
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                texts = [extract(shared.value, x) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], part.schema.names)

    return out.mapInArrow(run, out.schema)
