r"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: the runs of text between tags that start or end a block, by a scanner that only moves
forward, so a broken page takes no longer than a sound one of its length.  A block's features are the tags and the class
and id words of its ancestors, the nearest one that gives a page its structure and whether that is in an article, its
length, punctuation, capitals and share of link text, and whether the page has an article element that it is not in.  A two-label linear-chain CRF scores the sequence of a page's blocks and
Viterbi picks the labels.  It is trained on ``pages`` labelled pages (a documented bound; see ``labelled_pages``) by
gradient ascent on the likelihood, and its weights are broadcast: a few hundred numbers.

Text is decoded (character references), white space within a block is one space, and the kept blocks are joined by two
``\n`` in page order.  Scripts, styles, comments, titles, templates, text areas and drawings (svg) are never text; a drawing
ends with its own end tag, also around other drawings, or at once if its tag closes itself.

Defined results: null and empty pages give an empty text; markup that is not closed ends with the page, and a tag without
an end is text; where quotes in tags do not match, tags end at the next ``>`` from there on; a page without markup is one
block; repeated rows are judged alike; an empty table gives an empty result.  Columns that are not in
``keep`` are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slidelake.llm.labelled_pages import labelled_pages

# Fixed values of HTML: elements that part blocks, that hold no text, and whose content is not markup.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot "
    "th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("iframe noframes noscript script style svg template textarea title xmp".split())
# A start tag on the left ends an open element on the right, up to the nearest element that starts a scope.
ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
#: Tags that an element remembers of its ancestors.
TAGS = frozenset("a article aside blockquote button dd figcaption figure footer form h1 h2 h3 h4 h5 h6 header label legend li main nav ol option p pre section table td ul".split())
SCOPES = frozenset("article aside body button dl div footer form header html main nav ol section select table ul".split())

OPENING = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|[!?/])")
#: What may end a tag, or hide an end: a value in quotes stands behind an equals sign.
TAG_PART = re.compile(r">|=\s*([\"'])")
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORDS = re.compile(r"[a-z]+")
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
#: A slash that is part of a value without quotes does not close the tag.
OPEN_VALUE = re.compile(r"=\s*[^\s\"'][^\s]*\Z")
#: Ancestors that are features; others count only by their class and id words.
TAG_FEATURES = sorted(TAGS)
#: Ancestors that give a page its structure; the nearest one is a feature.
STRUCTURE = frozenset("article aside dialog fieldset footer form header main menu nav section".split())
SHAPE = "bias words1 words3 words8 words20 words60 ends_sentence starts_capital digits no_link some_link all_link outside_article".split()
SHAPE += [f"near_{t}{w}" for t in ["", *sorted(STRUCTURE)] for w in ("", "_in_article")]


@dataclass
class Block:
    text: str
    #: Tags and class and id words of the ancestors, and the nearest one that gives structure.
    tags: frozenset[str]
    names: frozenset[str]
    near: str
    link_share: float


@dataclass
class _Element:
    tag: str
    tags: frozenset[str]
    names: frozenset[str]
    near: str


class _Tags:
    """The tags of a page in order, each found from where the last one ended."""

    def __init__(self, html: str) -> None:
        self.html, self.last, self.quotes = html, html.rfind(">"), True

    def _end(self, at: int) -> int:
        """The place of the ``>`` that ends the tag whose name ends at ``at``; there is one further on."""
        if self.quotes:
            found = at
            while m := TAG_PART.search(self.html, found):
                if not m[1]:
                    return m.start()
                if (found := self.html.find(m[1], m.end()) + 1) == 0:
                    break
            # A quote without its match: looked for once in a page.
            self.quotes = False
        return self.html.index(">", at)

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, whether an end tag, name, attributes) of the next tag or comment, which has no name."""
        html = self.html
        while m := OPENING.search(html, at):
            if html.startswith("<!--", m.start()):
                body = m.start() + 4
                if html.startswith((">", "->"), body):
                    return m.start(), html.index(">", body) + 1, False, "", ""
                ends = [e + len(mark) for mark in ("-->", "--!>") if (e := html.find(mark, body)) >= 0]
                return m.start(), min(ends, default=len(html)), False, "", ""
            if m.end() > self.last:
                return None
            if m[2] is None:
                return m.start(), html.index(">", m.end()) + 1, False, "", ""
            end = self._end(m.end())
            return m.start(), end + 1, bool(m[1]), m[2].lower(), html[m.end() : end]
        return None


@dataclass
class _Parser:
    blocks: list[Block] = field(default_factory=list)
    #: The names that matter, if not all: no element then has more of them, however deep it lies.
    known: frozenset[str] | None = None
    open: list[_Element] = field(default_factory=lambda: [_Element("", frozenset(), frozenset(), "")])
    #: How many elements with a tag are open.
    count: Counter = field(default_factory=Counter)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    at: _Element | None = None

    def text(self, raw: str) -> None:
        if not raw:
            return
        text = unescape(raw) if "&" in raw else raw
        if self.at is None and not text.isspace():
            self.at = self.open[-1]
        self.parts.append(text)
        if "a" in self.open[-1].tags:
            self.linked += len(text)

    def end_block(self) -> None:
        if self.at is not None:
            text = " ".join("".join(self.parts).split())
            size = sum(map(len, self.parts))
            self.blocks.append(Block(text, self.at.tags, self.at.names, self.at.near, self.linked / max(1, size)))
        self.parts, self.linked, self.at = [], 0, None

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in BLOCK_TAGS:
            self.end_block()
            closes = ENDS.get(tag, set()) | ({"p"} if tag not in ("option", "button", "label", "optgroup") else set())
            self.close(closes, SCOPES)
        if tag not in VOID_TAGS:
            top = self.open[-1]
            names = top.names
            if attributes:
                for m in NAMES.finditer(attributes):
                    found = frozenset(WORDS.findall((m[1] or m[2] or m[3] or "").lower()))
                    names = names | (found if self.known is None else found & self.known)
            tags = top.tags | {tag} if tag in TAGS else top.tags
            self.open.append(_Element(tag, tags, names, tag if tag in STRUCTURE else top.near))
            self.count[tag] += 1

    def close(self, tags: set[str], scopes: frozenset[str] = frozenset()) -> None:
        """End the innermost open element of ``tags`` and all in it, if none of ``scopes`` is in between."""
        if not any(self.count[t] for t in tags):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                self.count.subtract(e.tag for e in self.open[i:])
                del self.open[i:]
                return
            if self.open[i].tag in scopes:
                return

    def end(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.end_block()
        self.close({tag})


def _closes_itself(attributes: str) -> bool:
    return attributes.endswith("/") and not OPEN_VALUE.search(QUOTED.sub('""', attributes))


def _behind_drawing(tags: _Tags, at: int) -> int:
    """The place behind the end tag of the svg element whose start tag ends at ``at``."""
    depth = 1
    while found := tags.next(at):
        _, at, ends, tag, attributes = found
        if tag == "svg":
            depth += -1 if ends else 0 if _closes_itself(attributes) else 1
            if not depth:
                return at
    return len(tags.html)


def leaf_blocks(html: str, known: frozenset[str] | None = None) -> list[Block]:
    """The page's blocks with text, in page order, with those of their ancestors' names that are ``known``."""
    parser, tags, at = _Parser(known=known), _Tags(html), 0
    while found := tags.next(at):
        start, end, ends, tag, attributes = found
        parser.text(html[at:start])
        at = end
        if not tag:
            continue
        if ends:
            parser.end(tag)
        elif tag == "svg":
            at = at if _closes_itself(attributes) else _behind_drawing(tags, at)
        elif tag in RAW_TAGS:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            at = html.find(">", close.end()) + 1 if close else 0
            at = at or len(html)
        else:
            parser.start(tag, attributes)
    parser.text(html[at:])
    parser.end_block()
    return parser.blocks


@dataclass
class BlockModel:
    """Weights by feature name for both labels, and for each pair of neighbouring labels."""

    places: dict[str, int]
    emission: np.ndarray
    transition: np.ndarray

    def __post_init__(self) -> None:
        self.names = frozenset(n[1:] for n in self.places if n[0] == ".")

    def features(self, blocks: list[Block]) -> list[list[int]]:
        has_article = any("article" in b.tags for b in blocks)
        get, out = self.places.get, []
        for b in blocks:
            n = b.text.count(" ") + 1
            on = ["bias", "words1" if n < 3 else "words3" if n < 8 else "words8" if n < 20 else "words20" if n < 60 else "words60"]
            on.append("no_link" if b.link_share == 0 else "all_link" if b.link_share > 0.8 else "some_link")
            if b.text[-1] in ".!?:\"'…”»":
                on.append("ends_sentence")
            if b.text[0].isupper():
                on.append("starts_capital")
            if b.text[0].isdigit():
                on.append("digits")
            if has_article and "article" not in b.tags:
                on.append("outside_article")
            on.append(f"near_{b.near}" + ("_in_article" if "article" in b.tags or "main" in b.tags else ""))
            found = [get(x) for x in on] + [get("<" + t) for t in b.tags] + [get("." + w) for w in b.names]
            out.append([k for k in found if k is not None])
        return out

    def labels(self, blocks: list[Block]) -> list[int]:
        """Viterbi over two labels."""
        if not blocks:
            return []
        (t00, t01), (t10, t11) = self.transition.tolist()
        w0, w1 = self.emission.tolist()
        back, a, b = [], 0.0, 0.0
        for i, on in enumerate(self.features(blocks)):
            e0, e1 = sum(w0[k] for k in on), sum(w1[k] for k in on)
            if i:
                from0, from1 = a + t00 < b + t10, a + t01 < b + t11
                back.append((from0, from1))
                a, b = max(a + t00, b + t10) + e0, max(a + t01, b + t11) + e1
            else:
                a, b = e0, e1
        out = [int(b > a)]
        for from0, from1 in reversed(back):
            out.append(int(from1 if out[-1] else from0))
        return out[::-1]

    def main_text(self, html: str | None) -> str:
        blocks = leaf_blocks(html or "", self.names)
        return "\n\n".join(b.text for b, y in zip(blocks, self.labels(blocks), strict=True) if y)


def train(pages: int = 600, steps: int = 100, rate: float = 0.2, decay: float = 1e-3) -> BlockModel:
    """Maximise the likelihood of the labelled pages' label sequences, all pages at once."""
    made = [(leaf_blocks(html), [y for _, y in marks]) for html, marks in labelled_pages(pages)]
    made = [(b, y) for b, y in made if len(b) == len(y) and b]
    names = sorted({w for b, _ in made for x in b for w in x.names})
    places = {name: i for i, name in enumerate([*SHAPE, *["<" + t for t in TAG_FEATURES], *["." + w for w in names]])}
    model = BlockModel(places, np.zeros((2, len(places))), np.zeros((2, 2)))
    long = max(len(b) for b, _ in made)
    x = np.zeros((len(made), long, len(places)), np.float32)
    y = np.zeros((len(made), long), np.int64)
    mask = np.zeros((len(made), long), bool)
    for i, (b, labels) in enumerate(made):
        for t, on in enumerate(model.features(b)):
            x[i, t, on] = 1
        y[i, : len(b)], mask[i, : len(b)] = labels, True
    flat, both = x.reshape(-1, len(places)), mask[:, 1:]
    hot = np.eye(2)[y] * mask[:, :, None]
    real = np.einsum("nti,ntj->ij", hot[:, :-1], hot[:, 1:] * both[:, :, None])
    weights = [model.emission, model.transition]
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        e = (flat @ model.emission.T.astype(np.float32)).reshape(len(made), long, 2).astype(float)
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        forward[:, 0] = e[:, 0]
        for t in range(1, long):
            new = np.logaddexp(forward[:, t - 1, :1] + model.transition[0], forward[:, t - 1, 1:] + model.transition[1]) + e[:, t]
            forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
        for t in range(long - 2, -1, -1):
            ahead = backward[:, t + 1] + e[:, t + 1]
            new = np.logaddexp(model.transition[:, 0] + ahead[:, :1], model.transition[:, 1] + ahead[:, 1:])
            backward[:, t] = np.where(mask[:, t + 1, None], new, 0)
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])[:, None, None]
        one = np.exp(forward + backward - total) * mask[:, :, None]
        pair = np.exp(forward[:, :-1, :, None] + model.transition + (e + backward)[:, 1:, None, :] - total[..., None]) * both[:, :, None, None]
        grads = [((hot - one).reshape(-1, 2).astype(np.float32).T @ flat).astype(float), real - pair.sum(axis=(0, 1))]
        for i, (w, g) in enumerate(zip(weights, grads, strict=True)):
            g = g / len(made) - decay * w
            mean[i], square[i] = 0.9 * mean[i] + 0.1 * g, 0.99 * square[i] + 0.01 * g**2
            w += rate * (1 - step / (steps + 1)) * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-8)
    return model


def _extractor(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            i = batch.schema.get_field_index("html")
            texts = [model.main_text(h.as_py()) for h in batch.column(i)]
            cols = [c for k, c in enumerate(batch.columns) if k != i]
            names = [n for k, n in enumerate(batch.schema.names) if k != i]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string())], [*names, "text"])

    return run


def main_texts(pages: DataFrame, model: BlockModel, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """``keep`` columns of each row with ``text`` and ``n_chars``, its code points."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    rows = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(html).alias("html"))
    schema = T.StructType([f for f in rows.schema if f.name != "html"]).add("text", "string")
    out = rows.mapInArrow(_extractor(shared), schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text", F.length("text").cast("long").alias("n_chars"))
