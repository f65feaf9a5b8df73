"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, in page order. Each block is a vector of its hashed tag
path (with classes and ids), all its hashed words and a few counts; a bidirectional LSTM in numpy reads the whole sequence, so
every block is classified with the document's context. Blocks labelled as article are joined.

The labeller is trained here on a bounded sample: at most ``sample`` pages, by hash of id and html, with at most
``sample_blocks`` blocks in all (a page that would pass that number is left out of the sample). Its teacher is the meaning
that HTML itself gives to elements: pages that mark an article say which blocks it holds, and nav, aside, footer, form and
their like say what is none; classes and ids decide no label. Pages of one template would teach just that template, so each
page is read again in other clothes: with its article in other containers and foreign blocks beside and inside it, and with
names that say nothing at all, where only text, links, order and place are left to tell. In these copies the article's text also
stands in lists, tables, quotes, captions, code and definitions, with notices and adverts between: no kind of element is foreign.

Defined results: null and empty html gives an empty text; text outside any tag is a block; unclosed and misnested tags are
closed as browsers do for paragraphs and by the enclosing end tag otherwise; null ids and repeated rows are kept; an empty
table gives no rows; a sample without any marked article is taught by its links and elements alone; other columns are never
read. Deep and long pages cost time and memory in proportion to their length.
"""

from __future__ import annotations

import random
import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import SAMPLE_BYTES, small_batches, that_fit
from tagloom.llm.tokens import slices

# Fixed values of HTML: elements that begin a block, that have no end tag, whose content isn't text, that end an open
# paragraph, that such an end doesn't reach beyond, and that never hold the article itself.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template svg textarea".split())
ENDS_P = BLOCK - frozenset("body head html option button title tbody td tfoot th thead tr caption legend noscript".split())
SCOPE = frozenset("html table td th caption button object template marquee".split())
NEVER = frozenset("head title nav aside footer form dialog menu select option button fieldset legend noscript".split())
# Containers that pages put an article in, and containers of other things, as element.class#id: clothes for training pages.
BODY = ("article", "main", "div.post-body", "div.entry-content", "div#content", "section.story", "div.article-body", "div.text", "td.content", "div.post")
EXTRA = ("header.site-header", "div#masthead", "nav.navbar", "div.menu", "div.topbar", "ul.breadcrumbs", "aside.sidebar", "div#sidebar", "div.widget", "div.cookie-notice", "div.notice", "div#consent", "div.gdpr", "div.advert", "div.ad", "div.ads", "div.ad-banner", "div.sponsored", "form.newsletter", "div.newsletter", "div.subscribe", "form#search", "form.login", "form", "footer.site-footer", "div#footer", "div.footer", "section#comments", "div.comments", "div.comment", "ol.comments", "ul.comment-list", "div.replies", "div.discussion", "div.related", "div.recommended", "div.share", "div.social", "div.promo", "div.popup", "div.modal", "div.pagination", "header", "aside", "footer", "nav", "div.banner", "div.disclaimer", "div.toolbar")
COMMENTS = ("comment", "comments", "replies", "discussion")
# Elements below an article that hold its text, one of a kind or several in a row.
ALONE = (["p"], ["div"], ["pre"], ["blockquote"], ["blockquote", "p"], ["figure", "figcaption"], ["figcaption"], ["h2"], ["h3"], ["h4"], ["section", "p"], ["div", "p"], ["details", "summary"], ["address"], ["header", "h1"], [])
SEVERAL = (["ul", "li"], ["ol", "li"], ["ul", "li", "p"], ["dl", "dt"], ["dl", "dd"], ["table", "tr", "td"], ["table", "tbody", "tr", "td"], ["table", "thead", "tr", "th"], ["table", "caption"], ["ul", "li", "ul", "li"])
NOTICES = ("div.notice", "div.cookie-notice", "p.notice", "div.alert", "aside", "div.advert", "div.ad", "div.newsletter", "div.share", "div.related", "form", "nav.toc", "div.popup", "div.promo", "ul.share")

PATHS, WORDS, COUNTS, HIDDEN = 96, 48, 9, 20
WIDTH = PATHS + WORDS + COUNTS
LEAN = -2.0  # a block is taken from these log odds on: lost article text is worse than a line too many
STEPS = 256  # blocks of a training sequence, and of the parts in which a long page is read
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z0-9]+")


def bucket(text: str, size: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % size


_BITS: dict[str, int] = {}


def name_bits(element: str) -> int:
    """A bit for each part of an element's tag, classes and id."""
    known = _BITS.get(element)
    if known is None:
        known = 0
        for n in _NAME.findall(element):
            known |= 1 << bucket(n, PATHS)
        if len(_BITS) < 50_000:
            _BITS[element] = known
    return known


class Node:
    """An open element: what a block needs to know about it and those around it, without walking up."""

    __slots__ = ("tag", "name", "parent", "bits", "depth", "paragraph", "article", "never")

    def __init__(self, tag: str, name: str, parent: Node | None):
        self.tag, self.name, self.parent = tag, name, parent
        block = tag in BLOCK
        self.bits = (parent.bits if parent else 0) | (name_bits(name) if block else 0)
        self.depth = (parent.depth if parent else 0) + block
        self.paragraph = self if tag == "p" else None if tag in SCOPE or not parent else parent.paragraph
        self.article = tag in ("article", "main") or bool(parent and parent.article)
        self.never = tag in NEVER or bool(parent and parent.never) or (tag == "header" and not self.article)

    def path(self) -> list[str]:
        """Names of the block elements, outermost first."""
        out, node = [], self
        while node:
            if node.tag in BLOCK:
                out.append(node.name)
            node = node.parent
        return out[::-1]


@dataclass
class Block:
    node: Node | None
    text: str
    linked: int  # characters inside links


class Leaves(HTMLParser):
    """Collects a page's blocks. Every element is opened and closed once, so the work grows with the page alone."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top: Node | None = None
        self.open: dict[str, int] = {}
        self.blocks: list[Block] = []
        self.text: list[str] = []
        self.linked = self.silent = 0

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.blocks.append(Block(self.top, text, self.linked))
        self.text, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self.flush()
        if tag in ENDS_P and self.top and self.top.paragraph:
            self.leave(self.top.paragraph)
        if tag in VOID:
            if tag in ("br", "img"):
                self.text.append(" ")
            return
        named = dict(attrs)
        name = tag + "".join(f".{c}" for c in (named.get("class") or "").lower().split()) + (f"#{named['id'].lower()}" if named.get("id") else "")
        self.top = Node(tag, name, self.top)
        self.open[tag] = self.open.get(tag, 0) + 1
        self.silent += tag in SILENT

    def leave(self, node: Node) -> None:
        """Close an open element and all inside it."""
        while self.top:
            gone, self.top = self.top, self.top.parent
            self.open[gone.tag] -= 1
            self.silent -= gone.tag in SILENT
            if gone is node:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        if self.open.get(tag):
            node = self.top
            while node.tag != tag:  # these are closed with it
                node = node.parent
            self.leave(node)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.text.append(data)
            self.linked += len(data) if self.open.get("a") else 0


def blocks_of(html: str) -> list[Block]:
    page = Leaves()
    page.feed(html)
    page.close()
    page.flush()
    return page.blocks


_BUCKETS: dict[str, int] = {}


def word_buckets(words: list[str]) -> list[int]:
    out = []
    for w in words:
        known = _BUCKETS.get(w)
        if known is None:
            known = bucket(w.lower(), WORDS)
            if len(_BUCKETS) < 100_000:
                _BUCKETS[w] = known
        out.append(known)
    return out


def vectors(blocks: list[Block], first: int = 0, total: int | None = None) -> np.ndarray:
    """A row for each block; ``first`` and ``total`` say where in its page the part begins and how many blocks the page has."""
    total = len(blocks) if total is None else total
    out = np.zeros((len(blocks), WIDTH), np.float32)
    masks = b"".join((b.node.bits if b.node else 0).to_bytes(PATHS // 8, "little") for b in blocks)
    out[:, :PATHS] = np.unpackbits(np.frombuffer(masks, np.uint8).reshape(len(blocks), -1), axis=1, bitorder="little")
    for k, b in enumerate(blocks):
        words, text = b.text.split(), b.text
        out[k, PATHS : PATHS + WORDS] = np.bincount(word_buckets(words), minlength=WORDS) / len(words)
        marks = text.count(".") + text.count(",") + text.count(";") + text.count("!") + text.count("?")
        at = first + k
        out[k, PATHS + WORDS :] = (np.log1p(len(text)) / 8, np.log1p(len(words)) / 6, b.linked / len(text), marks / (len(words) + 1), min(b.node.depth if b.node else 0, 40) / 8, at / total, (total - at) / total, text[-1] in ".!?\"”", text[0] in "©®|»›")
    return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """steps x pages x WIDTH, and a mask of real blocks."""
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), WIDTH), np.float32), np.zeros((steps, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with one logistic output for each block; padding leaves the state as it is."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p[f"w{d}"] = (rng.standard_normal((WIDTH + HIDDEN, 4 * HIDDEN)) * 0.15).astype(np.float32)
            self.p[f"c{d}"] = np.zeros(4 * HIDDEN, np.float32)
            self.p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1  # remember at first
        self.p["out"] = (rng.standard_normal(2 * HIDDEN) * 0.15).astype(np.float32)
        self.p["bias"] = np.zeros(1, np.float32)

    def pass_(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        steps, pages = mask.shape
        h, c, out, tape = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32), np.zeros((steps, pages, HIDDEN), np.float32), []
        given = x @ self.p[f"w{d}"][:WIDTH] + self.p[f"c{d}"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            gates = given[t] + h @ self.p[f"w{d}"][WIDTH:]
            i, f, o = (sigmoid(gates[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in (0, 1, 2))
            g = np.tanh(gates[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            tanh = np.tanh(new)
            tape.append((t, h, c, i, f, o, g, tanh, m))
            c = m * new + (1 - m) * c
            h = m * (o * tanh) + (1 - m) * h
            out[t] = h
        return out, tape

    def part(self, x: np.ndarray, mask: np.ndarray, d: str, state: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """What one direction adds to the outputs of a part of the sequence, from the state before it, and the state after it."""
        steps, pages = mask.shape
        h, c = state or (np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32))
        w, out = self.p[f"w{d}"][WIDTH:], np.zeros((steps, pages), np.float32)
        given = x @ self.p[f"w{d}"][:WIDTH] + self.p[f"c{d}"]
        weight = self.p["out"][:HIDDEN] if d == "f" else self.p["out"][HIDDEN:]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            gates = given[t] + h @ w
            s = sigmoid(gates[:, : 3 * HIDDEN])
            m = mask[t][:, None]
            new = s[:, HIDDEN : 2 * HIDDEN] * c + s[:, :HIDDEN] * np.tanh(gates[:, 3 * HIDDEN :])
            c = m * new + (1 - m) * c
            h = m * (s[:, 2 * HIDDEN :] * np.tanh(new)) + (1 - m) * h
            out[t] = h @ weight
        return out, (h, c)

    def long_page(self, blocks: list[Block]) -> np.ndarray:
        """Outputs for a page of any length: its vectors exist for one part at a time, in either direction."""
        out, total = np.full(len(blocks), self.p["bias"][0], np.float32), len(blocks)
        for d in "fb":
            state, starts = None, range(0, total, STEPS)
            for at in starts if d == "f" else reversed(starts):
                x = vectors(blocks[at : at + STEPS], at, total)[:, None]
                more, state = self.part(x, np.ones((len(x), 1), np.float32), d, state)
                out[at : at + STEPS] += more[:, 0]
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        forward, ft = self.pass_(x, mask, "f")
        backward, bt = self.pass_(x, mask, "b")
        return forward @ self.p["out"][:HIDDEN] + backward @ self.p["out"][HIDDEN:] + self.p["bias"], [forward, ft, backward, bt]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, known: np.ndarray | None = None) -> dict[str, np.ndarray]:
        logits, (forward, ft, backward, bt) = self.logits(x, mask)
        known = mask if known is None else known  # blocks without a label teach nothing
        error = (sigmoid(logits) - y) * known / max(known.sum(), 1)
        grads = {"out": np.concatenate([(h * error[:, :, None]).sum(axis=(0, 1)) for h in (forward, backward)]), "bias": error.sum(keepdims=True).reshape(1)}
        for d, tape, part in (("f", ft, self.p["out"][:HIDDEN]), ("b", bt, self.p["out"][HIDDEN:])):
            w = self.p[f"w{d}"]
            gw, gb = np.zeros_like(w), np.zeros(4 * HIDDEN, np.float32)
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h, c, i, f, o, g, tanh, m in reversed(tape):
                dh = dh + error[t][:, None] * part
                own = m * dh
                dn = own * o * (1 - tanh**2) + m * dc
                gates = np.hstack((dn * g * i * (1 - i), dn * c * f * (1 - f), own * tanh * o * (1 - o), dn * i * (1 - g**2)))
                gw[:WIDTH] += x[t].T @ gates
                gw[WIDTH:] += h.T @ gates
                gb += gates.sum(axis=0)
                dh = gates @ w[WIDTH:].T + (1 - m) * dh
                dc = dn * f + (1 - m) * dc
            grads[f"w{d}"], grads[f"c{d}"] = gw, gb
        return grads

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 12, batch: int = 32, rate: float = 0.012, seed: int = 5) -> Labeller:
        rng, first, second, step = np.random.default_rng(seed), {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        for epoch in range(epochs):
            order, now = rng.permutation(len(pages)), rate * (1 - 0.95 * epoch / epochs)  # steps become smaller
            order = order[np.argsort([-(-len(pages[k][0]) // 16) for k in order], kind="stable")]  # like lengths together: little padding
            batches = [order[at : at + batch] for at in range(0, len(order), batch)]
            for turn in rng.permutation(len(batches)):
                some = [pages[k] for k in batches[turn]]
                x, mask = padded([p for p, _ in some])
                y, known = np.zeros_like(mask), np.zeros_like(mask)
                for k, (_, labels) in enumerate(some):
                    y[: len(labels), k], known[: len(labels), k] = labels == 1, labels >= 0
                step += 1
                for k, g in self.gradients(x, mask, y, known).items():
                    g = np.clip(g, -1, 1)
                    first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.99 * second[k] + 0.01 * g * g
                    self.p[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self

    def choose(self, pages: list[list[Block]], most: int = 4096) -> list[np.ndarray]:
        """Which blocks of each page are article text. Pages of like length are read together, at most ``most`` steps x pages."""
        out = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            some = [order[at]]
            if len(pages[some[0]]) > most:
                out[some[0]] = self.long_page(pages[some[0]]) > LEAN
                at += 1
                continue
            while at + len(some) < len(order) and (len(some) + 1) * len(pages[order[at + len(some)]]) <= most:
                some.append(order[at + len(some)])
            x, mask = padded([vectors(pages[k]) for k in some])
            logits = self.part(x, mask, "f")[0] + self.part(x, mask, "b")[0] + self.p["bias"]
            for n, k in enumerate(some):
                out[k] = logits[: len(pages[k]), n] > LEAN
            at += len(some)
        return out


def labels_of(page: list[Block]) -> list[int]:
    """1 for the blocks of a marked article, 0 for others, as HTML's elements say; without a marked article 0 for links and
    elements that never hold one, and no label (-1) for the rest."""
    marked = any(b.node and b.node.article for b in page)
    out = []
    for b in page:
        never = b.node is not None and b.node.never
        if marked:
            out.append(int(b.node is not None and b.node.article and not never))
        else:
            out.append(0 if never or b.linked > 0.6 * len(b.text) else -1)
    return out


def chain(path: list[str]) -> Node | None:
    node = None
    for name in path:
        node = Node(name.split(".")[0].split("#")[0], name, node)
    return node


def gibberish(rng: random.Random) -> str:
    return "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randrange(2, 7)))


def sentence(pool: list[str], rng: random.Random, most: int) -> str:
    words = rng.choice(pool).split()
    at = rng.randrange(max(1, len(words) - most + 1))
    return " ".join(words[at : at + rng.randrange(1, most + 1)])


def foreign(name: str, pool: list[str], rng: random.Random) -> list[tuple[list[str], str, int]]:
    """(inner path, text, linked characters) of blocks as they stand in a container that holds no article text."""
    out = []
    kind = "comment" if any(c in name for c in COMMENTS) else rng.choice(("links", "short", "text"))
    for _ in range(rng.randrange(1, 6 if kind == "text" else 9)):
        if kind == "comment":
            inner = rng.choice((["p"], ["div"], ["li"], ["div", "p"], ["li", "p"]))
            out.append((inner, sentence(pool, rng, 3), 0))
            out.append((inner, sentence(pool, rng, 30), 0))
        elif kind == "links":
            text = sentence(pool, rng, 4)
            out.append((rng.choice((["ul", "li"], ["ul", "li"], ["li"], ["div"], [], ["table", "tr", "td"])), text, len(text)))
        else:
            text = sentence(pool, rng, 6 if kind == "short" else 40)
            out.append((rng.choice(([], [], ["p"], ["div"], ["h3"], ["div", "p"], ["ul", "li"], ["table", "tr", "td"])), text, len(text) if rng.random() < 0.2 else 0))
    return out


def refilled(rows: list[tuple[list[str], str, int, int]], pool: list[str], rng: random.Random) -> list[tuple[list[str], str, int, int]]:
    """The rows of a page with some of its article's text in other elements: lists, tables, quotes, captions, code, definitions."""
    out, kinds = [], rng.choice((0.15, 0.4, 0.8))
    for path, text, linked, y in rows:
        if y != 1 or rng.random() > kinds:
            out.append((path, text, linked, y))
            continue
        around = path[:-1] if path and path[-1].split(".")[0] in ("p", "h1", "h2", "h3", "div") and len(path) > 3 else path
        if rng.random() < 0.45:
            out.append(([*around, *rng.choice(ALONE)], text if rng.random() < 0.6 else sentence(pool, rng, 12), linked, 1))
            continue
        if rng.random() < 0.7:
            out.append((path, text, linked, y))
        kind = rng.choice(SEVERAL)
        mixed = kind[0] == "dl" or rng.random() < 0.2
        for n in range(rng.randrange(1, 9)):
            inner = (["dl", ("dt", "dd")[n % 2]] if kind[0] == "dl" else rng.choice(SEVERAL)) if mixed else kind
            item = sentence(pool, rng, rng.choice((2, 6, 14)))
            out.append(([*around, *inner], item, rng.choice((0, 0, 0, len(item) // 2, len(item))) if rng.random() < 0.3 else 0, 1))
    return out


def dressed(page: list[tuple[list[str], str, int]], labels: list[int], pool: list[str], rng: random.Random, plain: bool) -> tuple[list[Block], list[int]]:
    """A training page in other clothes: its article in another container, foreign blocks beside and inside it; ``plain``: with
    names that say nothing."""
    body = rng.choice(BODY)
    rows = [([body if x.split(".")[0].split("#")[0] in ("article", "main") else x for x in path], text, linked, y) for (path, text, linked), y in zip(page, labels)]
    rows = refilled(rows, pool, rng)
    for _ in range(rng.randrange(1, 7)):
        article = [k for k, r in enumerate(rows) if r[3] == 1]
        inside = not plain and rng.random() < 0.5 and article
        name = rng.choice(NOTICES if inside and rng.random() < 0.7 else EXTRA)
        more = [(["html", "body", *([body] if inside else []), name, *inner], text, linked, 0) for inner, text, linked in foreign(name, pool, rng)]
        if inside:
            at = rng.choice(article) + 1
        elif any(c in name for c in (*COMMENTS, "related", "footer", "share")):
            at = article[-1] + 1 if article else len(rows)
        else:
            at = rng.choice((0, article[0] if article else 0, article[-1] + 1 if article else len(rows), len(rows)))
        rows[at:at] = more
    if plain:
        names: dict[str, str] = {}
        keep = rng.random() < 0.5

        def other(x: str) -> str:
            tag = x.split(".")[0].split("#")[0]
            if tag in ("html", "body") or (keep and tag in ("p", "li", "ul", "h1", "h2", "h3", "td", "tr", "table")):
                return tag
            return names.setdefault(x, rng.choice(("div", "div", "div", "section", "td")) + rng.choice(("", f".{gibberish(rng)}", f"#{gibberish(rng)}")))

        rows = [(list(map(other, path)), *rest) for path, *rest in rows if "title" not in path[-1:]]
    return [Block(chain(path), text, linked) for path, text, linked, _ in rows], [y for *_, y in rows]


def train(htmls: list[str], sample_blocks: int = 20_000, copies: int = 6, seed: int = 5) -> Labeller:
    rng, pages, left = random.Random(seed), [], sample_blocks
    for html in htmls:
        page = blocks_of(html)
        if 0 < len(page) <= left and max(b.node.depth if b.node else 0 for b in page) <= STEPS:
            pages.append(page)
            left -= len(page)
    pool = [b.text for page in pages for b in page] or ["menu"]
    sequences: list[tuple[np.ndarray, np.ndarray]] = []

    def add(blocks: list[Block], labels: list[int]) -> None:
        x, y = vectors(blocks), np.array(labels, np.float32)
        sequences.extend((x[at : at + STEPS], y[at : at + STEPS]) for at in range(0, len(x), STEPS))

    for page in pages:
        labels = labels_of(page)
        for _ in range(2):
            add(page, labels)
        if 1 in labels:
            bare = [(b.node.path() if b.node else [], b.text, b.linked) for b in page]
            for n in range(copies):
                add(*dressed(bare, labels, pool, rng, plain=n % 2 == 1))
    return Labeller(seed).fit(sequences) if sequences else Labeller(seed)


def extract_main_text(pages: DataFrame, sample: int = 240, sample_blocks: int = 20_000, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """page_id, url, text, n_chars for every row; the labeller is taught on at most ``sample`` pages and ``most_bytes`` of html."""
    small_batches(pages.sparkSession)
    hashed = pages.where(F.octet_length("html") > 0).select(F.xxhash64("page_id", "html").alias("h"), "html")
    # sizes to the driver first, then the pages that fit, each once, however often it is repeated
    sizes = {r["h"]: r for r in hashed.select("h", F.octet_length("html").alias("size")).orderBy("h").limit(sample).collect()}
    few = pages.sparkSession.createDataFrame([(r["h"],) for r in that_fit(list(sizes.values()), most_bytes)], "h long")
    chosen = hashed.join(F.broadcast(few), "h", "left_semi").dropDuplicates(["h"]).collect()
    htmls = dict(sorted((r["h"], r["html"]) for r in chosen))
    labeller = train(list(htmls.values()), sample_blocks)
    shared = pages.sparkSession.sparkContext.broadcast(labeller)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                found = [blocks_of(h) for h in part.column("html").to_pylist()]
                texts = ["\n\n".join(x.text for x, yes in zip(b, keep) if yes) for b, keep in zip(found, shared.value.choose(found))]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kept = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    return kept.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
