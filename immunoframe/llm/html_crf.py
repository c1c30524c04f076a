"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read as a sequence of leaf blocks: runs of text between block-level tags, each with its open ancestor
tags. The field labels every block as content or not, from ancestor tags, class and id words, link share, length
and punctuation, and from its neighbour's label. Weights are trained on labelled pages by maximum likelihood
(forward-backward) and pages are decoded by Viterbi.

Labelled pages are HTML whose elements carry ``data-label="content"`` or ``"other"``; the innermost one holds.
:func:`sample_pages` writes such pages in many layouts, and is what the model is trained on by default.
"""

from __future__ import annotations

import bisect
import functools
import html
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages that the default model is fitted on.
TRAINING_PAGES = 700

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"<]*\"|'[^'<]*'|[^>\"'])*)(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|data-label|hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select", "object"}
#: Of these, the ones whose content isn't markup.
_CODE = {"script", "style", "textarea", "title"}
_SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
_VOID = {"br", "img", "hr", "input", "meta", "link", "wbr", "source", "area", "base", "col", "embed", "track", "param"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Open elements that a start tag ends.
_ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_SCOPE = {"ul", "ol", "table", "body", "html", "div", "article", "section", "main", "aside", "nav", "footer", "header", "form", "dl", "blockquote"}
_PARAGRAPHS = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
_END_TAG = re.compile(r"</(?=([a-zA-Z][^\s/>]{0,64}))")
_ASCII_NAME = re.compile(r"[a-zA-Z0-9]+")
_ASCII_WORD = re.compile(r"[a-z]+")


class _Open:
    """The open elements of a page: where each name stands, and the weight of the path's features, kept up as elements open and close."""

    def __init__(self, page: str, emit: dict[str, tuple[float, float]] | None) -> None:
        self.page, self.emit = page, emit
        self.items: list[tuple[str, str, str]] = []
        self.path: list[tuple[str, str, str]] = []  # without inline elements
        self.where: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.regions: list[str] = []  # names of the path but for paragraphs
        self.held: dict[str, int] = {}
        self.weight = [0.0, 0.0]
        self.ends: dict[str, list[int]] | None = None

    def push(self, name: str, words: str, label: str) -> None:
        self.where.setdefault(name, []).append(len(self.items))
        if name in _SCOPE:
            self.scopes.append(len(self.items))
        self.items.append((name, words, label))
        if name not in _INLINE:
            self.path.append((name, words, label))
            if name != "p":
                self.regions.append(name)
            self._count(name, words, 1)

    def cut(self, start: int) -> None:
        """Closes all elements from ``start`` on."""
        while len(self.items) > start:
            name, words, _ = self.items.pop()
            self.where[name].pop()
            if name in _SCOPE:
                self.scopes.pop()
            if name not in _INLINE:
                self.path.pop()
                if name != "p":
                    self.regions.pop()
                self._count(name, words, -1)

    def _count(self, name: str, words: str, by: int) -> None:
        if self.emit is None:
            return
        for f in _element_features(name, words):
            before = self.held.get(f, 0)
            self.held[f] = before + by
            if 0 in (before, before + by) and f in self.emit:
                for k in (0, 1):
                    self.weight[k] += by * self.emit[f][k]

    def close(self, name: str) -> None:
        if self.where.get(name):
            self.cut(self.where[name][-1])

    def close_before(self, names: set[str]) -> None:
        """Closes the innermost element of these names within the innermost region."""
        last = max((self.where[n][-1] for n in names if self.where.get(n)), default=-1)
        if last > (self.scopes[-1] if self.scopes else -1):
            self.cut(last)

    def snapshot(self) -> tuple:
        """The path, or with weights: the weight of its features."""
        if self.emit is None:
            return tuple(self.path)
        leaf = self.emit.get(f"leaf:{self.path[-1][0] if self.path else ''}", (0.0, 0.0))
        return self.weight[0] + leaf[0], self.weight[1] + leaf[1]

    def _end(self, name: str, at: int) -> int | None:
        """Where the first end tag of this name from ``at`` on starts; all end tags of the page are looked for once."""
        if self.ends is None:
            self.ends = {}
            for found in _END_TAG.finditer(self.page):
                for key in {found[1].lower(), _ASCII_NAME.match(found[1])[0].lower()}:
                    self.ends.setdefault(key, []).append(found.start())
        places = self.ends.get(name, [])
        i = bisect.bisect_left(places, at)
        return places[i] if i < len(places) else None

    def raw_end(self, at: int, name: str) -> int:
        """Where an element ends whose content is not text of the page, its start tag ending at ``at``.

        Code and plain text end at their end tag, or without one at that of the element around them. Others without an end
        tag within the element around them are read as empty, so that nothing after them is lost.
        """
        around = self.regions[-1] if self.regions else "body"
        own, outer = self._end(name, at), self._end(around, at)
        after = lambda start: (self.page.find(">", start) + 1) or len(self.page)
        if name in _CODE:
            return after(own) if own is not None else outer if outer is not None else len(self.page)
        return after(own) if own is not None and name != around and (outer is None or own < outer) else at


def blocks(page: str | None, emit: dict[str, tuple[float, float]] | None = None) -> list[tuple[str, tuple, float]]:
    """The leaf blocks of a page: text, open elements as (tag, words of class, id and role, label), link share.

    With the weights ``emit`` of features, the weight of the open elements' features stands in their place: pages of any depth are read in one linear pass.
    """
    out: list[tuple[str, tuple, float]] = []
    page = page or ""
    stack = _Open(page, emit)
    run: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            out.append((text, stack.snapshot(), linked / max(1, len(text))))
        run.clear()
        linked = 0

    def text(piece: str) -> None:
        nonlocal linked
        run.append(piece)
        if stack.where.get("a"):
            linked += len(piece)

    at, token = 0, _TOKEN.search(page)
    while token:
        if token.start() > at:
            text(page[at : token.start()])
        at = token.end()
        if token[2]:
            name, closing = token[2].lower(), bool(token[1])
            if name not in _INLINE:
                flush()
            elif name == "br":
                run.append(" ")
            if closing:
                stack.close(name)
            elif name in _RAW:
                if not _SELF_CLOSED.search(token[3] or ""):
                    at = stack.raw_end(at, name)
            elif name not in _VOID:
                stack.close_before(_ENDS.get(name) or (set() if name in _INLINE else _PARAGRAPHS))
                words, label = "", ""
                if token[3] and not token[3].isspace():
                    for key, *value in _ATTRIBUTE.findall(token[3]):
                        key, value = key.lower(), "".join(value)
                        if key == "data-label":
                            label = value
                        else:
                            words += " " + value.lower()
                stack.push(name, words, label)
        token = _TOKEN.search(page, at)
    if at < len(page):
        text(page[at:])
    flush()
    return out


@functools.lru_cache(maxsize=4096)
def _element_features(tag: str, words: str) -> frozenset[str]:
    out = {f"in:{tag}"}
    for w in _ASCII_WORD.findall(words):
        out.add(f"word:{w}")
        out |= {f"part:{s}" for s in _STEMS if s in w}
    return frozenset(out)


def _path_features(path: tuple) -> set[str]:
    return {f"leaf:{path[-1][0] if path else ''}"}.union(*(_element_features(tag, words) for tag, words, _ in path))


#: Parts of class and id words that names of page regions share.
_STEMS = ("nav", "menu", "foot", "head", "side", "widget", "comment", "reply", "cookie", "consent", "notice", "banner", "advert", "promo", "sponsor", "share", "social", "related", "breadcrumb", "login", "search", "subscri", "newsletter", "content", "article", "post", "entry", "story", "main", "body", "text")


def features(block: tuple[str, tuple, float], place: float) -> Iterable[str]:
    """The features of a block; those of its path only if it has one and not their weight already."""
    text, path, linked = block
    n = text.count(" ") + 1
    if not path or isinstance(path[0], tuple):
        yield from sorted(_path_features(path))
    yield f"words:{min(n.bit_length(), 7)}"
    yield f"link:{0 if linked == 0 else 1 if linked < 0.5 else 2}"
    yield f"end:{text[-1] if text[-1] in '.!?:;,' else 'other'}"
    yield f"place:{int(place * 4)}"
    if text[0] in "©®™":
        yield "sign"


class Field:
    """Weights of a two-label field: 0 other, 1 content."""

    def __init__(self, emit: dict[str, tuple[float, float]], step: np.ndarray) -> None:
        self.emit, self.step = emit, step

    def scores(self, page: list) -> np.ndarray:
        out = np.zeros((len(page), 2))
        for i, b in enumerate(page):
            for f in features(b, i / len(page)):
                w = self.emit.get(f)
                if w is not None:
                    out[i] += w
            if b[1] and not isinstance(b[1][0], tuple):
                out[i] += b[1]
        return out

    def decode(self, page: list) -> list[int]:
        """The likeliest labels (Viterbi); ties go to content."""
        (a, b), (c, d) = self.step.tolist()
        back, s = [], (0.0, 0.0)
        for i, (e0, e1) in enumerate(self.scores(page).tolist()):
            if i:
                p0, p1 = int(s[1] + c >= s[0] + a), int(s[1] + d >= s[0] + b)
                back.append((p0, p1))
                s = (max(s[0] + a, s[1] + c) + e0, max(s[0] + b, s[1] + d) + e1)
            else:
                s = (e0, e1)
        if not page:
            return []
        labels = [int(s[1] >= s[0])]
        for p in reversed(back):
            labels.append(p[labels[-1]])
        return labels[::-1]


def train(pages: Iterable[str], *, rounds: int = 120, ridge: float = 0.02, rate: float = 0.3) -> Field:
    """Maximum likelihood on labelled pages, by Adam on forward-backward gradients; blocks without a label are "other"."""
    parsed = [p for p in map(blocks, pages) if p]
    index: dict[str, int] = {}
    rows, cols, gold, lengths = [], [], [], []
    for p in parsed:
        lengths.append(len(p))
        for i, b in enumerate(p):
            gold.append(int(next((label for _, _, label in reversed(b[1]) if label), "other") == "content"))
            for f in features(b, i / len(p)):
                rows.append(len(gold) - 1)
                cols.append(index.setdefault(f, len(index)))
    rows, cols, gold, lengths = (np.array(x) for x in (rows, cols, gold, lengths))
    n, longest = len(lengths), int(lengths.max())
    first = np.cumsum(lengths) - lengths
    grid = np.minimum(first[:, None] + np.arange(longest), len(gold) - 1)
    live = np.arange(longest)[None, :] < lengths[:, None]
    y = np.where(live, gold[grid], 0)
    w, step = np.zeros((len(index), 2)), np.zeros((2, 2))
    moments = [[np.zeros_like(w), np.zeros_like(w)], [np.zeros_like(step), np.zeros_like(step)]]
    log_sum = lambda x: np.logaddexp(x[..., 0], x[..., 1])
    seen = np.stack([np.bincount(cols, gold[rows] == k, len(index)) for k in (0, 1)], axis=1)
    pairs = live[:, 1:]
    seen_step = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & pairs).sum() for b in (0, 1)] for a in (0, 1)], float)
    for t in range(1, rounds + 1):
        emission = np.stack([np.bincount(rows, w[cols, k], len(gold)) for k in (0, 1)], axis=1)[grid]
        alpha = [emission[:, 0]]
        for i in range(1, longest):
            a = log_sum((alpha[-1][:, :, None] + step[None]).transpose(0, 2, 1)) + emission[:, i]
            alpha.append(np.where(live[:, i, None], a, alpha[-1]))
        beta = [np.zeros((n, 2))]
        for i in range(longest - 1, 0, -1):
            b = log_sum(step[None] + (emission[:, i] + beta[0])[:, None, :])
            beta.insert(0, np.where(live[:, i, None], b, beta[0]))
        z = log_sum(alpha[-1])
        p = np.exp(np.stack(alpha, 1) + np.stack(beta, 1) - z[:, None, None])
        flat = np.zeros((len(gold), 2))
        flat[grid[live]] = p[live]
        joint = np.exp(np.stack(alpha, 1)[:, :-1, :, None] + step + (emission[:, 1:] + np.stack(beta, 1)[:, 1:])[:, :, None, :] - z[:, None, None, None])
        expect_step = (joint * pairs[:, :, None, None]).sum(axis=(0, 1))
        expect = np.stack([np.bincount(cols, flat[rows, k], len(index)) for k in (0, 1)], axis=1)
        for x, g, m in ((w, (seen - expect) / n - ridge * w / n, moments[0]), (step, (seen_step - expect_step) / n, moments[1])):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            x += rate * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.99**t)) + 1e-8) / (1 + t / 40)
    return Field({f: (float(w[i, 0]), float(w[i, 1])) for f, i in index.items()}, step)


def sample_pages(n: int, seed: int = 1) -> list[str]:
    """Labelled pages of invented words in many layouts, with sloppy markup."""
    rng = random.Random(seed)
    pick = rng.choice
    word = lambda: "".join(pick(("ka", "lo", "mi", "ter", "an", "es", "dor", "vé", "uß", "in")) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))

    def sentence() -> str:
        return words(1, 22).capitalize() + pick((".", ".", ".", "!", "?", "", ",", " &amp;"))

    def prose() -> str:
        body = " ".join(sentence() for _ in range(rng.randint(1, 5)))
        if rng.random() < 0.3:
            body += f" <{(t := pick(('a', 'b', 'em', 'span', 'strong')))}>{words(1, 4)}</{t}> {sentence()}"
        return body

    def box(tags: str, names: str, inner: str, label: str = "other", named: float = 0.8) -> str:
        tag = pick(tags.split())
        plain = tag not in ("div", "section", "ul", "ol", "span", "p")
        name = f' {pick(("class", "class", "id"))}="{pick(names.split())}"' if names and (rng.random() < named or not plain) else ""
        mark = f' data-label="{label}"' if label else ""
        return f"<{tag}{name}{mark}>{inner}</{tag}>"

    def links(a: int, b: int) -> str:
        items = [f'<a href="/{word()}">{words(1, 3)}</a>' for _ in range(rng.randint(a, b))]
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if rng.random() < 0.7 else " | ".join(items)

    def advert() -> str:
        return box("div div aside section ins", "ad ads advert advertisement sponsored promo banner-ad ad-slot adbox", pick((prose(), f"<p>{prose()}</p>", links(1, 2))))

    def form() -> str:
        return box("form form form div", "search login newsletter subscribe signup contact", f"<label>{words(1, 3)}</label><input name=q><p>{sentence()}</p><button>{word()}</button>")

    def notice() -> str:
        return box("div div section aside p", "cookie cookie-notice notice consent banner alert gdpr popup cookie-banner", pick((prose(), f"<p>{prose()}</p><button>{word()}</button>")))

    def comments() -> str:
        one = lambda: box("div li article section", "comment comment-body reply", f"<p>{prose()}</p>")
        return box("section div ol aside", "comments comment-list commentlist responses discussion", f"<h{(h := pick('23'))}>{words(1, 3)}</h{h}>" + "".join(one() for _ in range(rng.randint(1, 4))))

    def aside() -> str:
        return box("aside aside div section", "sidebar side widget related rail right-column", f"<h3>{words(1, 3)}</h3>" + pick((links(2, 6), f"<p>{prose()}</p>")))

    def content() -> str:
        parts = [f"<h1>{words(1, 10)}</h1>"] if rng.random() < 0.85 else []
        if rng.random() < 0.12 and parts:
            parts = [f"<header>{parts[0]}</header>"]
        for _ in range(pick((1, 1, 2, 4, 8, 16, 25))):
            u = rng.random()
            if u < 0.7:
                parts.append(f"<p>{prose()}</p>" if rng.random() < 0.9 else f"<p>{prose()}")
            elif u < 0.8:
                parts.append(f"<p><b>{prose()}<br>")
            elif u < 0.86:
                parts.append(f"<h{(h := pick('234'))}>{words(1, 6)}</h{h}>")
            elif u < 0.91:
                parts.append("<ul>" + "".join(f"<li>{sentence()}" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif u < 0.94:
                parts.append(f"<blockquote>{prose()}</blockquote>")
            elif u < 0.96:
                parts.append("<table>" + "".join(f"<tr><td>{words(1, 3)}<td>{words(1, 3)}" for _ in range(3)) + "</table>")
            else:
                parts.append(f"<div>{prose()}</div>")
            if rng.random() < 0.05:
                parts.append(pick((advert, form, aside, notice))())
        if rng.random() < 0.12:
            parts.append(comments())
        return "".join(parts)

    out = []
    for _ in range(n):
        maybe = lambda chance, make: make() if rng.random() < chance else ""
        kind = rng.random()
        inner = content()
        if kind < 0.55:
            main = box("article", "post entry story hentry", inner, "content", 0.3)
        elif kind < 0.7:
            main = "<main>" + maybe(0.3, advert) + box("article section div", "post content", inner, "content", 0.5) + maybe(0.3, comments) + maybe(0.2, aside) + "</main>"
        elif kind < 0.8:
            main = box("main", "main content", inner, "content", 0.3)
        else:
            main = box("div section", "content article article-body post entry-content story main text body", inner, "content", 1.0)
        nav = lambda: box("nav nav nav div ul", "menu nav navbar navigation main-menu breadcrumb", links(3, 8))
        top = lambda: box("header header div", "header masthead top site-header", pick((f"<a href=/>{words(1, 3)}</a>", f"<h1>{words(1, 4)}</h1>", f"<p>{words(1, 8)}</p>")) + maybe(0.5, nav))
        foot = box("footer footer footer div", "footer site-footer bottom foot", pick((f"&copy; {word()}.example &middot; {prose()}", f"<p>&copy; {words(2, 9)}</p>{links(1, 4)}", prose())))
        parts = [maybe(0.3, notice), maybe(0.4, top), maybe(0.8, nav), maybe(0.5, advert), main, maybe(0.2, comments), maybe(0.3, aside), maybe(0.2, form), maybe(0.2, advert), foot, maybe(0.1, notice)]
        page = "<html><head><title>x</title></head><body>" + "".join(parts) + pick(("</body></html>", "", "</body>"))
        out.append(page)
    return out


@functools.cache
def default_field() -> Field:
    return train(sample_pages(TRAINING_PAGES))


def main_text(page: str | None, field: Field) -> str:
    """The content blocks of a page in page order, joined by one line end."""
    found = blocks(page, field.emit)
    return "\n".join(b[0] for b, label in zip(found, field.decode(found), strict=True) if label)


def _extract(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x, field) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, *, field: Field | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row.

    Null or empty HTML gives the empty text. Null ids and urls stay null, repeated rows are read row by row,
    extra columns are ignored, and no rows give no rows. Pages of any length are read whole.
    """
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return given.mapInArrow(_extract(field or default_field()), "page_id long, url string, text string, n_chars long")
