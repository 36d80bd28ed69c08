"""Main-text extraction by a linear-chain CRF over DOM leaf blocks (operator 9).

A page is scanned into leaf blocks: the text between two block-level tags, with its open
elements. Each block gets features of its ancestors (tags, words of class and id) and of its
text (length, link share, punctuation, marks). A two-label chain (main text or not) is
trained by maximum likelihood on labelled pages and decoded by Viterbi; the blocks labelled
main text are joined by blank lines. Labelled pages come from ``labelled_pages``, a
generator of families of layouts (``LAYOUTS``) whose seed and number (``TRAINING_PAGES``) are
parameters; other labelled pages can be passed to ``train``.

Comments, scripts, styles and other raw elements are no text. Defined results: null or empty
html, and pages without main text, give the empty string; unclosed tags, stray ends and cut
pages are read as far as they go; rows are independent; other columns are ignored.
"""

from __future__ import annotations

import functools
import html as html_lib
import math
import random
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.scratch import spread

TRAINING_PAGES, SEED, STEPS = 500, 7, 150

_BLOCK = frozenset(
    "html head title body p div article section main nav header footer aside ul ol li dl dt dd h1 h2 h3 h4 h5 h6 table caption thead tbody tfoot tr td th form fieldset legend blockquote pre figure figcaption address details summary hr select option optgroup menu dialog center".split()
)
_VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
#: Elements whose content is no text; those of ``_SCRIPTED`` run to the end of the page if unclosed, others count as empty then.
_SCRIPTED = frozenset(("script", "style", "textarea", "iframe", "noembed", "noframes", "xmp"))
_DRAWN = frozenset(("svg", "template"))
#: Opening one of these ends an open element of its group.
_IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = _BLOCK - {"p", "html", "head", "body", "title"}
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_STOP = re.compile(r">|=\s*([\"'])")
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORD = re.compile(r"[a-z]+")
_INLINE_ROLES = frozenset(("a", "b", "strong", "em", "i", "button", "label", "small", "span", "code", "time"))


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    names: tuple[str, ...]
    links: int = 0
    bold: bool = False
    label: int = 0


@dataclass
class _Scan:
    stack: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    blocks: list[Block] = field(default_factory=list)

    def flush(self) -> None:
        if self.parts:
            text = " ".join(html_lib.unescape("".join(self.parts)).split())
            if text:
                path = tuple(t for t, _ in self.stack)
                self.blocks.append(Block(text, path, tuple(n for _, names in self.stack for n in names), min(self.linked, len(text)), any(t in ("b", "strong") for t in path)))
        self.parts, self.linked = [], 0

    def text(self, raw: str) -> None:
        self.parts.append(raw)
        if any(t == "a" for t, _ in self.stack[-4:]):
            self.linked += len(raw.strip())

    def open(self, tag: str, rest: str) -> None:
        if tag in _BLOCK:
            self.flush()
            if tag in _ENDS_P:
                self._close_inside("p", _ENDS_P)
            if tag in _IMPLIED:
                for other in _IMPLIED[tag]:
                    self._close_inside(other, {"ul", "ol", "dl", "table", "select", "div", "article", "section"})
        if tag not in _VOID and not rest.rstrip().endswith("/"):
            names = tuple(w for m in _NAMES.findall(rest) for w in _WORD.findall(m.lower())) if rest else ()
            self.stack.append((tag, names))

    def _close_inside(self, tag: str, stop: frozenset[str] | set[str]) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return
            if self.stack[i][0] in stop:
                return

    def close(self, tag: str) -> None:
        if tag in _BLOCK:
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return


class _Tags:
    """Tags of a page in one pass: nothing that was searched for and not found is searched for again."""

    def __init__(self, page: str):
        self.page, self.last = page, {q: page.rfind(q) for q in ">\"'"}
        self.absent: set[str] = set()

    def end(self, at: int) -> int:
        """Place of the ``>`` that ends the tag begun before ``at``, -1 if the page is cut inside it; one in a quoted value doesn't count."""
        while (m := _STOP.search(self.page, at)) is not None:
            quote = m[1]
            if quote is None:
                return m.start()
            at = m.end()
            if self.last[quote] >= at:
                at = self.page.find(quote, at) + 1
        return -1

    def after(self, name: str, at: int) -> int:
        """Where the content of a raw element ends: behind its end tag, -1 if there is none."""
        if name in self.absent:
            return -1
        m = re.compile(rf"</{name}(?=[\s/>])", re.I).search(self.page, at)
        if m is None:
            self.absent.add(name)
            return -1
        end = self.page.find(">", m.end())
        return end + 1 if end >= 0 else len(self.page)


def leaf_blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order, white space collapsed and references decoded; the work grows with the page's length."""
    scan, tags, at, size = _Scan(), _Tags(page), 0, len(page)
    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            scan.text(page[at:])
            break
        name = _NAME.match(page, begin + 1)
        if name is None and page[begin + 1 : begin + 2] not in ("!", "?", "/"):
            scan.text(page[at : begin + 1])  # no tag: text
            at = begin + 1
            continue
        if begin > at:
            scan.text(page[at:begin])
        if name is None:
            comment = page.startswith("<!--", begin)
            end = page.find("-->" if comment else ">", begin + 2) if tags.last[">"] > begin else -1
            at = size if end < 0 else end + (3 if comment else 1)
            continue
        end = tags.end(name.end()) if tags.last[">"] > begin else -1
        if end < 0:
            break  # the page is cut inside a tag
        at, tag, rest = end + 1, name[0].lower(), page[name.end() : end]
        if tag[0] == "/":
            scan.close(tag[1:])
        elif tag == "br":
            scan.parts.append(" ")
        elif tag in _SCRIPTED or tag in _DRAWN:
            behind = at if tag in _DRAWN and rest.endswith("/") else tags.after(tag, at)
            at = behind if behind >= 0 else at if tag in _DRAWN else size
            if scan.parts:
                scan.parts.append(" ")
        else:
            scan.open(tag, rest)
    scan.flush()
    return scan.blocks


#: Words of class, id and role that tell a block's part of the page.
_LEXICON = (
    "ad ads advert sponsor promo banner sidebar side widget related recommend nav menu breadcrumb crumb header masthead top footer foot bottom legal copyright cookie consent notice alert notification popup modal subscribe newsletter signup login form search share social comment reply discussion disqus respond content article post story entry main body text page title headline byline author meta date tag category pager pagination skip toolbar"
).split()


def features(blocks: Sequence[Block]) -> list[list[str]]:
    """Feature names of each block."""
    has = {t for b in blocks for t in b.path}
    out = []
    for i, b in enumerate(blocks):
        f = ["bias"]
        tags = [t for t in b.path if t not in ("html", "body")]
        outer = [t for t in tags if t not in _INLINE_ROLES]
        f += [f"in:{t}" for t in set(tags)]
        f.append(f"tag:{outer[-1] if outer else 'body'}")
        for word in _LEXICON:
            if any(n == word or (len(word) > 3 and word in n) for n in b.names):
                f.append(f"name:{word}")
        words = b.text.count(" ") + 1
        f.append(f"words:{min(8, int(math.log2(words)))}")
        share = b.links / len(b.text)
        f.append(f"links:{0 if share == 0 else 1 if share < 0.4 else 2 if share < 0.9 else 3}")
        f.append(f"end:{b.text[-1] in '.!?…:;»”)' }")
        f.append(f"commas:{min(3, b.text.count(','))}")
        if "©" in b.text or "(c)" in b.text.lower():
            f.append("copyright")
        if "·" in b.text or "|" in b.text or "»" in b.text:
            f.append("divider")
        place = "before" if not any(t in has for t in ("article", "main")) else "inside" if any(t in ("article", "main") for t in b.path) else "outside"
        f.append(f"main:{place}")
        f.append(f"main:{place}:{outer[-1] if outer else 'body'}")
        f.append(f"first:{i == 0}")
        f.append(f"last:{i == len(blocks) - 1}")
        out.append(f)
    return out


@dataclass(frozen=True)
class Model:
    weights: dict[str, tuple[float, float]]
    moves: tuple[tuple[float, float], tuple[float, float]]


def train(pages: Sequence[Sequence[Block]], steps: int = STEPS, rate: float = 0.15, decay: float = 1e-3) -> Model:
    """Maximum likelihood of the pages' labels, by full-batch Adam on forward-backward gradients."""
    names: dict[str, int] = {}
    index, starts, labels, lengths = [], [], [], []
    for page in pages:
        lengths.append(len(page))
        for block, own in zip(page, features(page), strict=True):
            starts.append(len(index))
            index += [names.setdefault(n, len(names)) for n in own]
            labels.append(block.label)
    idx, begin, gold, size = np.array(index), np.array(starts), np.array(labels), np.array(lengths)
    owner = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(idx))))
    page_of = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(gold)) - np.repeat(np.cumsum(size) - size, size)
    longest = int(size.max())
    grid = np.full((len(size), longest), -1)
    grid[page_of, place] = np.arange(len(gold))
    there = grid >= 0
    weights, moves = np.zeros((len(names), 2)), np.zeros((2, 2))
    observed_moves = np.zeros((2, 2))
    pairs = there[:, :-1] & there[:, 1:]
    np.add.at(observed_moves, (gold[grid[:, :-1][pairs]], gold[grid[:, 1:][pairs]]), 1)
    moment = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]
    for step in range(1, steps + 1):
        emission = np.zeros((len(gold), 2))
        np.add.at(emission, owner, weights[idx])
        e = np.where(there[..., None], emission[grid], 0.0)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, longest):
            new = np.logaddexp.reduce(alpha[:, t - 1, :, None] + moves[None], axis=1) + e[:, t]
            alpha[:, t] = np.where(there[:, t, None], new, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(moves[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(there[:, t + 1, None], new, 0.0)
        total = np.logaddexp.reduce(alpha[:, -1], axis=1)
        p = np.exp(alpha + beta - total[:, None, None])[there]
        p = p[np.argsort(grid[there], kind="stable")]
        expected_moves = np.zeros((2, 2))
        for t in range(longest - 1):
            both = np.exp(alpha[:, t, :, None] + moves[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :] - total[:, None, None])
            expected_moves += both[there[:, t + 1]].sum(axis=0)
        p[np.arange(len(gold)), gold] -= 1
        slope = np.zeros_like(weights)
        np.add.at(slope, idx, p[owner])
        slope = slope / len(size) + decay * weights
        moving = (expected_moves - observed_moves) / len(size) + decay * moves
        for value, grad, first, second in ((weights, slope, moment[0], moment[1]), (moves, moving, moment[2], moment[3])):
            first += 0.1 * (grad - first)
            second += 0.01 * (grad**2 - second)
            value -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model({n: (float(weights[i, 0]), float(weights[i, 1])) for n, i in names.items()}, tuple(tuple(map(float, r)) for r in moves))


def viterbi(model: Model, blocks: Sequence[Block]) -> list[int]:
    """The best label of each block."""
    get, (stay0, to1), (to0, stay1) = model.weights.get, *model.moves
    zero = (0.0, 0.0)
    back: list[tuple[int, int]] = []
    a = b = 0.0
    for i, own in enumerate(features(blocks)):
        e0 = e1 = 0.0
        for n in own:
            w = get(n, zero)
            e0 += w[0]
            e1 += w[1]
        if i:
            back.append((int(b + to0 > a + stay0), int(b + stay1 > a + to1)))
            a, b = max(a + stay0, b + to0) + e0, max(a + to1, b + stay1) + e1
        else:
            a, b = e0, e1
    if not blocks:
        return []
    labels = [int(b > a)]
    for step in reversed(back):
        labels.append(step[labels[-1]])
    return labels[::-1]


def main_text(model: Model, page: str | None) -> str:
    blocks = leaf_blocks(page or "")
    return "\n\n".join(b.text for b, label in zip(blocks, viterbi(model, blocks), strict=True) if label)


# ---- labelled pages ------------------------------------------------------------------

_SYLLABLES = "an be ci do el fa gu hi in jo ka le mu no or pa qui ra se tu un ve wo xi ya zu th er on at ing ed é ü ñ".split()


def _words(rng: random.Random, low: int, high: int) -> str:
    mark = rng.choice(("!", "!!!", "#", "*", "$", "%", "&amp;")) if rng.random() < 0.05 else ""
    out = []
    for _ in range(rng.randint(low, high)):
        word = "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4)))
        out.append(word + rng.choice(("", "", "", "", "", ",")) + mark)
    text = " ".join(out)
    return (text.upper() if rng.random() < 0.03 else text[0].upper() + text[1:]) + rng.choice((".", ".", ".", "", "!", "?"))


@dataclass(frozen=True)
class Layout:
    """Tags and names that a family of sites uses for the parts of a page."""

    name: str
    shells: tuple[str, ...]
    parts: dict[str, tuple[tuple[str, ...], tuple[str, ...]]]
    sloppy: float = 0.1  # share of end tags left out


def _layout(name: str, shells: str, sloppy: float, **parts: str) -> Layout:
    split = {kind: (tuple(tags.split()), tuple(names.split())) for kind, (tags, names) in ((k, v.split(":")) for k, v in parts.items())}
    return Layout(name, tuple(shells.split("|")), split, sloppy)


LAYOUTS = (
    _layout("journal", '<main><article>|<article class="post">|<article>', 0.05, menu="nav ul:site-nav menu", header="header:masthead site-header", footer="footer:site-footer colophon", side="aside:sidebar related-posts", ad="div aside:advert sponsor", notice="div:cookie-banner notice", form="form:newsletter search-form", comments="section:comments comment-list", share="div ul:share-links post-meta"),
    _layout("newspaper", '<div id="story-body">|<section class="article-content">|<article>', 0.1, menu="div nav:navbar breadcrumbs", header="div header:top-bar page-header", footer="div footer:legal footer", side="div aside:widget most-read recommended", ad="div section:ad ads promo banner", notice="div section:alert consent", form="form div:subscribe login", comments="div ol:comments discussion", share="p div:byline social tags"),
    _layout("handbook", '<main>|<div class="content">|<div id="main-content">', 0.05, menu="nav div:toc-menu nav breadcrumb", header="header:header topbar", footer="footer:footer page-foot", side="nav aside:side sidebar", ad="div:sponsored", notice="div aside:alert notification", form="form:search feedback", comments="section div:feedback-comments discussion", share="div:pagination page-tags"),
    _layout("bare", "<article>|<main>|<div>", 0.25, menu="nav ul:", header="header:", footer="footer:", side="aside:", ad="aside:ad", notice="aside:notice", form="form:", comments="section:comments", share="nav:"),
    _layout("legacy", '<td class="text">|<div class="maintext">|<div id="content">', 0.35, menu="div td:menu leftnav", header="div center:head header", footer="div center:bottom footer copyright", side="td div:right side", ad="div center:banner adbox ad", notice="div p:notice", form="form:search", comments="div ul:guestbook-comments replies", share="p div:links share"),
    _layout("magazine", '<div class="entry-content">|<section class="story"><div class="body">|<article id="article">', 0.1, menu="ul nav:main-menu mega-nav", header="div section:hero-header header", footer="section div:footer-bottom legal-links", side="section div:you-may-like related widget", ad="section div:ad-slot advertisement", notice="div dialog:popup modal-consent", form="div form:signup newsletter-form", comments="div section:responses comments", share="ul div:social-share author-meta"),
)
_KINDS = ("menu", "header", "footer", "side", "ad", "notice", "form", "comments", "share")


def _element(rng: random.Random, layout: Layout, kind: str, inner: str) -> str:
    tags, names = layout.parts[kind]
    tag, name = rng.choice(tags), rng.choice(names) if names and rng.random() < 0.85 else ""
    if not name:
        tag = tags[0]
    return f"<{tag}{f' {rng.choice(("class", "class", "class", "id"))}={chr(34)}{name}{chr(34)}' if name else ''}>{inner}</{tag}>"


def _end(rng: random.Random, layout: Layout, tag: str) -> str:
    return "" if rng.random() < layout.sloppy else f"</{tag}>"


def _links(rng: random.Random, low: int, high: int) -> str:
    items = [f'<a href="/{i}">{_words(rng, 1, 4).rstrip(".!?")}</a>' for i in range(rng.randint(low, high))]
    return rng.choice((lambda: "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>", lambda: rng.choice((" | ", " ", " / ")).join(items), lambda: "".join(f"<p>{i}</p>" for i in items)))()


def _noise(rng: random.Random, layout: Layout, kind: str) -> str:
    text = lambda a, b: f"<p>{_words(rng, a, b)}</p>" if rng.random() < 0.5 else _words(rng, a, b)
    if kind in ("menu", "share"):
        inner = _links(rng, 1 if kind == "share" else 2, 9 if kind == "menu" else 5)
    elif kind == "header":
        inner = text(1, 8) + (_links(rng, 1, 5) if rng.random() < 0.5 else "")
    elif kind == "footer":
        inner = rng.choice(("&copy; ", "© 2020 ", "&#169; ", "", "")) + text(2, 25) + (_links(rng, 1, 4) if rng.random() < 0.3 else "")
    elif kind == "side":
        inner = f"<h3>{_words(rng, 1, 4)}</h3>" * (rng.random() < 0.7) + (_links(rng, 2, 6) if rng.random() < 0.6 else text(4, 40))
    elif kind == "form":
        inner = f"<label>{_words(rng, 1, 5)}</label><input><button>{_words(rng, 1, 2)}</button>" + (text(3, 20) if rng.random() < 0.5 else "")
    elif kind == "comments":
        inner = f"<h2>{_words(rng, 1, 3)}</h2>" * (rng.random() < 0.6) + "".join(f'<{(t := rng.choice(("div", "li", "p")))}{rng.choice((" class={0}comment{0}".format(chr(34)), ""))}>{_words(rng, 3, 60)}</{t}>' for _ in range(rng.randint(1, 5)))
    else:
        inner = text(3, 35)
    return _element(rng, layout, kind, inner)


def _inline(rng: random.Random, layout: Layout, text: str) -> str:
    """``text`` with a link, emphasis (whose end tag may be missing) or line breaks in it."""
    words = text.split(" ")
    if len(words) > 3 and rng.random() < 0.3:
        at = rng.randrange(len(words) - 2)
        words[at] = f'<a href="/x">{words[at]}</a>'
    if len(words) > 3 and rng.random() < 0.3:
        tag, at = rng.choice(("em", "strong", "i", "b", "span")), rng.randrange(len(words) - 2)
        words[at] = f"<{tag}>{words[at]}"
        words[at + 1] += _end(rng, layout, tag)
    for _ in range(rng.choice((0, 0, 0, 1, 2))):
        words[rng.randrange(len(words))] += rng.choice(("<br>", "<br/>"))
    return " ".join(words)


def _paragraph(rng: random.Random, layout: Layout) -> str:
    text = _inline(rng, layout, _words(rng, 1, 8) if rng.random() < 0.2 else _words(rng, 5, 120))
    r = rng.random()
    if r < 0.06:
        return f"<h{(n := rng.randint(2, 4))}>{_words(rng, 1, 8)}</h{n}><p>{text}{_end(rng, layout, 'p')}"
    if r < 0.1:
        return "<ul>" + "".join(f"<li>{_words(rng, 3, 25)}{_end(rng, layout, 'li')}" for _ in range(rng.randint(2, 5))) + "</ul>"
    if r < 0.13:
        return f"<blockquote><p>{text}</p></blockquote>"
    if r < 0.15:
        return f"<table><tr><td>{_words(rng, 1, 6)}</td><td>{_words(rng, 1, 6)}</td></tr></table>"
    if r < 0.17:
        return f"<pre>{text}</pre>"
    return f"<p>{text}{_end(rng, layout, 'p')}"


def labelled_pages(count: int = TRAINING_PAGES, seed: int = SEED, layouts: Sequence[Layout] = LAYOUTS) -> Iterator[tuple[str, list[Block]]]:
    """(html, labelled blocks) of generated pages of the given layouts; main text is told by a hidden mark before each part."""
    rng = random.Random(seed)
    for _ in range(count):
        own = rng.choice(layouts)
        head = "".join(part for part in ("<meta charset=utf-8>", "<style>.a > .b { top: 0 }</style>", "<script>if (1 < 2) { run('x') }</script>") if rng.random() < 0.5)
        page: list[tuple[int, str]] = [(0, f"<html><head><title>{_words(rng, 2, 9)}</title>{head}</head><body>")]
        for kind in ("header", "menu", "notice", "ad", "form", "share", "side"):
            if rng.random() < 0.4:
                page.append((0, _noise(rng, own, kind)))
        shell = rng.choice(own.shells)
        page.append((1, shell + (f"<h1>{_words(rng, 2, 14)}</h1>" if rng.random() < 0.8 else "")))
        for i in range(rng.randint(1, 14)):
            page.append((1, _paragraph(rng, own)))
            if i and rng.random() < 0.08:
                page.append((0, "</p>" + _noise(rng, own, rng.choice(("ad", "side", "share", "form", "notice")))))
        if rng.random() < 0.12:
            page.append((0, "</p>" + _noise(rng, own, rng.choice(("comments", "share", "side", "footer")))))
        page.append((0, "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", shell)))))
        for kind in ("comments", "side", "ad", "form", "menu", "footer"):
            if rng.random() < (0.8 if kind == "footer" else 0.3):
                page.append((0, _noise(rng, own, kind)))
        whole = "".join(p for _, p in page) + "</body></html>"
        marked = "".join(re.sub(r">(?=[^<\s])", lambda m, label=label: f">\x02{label}", p) for label, p in page)
        blocks = leaf_blocks(marked)
        for b in blocks:
            b.label = int("\x021" in b.text)
            b.text = re.sub("\x02[01]", "", b.text)
            b.links = min(b.links, len(b.text))
        yield whole, [b for b in blocks if b.text]


@functools.cache
def default_model(count: int = TRAINING_PAGES, seed: int = SEED) -> Model:
    return train([blocks for _, blocks in labelled_pages(count, seed) if blocks])


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    own_model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [main_text(own_model, h) for h in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return spread(own).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
