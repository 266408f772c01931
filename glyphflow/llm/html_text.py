"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks. A bidirectional LSTM in numpy reads for each block a vector of its tag
path (tag names, class and id words, hashed) and of its words and shape (hashed), and labels it main text or not
with the whole page as context. It is trained here, on pages put together from a seeded generator of layouts.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tags that don't end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Tags whose content is never text, and tags without content.
SILENT = frozenset("script style noscript template svg math head title iframe object canvas audio video select option textarea button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the first kind is ended by a start tag of the second.
CLOSES = {"p": frozenset("p div ul ol dl table h1 h2 h3 h4 h5 h6 section article aside nav header footer main form blockquote pre hr figure address".split()), "li": frozenset(["li"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"])}
#: What a head may hold; any other start tag ends an unclosed head.
IN_HEAD = frozenset("title meta link script style base noscript template".split())
#: Slots of a path: tag names, then class, id and role words.
TAG_SIZE, NAME_SIZE = 40, 56
PATH_SIZE, WORD_SIZE, SHAPE = TAG_SIZE + NAME_SIZE, 32, 8
WIDTH = PATH_SIZE + WORD_SIZE + SHAPE
HIDDEN = 24
#: Blocks that the labeller holds at once; it reads longer pages in stretches and carries its states on, so memory stays bounded.
STRETCH = 2_000
TRAINING_PAGES = 800


@dataclass
class Block:
    path: np.ndarray
    depth: int
    heading: bool
    words: str
    linked: int = 0


#: A start or end tag: name, attributes. No part of it gives back what it has taken, so one that doesn't end is given up in one pass.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))?+)*+)>""")
_NAMED = re.compile(r"""(?<![^\s/"'])(?:class|id|role)\s*+=\s*+("[^"]*+"|'[^']*+'|(?!["'])[^\s>]++)""", re.I)
#: The end of an element whose content is not markup.
_RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in ("script", "style")}


class _Blocks:
    """Leaf blocks in page order, with the tag path of each; tolerant of unclosed and stray tags.

    A page is read in one pass. A tag or comment that isn't ended takes the rest of the page, as a browser has it; a quote that
    isn't closed is an ordinary character. Every open element
    holds the sum of the path down to it, so a block costs the same at any depth.
    """

    def __init__(self):
        self.open: list[tuple[str, str, np.ndarray]] = []
        self.tags: Counter[str] = Counter()
        self.silent = self.links = self.linked = 0
        self.parts: list[str] = []
        self.found: list[Block] = []

    def feed(self, html: str) -> None:
        at, text = 0, 0  # where to look on, and where the text before it begins
        while (at := html.find("<", at)) >= 0:
            following = html[at + 1 : at + 2]
            if following.isascii() and following.isalpha() or following == "/" and html[at + 2 : at + 3].isascii() and html[at + 2 : at + 3].isalpha():
                found = _TAG.match(html, at)
                end = found.end() if found else len(html)
            elif following in ("!", "?", "/") and following:
                found = None
                mark = "-->" if html.startswith("<!--", at) else ">"
                end = html.find(mark, at + (2 if mark == "-->" else 1))
                end = end + len(mark) if end >= 0 else len(html)
            else:  # a plain character
                at += 1
                continue
            if at > text:
                self.data(html[text:at])
            if found:
                tag = found[2].lower()
                if found[1]:
                    self.end(tag)
                else:
                    self.start(tag, found[3])
                    if found[3].endswith("/") and tag not in INLINE and tag not in VOID:
                        self.end(tag)
                    elif tag in _RAW:
                        close = _RAW[tag].search(html, end)
                        end = close.start() if close else len(html)
            at = text = end
        if text < len(html):
            self.data(html[text:])
        self.flush()

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.found.append(Block(self._path(), len(self.open), bool(self.open) and self.open[-1][0] == "h1", text, self.linked))
        self.parts, self.linked = [], 0

    def _path(self) -> np.ndarray:
        """Every step counts half, and the last three another half; two at most."""
        if not self.open:
            return np.zeros(PATH_SIZE)
        whole = self.open[-1][2]
        return np.minimum(whole - 0.5 * self.open[-4][2] if len(self.open) > 3 else whole, 2.0)

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in INLINE:
            self.links += tag == "a"
            return
        self.flush()
        if tag in VOID:
            return
        while self.open and (tag in CLOSES.get(self.open[-1][0], ()) or self.open[-1][0] == "head" and tag not in IN_HEAD):
            self._pop()
        named = unescape(" ".join(v.strip("\"'") for v in _NAMED.findall(attributes))) if attributes else ""
        step = f"{tag} {named}".strip().lower()
        before = self.open[-1][2] if self.open else 0.0
        self.open.append((tag, step, before + (_kept_step(step) if len(step) <= 200 else _step(step))))
        self.tags[tag] += 1
        self.silent += tag in SILENT

    def _pop(self) -> None:
        tag = self.open.pop()[0]
        self.tags[tag] -= 1
        self.silent -= tag in SILENT

    def end(self, tag: str) -> None:
        if tag in INLINE:
            self.links = max(0, self.links - (tag == "a"))
            return
        self.flush()
        if self.tags[tag]:
            while self.open[-1][0] != tag:
                self._pop()
            self._pop()

    def data(self, text: str) -> None:
        if not self.silent:
            self.parts.append(unescape(text) if "&" in text else text)
            self.linked += len(self.parts[-1]) * (self.links > 0)


def blocks(html: str | None) -> list[Block]:
    """Leaf blocks with decoded, blank-normalised text; none for null or empty pages."""
    parser = _Blocks()
    parser.feed(html or "")
    return parser.found


def _step(step: str) -> np.ndarray:
    """Hashed tag name and class and id words of one element."""
    v = np.zeros(PATH_SIZE)
    for k, token in enumerate(re.findall(r"[a-z0-9]+", step)):
        v[crc32(token.encode()) % TAG_SIZE if not k else TAG_SIZE + crc32(token.encode()) % NAME_SIZE] += 1.0
    return v


_kept_step = lru_cache(20_000)(_step)


def _hashed(word: str) -> int:
    return crc32(word.encode("utf-8", "surrogatepass")) % WORD_SIZE


_kept_hash = lru_cache(200_000)(_hashed)


def _slot(word: str) -> int:
    return _kept_hash(word) if len(word) <= 64 else _hashed(word)


def vectors(page: list[Block], part: slice = slice(None)) -> np.ndarray:
    """(blocks, WIDTH) of a part of the page: hashed tag path, hashed words (a share each), and the block's shape."""
    first, _, _ = part.indices(len(page))
    out = np.zeros((len(page[part]), WIDTH))
    for i, b in enumerate(page[part]):
        words = b.words.lower().split(" ")
        out[i, :PATH_SIZE] = b.path
        out[i, PATH_SIZE : PATH_SIZE + WORD_SIZE] = np.bincount([_slot(w) for w in words], minlength=WORD_SIZE) / len(words)
        n = len(b.words)
        out[i, PATH_SIZE + WORD_SIZE :] = (
            min(np.log1p(len(words)) / 6, 1), b.linked / n, b.words[-1] in ".!?", sum(map(b.words.count, ".,;")) / len(words),
            b.depth / 12, (first + i) / max(len(page) - 1, 1), "©" in b.words, b.heading,
        )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM over padded pages (pages, blocks, WIDTH) and a logistic output."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, seed: int = 3) -> Labeller:
        draw = np.random.default_rng(seed)
        w = {}
        for side in "fb":
            w[side + "x"] = draw.normal(0, 0.15, (WIDTH, 4 * HIDDEN))
            w[side + "h"] = draw.normal(0, 0.15, (HIDDEN, 4 * HIDDEN))
            w[side + "c"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        return cls(w | {"o": draw.normal(0, 0.15, (2 * HIDDEN,)), "p": np.zeros(1)})

    def _run(self, x: np.ndarray, keep: np.ndarray, side: str) -> tuple[np.ndarray, list]:
        n, t, _ = x.shape
        h, c, out, trace = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), np.zeros((n, t, HIDDEN)), []
        z = x @ self.w[side + "x"] + self.w[side + "c"]
        for k in range(t) if side == "f" else range(t - 1, -1, -1):
            a = z[:, k] + h @ self.w[side + "h"]
            i, f, o = (_sigmoid(a[:, j * HIDDEN : (j + 1) * HIDDEN]) for j in range(3))
            g, m = np.tanh(a[:, 3 * HIDDEN :]), keep[:, k, None]
            c2 = f * c + i * g
            tanh = np.tanh(c2)
            trace.append((k, h, c, i, f, o, g, tanh, m))
            h, c = m * (o * tanh) + (1 - m) * h, m * c2 + (1 - m) * c
            out[:, k] = h
        return out, trace

    def long_page(self, page: list[Block]) -> np.ndarray:
        """Probabilities of a page's blocks; states are carried from stretch to stretch, so its length makes no difference."""
        stretches = [slice(at, at + STRETCH) for at in range(0, len(page), STRETCH)]
        total = np.zeros(len(page))
        for at, side in enumerate("fb"):
            h = c = np.zeros(HIDDEN)
            wx, wh, wc = (self.w[side + k] for k in "xhc")
            for part in stretches if side == "f" else stretches[::-1]:
                z = vectors(page, part) @ wx + wc
                out = np.zeros((len(z), HIDDEN))
                for k in range(len(z)) if side == "f" else range(len(z) - 1, -1, -1):
                    a = z[k] + h @ wh
                    gates = _sigmoid(a[: 3 * HIDDEN])
                    c = gates[HIDDEN : 2 * HIDDEN] * c + gates[:HIDDEN] * np.tanh(a[3 * HIDDEN :])
                    out[k] = h = gates[2 * HIDDEN :] * np.tanh(c)
                total[part] += out @ self.w["o"][at * HIDDEN : (at + 1) * HIDDEN]
        return _sigmoid(total + self.w["p"])

    def probabilities(self, x: np.ndarray, keep: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, keep, s)[0] for s in "fb"], 2)
        return _sigmoid(both @ self.w["o"] + self.w["p"])

    def gradients(self, x: np.ndarray, keep: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {s: self._run(x, keep, s) for s in "fb"}
        both = np.concatenate([runs[s][0] for s in "fb"], 2)
        d = (_sigmoid(both @ self.w["o"] + self.w["p"]) - y) * keep / keep.sum()
        grad = {"o": np.einsum("ntk,nt->k", both, d), "p": np.array([d.sum()])}
        for at, s in enumerate("fb"):
            out_d = d[:, :, None] * self.w["o"][at * HIDDEN : (at + 1) * HIDDEN]
            dz = np.zeros((*x.shape[:2], 4 * HIDDEN))
            dh = dc = np.zeros((len(x), HIDDEN))
            gh = np.zeros_like(self.w[s + "h"])
            for k, h, c, i, f, o, g, tanh, m in reversed(runs[s][1]):
                dh = dh + out_d[:, k]
                inner = m * dh
                dc2 = m * dc + inner * o * (1 - tanh**2)
                a = np.concatenate([dc2 * g * i * (1 - i), dc2 * c * f * (1 - f), inner * tanh * o * (1 - o), dc2 * i * (1 - g**2)], 1)
                dz[:, k] = a
                gh += h.T @ a
                dh, dc = (1 - m) * dh + a @ self.w[s + "h"].T, (1 - m) * dc + dc2 * f
            grad[s + "h"], grad[s + "x"], grad[s + "c"] = gh, np.einsum("nti,ntj->ij", x, dz), dz.sum((0, 1))
        return grad


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x, keep = np.zeros((len(pages), max(map(len, pages)), WIDTH)), np.zeros((len(pages), max(map(len, pages))))
    for i, p in enumerate(pages):
        x[i, : len(p)], keep[i, : len(p)] = p, 1
    return x, keep


def training_page(draw: random.Random) -> tuple[str, list[bool]]:
    """A page of a random layout in made-up words, and for each of its blocks whether it is main text.

    Half of the pages name their parts by words like "sidebar". The others have made-up names or none, or some of each: what tells their
    parts are tags, links, marks, lengths and places alone, so parts that only a name tells from the article are left out there.
    """
    names = draw.choice(["words", "words", "words", "words", "some", "made up", "made up", "none"])
    plain = names in ("made up", "none")
    syllables = "ka lo mi ren tu sha vel dor an is qua ber zen ol ti pra".split()
    word = lambda: "".join(draw.choice(syllables) for _ in range(draw.randint(1, 4)))

    def sentence(low: int = 4, high: int = 22) -> str:
        return (" ".join(word() for _ in range(draw.randint(low, high))) + draw.choice([".", ".", ".", "!", "?"])).capitalize()

    def prose() -> str:
        return " ".join(sentence() for _ in range(draw.choice([1, 1, 2, 3, 5, 9, 20])))

    main: list[bool] = []

    def block(tag: str, text: str, is_main: bool, attrs: str = "") -> str:
        main.append(is_main)
        inner = draw.choice(["{}", "{}", "{}", "<b>{}</b>", "<span>{}</span>", "<b>{}"]).format(text)
        return f"<{tag}{attrs}>{inner}" + ("" if tag in ("p", "li") and draw.random() < 0.1 else f"</{tag}>")

    def named(*names: str) -> str:
        return draw.choice([f' class="{n}"' for n in names] + [f' id="{n}"' for n in names])

    def menu(tag: str, attrs: str = "") -> str:
        return f"<{tag}{attrs}><ul>" + "".join(block("li", f'<a href="/{word()}">{word()}</a>', False) for _ in range(draw.randint(2, 9))) + f"</ul></{tag}>"

    def small(tag: str, attrs: str) -> str:
        parts = [block(draw.choice(["p", "p", "div", "h3"]), draw.choice([sentence(2, 9), sentence(2, 9), prose()]), False) for _ in range(draw.randint(1, 3))]
        return f"<{tag}{attrs}>" + (draw.choice(["".join(parts)])) + f"</{tag}>"

    def bare(tag: str, attrs: str, text: str) -> str:
        main.append(False)
        return f"<{tag}{attrs}>{text}</{tag}>"

    def advert() -> str:
        if plain:
            return small("aside", "") if draw.random() < 0.5 else ""
        how = draw.random()
        name = named("ad", "ads", "advert", "sponsored", "promo", "banner")
        return bare("div", name, sentence(2, 14)) if how < 0.6 else small(draw.choice(["div", "aside", "section"]), name)

    def link_line(tag: str = "p") -> str:
        """A block of nothing but links."""
        main.append(False)
        return f"<{tag}>" + draw.choice([" ", " | ", ", "]).join(f'<a href="#{word()}">{word()}</a>' for _ in range(draw.randint(1, 6))) + f"</{tag}>"

    def article() -> str:
        out = []
        top = draw.choice(["h1", "h1", "h1", "h2"])
        title = lambda: block(top, draw.choice(["{}", "{}", "<a href='#'>{}</a>"]).format(sentence(3, 12).rstrip(".!?")) if top == "h2" else sentence(3, 12).rstrip(".!?"), True, draw.choice(["", "", ' class="entry-title"', ' class="title"']))
        byline = lambda: block(draw.choice(["p", "div"]), draw.choice(["By {}", "{}, <time>3 May</time>", "<span>{}</span> <span>4 min</span>"]).format(word()), True, draw.choice(["", named("byline", "meta", "author")]))
        head = draw.random()
        if head < 0.55:
            out.append(title())
        elif head < 0.8:
            out.append("<header>" + title() + (byline() if draw.random() < 0.6 else "") + "</header>")
        elif head < 0.9:
            out.append(title() + byline())
        if draw.random() < 0.1:
            out.append(f"<div{draw.choice(['', named('toc', 'contents')])}><ul>" + "".join(block("li", f'<a href="#{word()}">{word()}</a>', False) for _ in range(draw.randint(2, 6))) + "</ul></div>")
        text, before = [], len(main)
        for _ in range(draw.choice([1, 1, 2, 3, 5, 8, 14])):
            kind = draw.random()
            if kind < 0.72:
                text.append(block("p", draw.choice([prose(), prose(), sentence(1, 5)]), True))
            elif kind < 0.8:
                text.append(block(draw.choice(["h2", "h3"]), sentence(2, 7).rstrip(".!?"), True))
            elif kind < 0.86:
                text.append("<ul>" + "".join(block("li", sentence(2, 12), True) for _ in range(draw.randint(1, 4))) + "</ul>")
            elif kind < 0.9:
                text.append("<blockquote>" + block("p", prose(), True) + "</blockquote>")
            elif kind < 0.93:
                text.append("<table><tr>" + "".join(block("td", word(), True) for _ in range(draw.randint(2, 4))) + "</tr></table>")
            elif kind < 0.97:
                text.append(advert())
            elif not plain:
                text.append(small("div", named("related", "share", "newsletter", "signup", "social")))
        if draw.random() < 0.1:  # lines of a part without paragraphs
            del main[before:]
            text = [block("div", draw.choice([prose(), prose(), sentence(1, 5)]), True) for _ in range(draw.randint(2, 6))]
        inner = "".join(text)
        for _ in range(draw.choice([0, 0, 1, 1, 2])):
            inner = f"<{(tag := draw.choice(['div', 'div', 'section']))}{draw.choice(['', named('entry-content', 'post-body', 'text', 'article-body', 'parser-output', word()), named(word(), word())])}>{inner}</{tag}>"
        out.append(inner)
        if draw.random() < 0.15:
            out.append("<footer>" + (link_line() if draw.random() < 0.7 else block("p", sentence(1, 5), False)) + "</footer>")
        tag, attrs = draw.choice([("article", ""), ("article", ""), ("article", ' class="post"'), ("main", ""), ("div", named("content", "article", "post", "entry", "story", "main", "body")), ("div", named("content", "hentry", "mw-body", word()))])
        whole = f"<{tag}{attrs}>{''.join(out)}</{tag}>"
        for _ in range(draw.choice([0, 0, 0, 1, 1, 2])):
            whole = f"<{(tag := draw.choice(['div', 'div', 'main', 'section']))}{draw.choice(['', named('wrapper', 'page', 'container', 'site', word())])}>{whole}</{tag}>"
        return whole

    def comments() -> str:
        tag, attrs = draw.choice([("section", named("comments", "comment", "discussion", "responses")), ("div", named("comments", "comment", "replies", "disqus")), ("ol", named("commentlist", "comments"))])
        inner = block("h3", draw.choice(["Comments", "Kommentare", "Commentaires", "Comentarios", sentence(1, 3)]), False) if draw.random() < 0.6 else ""
        for _ in range(draw.randint(1, 5)):
            inner += f'<div{named("comment", "reply", "author")}>' + block("p", draw.choice([prose(), sentence()]), False) + "</div>"
        return f"<{tag}{attrs}>{inner}</{tag}>"

    out = []
    if draw.random() < 0.35:
        out.append(small("header", draw.choice(["", named("header", "top", "masthead")])))
    if draw.random() < 0.85:
        how = draw.random()
        out.append(menu("nav") if how < 0.65 else menu("div", named("menu", "nav", "navbar", "breadcrumb", "topnav")) if how < 0.9 else link_line(draw.choice(["div", "p"])))
    if draw.random() < 0.3 and not plain:
        out.append(bare("div", named("cookie", "notice", "consent", "gdpr", "alert", "banner"), sentence(4, 20)) if draw.random() < 0.5 else small("div", named("cookie", "notice", "consent", "popup", "modal")))
    if draw.random() < 0.6:
        out.append(advert())
    side = lambda: small("aside", draw.choice(["", named("sidebar", "side")])) if draw.random() < 0.6 else (small if draw.random() < 0.5 and not plain else menu)("div", named("sidebar", "related", "widget"))
    if draw.random() < 0.25:
        out.append(side())
    if draw.random() > 0.03:
        out.append(article())
    if draw.random() < 0.35 and not plain:
        out.append(comments())
    if draw.random() < 0.25:
        out.append(side())
    if draw.random() < 0.25:
        out.append(f"<form{draw.choice(['', named('search', 'login', 'subscribe', 'contact')])}>" + block(draw.choice(["p", "label", "div"]) if draw.random() < 0.01 else "p", sentence(1, 8), False) + "</form>")
    if draw.random() < 0.85:
        foot = draw.choice(["footer", "footer", "div"])
        attrs = named("footer", "copyright", "foot") if foot == "div" else ""
        mark = draw.choice(["&copy; {}.example &middot; {}", "&copy; {}.example &middot; {}", "© 2019 {}. {}", "Copyright &copy; {}. {}"]).format(word(), sentence(2, 20))
        out.append(bare(foot, attrs, mark) if draw.random() < 0.6 or plain and foot == "div" else small(foot, attrs))
    page = "".join(out)
    if names != "words":
        made_up = lambda found: "" if names == "none" else f' {found[1]}="{word()}-{word()}"' if plain or draw.random() < 0.3 else found[0]
        page = re.sub(r' (class|id)="[^"]*"', made_up, page)
    end = draw.choice(["</body></html>", "</body></html>", ""])
    return "<!DOCTYPE html><html><head><title>" + sentence() + "</title></head><body>" + page + end, main


@lru_cache(1)
def trained(pages: int = TRAINING_PAGES, epochs: int = 14, seed: int = 20) -> Labeller:
    """The labeller, trained by Adam on pages of the generator; always the same for the same arguments."""
    draw = random.Random(seed)
    made = []
    while len(made) < pages:
        html, main = training_page(draw)
        found = blocks(html)
        if len(found) == len(main) and found:
            made.append((vectors(found), np.array(main, float)))
    model, t = Labeller.fresh(), 0
    m, v = ({k: np.zeros_like(a) for k, a in model.w.items()} for _ in "mv")
    for _ in range(epochs):
        draw.shuffle(made)
        for at in range(0, len(made), 25):
            group = made[at : at + 25]
            x, keep = _padded([p for p, _ in group])
            y = np.zeros(keep.shape)
            for i, (_, z) in enumerate(group):
                y[i, : len(z)] = z
            t += 1
            for k, g in model.gradients(x, keep, y).items():
                g = np.clip(g, -1, 1)
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                model.w[k] = model.w[k] - 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return model


def label_pages(model: Labeller, pages: list[list[Block]]) -> list[np.ndarray]:
    """Whether each block of each page is main text; pages of like length run together, those over STRETCH blocks alone."""
    out = [np.zeros(len(p), bool) for p in pages]
    group: list[int] = []

    def run() -> None:
        for k, p in zip(group, model.probabilities(*_padded([vectors(pages[k]) for k in group])), strict=True):
            out[k][:] = p[: len(pages[k])] > 0.5

    for n, k in sorted((len(p), k) for k, p in enumerate(pages) if p):
        if n > STRETCH:
            out[k][:] = model.long_page(pages[k]) > 0.5
            continue
        if group and (len(group) + 1) * n > 6_000:
            run()
            group = []
        group.append(k)
    if group:
        run()
    return out


def main_texts(pages: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page: its main blocks in order, joined by one blank.

    A null or empty html gives an empty text, as does a page without main text. Nothing is cut off; repeated rows are
    read each; other columns are ignored. The trained weights travel with the tasks.
    """
    weights = weights or trained().w

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Labeller(weights)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                found = [blocks(h.as_py()) for h in part.column("html")]
                kept = label_pages(model, found)
                texts = [" ".join(x.words for x, k in zip(p, keep, strict=True) if k) for p, keep in zip(found, kept, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    given = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return given.mapInArrow(scan, "page_id long, url string, text string, n_chars long")
