"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks, runs of text between block-level tags, each with the path of open elements. A bidirectional LSTM in numpy
reads the page's blocks in order, each as hashed vectors of its tag path and its words and a few figures about its form, and labels every block
as main text or not with the whole page in view.

The labeller is trained here, once in a process and on the driver, on pages made up by page(): layouts with menus, headers, footers, sidebars,
notices, adverts, forms and comments in many spellings, around articles of invented words, where the right label is known. Its seed is
fixed, so every session has the same weights, about 30,000 numbers that go to the executors with the task.

Markup is read as browsers read it where that decides what is text: raw elements end at their own end tag only, a head ends at the first thing
that can't be in one, quotes matter after an equals sign, elements are open until their own end tag or their parent's. Reading takes time
in proportion to a page's length, whatever it holds: tags look up open elements by name, and blocks share their paths.

Defined results: a null or empty page has an empty text; a page's text is that of its blocks labelled as main, joined by an empty line;
very long pages are read whole, in a step by themselves; repeated rows repeat their result; an empty table gives no rows; a column named
text is refused. Character references are decoded, white space inside a block is one space.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import refuse

PATHS, WORDS, FIGURES, HIDDEN = 96, 32, 10, 20
INPUTS = PATHS + WORDS + FIGURES
EXAMPLES, EPOCHS, BATCH, RATE, SEED = 600, 6, 24, 0.02, 7
DROPPED = 0.5  # share of blocks whose words are hidden in training, so that the layout has to do
#: Most blocks that are labelled at once, over all pages of a step; a longer page is a step by itself.
STEP = 8192

#: Fixed lists of HTML: elements whose content isn't text, those of them whose content holds no tags, elements that may stand in a head, elements
#: that break text into blocks, elements without content, elements that an opening tag of the same kind ends, and elements within which it does.
_RAW = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "textarea", "select", "title"}
_PLAIN = {"script", "style", "textarea", "title", "iframe"}
_HEAD = {"base", "basefont", "bgsound", "link", "meta", "title", "noscript", "noframes", "style", "script", "template", "html", "head"}
_BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul option button label".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_SELF_ENDING = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
_SCOPES = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "body", "select"}

_TAG = re.compile(r"<(?:(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)|[!?]|/)")
_ATTRIBUTES, _TO_END = re.compile(r"""(?:[^>=]+|=\s*+(?:"[^"]*"|'[^']*')?+)*+>"""), re.compile("[^>]*>")
_NAMES = re.compile(r"""(?<![^\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_DIGIT = re.compile(r"\d")


def _hash(s: str, n: int) -> int:
    return zlib.crc32(s.encode("utf-8", "replace")) % n


class Element:
    """An open element: its parent, and the hashed features of its name, class, id and role, of its own and with all above it, as bits."""

    __slots__ = ("above", "name", "own", "parent")

    def __init__(self, name: str, marks: str, parent: Element | None) -> None:
        self.name, self.parent, self.own = name, parent, _bits(name, marks)
        self.above = self.own | (parent.above if parent else 0)


_known: dict[tuple[str, str], int] = {}


def _bits(name: str, marks: str) -> int:
    found = _known.get((name, marks))
    if found is None:
        found = 1 << _hash(name, PATHS)
        for w in set(_PART.findall(marks)):
            found |= 1 << _hash("." + w, PATHS)
        if len(_known) < 100_000:
            _known[name, marks] = found
    return found


Block = tuple[str, Element | None, int]


class _Reader:
    """The state of reading one page."""

    def __init__(self) -> None:
        self.out: list[Block] = []
        self.held: list[str] = []
        self.linked = 0
        self.path: list[Element] = []
        self.open: dict[str, list[int]] = {}  # places in the path by name
        self.scopes: list[int] = []

    def cut(self) -> None:
        if self.held:
            text = _SPACE.sub(" ", html.unescape("".join(self.held))).strip()
            if text:
                self.out.append((text, self.path[-1] if self.path else None, min(self.linked, len(text))))
            self.held, self.linked = [], 0

    def text(self, piece: str) -> None:
        if piece:
            self.held.append(piece)
            if self.open.get("a"):
                self.linked += len(piece)

    def enter(self, name: str, marks: str) -> None:
        at = len(self.path)
        self.path.append(Element(name, marks, self.path[-1] if at else None))
        self.open.setdefault(name, []).append(at)
        if name in _SCOPES:
            self.scopes.append(at)

    def leave(self, name: str) -> None:
        """Close the last open element of this name and all in it; each element is closed once, so this costs no more than opening them."""
        if places := self.open.get(name):
            at = places[-1]
            while len(self.path) > at:
                self.open[self.path.pop().name].pop()
            while self.scopes and self.scopes[-1] >= at:
                self.scopes.pop()

    def renew(self, name: str) -> None:
        """What an opening tag of a self-ending element closes: one of its kind within the last scope."""
        places = self.open.get(name)
        if places and places[-1] > (self.scopes[-1] if self.scopes else -1):
            self.leave(name)


def _end(page: str, at: int, name: str) -> tuple[int, int] | None:
    """Where the next end tag of a raw element begins and ends."""
    m = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
    if not m:
        return None
    end = page.find(">", m.end())
    return m.start(), len(page) if end < 0 else end + 1


def _past(page: str, at: int, name: str) -> int | None:
    """Where a raw element that may hold its own kind ends; without an end tag, nowhere."""
    depth = 1
    for m in re.compile(rf"<(/?){name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).finditer(page, at):
        depth += -1 if m[1] else 0 if m[0].endswith("/>") else 1
        if not depth:
            return m.end()
    return None


def blocks(page: str) -> list[Block]:
    """A page's leaf blocks: text, the innermost open element, and characters of the text inside links."""
    r = _Reader()
    at, last, head, rest = 0, page.rfind(">"), False, _ATTRIBUTES
    endless: set[str] = set()  # raw elements without an end tag in the rest of the page
    while m := _TAG.search(page, at):
        between = page[at : m.start()]
        if head and between.strip():
            head = False
        if not head:
            r.text(between)
        at, name = m.end(), (m["name"] or "").lower()
        if not name:
            comment = page.startswith("<!--", m.start())
            if comment and not page.startswith(("<!-->", "<!--->"), m.start()):
                end = page.find("-->", m.start() + 4)
                at = len(page) if end < 0 else end + 3
            elif at <= last:
                at = page.find(">", at) + 1
            else:
                r.text(page[m.start() : at])
            continue
        tag = rest.match(page, at) if at <= last else None
        if not tag and at <= last:  # a quote that is never closed has hidden all that follows: quotes don't count from here on
            rest = _TO_END
            tag = rest.match(page, at)
        if not tag:
            r.text(page[m.start() : at])
            continue
        attrs, at = tag[0][:-1], tag.end()
        if head and (name not in _HEAD or m["close"]) and not (m["close"] and name in _HEAD - {"head", "html"}):
            head = False
        if m["close"]:
            if name in _BLOCKS:
                r.cut()
            r.leave(name)
            continue
        if name in _RAW:
            if attrs.endswith("/") and name in ("svg", "math"):
                r.cut()
                continue
            found = None
            if name not in endless:
                found = (e[1] if (e := _end(page, at, name)) else None) if name in _PLAIN else _past(page, at, name)
            if found:
                r.cut()
                at = found
                continue
            endless.add(name)
            if name in ("script", "style"):  # nothing but their end tag ends them
                r.cut()
                return r.out
        if name == "head":
            r.cut()
            head = True
            continue
        if name == "br":
            r.text(" ")
        if name in _BLOCKS:
            r.cut()
            if name in _SELF_ENDING:
                r.renew(name)
        if name not in _VOID and not head:
            r.enter(name, " ".join("".join(g) for g in _NAMES.findall(attrs)).lower() if attrs else "")
    r.text(page[at:])
    r.cut()
    return r.out


def vectors(page: list[Block]) -> np.ndarray:
    """One row of INPUTS for each block of a page. The three innermost elements count fully, those above them less."""
    x = np.zeros((len(page), INPUTS), np.float32)
    near, far = bytearray(), bytearray()
    width = PATHS // 8
    for i, (text, element, linked) in enumerate(page):
        own, e = 0, element
        for _ in range(3):
            if e:
                own, e = own | e.own, e.parent
        near += own.to_bytes(width, "little")
        far += (e.above if e else 0).to_bytes(width, "little")
        row = x[i]
        words = text.lower().split()
        for w in words:
            row[PATHS + _hash(w.strip(".,;:!?()"), WORDS)] += 1.0
        if words:
            row[PATHS : PATHS + WORDS] *= 0.5 / np.sqrt(len(words))
        n = len(text)
        row[PATHS + WORDS :] = (
            np.log1p(n) / 8, linked / n, min(1.0, (text.count(".") + text.count(",")) * 20 / n), float(text[-1] in ".!?…»\""), float(text[:1].isupper()),
            min(1.0, 4 * len(_DIGIT.findall(text)) / n), float(n < 30), float(n > 200), float("©" in text), 1.0,
        )
    spread = lambda bits: np.unpackbits(np.frombuffer(bytes(bits), np.uint8).reshape(-1, width), axis=1, bitorder="little")
    x[:, :PATHS] = np.maximum(spread(near), np.float32(0.6) * spread(far)) if page else 0
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic output for each block."""

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.normal(0, 1 / np.sqrt(shape[0]), shape)).astype(np.float32)
        self.w = {}
        for d in "fb":
            self.w |= {f"{d}x": draw(INPUTS, 4 * HIDDEN), f"{d}h": draw(HIDDEN, 4 * HIDDEN), f"{d}c": np.zeros(4 * HIDDEN, np.float32)}
            self.w[f"{d}c"][HIDDEN : 2 * HIDDEN] = 1.0  # gates: input, forget, output, candidate
        self.w |= {"o": draw(2 * HIDDEN, 1), "oc": np.zeros(1, np.float32)}

    def _run(self, d: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states of one direction over x, steps x pages x INPUTS."""
        steps, pages, _ = x.shape
        z = x.reshape(-1, INPUTS) @ self.w[f"{d}x"] + self.w[f"{d}c"]
        z = z.reshape(steps, pages, -1)
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        out = np.empty((steps, pages, HIDDEN), np.float32)
        for t in range(steps):
            a = z[t] + h @ self.w[f"{d}h"]
            g = _sigmoid(a[:, : 3 * HIDDEN])
            i, f, o, u = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :], np.tanh(a[:, 3 * HIDDEN :])
            if keep is not None:
                keep.append((h, c, i, f, o, u))
            c = f * c + i * u
            h = o * np.tanh(c)
            out[t] = h
        return out

    @staticmethod
    def _turn(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each page's steps in reverse, its filling left at the end."""
        out = x.copy()
        for k, n in enumerate(lengths):
            out[:n, k] = x[:n, k][::-1]
        return out

    def scores(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """The probability of main text for each block of each page."""
        lengths = np.array([len(p) for p in pages])
        x = np.zeros((int(lengths.max(initial=0)), len(pages), INPUTS), np.float32)
        for k, p in enumerate(pages):
            x[: len(p), k] = p
        forward = self._run("f", x)
        backward = self._turn(self._run("b", self._turn(x, lengths)), lengths)
        p = _sigmoid(np.concatenate([forward, backward], 2) @ self.w["o"] + self.w["oc"])[:, :, 0]
        return [p[:n, k] for k, n in enumerate(lengths)]

    def _back(self, d: str, x: np.ndarray, kept: list, slope: np.ndarray, grad: dict) -> None:
        """Back-propagation through one direction's steps."""
        steps, pages, _ = x.shape
        dz = np.empty((steps, pages, 4 * HIDDEN), np.float32)
        dh, dc = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            h, c, i, f, o, u = kept[t]
            tc = np.tanh(f * c + i * u)
            dh = dh + slope[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz[t] = np.concatenate([dc * u * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], 1)
            grad[f"{d}h"] += h.T @ dz[t]
            dh, dc = dz[t] @ self.w[f"{d}h"].T, dc * f
        flat = dz.reshape(-1, 4 * HIDDEN)
        grad[f"{d}x"] += x.reshape(-1, INPUTS).T @ flat
        grad[f"{d}c"] += flat.sum(0)

    def fit(self, examples: list[tuple[np.ndarray, np.ndarray]]) -> Labeller:
        """Adam on the blocks' cross-entropy at a falling rate, pages of like length together."""
        moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.w.items()}
        order = sorted(range(len(examples)), key=lambda k: len(examples[k][0]))
        groups = [order[k : k + BATCH] for k in range(0, len(order), BATCH)]
        step, rng, last = 0, random.Random(SEED), EPOCHS * len(groups)
        for _ in range(EPOCHS):
            rng.shuffle(groups)
            for group in groups:
                step += 1
                lengths = np.array([len(examples[k][0]) for k in group])
                x = np.zeros((lengths.max(), len(group), INPUTS), np.float32)
                y, seen = np.zeros(x.shape[:2], np.float32), np.zeros(x.shape[:2], np.float32)
                for j, k in enumerate(group):
                    x[: lengths[j], j], y[: lengths[j], j], seen[: lengths[j], j] = examples[k][0], examples[k][1], 1
                hidden = np.array([rng.random() < DROPPED for _ in range(x.shape[0] * x.shape[1])]).reshape(x.shape[:2])
                x[hidden, PATHS : PATHS + WORDS] = 0
                kept_f, kept_b, turned = [], [], self._turn(x, lengths)
                both = np.concatenate([self._run("f", x, kept_f), self._turn(self._run("b", turned, kept_b), lengths)], 2)
                p = _sigmoid(both @ self.w["o"] + self.w["oc"])[:, :, 0]
                e = ((p - y) * seen / seen.sum())[:, :, None]
                grad = {k: np.zeros_like(v) for k, v in self.w.items()}
                grad["o"] = both.reshape(-1, 2 * HIDDEN).T @ e.reshape(-1, 1)
                grad["oc"] = e.sum((0, 1))
                slope = e * self.w["o"][:, 0]
                self._back("f", x, kept_f, slope[:, :, :HIDDEN], grad)
                self._back("b", turned, kept_b, self._turn(slope[:, :, HIDDEN:], lengths), grad)
                for k, g in grad.items():
                    g = np.clip(g, -1, 1)
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.w[k] -= RATE * (1 - step / (last + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self


def page(rng: random.Random) -> tuple[str, set[str]]:
    """A made-up page and its main blocks. Every block's text is unlike the others' by a running number of letters."""
    number = 0
    main: set[str] = set()
    letters = "abcdefghijklmnoprstuvéèöüñ"

    def word() -> str:
        return "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))

    def phrase(low: int, high: int) -> str:
        nonlocal number
        number += 1
        mark = "".join(chr(97 + int(c)) for c in str(number))
        glue = rng.choice(["", "", "", "", "###", "***", " |", "!!"])
        words = [word() for _ in range(rng.randint(low, high))]
        if rng.random() < 0.1:
            words = [w for w in words[: len(words) // 8 + 1] for _ in range(8)]
        t = " ".join(w + (glue if rng.random() < 0.8 else "") for w in ["Q" + mark, *words]) + rng.choice([".", ".", "", "!"])
        return t.upper() if rng.random() < 0.08 else t

    def good(low: int, high: int) -> str:
        t = phrase(low, high)
        main.add(t)
        return t

    def marks(*names: str) -> str:
        kind = rng.choice(["class", "class", "id"])
        return f' {kind}="{rng.choice(names)}{rng.choice(["", "", " x", "-inner", "_1"])}"' if names else ""

    link = lambda t: f'<a href="/{word()}">{t}</a>'
    listed = lambda n: "<ul>" + "".join(f"<li>{link(phrase(0, 2))}</li>" for _ in range(n)) + "</ul>"
    menus = lambda: rng.choice([lambda: f"<nav>{listed(rng.randint(2, 9))}</nav>", lambda: f"<div{marks('menu', 'nav', 'navbar', 'navigation', 'topnav', 'breadcrumb', 'toolbar')}>{listed(rng.randint(2, 9))}</div>", lambda: f"<nav{marks('menu', 'main-nav')}>{' '.join(link(phrase(0, 2)) for _ in range(rng.randint(2, 9)))}</nav>"])()
    advert = lambda: f"<{(e := rng.choice(['div', 'div', 'aside', 'section']))}{marks('ad', 'ads', 'advert', 'advertisement', 'sponsor', 'sponsored', 'promo', 'banner', 'teaser')}>{rng.choice([phrase, phrase, lambda a, b: '<p>' + phrase(a, b) + '</p>'])(2, 40)}</{e}>"
    notice = lambda: f"<div{marks('cookie', 'cookie-notice', 'consent', 'notice', 'gdpr', 'alert', 'popup', 'newsletter', 'subscribe', 'privacy', 'overlay', 'modal')}><p>{phrase(4, 30)}</p><button>{phrase(0, 1)}</button></div>"
    aside = lambda: f"<aside{rng.choice(['', marks('sidebar', 'side', 'widget')])}><h3>{phrase(0, 3)}</h3>{rng.choice([listed(4), '<p>' + phrase(5, 40) + '</p>'])}</aside>" if rng.random() < 0.6 else f"<div{marks('sidebar', 'side', 'widget', 'related', 'recommended', 'popular', 'share', 'social', 'tags', 'meta')}><h4>{phrase(0, 3)}</h4>{rng.choice([listed(4), '<p>' + phrase(5, 40) + '</p>'])}</div>"
    header = lambda: f"<header{rng.choice(['', marks('site-header', 'masthead')])}>{rng.choice(['<h1>', '<p>', '<div>'])}{phrase(0, 6)}{menus() if rng.random() < 0.5 else ''}</header>" if rng.random() < 0.7 else f"<div{marks('header', 'masthead', 'logo', 'site-title', 'top')}>{phrase(0, 8)}</div>"
    form = lambda: f"<form><label>{phrase(0, 3)}</label><input type=text><button>{phrase(0, 2)}</button></form>" if rng.random() < 0.6 else f"<div{marks('login', 'search', 'contact-form', 'signup')}><form><p>{phrase(1, 12)}</p><input></form></div>"
    comment = lambda: "<div" + marks("comments", "comment-list", "responses", "discussion", "replies") + ">" + f"<h3>{phrase(0, 3)}</h3>" * rng.randint(0, 1) + "".join(f"<{e}{marks('comment', 'reply', 'response')}>{rng.choice(['<p>' + phrase(3, 60) + '</p>', phrase(3, 60)])}</{e}>" for e in [rng.choice(["div", "li", "article", "section"])] * rng.randint(1, 6)) + "</div>"
    footer = lambda: f"<footer{rng.choice(['', marks('site-footer', 'bottom')])}>{rng.choice(['&copy; ', '', '© '])}{phrase(2, 25)}{listed(3) if rng.random() < 0.3 else ''}</footer>" if rng.random() < 0.75 else f"<div{marks('footer', 'copyright', 'bottom', 'legal', 'imprint', 'colophon')}>&copy; {phrase(2, 25)}</div>"

    def article() -> str:
        inner = f"<h1>{good(1, 9)}</h1>" if rng.random() < 0.8 else ""
        inner += f"<p{marks('byline', 'meta', 'share', 'social')}>{phrase(1, 4)}</p>" if rng.random() < 0.15 else ""
        for _ in range(rng.choice([1, 1, 2, 3, 6, 12, 20])):
            kind = rng.random()
            long = rng.choice([0, 1, 3, 10, 40, 40, 90, 300])
            if kind < 0.62:
                inner += f"<p>{good(long, long + 20)}</p>"
            elif kind < 0.7:
                inner += f"<p><b>{good(long, long + 20)}<br>"
            elif kind < 0.77:
                inner += f"<h{rng.choice('2345')}>{good(1, 6)}</h2>"
            elif kind < 0.83:
                inner += "<ul>" + "".join(f"<li>{good(1, 20)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>"
            elif kind < 0.87:
                inner += f"<blockquote>{good(3, 30)}</blockquote>"
            elif kind < 0.9:
                inner += "<table>" + "".join("<tr>" + "".join(f"<td>{good(0, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(1, 4))) + "</table>"
            elif kind < 0.93:
                inner += f"<div>{good(3, 30)}</div>"
            elif kind < 0.95:
                inner += f"<pre>{good(3, 30)}</pre>"
            else:
                inner += rng.choice([advert, advert, aside, form, notice])()
        tag = rng.choice(["<article>", "<article>", "<article>", "<main>", f"<article{marks('post', 'story', 'entry')}>", f"<div{marks('content', 'article', 'article-body', 'post-content', 'entry-content', 'story', 'main', 'text', 'body-text')}>"])
        return f"{tag}{inner}</{tag[1:].split()[0].rstrip('>')}>"

    some = lambda make, chance: make() if rng.random() < chance else ""
    body = some(notice, 0.25) + some(header, 0.5) + some(menus, 0.8) + some(advert, 0.5) + some(form, 0.2) + some(aside, 0.2)
    body += rng.choice(["", "", "<div>", f"<div{marks('wrapper', 'page', 'container')}>"]) + article()
    body += some(aside, 0.4) + some(advert, 0.25) + some(comment, 0.35) + some(form, 0.15) + some(footer, 0.85) + some(notice, 0.1)
    return f"<!DOCTYPE html><html><head><title>{phrase(1, 5)}</title><script>var t='</p>';</script></head><body>{body}</body></html>", main


def examples(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    rng, out = random.Random(seed), []
    for _ in range(n):
        source, main = page(rng)
        found = blocks(source)
        out.append((vectors(found), np.array([float(t in main) for t, _, _ in found], np.float32)))
    return out


_trained: Labeller | None = None


def trained() -> Labeller:
    """The labeller, trained when first asked for."""
    global _trained
    if _trained is None:
        _trained = Labeller().fit(examples(EXAMPLES, SEED))
    return _trained


def extract_all(labeller: Labeller, sources: list[str | None]) -> Iterator[str]:
    """The main texts of pages, labelled in steps of like length."""
    found = [blocks(s) if s else [] for s in sources]
    order = sorted((k for k in range(len(found)) if found[k]), key=lambda k: len(found[k]))
    texts = [""] * len(found)
    while order:
        step = [order.pop()]
        while order and (len(step) + 1) * len(found[step[0]]) <= STEP:
            step.append(order.pop())
        for k, p in zip(step, labeller.scores([vectors(found[k]) for k in step])):
            texts[k] = "\n\n".join(t for (t, _, _), s in zip(found[k], p) if s >= 0.5)
    yield from texts


class _Extracted:
    def __init__(self, labeller: Labeller, names: list[str], at: int) -> None:
        self.labeller, self.names, self.at = labeller, names, at

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = list(extract_all(self.labeller, part.column(self.at).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], self.names)


def extract(pages: DataFrame, html_col: str = "html", labeller: Labeller | None = None) -> DataFrame:
    """pages without the html, with text, the main text."""
    refuse(pages, {"text"})
    schema = T.StructType([*pages.schema.fields, T.StructField("text", T.StringType())])
    return pages.mapInArrow(_Extracted(labeller or trained(), schema.names, pages.columns.index(html_col)), schema).drop(html_col)
