"""HTML extraction by a recurrent block labeller.

A page becomes a sequence of leaf blocks (runs of text between block-level tags). Each has
a vector of its tag path with class and id words, of its hashed words, and of its shape. A
numpy LSTM reads the sequence in both directions, so that every block is classified in the
context of the whole page; the blocks of the article are joined in page order.

The labeller is trained here, on pages that a generator writes with known labels: menus,
headers, notices, adverts, sidebars, forms, comments and footers around articles, with and
without telling tags and class names, in words that are new on every page.
"""

from __future__ import annotations

import html
import math
import os
import random
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from .common import field, free_name, table, tune

# Fixed values of HTML: elements without content, of block level, with raw text, and never shown as text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul head title".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
HIDDEN = frozenset("head script style title textarea iframe noembed noframes noscript template svg math canvas audio video object select datalist xmp".split())
CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"thead", "tbody", "tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
SCOPES = frozenset("ul ol dl table article section div nav aside footer header main form body blockquote td th".split())
CELLS = frozenset("tr td th thead tbody tfoot".split())
#: Elements that a start tag may end, or that bound which ones it ends: between two scopes at most one of each name is open.
MARKS = SCOPES.union(*CLOSES.values())

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
# the end of a tag, or a quoted value, in which a `>` does not end it
TAG_STEP = re.compile(r">|=[ \t\n\r\f]*([\"'])")
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PIECE = re.compile(r"[a-z]+")
# numeric references of any length: leading zeros mean nothing, and no character has nine digits
ZEROS, TOO_LONG = re.compile(r"&#([xX]?)0+(?=[0-9a-fA-F])"), re.compile(r"&#(?:[0-9]{9,}|[xX][0-9a-fA-F]{9,});?")

PATH_DIM, LAST_DIM, WORD_DIM, SHAPE_DIM = 96, 24, 48, 10
IN_DIM = PATH_DIM + LAST_DIM + WORD_DIM + SHAPE_DIM
HIDDEN_DIM = 20
#: Blocks whose vectors are held at once.
PART = 4096


class Slot(dict):
    """Hash slot and sign of a name: slot * 2 + (1 for minus); kept up to a number of names."""

    def __init__(self, size: int, salt: int):
        super().__init__()
        self.size, self.salt = size, salt

    def __missing__(self, name: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        h = xxhash.xxh3_64_intdigest(name, self.salt)
        x = self[name] = (h >> 8) % self.size * 2 + (h & 1)
        return x


PATH_SLOT, LAST_SLOT, WORD_SLOT = Slot(PATH_DIM, 1), Slot(LAST_DIM, 2), Slot(WORD_DIM, 3)


class Leaf(NamedTuple):
    path: bytes  # sums of the signs of the open elements' names, by slot
    last: str  # the innermost open block element
    text: str
    linked: int  # characters inside links


def unescape(text: str) -> str:
    if "&" not in text:
        return text
    if "&#" in text:
        text = TOO_LONG.sub("\ufffd", ZEROS.sub(r"&#\1", text))
    return html.unescape(text)


class _Tree:
    """The open elements of a page. Every element is pushed and popped once, whatever is never closed."""

    def __init__(self):
        self.stack: list[tuple[str, list[int]]] = []  # tag, slots that it adds to the path
        self.open: Counter[str] = Counter()
        self.blocks: list[str] = [""]
        self.marks: list[int] = []  # places in the stack of the elements in MARKS
        self.path = array("f", bytes(4 * PATH_DIM))
        self.hidden = 0

    def push(self, name: str, names: tuple[str, ...]) -> None:
        slots = [PATH_SLOT[n] for n in names]
        for s in slots:
            self.path[s >> 1] += -1.0 if s & 1 else 1.0
        if name in MARKS:
            self.marks.append(len(self.stack))
        if name in BLOCK:
            self.blocks.append(name)
        self.stack.append((name, slots))
        self.open[name] += 1
        self.hidden += name in HIDDEN

    def pop(self) -> str:
        name, slots = self.stack.pop()
        for s in slots:
            self.path[s >> 1] -= -1.0 if s & 1 else 1.0
        if name in MARKS:
            self.marks.pop()
        if name in BLOCK:
            self.blocks.pop()
        self.open[name] -= 1
        self.hidden -= name in HIDDEN
        return name

    def make_room(self, name: str) -> None:
        """End what a start tag of a block ends without saying so: its like, or an open paragraph."""
        shut = CLOSES.get(name) or (set() if name in ("li", "dd", "dt") else {"p"})
        k = len(self.marks) - 1
        while k >= 0:
            held = self.stack[self.marks[k]][0]
            if held in shut:
                to = self.marks[k]
                while len(self.stack) > to:
                    self.pop()
            elif held in SCOPES and not (held in ("td", "th") and name in CELLS):
                return
            k -= 1


def leaves(page: str) -> list[Leaf]:
    """Every leaf block with text, in page order, in one pass: each character is looked at a bounded number of times."""
    out: list[Leaf] = []
    tree, paths = _Tree(), {}
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                raw = tree.path.tobytes()
                out.append(Leaf(paths.setdefault(raw, raw), tree.blocks[-1], text, linked))
            parts, linked = [], 0

    def say(text: str) -> None:
        nonlocal linked
        if text and not tree.hidden:
            text = unescape(text)
            parts.append(text)
            if tree.open["a"]:
                linked += len(text)

    at, from_, size, last_end, quotes = 0, 0, len(page), page.rfind(">"), True
    while True:
        at = page.find("<", at)
        if at < 0 or at > last_end and not page.startswith("<!--", at):  # no tag can end any more
            say(page[from_:])
            break
        if page.startswith("<!--", at):
            say(page[from_:at])
            end = page.find("-->", at + 4)
            if end < 0:
                break
            at = from_ = end + 3
            continue
        closing = page.startswith("/", at + 1)
        m = NAME.match(page, at + 1 + closing)
        if not m:
            if closing or page[at + 1 : at + 2] in ("!", "?"):
                say(page[from_:at])
                at = from_ = page.find(">", at) + 1
            else:
                at += 1  # a bare `<` is text
            continue
        end = m.end()
        while quotes:
            step = TAG_STEP.search(page, end)
            if step is None:
                quotes = False  # a value that never ends: from here on a tag ends at the next `>`, and no quote is looked for again
            elif step[1] is None:
                end = step.end()
                break
            else:
                shut = page.find(step[1], step.end())
                quotes, end = shut >= 0, shut + 1
        else:
            end = page.find(">", m.end()) + 1
        say(page[from_:at])
        at = from_ = end
        name, attrs = m[0].lower(), page[m.end() : end - 1]
        if closing:
            if tree.open[name] > 0:
                if name in BLOCK:
                    flush()
                while True:
                    if tree.stack[-1][0] in BLOCK:
                        flush()
                    if tree.pop() == name:
                        break
            elif name in BLOCK:
                flush()
            continue
        if name == "br":
            parts.append(" ")
        if name in BLOCK:
            flush()
            tree.make_room(name)
        if name in VOID:
            continue
        names = (name,)
        if "=" in attrs:
            names += tuple("." + w for a in NAMES.findall(attrs) for w in PIECE.findall((a[0] or a[1] or a[2]).lower()))
        if attrs.endswith("/") and name in ("svg", "math", "path"):
            continue
        tree.push(name, names)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at)
            at = from_ = end.start() if end else size
    flush()
    return out


def vectors(blocks: list[Leaf], start: int = 0, total: int | None = None) -> np.ndarray:
    """One row for each block of a page, or of a part of it from block `start` on."""
    n = len(blocks)
    x = np.zeros((n, IN_DIM), np.float32)
    total = n if total is None else total
    if n:
        x[:, :PATH_DIM] = np.frombuffer(b"".join(b.path for b in blocks), np.float32).reshape(n, PATH_DIM)
    for i, (_, last, text, linked) in enumerate(blocks):
        s = LAST_SLOT[last]
        x[i, PATH_DIM + (s >> 1)] = -1.0 if s & 1 else 1.0
        words = text.lower().split(" ")
        slots = np.fromiter(map(WORD_SLOT.__getitem__, words), np.int64, len(words))
        x[i, PATH_DIM + LAST_DIM : PATH_DIM + LAST_DIM + WORD_DIM] = np.bincount(slots >> 1, weights=1.0 - 2.0 * (slots & 1), minlength=WORD_DIM) / math.sqrt(len(words))
        k, o = len(text), PATH_DIM + LAST_DIM + WORD_DIM
        x[i, o : o + SHAPE_DIM] = (math.log1p(k) / 6, math.log1p(len(words)) / 5, min(1.0, linked / k), text[-1] in ".!?:;»”\"'", text[:1].isupper(), (start + i + 1) / total, min(1.0, total / 50), text.count(",") / (1 + len(words)), sum(map(text.count, "0123456789")) / k, text.startswith(("©", "(c)", "Copyright")))
    np.clip(x, -3, 3, out=x)
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class BiLSTM:
    """One bidirectional layer and a logistic output; sequences are padded at their end and masked."""

    def __init__(self, seed: int = 7):
        rng, h = np.random.default_rng(seed), HIDDEN_DIM
        self.p: dict[str, np.ndarray] = {"out": rng.normal(0, 0.2, (2 * h, 1)), "bias": np.zeros(1)}
        for d in "fb":
            self.p["x" + d], self.p["h" + d] = rng.normal(0, 0.12, (IN_DIM, 4 * h)), rng.normal(0, 0.15, (h, 4 * h))
            self.p["c" + d] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])

    def _pass(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None, hid: np.ndarray | None = None, cell: np.ndarray | None = None):
        """States (time, batch, hidden) of one direction, and the last hidden and cell state; starts from those given."""
        h, n, t = HIDDEN_DIM, x.shape[1], x.shape[0]
        z = x @ self.p["x" + d] + self.p["c" + d]
        hid, cell = (np.zeros((n, h)), np.zeros((n, h))) if hid is None else (hid, cell)
        out = np.zeros((t, n, h))
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            a = z[k] + hid @ self.p["h" + d]
            gates, g = sigmoid(a[:, : 3 * h]), np.tanh(a[:, 3 * h :])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            m = mask[k][:, None]
            new = f * cell + i * g
            th = np.tanh(new)
            if keep is not None:
                keep.append((k, hid, cell, i, f, o, g, th, m))
            cell, hid = np.where(m, new, 0.0), np.where(m, o * th, 0.0)
            out[k] = hid
        return out, hid, cell

    def forward(self, x: np.ndarray, mask: np.ndarray, tape: dict | None = None) -> np.ndarray:
        x = x.astype(np.float64)
        kf, kb = ([], []) if tape is not None else (None, None)
        both = np.concatenate([self._pass("f", x, mask, kf)[0], self._pass("b", x, mask, kb)[0]], axis=2)
        p = sigmoid((both @ self.p["out"])[:, :, 0] + self.p["bias"])
        if tape is not None:
            tape |= {"x": x, "both": both, "f": kf, "b": kb}
        return p

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """(gradient of every parameter, mean loss) of a batch."""
        tape: dict = {}
        p, h = self.forward(x, mask, tape), HIDDEN_DIM
        total = mask.sum()
        d = (p - y) * mask / total
        g = {"out": np.einsum("tnh,tn->h", tape["both"], d)[:, None], "bias": np.array([d.sum()])}
        dh_all = d[:, :, None] * self.p["out"][:, 0]
        for way, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            dz = np.zeros((x.shape[0], x.shape[1], 4 * h))
            gh = np.zeros_like(self.p["h" + way])
            dh, dc = np.zeros((x.shape[1], h)), np.zeros((x.shape[1], h))
            for k, hid, cell, i, f, o, gg, th, m in reversed(tape[way]):
                dh = (dh + dh_all[k][:, part]) * m
                dc = dc * m + dh * o * (1 - th * th)
                a = np.concatenate([dc * gg * i * (1 - i), dc * cell * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
                dz[k] = a
                gh += hid.T @ a
                dh, dc = a @ self.p["h" + way].T, dc * f
            g["x" + way], g["h" + way], g["c" + way] = np.einsum("tni,tnj->ij", tape["x"], dz), gh, dz.sum(axis=(0, 1))
        q = np.clip(np.where(y > 0.5, p, 1 - p), 1e-9, 1)
        return g, float(-(np.log(q) * mask).sum() / total)

    def step(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, state: dict, rate: float) -> float:
        """One Adam step on a batch; returns the mean loss."""
        g, loss = self.gradients(x, mask, y)
        norm = math.sqrt(sum(float((v * v).sum()) for v in g.values()))
        state["t"] = t = state.get("t", 0) + 1
        for k, v in g.items():
            v = v * min(1.0, 5.0 / (norm + 1e-9))
            m1 = state[k, 1] = 0.9 * state.get((k, 1), 0.0) + 0.1 * v
            m2 = state[k, 2] = 0.99 * state.get((k, 2), 0.0) + 0.01 * v * v
            self.p[k] -= rate * (m1 / (1 - 0.9**t) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8) + (1e-3 * self.p[k] if k[0] == "x" else 0.0))
        return loss

    def label(self, pages: list[list[Leaf]]) -> list[np.ndarray]:
        """P(article) of every block of every page. Pages of like length go together; a page is never cut."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order, at = sorted((i for i, x in enumerate(pages) if len(x)), key=lambda i: len(pages[i])), 0
        while at < len(order):
            if len(pages[order[at]]) > PART:
                out[order[at]] = self.label_long(pages[order[at]])
                at += 1
                continue
            some = [order[at]]
            while at + len(some) < len(order) and (len(some) + 1) * len(pages[order[at + len(some)]]) <= PART:
                some.append(order[at + len(some)])
            at += len(some)
            x, mask = padded([vectors(pages[i]) for i in some])
            p = self.forward(x, mask)
            for k, i in enumerate(some):
                out[i] = p[: len(pages[i]), k]
        return out

    def label_long(self, page: list[Leaf]) -> np.ndarray:
        """The same for one page of any length: vectors are made for PART blocks at a time, states go on from part to part."""
        n, h = len(page), HIDDEN_DIM
        score = np.full(n, float(self.p["bias"][0]))
        for way, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            hid, cell = np.zeros((1, h)), np.zeros((1, h))
            cuts = range(0, n, PART)
            for a in cuts if way == "f" else reversed(cuts):
                x = vectors(page[a : a + PART], a, n)[:, None].astype(np.float64)
                states, hid, cell = self._pass(way, x, np.ones((len(x), 1), bool), None, hid, cell)
                score[a : a + PART] += states[:, 0] @ self.p["out"][part, 0]
        return sigmoid(score)


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, pages))
    x, mask = np.zeros((t, len(pages), IN_DIM), np.float32), np.zeros((t, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


# ---- pages with known labels: text inside \x01 ... \x02 belongs to the article


def make_page(rng: random.Random) -> str:
    letters = "aeiouáéöñ" + "bcdfghklmnprstvz"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 10))) for _ in range(60)]

    def words(a: int, b: int) -> str:
        return " ".join(rng.choice(made) for _ in range(rng.randrange(a, b))).capitalize()

    def prose(a: int, b: int) -> str:
        return " ".join(words(3, 14) + rng.choice(["."] * 8 + ["!", "?"]) for _ in range(rng.randrange(a, b)))

    def named(*names: str) -> str:
        return "" if rng.random() < 0.25 else f' {rng.choice(["class", "id", "class"])}="{rng.choice(names)}{rng.choice(["", "-box", " wrap", "_1", "-inner"])}"'

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{rng.choice(made)}">{words(1, 4)}</a>{rng.choice(["</li>", "</li>", ""])}' for _ in range(n))

    def menu() -> str:
        n = rng.randrange(2, 12)
        if rng.random() < 0.7:
            return f"<nav{named('nav', 'menu', 'main-nav')}><ul>{links(n)}</ul></nav>"
        return f"<div{named('nav', 'menu', 'navbar', 'breadcrumb')}>" + " | ".join(f'<a href="#">{words(1, 3)}</a>' for _ in range(n)) + "</div>"

    def head() -> str:
        return f"<header{named('header', 'masthead', 'site-header')}>{rng.choice(['<a href=/>', '<h1>', '<div>', '<p>'])}{words(1, 6)}</a></header>" if rng.random() < 0.7 else f'<div class="{rng.choice(["header", "top", "logo", "masthead"])}"><p>{prose(1, 2)}</p></div>'

    def advert() -> str:
        return f'<{rng.choice(["div", "div", "aside", "section", "p"])} class="{rng.choice(["ad", "ads", "advert", "sponsored", "promo", "banner ad", "ad-slot"])}">{rng.choice(["", "Advertisement ", "Sponsored: "])}{prose(1, 4)}</div>'

    def side() -> str:
        return f"<aside{named('sidebar', 'side', 'related', 'widget')}><h3>{words(1, 4)}</h3><ul>{links(rng.randrange(2, 8))}</ul><p>{prose(1, 3)}</p></aside>" if rng.random() < 0.7 else f'<div class="{rng.choice(["sidebar", "related", "widget", "share"])}"><h3>{words(1, 4)}</h3><p>{prose(1, 3)}</p><ul>{links(3)}</ul></div>'

    def notice() -> str:
        return f'<div class="{rng.choice(["cookie", "consent", "notice", "cookie-banner", "alert", "popup", "gdpr"])}"><p>{rng.choice(["We use cookies. ", "This site uses cookies ", "", ""])}{prose(1, 3)}</p>{rng.choice(["<button>OK</button>", "<a href=#>Accept</a>", ""])}</div>'

    def form() -> str:
        return f'<form action="/x"{named("search", "newsletter", "subscribe", "login")}><label>{words(1, 4)}</label><input name=q><p>{prose(1, 2)}</p><button>{words(1, 3)}</button></form>'

    def comments() -> str:
        kind = rng.choice(["comments", "comment-list", "discussion", "responses"])
        one = "".join(f'<{(t := rng.choice(["div", "li", "article"]))} class="{rng.choice(["comment", "reply", "response"])}"><b>{words(1, 3)}</b><p>{prose(1, 5)}</p></{t}>' for _ in range(rng.randrange(1, 6)))
        return f'<{(s := rng.choice(["section", "div"]))} {rng.choice(["class", "id"])}="{kind}"><h3>{rng.choice(["Comments", words(1, 3)])}</h3>{one}</{s}>'

    def foot() -> str:
        text = rng.choice(["&copy; ", "Copyright ", ""]) + words(1, 3) + rng.choice([" &middot; ", " - ", ". "]) + prose(1, 4)
        return f"<footer{named('footer', 'site-footer')}>{rng.choice(['', '<p>', '<div>'])}{text}{rng.choice(['', f'<ul>{links(3)}</ul>'])}</footer>" if rng.random() < 0.75 else f'<div class="{rng.choice(["footer", "foot", "copyright", "site-footer"])}"><p>{text}</p></div>'

    def article() -> str:
        title = words(3, 11)
        body = [f"<{rng.choice(['h1', 'h1', 'h2'])}>\1{title}\2</h1>"] if rng.random() < 0.85 else []
        opened = rng.choice(["<b>", "<i>", "", "", ""])
        for k in range(rng.randrange(1, 9)):
            kind = rng.random()
            text = prose(1, 12) if kind > 0.15 else prose(1, 2)
            if k == 0 and rng.random() < 0.4:
                body.append(f"<p>{opened}\1{title}. {text}\2<br>{rng.choice(['', '</p>'])}")
            elif kind < 0.72:
                body.append(f"<p>\1{text}\2{rng.choice(['</p>', '</p>', ''])}")
            elif kind < 0.8:
                body.append(f"<h2>\1{words(2, 7)}\2</h2><p>\1{text}\2</p>")
            elif kind < 0.87:
                body.append("<ul>" + "".join(f"<li>\1{words(2, 12)}\2</li>" for _ in range(rng.randrange(2, 5))) + "</ul>")
            elif kind < 0.93:
                body.append(f"<blockquote>{rng.choice(['', '<p>'])}\1{text}\2</blockquote>")
            elif kind < 0.96:
                body.append(f"<p>\1{words(2, 6)}\2 <a href=x>\1{words(1, 3)}\2</a> \1{text}\2</p>")
            else:
                body.append(advert() if rng.random() < 0.5 else f"<pre>\1{text}\2</pre>")
        tag = rng.choice(["article", "article", "article", "main", "div", "section"])
        cls = named("post", "article", "entry", "content", "story") if tag in ("article", "main") else f' class="{rng.choice(["post", "article", "entry", "content", "story", "text"])}"'
        return f"<{tag}{cls}>" + "".join(body) + f"</{tag}>"

    before = [f() for f in (head, menu, notice, advert, form, side, menu) if rng.random() < 0.45]
    after = [f() for f in (side, advert, form, comments, menu, notice) if rng.random() < 0.35]
    rng.shuffle(before), rng.shuffle(after)
    body = "".join(before) + article() + "".join(after) + (foot() if rng.random() < 0.85 else "")
    if rng.random() < 0.4:
        body = f"<div{named('page', 'container', 'wrapper')}>{body}</div>"
    return f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><style>p{{}}</style></head><body>{body}</body></html>"


def labelled(page: str) -> tuple[np.ndarray, np.ndarray]:
    blocks = leaves(page)
    y = np.array(["\1" in b.text for b in blocks], float)
    return vectors([b._replace(text=" ".join(b.text.replace("\1", "").replace("\2", "").split()) or "x") for b in blocks]), y


_MODEL: dict[tuple[int, int, int], BiLSTM] = {}


def train(pages: int = 1200, epochs: int = 8, seed: int = 7) -> BiLSTM:
    """A labeller fitted on that many generated pages; the same numbers give the same labeller."""
    key = (pages, epochs, seed)
    if key not in _MODEL:
        rng = random.Random(seed)
        data = [labelled(make_page(rng)) for _ in range(pages)]
        data.sort(key=lambda d: len(d[0]))
        batches = [data[i : i + 24] for i in range(0, len(data), 24)]
        model, state = BiLSTM(seed), {}
        for epoch in range(epochs):
            rng.shuffle(batches)
            for b in batches:
                x, mask = padded([d[0] for d in b])
                y = np.zeros(mask.shape)
                for k, d in enumerate(b):
                    y[: len(d[1]), k] = d[1]
                model.step(x, mask, y, state, 0.01 if epoch < epochs - 3 else 0.003)
        _MODEL[key] = model
    return _MODEL[key]


_HELD: dict[str, BiLSTM] = {}


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", carry: tuple[str, ...] = ("url",), level: float = 0.5, with_blocks: bool = False, model: BiLSTM | None = None) -> DataFrame:
    """The operator: (id, carry columns, text, n_chars[, blocks array<struct<text, p>>]) of every page.

    A null html is empty and gives an empty text; repeated rows each give a row. A tag that
    does not end is text; a comment, script or style that does not end goes on to the end of
    the page. Pages are read whole where they are, without a shuffle, in one pass.
    """
    spark = tune(pages.sparkSession)
    shared, key = spark.sparkContext.broadcast(model or train()), os.urandom(8).hex()
    keep = [id_col, *carry]
    schema = [field(pages, c) for c in keep] + [StructField("text", StringType()), StructField("n_chars", LongType())]
    kind = pa.list_(pa.struct([("text", pa.string()), ("p", pa.float64())]))
    if with_blocks:
        schema.append(StructField("blocks", ArrayType(StructType([StructField("text", StringType()), StructField("p", DoubleType())]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _HELD:
            _HELD.clear()
            _HELD[key] = shared.value
        labeller = _HELD[key]
        for batch in batches:
            found = [leaves((x.as_py() or b"").decode("utf-8", "replace")) for x in batch.column(len(keep))]
            probs = labeller.label(found)
            texts = ["\n".join(b.text for b, q in zip(f, p) if q >= level) for f, p in zip(found, probs)]
            cols = [batch.column(i) for i in range(len(keep))] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            if with_blocks:
                cols.append(pa.array([[{"text": b.text, "p": float(q)} for b, q in zip(f, p)] for f, p in zip(found, probs)], kind))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    return pages.select(*keep, F.col(html_col).cast("binary").alias(free_name(pages, "html"))).mapInArrow(run, StructType(schema))


def op4_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op4_html_extract": op4_html_extract}
ORACLE: dict[str, str] = {}
