"""Main-text extraction by a recurrent block labeller.

A page becomes the sequence of its leaf blocks. Each block is a hashed vector of its tag path (tags, classes, ids) and of all its
words, plus a few counts. A numpy bidirectional LSTM reads the whole sequence, so that every block is judged with the document around
it. The model is trained, deterministically, on pages that ``sample_page`` invents; nothing of the corpus is learnt from.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from bisect import bisect_left
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm import tokens

#: Elements that hold raw text, never markup or text of the page. Without an end, the first two take the rest, the others nothing.
_RAW = ("script", "style", "textarea", "iframe", "title")
#: Elements whose content, markup as well, isn't text of the page. They end with their parent at the latest.
_HIDING = frozenset("noscript template select svg".split())
#: What may stand in a head; anything else, text too, ends it.
_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
_OPEN = re.compile(r"<(?:(?P<comment>!--)|(?P<cdata>!\[CDATA\[)|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]{0,63})|(?P<other>[/!?]))")
#: The rest of a tag that has neither < nor > in its attributes.
_PLAIN = re.compile(r"[^'\"<>]*+(?:(?:\"[^\"<>]*+\"|'[^'<>]*+')[^'\"<>]*+)*+>")
_MARK = re.compile(r"[\"'>]")
#: Elements that break the text into blocks.
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag of the key closes open elements of these kinds above the nearest element that isn't one of them.
_CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_VOID = {"hr"}
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

PATH, WORDS, COUNTS = 48, 32, 6
INPUT, HIDDEN = PATH + WORDS + COUNTS, 16
_NOWHERE = np.zeros(PATH, np.float32)
#: Steps whose inputs are multiplied at once.
_STEPS = 4_096


class _Ends:
    """Where tags of a page end: at the first > outside quotes. A place from which no end was found is remembered, so that all searches
    together take time in proportion to the page."""

    def __init__(self, page: str):
        self.page, self.marks, self.dead = page, None, set()

    def of(self, at: int) -> int:
        """The place after the tag whose attributes start at ``at``; -1 if it never ends."""
        if m := _PLAIN.match(self.page, at):
            return m.end()
        if self.marks is None:
            self.marks = [m.start() for m in _MARK.finditer(self.page)]
            self.next, last = [-1] * len(self.marks), {}
            for k in range(len(self.marks) - 1, -1, -1):
                sign = self.page[self.marks[k]]
                self.next[k] = last.get(sign, -1)
                last[sign] = k
        k, seen = bisect_left(self.marks, at), []
        while 0 <= k < len(self.marks) and k not in self.dead:
            if self.page[self.marks[k]] == ">":
                return self.marks[k] + 1
            seen.append(k)
            k = self.next[k] + 1 or -1
        self.dead.update(seen)
        return -1


def tokens_of(page: str):
    """(place, end, tag, whether it closes, attributes) of each piece of markup: None for one without a tag, empty for a whole raw
    element. An unfinished tag is text."""
    ends, at, last = _Ends(page), 0, page.rfind(">")
    endless: set[str] = set()  # raw elements that nothing closes any more
    while m := _OPEN.search(page, at):
        start, tag = m.start(), m["tag"]
        if m["comment"] or m["cdata"]:
            close = "-->" if m["comment"] else "]]>"
            at = page.find(close, m.end())
            at = len(page) if at < 0 else at + 3
            yield start, at, None, False, ""
            continue
        if start > last:  # no tag ends any more
            at = m.end()
            continue
        end = ends.of(m.end()) if tag else -1
        if end < 0 and (m["other"] or m["end"]):
            end = page.find(">", m.end()) + 1 or -1
            tag = None
        if end < 0:
            at = start + 1
            continue
        at = end
        raw = tag.lower() if tag and not m["end"] else ""
        if raw in _RAW:
            found = None if raw in endless else _closing(raw).search(page, end)
            if found:
                at = found.end()
            elif raw in _RAW[:2]:
                at = len(page)
            endless |= set() if found else {raw}
            yield start, at, "", False, ""
            continue
        yield start, at, tag, bool(m["end"]), page[m.end() : end - 1]


@lru_cache(32)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.I)


class Node:
    """An open element: its label, its parent and what the path down to it adds up to."""

    __slots__ = ("tag", "label", "parent", "depth", "vector", "below")

    def __init__(self, tag: str, label: str, parent: Node | None):
        self.tag, self.label, self.parent = tag, label, parent
        self.depth = parent.depth + 1 if parent else 1
        above, near = (parent.below, parent.vector) if parent else (_NOWHERE, _NOWHERE)
        if label in ("html", "body"):
            self.vector, self.below = near, above
        else:
            own = _label_vector(label)
            self.vector, self.below = above + own, above + np.float32(0.7) * own

    def path(self) -> tuple[str, ...]:
        return (*(self.parent.path() if self.parent else ()), self.label)


def leaf_blocks(page: str | None) -> list[tuple[Node | None, str, float]]:
    """(innermost open element, text, share of link text) of each block with text, in page order. Null and empty pages have none."""
    out: list[tuple[Node | None, str, float]] = []
    stack: list[Node] = []
    open_tags: dict[str, int] = {}
    parts: list[str] = []
    linked: list[str] = []
    in_link, at, in_head = False, 0, False
    hiding, inside = "", Counter()  # the element that hides what follows, and what is open in it
    page = page or ""

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                share = len("".join(linked)) / max(1, len("".join(parts)))
                out.append((stack[-1] if stack else None, text, min(1.0, share)))
            parts.clear()
            linked.clear()

    def pop() -> Node:
        open_tags[stack[-1].tag] -= 1
        return stack.pop()

    def add(text: str) -> None:
        parts.append(text)
        if in_link:
            linked.append(text)

    for start, end, tag, closes, attrs in tokens_of(page):
        if start > at and not hiding:
            text = page[at:start]
            in_head = in_head and text.isspace()
            if not in_head:
                add(text)
        at = end
        if not tag:
            continue
        tag = tag.lower()
        if hiding:
            if closes and inside[tag]:
                inside[tag] -= 1
                hiding = hiding if inside[hiding] else ""
                continue
            # the end of what isn't open inside is its parent's; a list or drawing can't hold blocks
            if not (closes or (tag in _BLOCK and hiding in ("select", "svg") and tag not in ("option", "hr"))):
                inside[tag] += 1
                continue
            if closes and tag in _BLOCK and not open_tags.get(tag):
                continue
            hiding = ""
        if tag in _HIDING:
            if not closes and not attrs.endswith("/"):
                hiding, inside = tag, Counter((tag,))
            continue
        in_head = in_head and tag in _HEAD
        if tag == "a":
            in_link = not closes
        elif tag == "br":
            parts.append(" ")
        elif tag == "head":
            flush()
            in_head = not closes
        elif tag in _BLOCK:
            flush()
            if closes:
                if open_tags.get(tag):
                    while pop().tag != tag:
                        pass
            else:
                above = _CLOSES.get(tag, {"p"})
                while stack and stack[-1].tag in above:
                    pop()
                if tag not in _VOID:
                    stack.append(Node(tag, _label(tag, attrs), stack[-1] if stack else None))
                    open_tags[tag] = open_tags.get(tag, 0) + 1
    if at < len(page) and not hiding:
        add(page[at:])
    flush()
    return out


@lru_cache(1 << 14)
def _label(tag: str, attrs: str) -> str:
    names = [tag]
    for kind, *value in _ATTR.findall(attrs):
        names += [f"{kind.lower()}:{w.lower()}" for v in value for w in re.findall(r"[a-zA-Z]+", v)]
    return " ".join(names)


@lru_cache(1 << 14)
def _label_vector(label: str) -> np.ndarray:
    v = np.zeros(PATH, np.float32)
    for k, name in enumerate(label.split(" ")):
        name = name.partition(":")[2] if k else name  # a tag nav and a class nav say the same
        h = zlib.crc32(name.encode("utf-8", "surrogatepass"))
        for shift in (0, 8, 16):
            v[(h >> shift) % PATH] += 1 if h >> (24 + shift // 8) & 1 else -1
    return v


def vectors(blocks: list[tuple[Node | None, str, float]]) -> np.ndarray:
    """Input vectors of blocks (of any number of pages, one after the other)."""
    x = np.zeros((len(blocks), INPUT), np.float32)
    if not blocks:
        return x
    x[:, :PATH] = np.stack([b[0].vector if b[0] else _NOWHERE for b in blocks])
    data, offsets = tokens.column_bytes(pa.array([b[1] for b in blocks], pa.large_string()))
    starts, ends = tokens.space_tokens(data, offsets)
    h = tokens.run_hashes(tokens.lower(data), starts, ends)
    block = np.searchsorted(offsets, starts, "right") - 1
    n = np.maximum(np.bincount(block, minlength=len(blocks)), 1)
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    words = np.bincount(block * WORDS + (h % np.uint64(WORDS)).astype(np.int64), sign, len(blocks) * WORDS).reshape(-1, WORDS)
    x[:, PATH : PATH + WORDS] = np.clip(words / np.sqrt(n)[:, None], -2, 2)
    dots = np.add.reduceat(np.isin(data, (33, 44, 46, 63)), offsets[:-1]) if len(data) else np.zeros(len(blocks))
    for k, column in enumerate((np.log1p(n) / 3, [b[2] for b in blocks], dots / n, np.minimum([b[0].depth if b[0] else 0 for b in blocks], 12) / 6, n < 4, n > 25)):
        x[:, PATH + WORDS + k] = column
    return x


class BiLstm:
    """Two LSTMs, one from each end, and a logistic output over both states."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p["x" + d] = r.normal(0, INPUT**-0.5, (INPUT, 4 * HIDDEN)).astype(np.float32)
            self.p["h" + d] = r.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            self.p["c" + d] = np.zeros(4 * HIDDEN, np.float32)
            self.p["c" + d][HIDDEN : 2 * HIDDEN] = 1
        self.p["o"] = r.normal(0, 0.2, 2 * HIDDEN).astype(np.float32)
        self.p["z"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        steps, many, _ = x.shape
        h = c = np.zeros((many, HIDDEN), np.float32)
        out = np.empty((steps, many, HIDDEN), np.float32)
        for t in range(steps):
            if t % _STEPS == 0:
                gates = x[t : t + _STEPS] @ self.p["x" + d] + self.p["c" + d]
            a = gates[t % _STEPS] + h @ self.p["h" + d]
            s = 1 / (1 + np.exp(-np.clip(a[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            g = np.tanh(a[:, 3 * HIDDEN :])
            before, last = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep is not None:
                keep.append((i, f, o, g, before, tc, last))
        return out

    def _back(self, x: np.ndarray, d: str, keep: list, up: np.ndarray, grads: dict) -> None:
        steps, many, _ = x.shape
        da = np.empty((steps, many, 4 * HIDDEN), np.float32)
        dh = dc = np.zeros((many, HIDDEN), np.float32)
        lasts = np.stack([k[6] for k in keep])
        for t in range(steps - 1, -1, -1):
            i, f, o, g, before, tc, _ = keep[t]
            dh = dh + up[t]
            dc = dc + dh * o * (1 - tc * tc)
            da[t] = np.concatenate((dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)), axis=1)
            dh = da[t] @ self.p["h" + d].T
            dc = dc * f
        flat = da.reshape(-1, 4 * HIDDEN)
        grads["x" + d] = x.reshape(-1, INPUT).T @ flat
        grads["h" + d] = lasts.reshape(-1, HIDDEN).T @ flat
        grads["c" + d] = flat.sum(0)

    def logits(self, pages: list[np.ndarray], keep: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(logits [step, page], lengths); pages are filled up at their ends in either direction."""
        lengths = np.array([len(p) for p in pages])
        steps = int(lengths.max())
        x = np.zeros((steps, len(pages), INPUT), np.float32)
        for k, p in enumerate(pages):
            x[: len(p), k] = p
        turn = np.where(np.arange(steps)[:, None] < lengths, lengths - 1 - np.arange(steps)[:, None], np.arange(steps)[:, None])
        cols = np.arange(len(pages))
        y = x[turn, cols]
        kf, kb = ([], []) if keep is not None else (None, None)
        hf, hb = self._run(x, "f", kf), self._run(y, "b", kb)[turn, cols]
        if keep is not None:
            keep |= {"x": x, "y": y, "turn": turn, "cols": cols, "kf": kf, "kb": kb, "h": np.concatenate((hf, hb), axis=2)}
        return hf @ self.p["o"][:HIDDEN] + hb @ self.p["o"][HIDDEN:] + self.p["z"], lengths

    def learn(self, pages: list[np.ndarray], truth: list[np.ndarray], rate: float, state: dict) -> float:
        """One Adam step on a batch of pages."""
        keep: dict = {}
        z, lengths = self.logits(pages, keep)
        y, mask = np.zeros_like(z), np.arange(len(z))[:, None] < lengths
        for k, t in enumerate(truth):
            y[: len(t), k] = t
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        dz = ((p - y) * mask / mask.sum()).astype(np.float32)
        grads = {"o": (keep["h"] * dz[:, :, None]).sum((0, 1)), "z": dz.sum(keepdims=True).reshape(1)}
        self._back(keep["x"], "f", keep["kf"], dz[:, :, None] * self.p["o"][:HIDDEN], grads)
        up = (dz[:, :, None] * self.p["o"][HIDDEN:])[keep["turn"], keep["cols"]]
        self._back(keep["y"], "b", keep["kb"], up, grads)
        state["t"] = state.get("t", 0) + 1
        for k, g in grads.items():
            m, v = state.get(k, (0.0, 0.0))
            state[k] = m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            self.p[k] -= (rate * (m / (1 - 0.9 ** state["t"])) / (np.sqrt(v / (1 - 0.99 ** state["t"])) + 1e-8)).astype(np.float32)
        return float(-(np.log(np.where(y == 1, p, 1 - p) + 1e-9) * mask).sum() / mask.sum())

    def label(self, pages: list[np.ndarray], most: int = 1 << 14) -> list[np.ndarray]:
        """Whether each block of each page is main text; at most about ``most`` blocks run side by side."""
        order = sorted((k for k, p in enumerate(pages) if len(p)), key=lambda k: len(pages[k]))
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and to - at < 512 and len(pages[order[to]]) * (to - at + 1) <= most:
                to += 1
            z, _ = self.logits([pages[k] for k in order[at:to]])
            for c, k in enumerate(order[at:to]):
                out[k] = z[: len(pages[k]), c] > 0
            at = to
        return out


#: Boilerplate of invented pages: how it may be wrapped, and what it may say.
_WRAPS = {
    "nav": ["<nav>{}</nav>", '<div class="menu">{}</div>', '<ul class="nav navbar">{}</ul>', '<div id="navigation">{}</div>', '<div class="breadcrumbs">{}</div>', '<div role="navigation">{}</div>'],
    "header": ["<header>{}</header>", '<div class="header">{}</div>', '<div id="masthead">{}</div>', '<div class="site-header banner">{}</div>', '<div class="topbar">{}</div>'],
    "ad": ['<div class="ad">{}</div>', '<div class="advert">{}</div>', '<div class="ads sponsored">{}</div>', '<div class="banner-ad">{}</div>', '<aside class="promo">{}</aside>', '<div id="ad-top">{}</div>', '<section class="advertisement">{}</section>'],
    "side": ["<aside>{}</aside>", '<div class="sidebar">{}</div>', '<div id="sidebar" class="widget">{}</div>', '<div class="related">{}</div>', '<section class="widget recent">{}</section>', '<div class="tags">{}</div>', '<div class="share social">{}</div>'],
    "notice": ['<div class="cookie">{}</div>', '<div id="cookie-banner">{}</div>', '<div class="notice consent">{}</div>', '<div class="popup newsletter">{}</div>', '<div role="dialog" class="modal">{}</div>', '<div class="alert gdpr">{}</div>'],
    "form": ["<form>{}</form>", '<form class="search">{}</form>', '<form id="subscribe"><label>{}</label><button>Go</button></form>', '<div class="login"><form>{}</form></div>'],
    "comments": ['<section class="comments">{}</section>', '<div id="comments">{}</div>', '<ol class="commentlist"><li class="comment">{}</li></ol>', '<div class="disqus replies">{}</div>'],
    "footer": ["<footer>{}</footer>", '<div class="footer">{}</div>', '<div id="footer">{}</div>', '<div class="copyright legal">{}</div>', '<div class="site-footer">{}</div>'],
}
_ARTICLES = ["<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div class="post entry-content">{}</div>', '<div id="article">{}</div>', '<main><article class="post">{}</article></main>', '<div class="article-body story">{}</div>', "<section>{}</section>", '<div role="main">{}</div>', "{}"]


def sample_page(r: random.Random) -> tuple[str, set[int]]:
    """An invented page whose main-text words are marked: ('main' words start with the letter q, no others do)."""

    def words(n: int, main: bool) -> str:
        out = [("q" if main else "") + "".join(r.choice("abcdefghijklmnoprstuvwxyzäéñ") for _ in range(r.randrange(2, 9))) for _ in range(n)]
        if r.random() < 0.08:
            out = out[:1] * n if r.random() < 0.5 else [w.upper() + r.choice(["!!", "***", "$$"]) for w in out]
        dots = r.choice([0.05, 0.15, 0.4])
        text = " ".join(w + (r.choice([".", ",", "."]) if r.random() < dots else "") for w in out).capitalize() + r.choice([".", ""])
        return text if main or r.random() < 0.7 else r.choice(["© ", "", "© 2024 "]) + ".".join(out[:1] * 3) + r.choice([" · ", " | ", " "]) + text

    def boiler(kind: str) -> str:
        n = r.randrange(1, 9)
        items = ["".join(("<li>" * li) + f'<a href="/{k}">{words(r.randrange(1, 4), False)}</a>' + "</li>" * li for k in range(n)) for li in (0, 1)]
        text = "".join(f"<p>{words(r.randrange(2, 40), False)}</p>" for _ in range(r.randrange(1, 4)))
        body = {"nav": r.choice([f"<ul>{items[1]}</ul>", items[0]]), "header": r.choice([items[0], f"<h1>{words(2, False)}</h1>", words(4, False)]), "footer": r.choice([words(r.randrange(2, 60), False), f"<p>© {words(5, False)}</p>{items[0]}", f"<ul>{items[1]}</ul>"])}
        return r.choice(_WRAPS[kind]).format(body.get(kind) or r.choice([text, words(r.randrange(1, 30), False), f"<h3>{words(2, False)}</h3>{text}", f"<h3>{words(2, False)}</h3><ul>{items[1]}</ul>"]))

    def paragraph() -> str:
        n = r.choice([1, 2, 4, 8, 20, 40, 80, 150])
        text = words(r.randrange(1, n + 1), True)
        return r.choice(["<p>{}</p>"] * 8 + ["<p>{}", "<p><b>{}<br>", "<h2>{}</h2>", "<blockquote><p>{}</p></blockquote>", "<ul><li>{}</li></ul>", "<div>{}</div>", '<p class="lead">{}</p>', "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>"]).format(text)

    body = [paragraph() for _ in range(r.choice([0, 1, 2, 3, 5, 8, 15, 30]))]
    head = r.choice(["<h1>{}</h1>", '<h1 class="title">{}</h1>', "<header><h1>{}</h1></header>", ""]).format(words(r.randrange(1, 12), True))
    for kind in ("ad", "side", "form", "notice"):
        if body and r.random() < 0.15:
            body.insert(r.randrange(len(body) + 1), boiler(kind))
    article = r.choice(_ARTICLES + _ARTICLES[:2] * 4).format(head + "".join(body))
    before = [boiler(k) for k in ("nav", "header", "notice", "ad", "form", "side") if r.random() < 0.45]
    after = [boiler(k) for k in ("comments", "side", "ad", "form", "nav", "footer", "notice") if r.random() < 0.45]
    r.shuffle(before)
    return f"<!DOCTYPE html><html><head><title>{words(4, False)}</title></head><body>{''.join(before)}{article}{''.join(after)}</body></html>", set()


@lru_cache(1)
def trained(pages: int = 2000, rounds: int = 10, seed: int = 3) -> BiLstm:
    """The model after ``rounds`` over ``pages`` invented pages: some seconds on the driver, once a process."""
    r = random.Random(seed)
    xs, ys = [], []
    while len(xs) < pages:
        blocks = leaf_blocks(sample_page(r)[0])
        if blocks:
            truth = np.array([b[1][:1] in "qQ" for b in blocks], np.float32)
            xs.append(vectors([(p, re.sub(r"\b[qQ](?=\w)", "", t), s) for p, t, s in blocks]))
            ys.append(truth)
    model, state, batch = BiLstm(), {}, 24
    total = rounds * (pages // batch)
    for n in range(rounds):
        order = sorted(range(pages), key=lambda k: (len(xs[k]) // 4, r.random()))
        groups = [order[k : k + batch] for k in range(0, pages - batch + 1, batch)]
        r.shuffle(groups)
        for own in groups:
            rate = 0.01 * (1 - state.get("t", 0) / (total + 1))
            model.learn([xs[k] for k in own], [ys[k] for k in own], rate, state)
    return model


def main_text(pages: list[str | None], model: BiLstm) -> list[str]:
    blocks = [leaf_blocks(p) for p in pages]
    x = vectors([b for own in blocks for b in own])
    cuts = np.cumsum([0] + [len(b) for b in blocks])
    labels = model.label([x[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
    return ["\n".join(b[1] for b, keep in zip(own, label, strict=True) if keep) for own, label in zip(blocks, labels, strict=True)]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: identifier, URL, ``text`` (main-text blocks joined by line ends) and ``n_chars``.

    White space inside a block is one blank, character references are decoded. Null and empty pages, and pages without
    main text, give an empty text. Rows are independent: repeated rows give repeated results; other columns
    aren't read. An empty table gives no rows.
    """
    model = pages.sparkSession.sparkContext.broadcast(trained())  # some ten thousand numbers

    def run(batches):
        for batch in batches:
            for at, part in tokens.batches_of(batch.column("html"), 8 << 20):
                texts = main_text(part.to_pylist(), model.value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, len(part)), batch.column("url").slice(at, len(part)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[id_col, url_col, "text", "n_chars"],
                )

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"`{id_col}` long, `{url_col}` string, text string, n_chars long")
