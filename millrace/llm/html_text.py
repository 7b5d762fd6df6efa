"""Main text of web pages by a tree-structured graphical model over the DOM.

A page becomes a tree: block elements, and below them one leaf for each block of inline text. Every node holds a
hidden label, content or not, with a potential from the node's own features (tag, words of class and id, length, links,
punctuation; what it holds of the page's text, links and paragraphs; the nearest frame's name), and every edge a potential for the labels of parent and child. Messages pass upward from the
leaves and downward from the root (sum-product), which gives each node's exact marginal on a tree. Weights are
learned by gradient steps on the exact likelihood of labelled pages; those pages come from `labelled_pages`, with
many kinds of frames around an article. Leaves whose marginal is a half or more make the text.

Scripts, styles, comments and what a browser doesn't show never become nodes. Character references are decoded,
white space inside a block becomes one space, and blocks are joined in page order by a line break. Null or empty
html gives an empty text. Elements that are hidden by an attribute or by their style are left out with all they hold, if
something closes them. Rows are treated one by one, so repeated ids stay; other columns are not read, whatever their
names. A very long or deeply nested page takes time in proportion to its length: one pass over its tags, one more if
anything in it is hidden. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import html as entities
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

#: Nodes whose messages are passed at a time.
STEP_NODES = 20_000
#: Training: pages, gradient steps, step length, penalty.
PAGES, STEPS, RATE, PENALTY = 500, 120, 0.2, 2e-4

# Elements of HTML by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template iframe svg canvas object head title select option datalist audio video map textarea".split())
RAW = frozenset("script style noscript template iframe svg canvas textarea title xmp".split())
BLOCK = frozenset(
    "html body main article section aside nav header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption table thead tbody tfoot tr td th caption form fieldset legend label button details summary dialog address hgroup search menu center".split()
)
#: An opening tag that ends an open element of these.
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th"}
CLOSES = {k: frozenset(v.split()) for k, v in CLOSES.items()}
ENDS_P = BLOCK - frozenset("label button html body tr td th thead tbody tfoot caption legend summary".split())
SCOPE = frozenset("ul ol table dl article section main aside div body".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)[^>]*+(?:>|\Z)|<[!?][^>]*+(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HIDE = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?false)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_UNSEEN = re.compile(r"(?<![\w-])hidden(?![\w-])(?!\s*=\s*false)", re.I)
_STYLE = re.compile(r"(?<![\w-])style\s*=\s*(?:\"[^\"]*|'[^']*|[^\s>]*)(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_SPLIT = re.compile(r"[a-z]+|[0-9]+")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def unseen(attributes: str) -> bool:
    """Whether an element with these attributes is hidden by itself."""
    low = attributes.lower()
    return ("hidden" in low and bool(_UNSEEN.search(_QUOTED.sub("", attributes)))) or ("style" in low and bool(_STYLE.search(attributes)))


def closings(source: str) -> dict[int, int]:
    """Where each element that something closes ends, by where its tag begins: one pass, with a stack for each name."""
    ends = [m.start() for m in re.finditer(">", source)]
    opened: dict[str, list[int]] = {}
    out: dict[int, int] = {}
    for m in _TAG.finditer(source):
        i = bisect.bisect_left(ends, m.end())
        if i == len(ends):
            break
        name = m[2].lower()
        if not m[1]:
            opened.setdefault(name, []).append(m.start())
        elif own := opened.get(name):
            out[own.pop()] = ends[i] + 1
    return out


class Page:
    """The tree of a page: parents come before their children, and leaves stand in page order."""

    def __init__(self, source: str, marked: bool = False):
        self.parent: list[int] = []
        self.traits: list[tuple[str, ...]] = []
        self.leaves: list[int] = []
        self.texts: list[str] = []
        self.label: list[int] = []
        self.linked: dict[int, int] = {}  # characters in links, by leaf
        self.marked = marked
        self._read(source)

    def _node(self, parent: int, traits: tuple[str, ...], label: int) -> int:
        self.parent.append(parent)
        self.traits.append(traits)
        self.label.append(label)
        return len(self.parent) - 1

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = []  # open elements; the node that text in them belongs to
        root = self._node(-1, ("root",), 0)
        text: list[str] = []
        linked = 0
        anchors = 0
        at, hidden_depth, end = 0, 0, len(source)

        def flush() -> None:
            nonlocal linked
            if text:
                joined = " ".join(entities.unescape("".join(text)).split())
                text.clear()
                if joined:
                    self._leaf(stack[-1][1] if stack else root, joined, linked)
            linked = 0

        opened: dict[str, int] = {}
        closed: dict[int, int] | None = None

        def close(names: frozenset[str], scope: frozenset[str]) -> None:
            if not any(map(opened.get, names)):
                return
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in names:
                    flush()
                    for x, _ in stack[i:]:
                        opened[x] -= 1
                    del stack[i:]
                    return
                if stack[i][0] in scope:
                    return

        while at < end:
            m = _TOKEN.search(source, at)
            run = source[at : m.start() if m else end]
            if run:
                text.append(run)
                linked += len(run) if anchors else 0
            if not m:
                break
            at, name = m.end(), m[2]
            if not name:
                continue
            name = name.lower()
            if m[1]:
                if name in BLOCK:
                    close(frozenset((name,)), frozenset())
                    anchors = 0
                elif name == "a":
                    anchors = 0
                continue
            if name in HIDDEN:
                if name in RAW:
                    stop = re.compile(rf"</{re.escape(name)}\b[^>]*+(?:>|\Z)", re.I).search(source, at)
                    at = stop.end() if stop else end
                elif not m[3].endswith("/"):
                    stop = re.compile(rf"</{re.escape(name)}\b[^>]*+(?:>|\Z)" + (r"|<body\b" if name == "head" else ""), re.I).search(source, at)
                    at = end if not stop else stop.start() if stop[0][1] != "/" else stop.end()
                text.append(" ")
                continue
            if name not in VOID and unseen(m[3]):
                closed = closings(source) if closed is None else closed
                if (to := closed.get(m.start())) is not None:
                    text.append(" ")
                    at = max(at, to)
                    continue
            if name == "a":
                anchors = 1
            elif name in ("br", "hr", "img", "input", "wbr"):
                text.append("" if name == "wbr" else " ")
                if name == "hr":
                    flush()
            if name not in BLOCK or name in VOID:
                continue
            if name in ENDS_P:
                close(frozenset("p"), SCOPE)
            if name in CLOSES:
                close(CLOSES[name], SCOPE)
            flush()
            anchors = 0
            up = stack[-1][1] if stack else root
            traits, label = _traits(name, m[3]), self.label[up]
            if self.marked:
                label = 1 if 'data-y="1"' in m[3] else 0 if 'data-y="0"' in m[3] else label
            stack.append((name, self._node(up, traits, label)))
            opened[name] = opened.get(name, 0) + 1
        flush()
        self._measure()

    def _measure(self) -> None:
        """Adds what a node holds to its traits: its share of the page's text and of links, paragraphs, and its place."""
        n = len(self.parent)
        chars, linked, prose, first = [0] * n, [0] * n, [0] * n, [0] * n
        total = 0
        for i, text in zip(self.leaves, self.texts):
            chars[i], linked[i], first[i] = len(text), min(len(text), self.linked[i]), total
            prose[i] = len(text) >= 60 and text[-1] in STOPS and 3 * linked[i] < len(text)
            total += len(text)
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            if chars[i] and (not chars[up] or first[i] < first[up]):
                first[up] = first[i]
            for x in (chars, linked, prose):
                x[up] += x[i]
        under = [""] * n  # the nearest name of a frame, its own or above
        for i in range(n):
            up = self.parent[i]
            under[i] = next((x for x in self.traits[i] if x in FRAMED), under[up] if up >= 0 else "")
            part, share, place = (a / max(1, b) for a, b in ((chars[i], total), (linked[i], chars[i]), (first[i], total)))
            # what an element holds tells the more the less its name does
            framed = not FRAMED.isdisjoint(self.traits[i])
            named = ("mixed" if framed else "other") if "w:other" in self.traits[i] else "framed" if framed else "plain"
            more = (named, f"part{bisect.bisect(PARTS, part)}-{named}", f"linked{bisect.bisect(SHARES, share)}", f"prose{bisect.bisect(PROSE, prose[i])}-{named}", f"place{bisect.bisect(PLACES, place)}")
            if under[i]:
                more += (f"under-{under[i]}", f"under-{under[i]}-{named}")
            if up >= 0:
                more += (f"{more[2]}-in-prose{bisect.bisect(PROSE, prose[up] - prose[i])}",)
            self.traits[i] += more if chars[i] else ("blank",)

    def _leaf(self, parent: int, text: str, linked: int) -> None:
        share = min(1.0, linked / max(1, len(text)))
        size = next(i for i, most in enumerate((15, 40, 80, 160, 400, 1 << 60)) if len(text) <= most)
        traits = ("leaf", f"size{size}", f"link{int(share * 2.99)}", "stop" if text[-1] in STOPS else "nostop")
        traits += (f"in-{self.traits[parent][0]}", f"size{size}-in-{self.traits[parent][0]}")
        if len(text) < 160 and ("©" in text or "copyright" in text.lower()):
            traits += ("copyright",)
        self.leaves.append(self._node(parent, traits, self.label[parent]))
        self.linked[self.leaves[-1]] = linked
        self.texts.append(text)


@lru_cache(4096)
def _traits(name: str, attributes: str) -> tuple[str, ...]:
    out = [name]
    for m in _NAMES.finditer(attributes):
        value = _CAMEL.sub(" ", m[1] or m[2] or m[3] or "").lower()
        found = [_stem(w) for w in _SPLIT.findall(value) if not w.isdigit()]
        out += [f"w:{w}" for w in found]
        if found and not KNOWN.issuperset(found):
            out.append("w:other")
    if _HIDE.search(attributes):
        out.append("hidden")
    return tuple(dict.fromkeys(out))


STOPS = ".!?…\"”»"
#: Bounds of the classes of what a node holds.
PARTS, SHARES, PROSE, PLACES = (0.02, 0.1, 0.3, 0.6), (0.01, 0.2, 0.6), (1, 2, 5), (0.05, 0.5, 0.9)


def _stem(word: str) -> str:
    return word[:-1] if len(word) > 3 and word.endswith("s") and not word.endswith("ss") else word


# Labelled pages -----------------------------------------------------------------------------------------------

#: Words of class and id, in use on the web, by what they hold.
FRAME_WORDS = {
    "nav": "nav navbar navigation menu menubar topnav mainmenu breadcrumb breadcrumbs crumbs pagination pager skip toc tabs",
    "header": "header masthead topbar banner logo branding",
    "footer": "footer colophon copyright legal bottom credits",
    "aside": "sidebar side aside widget widgets rail related recommended popular trending teaser promo toplist tags categories archive",
    "div": "ad ads advert advertisement adverts adsense sponsored sponsor promo promotion banner-ad commercial outbrain taboola",
    "notice": "cookie cookies consent gdpr notice alert warning message privacy popup modal overlay dialog paywall disclaimer",
    "form": "form newsletter subscribe signup login search searchbox register contact",
    "comment": "comment comments commentlist comment-list disqus discussion responses replies reply reader-comments user-comments feedback reviews",
    "share": "share sharing social follow toolbar print",
}
BODY_WORDS = "content article post entry story main text body post-content entry-content article-body story-body main-content page wrapper container row col".split()
#: Words of frames that may also begin the name of a part of an article: "related-history", "share-price".
SHARED_WORDS = "related share alert warning message notice info legal bottom credits archive categories tags top".split()
KNOWN = {_stem(w) for words in (*FRAME_WORDS.values(), " ".join(BODY_WORDS)) for x in words.split() for w in x.split("-")}
FRAMED = {f"w:{_stem(w)}" for words in FRAME_WORDS.values() for x in words.split() for w in x.split("-")} | {"nav", "footer", "aside", "form", "dialog"}
_SYLLABLES = "ba re li no tu ka mer sol den fir gul hap ion est ure al".split()


#: The share of frames in training whose names are no words that are known.
UNNAMED = 0.2


def labelled_pages(count: int, seed: int = 7, names: dict[str, str] = FRAME_WORDS) -> list[str]:
    """Pages whose elements carry data-y="1" where content begins and data-y="0" where it ends; names: the frames' words."""
    rng = random.Random(seed)

    def words(lo: int, hi: int, stop: str = ".") -> str:
        n = rng.randint(lo, hi)
        return " ".join("".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + stop

    def cls(kind: str, y: str = "") -> str:
        picked = rng.choice(names[kind].split()) if rng.random() > UNNAMED else words(1, 1, "").lower()
        return f" {rng.choice(['class', 'class', 'id'])}=\"{picked}\"{y}"

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{words(1, 5, "")}</a></li>' for _ in range(n)) + "</ul>"

    def frame(inside: bool) -> str:
        y = ' data-y="0"'
        kind = rng.choice(["nav", "header", "footer", "aside", "div", "div", "notice", "form", "comment", "comment", "share"])
        text = f"<p>{words(3, 50)}</p>" if rng.random() < 0.7 else words(3, 40)
        if kind == "nav":
            return f"<{rng.choice(['nav', 'div'])}{cls('nav', y)}>{links(rng.randint(2, 8))}</div></nav>" if rng.random() < 0.6 else f"<nav{y}>{links(rng.randint(2, 7))}</nav>"
        if kind == "header" and not inside:
            return f"<header{rng.choice([y, cls('header', y)])}><a href=\"/\">{words(1, 3, '')}</a><p>{words(2, 8, '')}</p></header>"
        if kind == "footer":
            return f"<footer{rng.choice([y, cls('footer', y)])}>{rng.choice(['&copy; ', 'Copyright ', ''])}{words(2, 12)}{links(2) if rng.random() < 0.4 else ''}</footer>"
        if kind == "aside":
            tag = rng.choice(["aside", "div", "section"])
            own = y if tag == "aside" and rng.random() < 0.5 else cls("aside", y)
            return f"<{tag}{own}><h3>{words(1, 4, '')}</h3>{rng.choice([links(4), text])}</{tag}>"
        if kind == "notice":
            tag = rng.choice(["div", "div", "section", "dialog"])
            return f"<{tag}{cls('notice', y)}>{text}<button>{words(1, 2, '')}</button></{tag}>"
        if kind == "form":
            return f"<form{rng.choice([y, cls('form', y)])}><label>{words(1, 3, '')}</label><input><p>{words(3, 20)}</p><button>{words(1, 2, '')}</button></form>"
        if kind == "comment":
            tag = rng.choice(["div", "section", "ol"])
            item = rng.choice(["li", "li", "div", "div", "div", "article", "p", "p"])
            each = "".join(f"<{item}{cls('comment') if rng.random() < 0.7 else ''}>{rng.choice(['', f'<b>{words(1, 2, "")}</b>'])}<p>{words(4, 80)}</p></{item}>" for _ in range(rng.randint(1, 4)))
            return f"<{tag}{cls('comment', y)}>{rng.choice(['', f'<h3>{words(1, 3, "")}</h3>'])}{each}</{tag}>"
        if kind == "share":
            return f"<div{cls('share', y)}>{rng.choice([links(3), words(2, 6, '')])}</div>"
        return f"<{rng.choice(['div', 'div', 'section'])}{cls('div', y)}>{text}</div></section>"

    pages = []
    for _ in range(count):
        parts = [f"<h1>{words(2, 12, rng.choice(['', '.']))}</h1>"]
        for _ in range(rng.randint(1, 12)):
            roll = rng.random()
            if roll < 0.65:
                parts.append(rng.choice([f"<p>{words(1, 120)}</p>", f"<p>{words(1, rng.choice([3, 12, 40]), rng.choice(['.', '']))}</p>", f"<p><b>{words(1, rng.choice([3, 30, 90]), rng.choice(['.', '']))}<br><p>{words(1, rng.choice([4, 90]))}", f"<p>{words(2, 40)} <a href=\"/y\">{words(1, 3, '')}</a> {words(2, 40)}</p>"]))
            elif roll < 0.74:
                parts.append(f"<h{rng.randint(2, 4)}>{words(1, 8, '')}</h2>")
            elif roll < 0.80:
                parts.append(f"<{rng.choice(['ul', 'ol'])}>" + "".join(f"<li>{words(2, 25)}</li>" for _ in range(rng.randint(2, 5))) + "</ul></ol>")
            elif roll < 0.84:
                parts.append(f"<blockquote>{words(4, 50)}</blockquote>")
            elif roll < 0.87:
                parts.append(f"<table><tr><td>{words(1, 5, '')}</td><td>{words(1, 8, '')}</td></tr></table>")
            elif roll < 0.88:
                parts.append(f"<p><a href=\"/y\">{words(2, 14, rng.choice(['', '.']))}</a>{rng.choice(['', '.', ' ' + words(1, 3, '')])}</p>")
            elif roll < 0.92:
                parts.append(rng.choice([
                    f'<{(tag := rng.choice(["div", "section"]))} class="{rng.choice(SHARED_WORDS)}-{words(1, 1, "").lower()}">' + "".join(f"<p>{words(8, 60)}</p>" for _ in range(rng.randint(1, 4))) + f"</{tag}>",
                    f"<p>{words(2, 30, '')} &copy; {words(1, 20)}</p>", f"<{rng.choice(['ul', 'ol'])}>" + "".join(f'<li><a href="/s">{words(2, 12, "")}</a>{rng.choice(["", " " + words(1, 6)])}</li>' for _ in range(rng.randint(2, 6))) + "</ul></ol>",
                ]))
            elif roll < 0.93:
                parts.append(f"<figure><img><figcaption>{words(2, 14)}</figcaption></figure>")
            else:
                parts.append(frame(True))
        if rng.random() < 0.3:
            parts.append(frame(True))
        y, inner = ' data-y="1"', "".join(parts)
        shape = rng.random()
        if shape < 0.5:
            body = f"<article{y}>{inner}</article>"
        elif shape < 0.65:
            body = f"<main{y}><article>{inner}</article></main>"
        elif shape < 0.75:
            body = f"<main{y}>{inner}</main>"
        elif shape < 0.86:
            body = f'<div class="{rng.choice(BODY_WORDS)}"{y}>{inner}</div>'
        else:  # nothing but what it holds tells what it is
            body = f"<{rng.choice(['div', 'section'])}{rng.choice(['', f' class={words(1, 1, str()).lower()}', f' id={words(1, 1, str()).lower()}{rng.randint(0, 9)}'])}{y}>{inner}</div></section>"
        if rng.random() < 0.3:
            body = f'<div class="{rng.choice(BODY_WORDS)}">{body}</div>'
        head = rng.random()
        if head < 0.25:
            body = body.replace("<h1>", "<header><h1>", 1).replace("</h1>", "</h1></header>", 1)
        elif head < 0.35:
            body = body.replace("<h1>", f'<div class="{rng.choice(BODY_WORDS)}-{rng.choice(["header", "head", "title"])}"><h1>', 1).replace("</h1>", "</h1></div>", 1)
        before = "".join(frame(False) for _ in range(rng.randint(0, 3)))
        after = "".join(frame(False) for _ in range(rng.randint(0, 4)))
        whole = f"{before}{body}{after}"
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            whole = f'<div {rng.choice(["id", "class"])}="{rng.choice(BODY_WORDS)}">{whole}</div>'
        page = f"<!DOCTYPE html><html><head><title>{words(2, 6, '')}</title></head><body>{whole}"
        pages.append(page[: rng.randint(len(page) * 3 // 4, len(page))] if rng.random() < 0.1 else page + "</body></html>")
    return pages


# The graphical model ------------------------------------------------------------------------------------------


class Forest:
    """The trees of several pages as arrays, in levels of equal depth."""

    def __init__(self, pages: list[Page], place: dict[str, int]):
        base = np.cumsum([0] + [len(p.parent) for p in pages])
        self.parent = np.concatenate([np.where((x := np.array(p.parent)) < 0, -1, x + b) for p, b in zip(pages, base)])
        self.label = np.concatenate([np.array(p.label) for p in pages])
        self.leaf = np.zeros(len(self.parent), bool)
        self.leaf[[b + x for p, b in zip(pages, base) for x in p.leaves]] = True
        get = place.get
        found = [(i, f) for i, t in enumerate(t for p in pages for t in p.traits) for x in t if (f := get(x)) is not None]
        self.node, self.feature = (np.array(x, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        depth = np.zeros(len(self.parent), np.int64)
        for p, b in zip(pages, base):
            own = [0] * len(p.parent)
            for i in range(1, len(own)):
                own[i] = own[p.parent[i]] + 1
            depth[b : b + len(own)] = own
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
        self.base = base

    def marginals(self, unary: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each node, and the joint of each node with its parent. unary: log odds of content by
        feature; edge: log potentials [leaf or not, parent's label, own label]."""
        n = len(self.parent)
        own = np.zeros((n, 2))
        own[:, 1] = np.bincount(self.node, unary[self.feature], n)
        pair = edge[self.leaf.astype(int)]
        up, to_parent = own.copy(), np.zeros((n, 2))  # upward: what the subtree says of the node, and tells the parent
        for level in self.levels[:0:-1]:
            to_parent[level] = np.logaddexp(pair[level, :, 0] + up[level, None, 0], pair[level, :, 1] + up[level, None, 1])
            np.add.at(up, self.parent[level], to_parent[level])
        down = np.zeros((n, 2))  # downward: what the rest of the tree says of the node
        joint = np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            above = up[self.parent[level]] + down[self.parent[level]] - to_parent[level]
            both = above[:, :, None] + pair[level]
            down[level] = np.logaddexp(both[:, 0], both[:, 1])
            down[level] -= down[level].max(1, keepdims=True)
            both = both + up[level][:, None, :]
            both = np.exp(both - both.max((1, 2), keepdims=True))
            joint[level] = both / both.sum((1, 2), keepdims=True)
        total = up + down
        return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -700, 700))), joint


@lru_cache(2)
def fit(count: int = PAGES, steps: int = STEPS) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """The features' places, their weights and the edge potentials, by Adam on the exact likelihood."""
    pages = [Page(p, marked=True) for p in labelled_pages(count)]
    names = sorted({x for p in pages for t in p.traits for x in t})
    place = {x: i for i, x in enumerate(names)}
    forest = Forest(pages, place)
    y, n = forest.label, len(forest.label)
    for level in forest.levels[:0:-1]:  # an element that holds content is content
        np.maximum.at(y, forest.parent[level], y[level])
    has = forest.parent >= 0
    parents, kinds = y[forest.parent[has]], forest.leaf[has].astype(int)
    w = np.zeros(len(names) + 8)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        p, joint = forest.marginals(w[:-8], w[-8:].reshape(2, 2, 2))
        g = np.zeros_like(w)
        g[:-8] = np.bincount(forest.feature, (y - p)[forest.node], len(names))
        seen = np.zeros((2, 2, 2))
        np.add.at(seen, (kinds, parents, y[has]), 1)
        for k in (0, 1):
            seen[k] -= joint[has][kinds == k].sum(0)
        g[-8:] = seen.ravel()
        g = g / n - PENALTY * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return place, w[:-8], w[-8:].reshape(2, 2, 2)


def texts(sources: list[str], model: tuple[dict[str, int], np.ndarray, np.ndarray]) -> list[str]:
    out, held, nodes = [], [], 0

    def end() -> None:
        forest = Forest(held, model[0])
        content = forest.marginals(model[1], model[2])[0] >= 0.5
        out.extend("\n".join(t for i, t in zip(p.leaves, p.texts) if content[b + i]) for p, b in zip(held, forest.base))
        held.clear()

    for source in sources:
        held.append(Page(source))
        nodes += len(held[-1].parent)
        if nodes >= STEP_NODES:
            end()
            nodes = 0
    if held:
        end()
    return out


def main_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), model=None) -> DataFrame:
    """The columns `keep` with text, the main text of each page."""
    names = list(keep)
    shared = pages.sparkSession.sparkContext.broadcast(model or fit())
    out, arrow = common.schema_of(pages, names, "text string")

    def run(batches):
        model = shared.value
        for batch in batches:
            column = batch.column(len(names))
            for lo, hi in common.steps(common.utf8(column)[1]):
                found = texts([x or "" for x in column.slice(lo, hi - lo).to_pylist()], model)
                yield common.columns(batch, lo, hi, names, {"text": pa.array(found, pa.string())}, arrow)

    return common.mapped(pages.select(*names, F.col(html)), run, out)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, and its length in code points."""
    return main_text(common.table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
