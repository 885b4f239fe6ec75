"""Operator 10: main text of web pages by a conditional random field.

A page becomes the sequence of its leaf blocks: runs of text between block-level
tags.  A linear-chain CRF over the blocks, with features of their ancestors
(tags, words of class, id and role) and of their text, labels each as main text
or not; Viterbi finds the best labels.  It is trained on labelled pages that
labelled_page() lays out in many ways.

An element that holds much of the page tells little of any one block in it, so
what wide elements are and are called makes features of its own; what html and
body are called, none.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import bounded

#: Labelled pages the model is trained on, and the seed that lays them out.
TRAINING_PAGES = 1200
TRAINING_SEED = 7

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_UNQUOTED = re.compile(r"""[^>"']*""")
_COMMENT_END = re.compile(r"--!?>")
_NAME = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements whose content is no text of the page.
OMIT = frozenset("script style noscript template svg math head title textarea select iframe object canvas audio video map".split())
#: Elements whose content is plain characters up to their end tag.
RAW = frozenset("script style textarea title iframe".split())
#: Elements with a syntax of their own, in which "/>" ends an element, and the HTML elements that end them.
FOREIGN = ("svg", "math")
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Elements that can stand in a head; any other ends it, as its end tag can be left out.
HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What an opening tag ends, up to the element in which it stands.
ENDS = {"li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Parts of class, id and role names that tell what an element is for.
NAMES = {
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion dfp banner", "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc skip",
    "header": "header masthead topbar top logo branding", "footer": "footer bottom copyright colophon legal", "side": "side sidebar aside rail widget widgets secondary complementary related recommended popular trending more",
    "comment": "comment comments reply replies disqus discussion respond reader response responses feedback reaction reactions opinions guestbook talkback conversation thoughts remarks", "notice": "notice notices cookie cookies consent gdpr alert message banner popup modal overlay warning privacy",
    "form": "form newsletter subscribe subscription signup login search contact poll", "share": "share sharing social follow twitter facebook tags tag meta byline author bio", "main": "article content main post entry body story text page prose copy",
}
_GROUP = {word: group for group, ws in NAMES.items() for word in ws.split()}
_LEXICAL = (
    ("cookie", re.compile(r"\b(cookies?|consent|privacy|gdpr)\b", re.I)), ("legal", re.compile(r"©|\(c\)|\ball rights reserved\b|\bterms\b|\bimprint\b", re.I)),
    ("talk", re.compile(r"\b(comments?|responses?|replies|reactions?|thoughts on|discussion|feedback)\b", re.I)), ("action", re.compile(r"\b(subscribe|sign ?up|log ?in|share|follow|click|download|buy|reply|register|search|submit|e-?mail)\b", re.I)), ("advert", re.compile(r"\b(advert\w*|sponsored|promot\w+)\b", re.I)),
)


@dataclass(eq=False, slots=True)
class Element:
    """An open element; what it and all around it say together is known once the page is read."""

    name: str = ""
    up: Element | None = None
    #: groups of its own names
    own: frozenset[str] = frozenset()
    #: number of this chain of element names in its page
    place: int = 0
    #: characters of text in it, and whether a main heading is there
    size: int = 0
    headed: bool = False
    #: all elements around, and those of them that hold much of the page
    tags: frozenset[str] = frozenset()
    wide_tags: frozenset[str] = frozenset()
    groups: frozenset[str] = frozenset()
    wide_groups: frozenset[str] = frozenset()
    #: groups of the nearest element that has any, and whether that is a wide one
    nearest: frozenset[str] = frozenset()
    nearest_wide: bool = False
    #: the nearest sectioning element that is not wide, or is an article or main
    around: str = "none"

    def settle(self, total: int, headed: bool) -> None:
        """Takes over what the element around it says; total and headed are the page's."""
        up = self.up
        wide = self.headed and 3 * self.size >= total or not headed and 2 * self.size >= total
        known = self.name in up.tags
        self.tags = up.tags if known else up.tags | {self.name}
        self.wide_tags = up.wide_tags | {self.name} if wide and self.name not in up.wide_tags else up.wide_tags
        self.groups, self.wide_groups, self.nearest, self.nearest_wide = up.groups, up.wide_groups, up.nearest, up.nearest_wide
        if self.own and self.name not in ("html", "body"):
            self.nearest, self.nearest_wide = self.own, wide
            if wide:
                self.wide_groups = up.wide_groups | self.own
            else:
                self.groups = up.groups | self.own
        self.around = self.name if self.name in _SECTIONS and (not wide or self.name in ("article", "main")) else up.around


_SECTIONS = frozenset("article main nav aside footer header form section".split())


def _groups(element: str, attributes: str) -> frozenset[str]:
    """What the names in an element's attributes tell; a name of an article that tells of main text only outweighs its others."""
    found = []
    for names in _NAME.findall(attributes):
        for name in "".join(names).split():
            own = frozenset(g for part in _PART.findall(name) if (g := _GROUP.get(part.lower())))
            if own:
                found.append(own)
    if element in ("article", "main") and frozenset({"main"}) in found:
        return frozenset({"main"})
    return frozenset().union(*found)


@dataclass
class Block:
    text: str
    element: Element
    linked: int = 0


class _Reader:
    """Blocks of a page, in time linear in its tags: every step looks only at what it opens or closes."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.root = Element()
        self.elements: list[Element] = []
        self.stack: list[Element] = []
        #: for each name the places in the stack, under "#block" those of all block elements but p
        self.where: dict[str, list[int]] = {n: [] for n in (*BLOCK, *OMIT, "foreignobject", "#block")}
        self.places: dict[tuple[int, str], int] = {}
        self.parts: list[str] = []
        self.linked, self.in_link, self.omitted = 0, False, 0

    def text(self, raw: str) -> None:
        if self.stack and self.stack[-1].name == "head" and raw and not raw.isspace():
            self.end_head()
        if raw and not self.omitted:
            text = entities.unescape(raw) if "&" in raw else raw
            self.parts.append(text)
            if self.in_link:
                self.linked += len(text.strip())

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                own = self.stack[-1] if self.stack else self.root
                own.size += len(text)
                own.headed |= own.name == "h1"
                self.blocks.append(Block(text, own, self.linked))
            self.parts = []
        self.linked, self.in_link = 0, False

    def top(self, names: Iterable[str]) -> int:
        """Place of the innermost open element of these names; -1 if none is open."""
        return max((self.where[n][-1] for n in names if self.where[n]), default=-1)

    def foreign(self) -> bool:
        return (k := self.top(FOREIGN)) >= 0 and k > self.top(("foreignobject",))

    def cut(self, k: int) -> None:
        """Closes the element at k and all inside it."""
        while len(self.stack) > k:
            name = self.stack.pop().name
            self.where[name].pop()
            if name in BLOCK and name != "p":
                self.where["#block"].pop()
            self.omitted -= name in OMIT

    def close(self, name: str) -> None:
        if self.where[name]:
            self.cut(self.where[name][-1])

    def end_head(self) -> None:
        while self.stack and self.stack[-1].name == "head":
            self.cut(len(self.stack) - 1)

    def open(self, name: str, attributes: str) -> None:
        inner, limit = ENDS.get(name) or ((("p",), ("#block",)) if name in BLOCK else ((), ()))
        while (k := self.top(inner)) > self.top(limit):
            self.cut(k)
        up = self.stack[-1] if self.stack else self.root
        place = self.places.setdefault((up.place, name), len(self.places) + 1)
        self.where[name].append(len(self.stack))
        if name in BLOCK and name != "p":
            self.where["#block"].append(len(self.stack))
        self.stack.append(Element(name, up, _groups(name, attributes) if "=" in attributes else frozenset(), place))
        self.elements.append(self.stack[-1])
        self.omitted += name in OMIT

    def settle(self) -> None:
        for e in reversed(self.elements):
            e.up.size += e.size
            e.up.headed |= e.headed
        for e in self.elements:
            e.settle(self.root.size, self.root.headed)


class _Tags:
    """Where tags end: past the first ">" outside of quotes, or if there is none past the first ">"."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.last = {c: page.rfind(c) for c in "\"'>"}
        #: quotes after which no ">" outside of quotes comes; so no stretch is searched twice
        self.dead: set[int] = set()

    def end(self, at: int) -> int:
        page, i, seen = self.page, at, []
        while (i := _UNQUOTED.match(page, i).end()) < len(page) and i not in self.dead:
            if page[i] == ">":
                return i + 1
            seen.append(i)
            if self.last[page[i]] == i:
                break
            i = page.index(page[i], i + 1) + 1
        self.dead.update(seen)
        return page.index(">", at) + 1

    def at(self, start: int) -> tuple[int, bool, str, str] | None:
        """(end, is an end tag, name, attributes) of the tag that begins at start; a comment has no name."""
        page = self.page
        if page.startswith("<!--", start):
            found = _COMMENT_END.search(page, start + 2)
            return (found.end() if found else len(page)), False, "", ""
        if self.last[">"] < start:
            return None
        if page.startswith(("<!", "<?"), start):
            return page.index(">", start) + 1, False, "", ""
        m = _TAG.match(page, start)
        if m is None:
            return None
        end = self.end(m.end())
        return end, bool(m[1]), m[2].lower(), page[m.end() : end - 1]


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order; white space, also that of references, is one space."""
    r, tags, at, look = _Reader(), _Tags(page), 0, 0
    while (start := page.find("<", look)) >= 0:
        tag = tags.at(start)
        if tag is None:
            look = start + 1
            continue
        r.text(page[at:start])
        at, closing, name, attributes = tag
        if closing:
            if name in BLOCK:
                r.flush()
            if name == "a":
                r.in_link = False
            elif name in r.where:
                r.close(name)
        elif name:
            at = _start(r, page, at, name, attributes)
        look = at
    r.text(page[at:])
    r.flush()
    r.settle()
    return r.blocks


def _start(r: _Reader, page: str, at: int, name: str, attributes: str) -> int:
    """Takes a start tag; where to read on."""
    if name not in HEAD:
        r.end_head()
    if r.foreign():
        if name in BREAKOUT:
            r.cut(min(r.where[n][0] for n in FOREIGN if r.where[n]))
        elif attributes.endswith("/"):
            return at
    if name in FOREIGN and attributes.endswith("/"):
        return at
    if name == "br":
        r.text(" ")
    elif name in VOID:
        if name in BLOCK:
            r.flush()
    elif name in RAW:
        end = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
        return len(page) if end is None else (page.find(">", end.start()) + 1 or len(page))
    elif name in BLOCK or name in OMIT or (name == "foreignobject" and r.foreign()):
        if name in BLOCK:
            r.flush()
        r.open(name, attributes)
    elif name == "a":
        r.in_link = True
    return at


def _bucket(n: float, edges: tuple[float, ...]) -> int:
    return sum(n >= e for e in edges)


_ANCESTORS = frozenset("nav aside footer header form ul ol table blockquote figure button dialog details label fieldset section".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def features(page: list[Block]) -> list[list[str]]:
    out, under = [], False
    repeated = Counter(b.element.place for b in page)
    for i, b in enumerate(page):
        e, length, density = b.element, len(b.text), b.linked / max(1, len(b.text))
        inside = "article" if "article" in e.tags else "main" if "main" in e.tags else "none"
        f = ["bias", f"tag={e.name}", f"in={inside}", f"around={e.around}", f"length={_bucket(length, (20, 60, 120, 250, 500))}", f"links={_bucket(density, (0.01, 0.3, 0.7))}"]
        f += [f"ancestor={n}" for n in e.tags & _ANCESTORS if n not in e.wide_tags] + [f"wide-ancestor={n}" for n in e.wide_tags & _ANCESTORS]
        f += [f"name={g}" for g in e.groups] + [f"wide-name={g}" for g in e.wide_groups]
        f += [f"{'wide-near' if e.nearest_wide else 'near'}={g}" for g in e.nearest]
        says = [k for k, p in _LEXICAL if length < 400 and p.search(b.text)]
        f += [f"says={k}" for k in says]
        if e.name in _HEADINGS:
            under = "talk" in says
        if under:
            f.append("under=talk")
        f.append(f"stop={b.text[-1] in '.!?…:;”\"' }")
        f.append(f"place={_bucket(i / max(1, len(page) - 1), (0.05, 0.2, 0.8, 0.95))}")
        f.append(f"like={_bucket(repeated[e.place], (2, 4, 8))}")
        f.append(f"blocks={_bucket(len(page), (2, 4, 8))}")
        out.append(f)
    return out


@dataclass(frozen=True)
class Model:
    #: score of main text less that of the rest
    weights: dict[str, float]
    #: [from][to], label 1 is main text
    moves: tuple[tuple[float, float], tuple[float, float]]

    def label(self, page: list[Block]) -> list[bool]:
        """Viterbi."""
        if not page:
            return []
        (a, b), (c, d) = self.moves
        scores = [sum(self.weights.get(f, 0.0) for f in fs) for fs in features(page)]
        zero, one, back = 0.0, scores[0], []
        for s in scores[1:]:
            from0, from1 = (zero + a >= one + c), (zero + b > one + d)
            zero, one = (zero + a if from0 else one + c), (zero + b if from1 else one + d) + s
            back.append((0 if from0 else 1, 0 if from1 else 1))
        now = int(one > zero)
        out = [now]
        for choice in reversed(back):
            now = choice[now]
            out.append(now)
        return [bool(x) for x in reversed(out)]


def train(pages: list[tuple[list[Block], list[bool]]], steps: int = 150, penalty: float = 1e-3) -> Model:
    """Maximum likelihood with an L2 penalty, by Adam on all pages at once."""
    pages = [p for p in pages if p[0]]
    names: dict[str, int] = {}
    place, feature, y = [], [], []
    width, at = max(len(b) for b, _ in pages), 0
    for k, (bs, labels) in enumerate(pages):
        for i, fs in enumerate(features(bs)):
            for f in fs:
                place.append(k * width + i)
                feature.append(names.setdefault(f, len(names)))
            at += 1
    place, feature = np.array(place), np.array(feature)
    size = np.array([len(b) for b, _ in pages])
    y = np.zeros((len(pages), width), int)
    for k, (_, labels) in enumerate(pages):
        y[k, : len(labels)] = labels
    live = np.arange(width) < size[:, None]
    joint = live[:, 1:]
    theta, m, v = np.zeros(len(names) + 4), 0.0, 0.0
    for step in range(1, steps + 1):
        emit = np.bincount(place, theta[:-4][feature], len(pages) * width).reshape(len(pages), width)
        move = theta[-4:].reshape(2, 2)
        score = np.stack([np.zeros_like(emit), emit], -1)
        alpha, beta = np.zeros_like(score), np.zeros_like(score)
        alpha[:, 0] = score[:, 0]
        for t in range(1, width):
            new = np.logaddexp(alpha[:, t - 1, :1] + move[0], alpha[:, t - 1, 1:] + move[1]) + score[:, t]
            alpha[:, t] = np.where(live[:, t, None], new, alpha[:, t - 1])
        for t in range(width - 2, -1, -1):
            ahead = score[:, t + 1] + beta[:, t + 1]
            new = np.logaddexp(move[:, 0] + ahead[:, :1], move[:, 1] + ahead[:, 1:])
            beta[:, t] = np.where(live[:, t + 1, None], new, 0)
        total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        one = np.exp(alpha[..., 1] + beta[..., 1] - total[:, None]) * live
        grad = np.bincount(feature, ((y - one) * live).ravel()[place], len(names))
        pair = alpha[:, :-1, :, None] + move + (score + beta)[:, 1:, None, :]
        seen = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                seen[a, b] = ((y[:, :-1] == a) & (y[:, 1:] == b) & joint).sum() - (np.exp(pair[:, :, a, b] - total[:, None]) * joint).sum()
        g = np.append(grad, seen.ravel()) / live.sum() - penalty * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    moves = theta[-4:].reshape(2, 2)
    return Model({f: float(theta[i]) for f, i in names.items()}, tuple(tuple(float(x) for x in r) for r in moves))


# --- labelled pages ---------------------------------------------------------------------------------------------------

#: Names that pages give to what holds all of their text.
_WIDE = (
    "comments-open", "single comments-open", "has-sidebar", "header-fixed", "sidebar-right", "no-sidebar", "header-fixed sidebar-right", "with-menu", "nav-open", "page-footer-dark", "ad-free", "banner-top", "share-on", "form-page", "comment-open", "menu-left", "notice-shown",
    "layout-side", "widget-ready", "site", "wrapper", "container", "page single", "archive tag-news", "login-page", "top", "message-board",
)
_SYLLABLES = "ba co de fi gu la me no pi ra se ti vo an er in on st tion ly ment".split()


def _words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n))


def _sentences(r: random.Random, n: int) -> str:
    return " ".join(_words(r, r.randint(3, 16)).capitalize() + r.choice(".....!?") for _ in range(n))


def labelled_page(r: random.Random) -> tuple[list[Block], list[bool]]:
    """A page laid out at random, and which of its blocks are main text."""
    yes, out = "\ue000", []  # marks main text

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{i}">{_words(r, r.randint(1, 3))}</a></li>' for i in range(n))

    def aside_text() -> str:
        return r.choice([_words(r, r.randint(1, 6)), _sentences(r, 1), _sentences(r, r.randint(1, 3))])

    def rest(kind: str) -> str:
        tag = lambda own: own if r.random() < 0.6 else "div"
        name = lambda ws: f' {r.choice(["class", "id"])}="{r.choice(ws.split())}"' if r.random() < 0.85 else ""
        if kind == "nav":
            t = tag("nav")
            return f"<{t}{name('nav menu navbar breadcrumb main-nav') if t == 'nav' else ' class=' + r.choice(['menu', 'nav', 'navbar'])}><ul>{links(r.randint(2, 9))}</ul></{t}>"
        if kind == "header":
            t = tag("header")
            own = name("site-header header masthead") if t == "header" else ' class="header"'
            return f"<{t}{own}><{(h := r.choice(['h1', 'h2', 'p', 'div', 'span']))}>{_words(r, r.randint(1, 5))}</{h}><p>{aside_text()}</p></{t}>"
        if kind == "footer":
            t = tag("footer")
            own = name("footer site-footer") if t == "footer" else ' id="footer"'
            return f"<{t}{own}><p>{r.choice(['&copy; ', '', 'Copyright 2020 '])}{aside_text()} {r.choice(['All rights reserved.', '&middot; ' + _sentences(r, 1)])}</p>{r.choice(['', '<ul>' + links(3) + '</ul>'])}</{t}>"
        if kind == "side":
            t = tag("aside")
            own = name("sidebar widget related") if t == "aside" else ' class="sidebar"'
            return f"<{t}{own}><h3>{_words(r, 2)}</h3>" + "".join(f"<p>{aside_text()}</p>" for _ in range(r.randint(0, 3))) + f"<ul>{links(r.randint(0, 5))}</ul></{t}>"
        if kind == "ad":
            own = r.choice("ad ads advert ad-box sponsored promo advertisement banner".split())
            t = r.choice(["div", "div", "aside", "section"])
            return f'<{t} {r.choice(["class", "id"])}="{own}">' + r.choice(["{}", "<p>{}</p>", "<a href='#'>{}</a>"]).format(aside_text()) + f"</{t}>"
        if kind == "notice":
            t = r.choice(["div", "section", "aside", "dialog"])
            own = r.choice(["notice", "cookie-notice", "cookie-banner", "alert", "consent", "message"])
            return f'<{t} {r.choice(["class", "id", "role"])}="{own}"><p>{r.choice([aside_text(), "We use cookies. " + aside_text()])}</p>{r.choice(["", "<button>OK</button>"])}</{t}>'
        if kind == "form":
            own = r.choice(["", ' class="newsletter"', ' class="search-form"', ' id="login"'])
            return f"<form{own}><label>{_words(r, 2)}</label><input type=text><p>{aside_text()}</p><button>{_words(r, 1)}</button></form>"
        if kind == "share":
            return f'<div class="{r.choice(["share", "social", "tags"])}"><a href="#">{_words(r, 1)}</a> <a href="#">{_words(r, 1)}</a></div>'
        if kind == "bare":  # what a page without any names has
            anchors = " ".join(f'<a href="/{i}">{_words(r, r.randint(1, 2))}</a>{r.choice(["", "<br>"])}' for i in range(r.randint(2, 6)))
            t = r.choice(["div", "p", "td", "center"])
            return r.choice([f"<{t}>{_words(r, r.randint(1, 3))}</{t}>", f"<{t}>{anchors}</{t}>", f"<{t}>{anchors}</{t}>"])
        if kind == "imprint":
            t = r.choice(["div", "p", "center", "address"])
            return f"{r.choice(['', '<hr>'])}<{t}>{r.choice(['&copy; ', 'Copyright ', '(c) '])}{_words(r, r.randint(1, 5))}{r.choice(['', '. All rights reserved.', ' <a href=/x>Terms of use</a>'])}</{t}>"
        if kind == "meta":
            t = r.choice(["p", "div", "span", "div"])
            own = r.choice(["", ' class="byline"', ' class="entry-meta"', ' class="author"', ' class="post-meta"'])
            return f"<{t}{own}>{r.choice(['By ', 'Posted on ', 'Published ', ''])}{_words(r, r.randint(1, 4))} <a href=/x>{_words(r, r.randint(1, 2))}</a></{t}>"
        t = r.choice(["section", "div", "ol", "ul"])
        inner = "li" if t in ("ol", "ul") else r.choice(["div", "p", "article"])
        own = r.choice(["comments", "comment-list", "reader-comments", "discussion", "comments-area", "responses", "feedback", "reactions", "talkback", "opinions", "x1"])
        said = r.choice(["Comments", "{n} comments", "Responses", "{n} responses", "Discussion", "Reader comments", "Leave a reply", "{n} thoughts on " + _words(r, 2)]).format(n=r.randint(1, 40))
        head = "" if t in ("ol", "ul") and own != "x1" else f"<h{(h := r.choice((2, 3, 4)))}>{said if own == 'x1' or r.random() < 0.6 else _words(r, 1)}</h{h}>"
        return f'<{t} {r.choice(["class", "id"])}="{own}">{head}' + "".join(f'<{inner}{r.choice(["", " class=comment"])}>' + r.choice(["{}", "<p>{}</p>"]).format(_sentences(r, r.randint(1, 4))) + f"</{inner}>" for _ in range(r.randint(1, 5))) + f"</{t}>"

    def main() -> str:
        parts = []
        if r.random() < 0.9:
            title = f"<h1>{yes}{r.choice([_words(r, r.randint(2, 9)), _sentences(r, 1)])}</h1>"
            top = r.random()
            parts.append(f"<header{r.choice(['', ' class=entry-header'])}>{title}{r.choice(['', rest('meta')])}</header>" if top < 0.15 else title + rest("meta") if top < 0.25 else title)
        for _ in range(r.choice([1, 2, 4, 6, 9, 14])):
            kind = r.random()
            text = yes + (_sentences(r, r.choice([1, 1, 2, 4, 8])) if r.random() < 0.9 else _words(r, r.randint(1, 3)) + r.choice([".", ""]))
            if kind < 0.68:
                parts.append(f"<p>{text}{r.choice(['</p>', '</p>', '</p>', ''])}")
            elif kind < 0.76:
                parts.append(f"<p><b>{text}<br>")
            elif kind < 0.82:
                parts.append(f"<h{(h := r.randint(2, 4))}>{yes}{_words(r, r.randint(1, 6))}{' feedback' if r.random() < 0.02 else ''}</h{h}>")
            elif kind < 0.88:
                parts.append("<ul>" + "".join(f"<li>{yes}{r.choice([_words(r, 4), _sentences(r, 1)])}</li>" for _ in range(r.randint(1, 4))) + "</ul>")
            elif kind < 0.92:
                parts.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind < 0.95:
                parts.append("<table>" + "".join(f"<tr><td>{yes}{_words(r, 2)}</td><td>{yes}{_words(r, 1)}</td></tr>" for _ in range(2)) + "</table>")
            else:
                parts.append(f"<pre>{text}</pre>")
        for kind in r.sample(["ad", "share", "side", "notice", "form", "comments"], r.choice([0, 0, 0, 1, 2])):
            parts.insert(len(parts) if kind == "comments" else r.randint(1, len(parts)), rest(kind))
        if r.random() < 0.1:
            parts.append(f"<footer{r.choice(['', ' class=entry-footer'])}>{_words(r, 1)} <a href=/x>{_words(r, 1)}</a></footer>")
        if r.random() < 0.15:
            parts = [f"<section>{''.join(parts[k : k + 3])}</section>" for k in range(0, len(parts), 3)]
        if bare:
            own = r.choice(["div", "div", "div", "table><tr><td"])
            return r.choice([f"<{own}>{''.join(parts)}</{own.split('>')[0]}>", "".join(parts)])
        own = r.choice(['article', 'article', 'article', 'main', 'div class="content"', 'div id="main-content"', 'div class="post"', 'section class="article-body"', 'div', f'article class="{r.choice(["post", "hentry", "entry", "article"])} {r.choice(_WIDE)}"'])
        body = f"<{own}>{''.join(parts)}</{own.split()[0]}>"
        return f"<main>{body}</main>" if r.random() < 0.2 else body

    short = r.random()
    if short < 0.06:  # nothing but a few paragraphs
        own = r.choice(["{}", "{}", "<div>{}</div>", "<main>{}</main>", "<center>{}</center>"])
        out.append(own.format(r.choice(["", "", f"<h1>{yes}{_words(r, 3)}</h1>"]) + "".join(f"<p>{yes}{_sentences(r, r.randint(1, 4))}</p>" for _ in range(r.randint(1, 3)))))
        return _labelled(r, out, yes)
    if short < 0.08:  # nothing of its own
        return _labelled(r, [rest(k) for k in r.sample(["nav", "footer", "notice", "nav"], r.randint(1, 2))], yes)
    bare = r.random() < 0.25
    for kind in ("bare", "bare") if bare else ("notice", "header", "nav", "ad", "form"):
        if r.random() < (0.7 if kind in ("nav", "bare") else 0.35):
            out.append(rest(kind))
    out.append(main())
    if bare and r.random() < 0.8:
        out.append(rest("imprint"))
    for kind in () if bare else ("comments", "side", "form", "ad", "share", "notice", "nav", "footer"):
        if r.random() < (0.7 if kind == "footer" else 0.25):
            out.append(rest(kind))
    return _labelled(r, out, yes)


def _labelled(r: random.Random, parts: list[str], yes: str) -> tuple[list[Block], list[bool]]:
    """The page of these parts, sometimes within elements that hold much of it."""
    wide = r.random()
    if wide < 0.15:
        own = r.choice([f'div class="{r.choice(_WIDE)}"', f'div id="{r.choice(_WIDE).split()[0]}"', 'form id="aspnetForm"', "form", 'form name="form1" id="form1"', f'section class="{r.choice(_WIDE)}"'])
        parts = [f"<{own}>", *parts, f"</{own.split()[0]}>"]
    elif wide < 0.3 and len(parts) > 1:
        k = r.randrange(len(parts))
        parts = [*parts[:k], f'<div class="{r.choice(_WIDE)}">', *parts[k:], "</div>"]
    named = f' class="{r.choice(_WIDE)}"' if r.random() < 0.3 else ""
    found = blocks(f"<!DOCTYPE html><html><head><title>x</title></head><body{named}>{''.join(parts)}</body></html>")
    labels = [b.text.startswith(yes) for b in found]
    for b in found:
        b.text = b.text.removeprefix(yes)
    return found, labels


@lru_cache(maxsize=4)
def trained(pages: int = TRAINING_PAGES, seed: int = TRAINING_SEED) -> Model:
    r = random.Random(seed)
    return train([labelled_page(r) for _ in range(pages)])


def main_text(page: str | None, model: Model) -> str:
    found = blocks(page or "")
    return "\n\n".join(b.text for b, keep in zip(found, model.label(found)) if keep)


def _extract(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, model) for x in batch["html"].to_pylist()]
            yield pa.record_batch([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=("page_id", "url", "text", "n_chars"))

    return run


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    text joins the blocks of main text by an empty line; it is empty if there
    are none, as of a null or empty page.  n_chars counts code points.  Null ids
    and urls are kept, repeated rows are rows of their own, other columns are
    not read.
    """
    model = model or trained()
    return bounded(pages).select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(_extract(model), f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
