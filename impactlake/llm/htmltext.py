"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded top to bottom.

A page is parsed into its elements (character references decoded, unclosed and implied ends
repaired).  Every element that could hold a block gets numeric features: its tag, attribute tokens of its own
and of its ancestors, depth and place, text, link and punctuation density of its subtree, and how
it compares with its siblings.  Gradient-boosted trees, trained here on generated pages whose
parts are known, give the chance that an element belongs to the article.  A dynamic program over the tree
then takes the most likely labels under one rule: nothing is kept inside an element that is dropped.
The kept text is given block by block: white space becomes one blank, blocks are joined by line feeds.
Text that stands in no element of its own (bare in the body, or in no element at all) is judged run by run; so are formulas,
drawings and what stands in for media.  A head that is left open ends where something stands that no head holds.

A null page counts as empty and gives an empty text, as does a page without an article.  Pages of any
length are handled whole.  Rows that repeat give equal results; an empty table gives no rows; other
columns pass through unless they bear the name of an added one.
"""

from __future__ import annotations

import functools
import html as markup
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import extra_columns, read

STOP = re.compile(r"""[>"']""")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
RAW = {"script", "style", "title", "textarea", "iframe", "xmp", "noembed", "noframes", "template"}
GONE = {"button", "select", "option", "optgroup", "datalist", "head"}
OWN = {"math", "svg", "object", "canvas", "audio", "video", "noscript"}  # in the line, but elements of their own: formulas, drawings, what stands in for media
HEAD = {"title", "meta", "link", "script", "style", "base", "noscript", "template"}  # anything else ends an open head
CELL = {"td", "th", "table"}  # an inline end tag does not reach beyond these
LOOSE = {"#", "html", "body"}  # a run of text that stands in these is an element of its own, "#text"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption", "legend", "head"}
ENDS_P = BLOCK - {"html", "body", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
TAGS = ("article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "table", "td", "blockquote", "pre", "figure", "nav", "header", "footer", "aside", "form", "dl", "a", "span", "body", "#text", "math", "svg", "object", "noscript", "video")
GOOD = {"article", "content", "post", "entry", "main", "body", "story", "text", "blog", "page", "prose", "column", "lead", "paragraph"}
BAD = {
    "menu": {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "toolbar", "tabs"},
    "frame": {"header", "footer", "masthead", "topbar", "copyright", "colophon", "legal", "bottom"},
    "side": {"sidebar", "side", "aside", "widget", "rail", "related", "recommended", "popular", "trending", "tags", "teaser", "promo", "more"},
    "ad": {"ad", "ads", "advert", "advertisement", "adslot", "banner", "sponsor", "sponsored", "dfp", "outbrain", "taboola", "commercial"},
    "notice": {"cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay", "alert", "newsletter", "subscribe", "subscription", "signup", "paywall", "banner"},
    "line": {"byline", "author", "authors", "meta", "dateline", "posted", "published", "timestamp", "pubdate"},
    "talk": {"comment", "comments", "respond", "reply", "replies", "disqus", "discussion", "share", "sharing", "social", "form", "search", "login", "rating"},
}
LEX = {"advertisement", "sponsored", "cookie", "cookies", "subscribe", "newsletter", "copyright", "comments", "comment", "reply", "related", "share", "follow", "login", "menu", "privacy", "search", "rights", "reserved"}
FEATURES = len(TAGS) + 2 * (1 + len(BAD)) + 24


class Page:
    """Elements of a page and, in page order, the pieces of text with the element each is in; None parts blocks."""

    def __init__(self, source: str):
        self.tag, self.parent, self.attrs = ["#"], [-1], [""]
        self.flow: list[tuple[int, int, str] | None] = []  # element, in a link, text
        self._parse(source)

    def _open(self, tag: str, attrs: str, parent: int) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.attrs.append(attrs)
        return len(self.tag) - 1

    def _parse(self, source: str) -> None:
        """Each place is looked at a bounded number of times: tags are scanned without going back (`Tags`), and what is
        open is known by name, so no end tag walks the open elements."""
        stack: list[tuple[str, int]] = [("#", 0)]  # tag, the element that text goes to
        open_: dict[str, list[int]] = {}  # places in the stack, by tag
        blocks, cells = [0], [0]  # of open blocks, of open table cells and tables
        links = gone = run = 0
        at, n = 0, len(source)
        flow = self.flow
        lower = None
        tags = Tags(source)

        def part() -> None:
            """A block ends or begins."""
            nonlocal run
            flow.append(None)
            run = 0

        def last(tag: str) -> int:
            """The place of the innermost open one, 0 for none."""
            places = open_.get(tag)
            return places[-1] if places else 0

        def pop(to: int) -> None:
            nonlocal links, gone
            while len(stack) > to:
                tag, _ = stack.pop()
                open_[tag].pop()
                links -= tag == "a"
                gone -= tag in GONE
                if tag in CELL:
                    cells.pop()
                if tag in BLOCK:
                    blocks.pop()
                    part()

        def push(tag: str, own: int) -> None:
            place = len(stack)
            stack.append((tag, own))
            open_.setdefault(tag, []).append(place)
            if tag in CELL:
                cells.append(place)
            if tag in BLOCK:
                blocks.append(place)

        def text(s: str) -> None:
            nonlocal run
            if not s:
                return
            if stack[-1][0] == "head" and not s.isspace():
                pop(len(stack) - 1)
            if gone:
                return
            own = stack[-1][1]
            if self.tag[own] in LOOSE and (run or not s.isspace()):
                run = own = run or self._open("#text", "", own)
            flow.append((own, links, markup.unescape(s) if "&" in s else s))

        while at < n:
            begin, end, tag, attrs, closes_it = tags.next(at)
            text(source[at:begin])
            at = end
            if not tag:
                continue
            if closes_it:
                place = last(tag)
                if place and (tag in BLOCK or place > cells[-1]):
                    pop(place)
                elif tag in BLOCK:
                    part()
                continue
            if stack[-1][0] == "head" and tag not in HEAD:
                pop(len(stack) - 1)
            if tag in ENDS_P and (place := last("p")) and place == blocks[-1]:
                pop(place)
            if tag in IMPLIED:
                closes, walls = IMPLIED[tag]
                while (place := max(map(last, closes))) > max(map(last, walls)):
                    pop(place)
                    if tag not in ("tr", "option"):
                        break
            if tag in BLOCK:
                part()
            if tag in OWN and attrs.endswith("/"):
                continue
            if tag in RAW:
                if lower is None:
                    lower = source.lower() if len(source.lower()) == n else source
                end = lower.find(f"</{tag}", at)
                at = n if end < 0 else (source.find(">", end) + 1 or n)
                continue
            if tag in VOID:
                if tag == "br":
                    text(" ")
                continue
            if tag == "a":
                links += 1
            if tag in GONE:
                gone += 1
            own = stack[-1][1]
            if tag in BLOCK or tag in OWN or attrs and any(x in attrs for x in ("class", "id=", "role", "hidden", "display")):
                own = self._open(tag, attrs, own)
            push(tag, own)
        pop(1)


class Tags:
    """Finds the tags of a page one after another, in time that grows with the page's length only."""

    def __init__(self, source: str):
        self.source = source
        self.last = source.rfind(">")  # no tag ends beyond it
        self.open = set()  # quotes from which no tag ends

    def _end(self, at: int) -> int:
        """Where the > of a tag is whose attributes begin at `at`: the first one outside quotes, or the first one if quotes are not closed."""
        source, p, passed = self.source, at, []
        while m := STOP.search(source, p):
            q = m.start()
            if source[q] == ">":
                return q
            if q in self.open:
                break
            passed.append(q)
            p = source.find(source[q], q + 1) + 1
            if not p:
                break
        self.open.update(passed)
        return source.find(">", at)

    def next(self, at: int) -> tuple[int, int, str, str, bool]:
        """Begin and end of the next markup, its tag in lower case (empty for comments and the like), attributes, and whether it is an end tag."""
        source, n = self.source, len(self.source)
        while (lt := source.find("<", at)) >= 0:
            at = lt + 1
            if source.startswith("!--", at):
                end = source.find("-->", lt + 4)
                return lt, n if end < 0 else end + 3, "", "", False
            closes = source.startswith("/", at)
            name = NAME.match(source, at + closes) if at <= self.last else None
            if name:
                end = self._end(name.end())
                return lt, end + 1, name[0].lower(), source[name.end() : end], closes
            if source[at : at + 1] in ("!", "?", "/") and at < n:
                end = source.find(">", at)
                return lt, n if end < 0 else end + 1, "", "", False
        return n, n, "", "", False


def _tokens(attrs: str) -> tuple[set[str], bool]:
    words: set[str] = set()
    hidden = False
    for name, value in ATTR.findall(attrs):
        name = name.lower()
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            words.update(WORD.findall(CAMEL.sub(" ", value).lower()))
        elif name == "hidden" or name == "aria-hidden" and "true" in value or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
    return words, hidden


def features(page: Page) -> np.ndarray:
    """A row for each element."""
    n = len(page.tag)
    parent = page.parent
    chars, linked, punct, words, blocks = (np.zeros(n) for _ in range(5))
    lex = np.zeros(n)
    first = np.full(n, -1.0)
    seen = 0.0
    for piece in page.flow:
        if piece is None:
            continue
        e, link, s = piece
        k = len(s) - s.count(" ") if not s.isspace() else 0
        if not k:
            continue
        chars[e] += k
        linked[e] += k * (link > 0)
        punct[e] += s.count(".") + s.count(",") + s.count("!") + s.count("?") + s.count("。")
        words[e] += s.count(" ") + 1
        blocks[e] += 1
        if first[e] < 0:
            first[e] = seen
        if k < 200:
            lex[e] += len(LEX.intersection(WORD.findall(s.lower())))
        seen += k
    own = chars.copy()
    depth, kids = np.zeros(n), np.zeros(n)
    paras, heads, subs = np.zeros(n), np.zeros(n), np.zeros(n)
    good, bad = np.zeros(n), np.zeros((n, len(BAD)))
    hidden = np.zeros(n)
    up_good, up_bad = np.zeros(n), np.zeros((n, len(BAD)))
    in_article = np.zeros(n)
    sets = list(BAD.values())
    for i in range(n):
        p = parent[i]
        tag = page.tag[i]
        if page.attrs[i]:
            got, hidden[i] = _tokens(page.attrs[i])
            good[i] = len(got & GOOD)
            for j, s in enumerate(sets):
                bad[i, j] = len(got & s)
        if p >= 0:
            depth[i] = depth[p] + 1
            kids[p] += 1
            up_good[i] = up_good[p] or good[p]
            up_bad[i] = np.maximum(up_bad[p], bad[p])
            in_article[i] = in_article[p] or page.tag[p] in ("article", "main")
            hidden[i] = max(hidden[i], hidden[p])
        paras[i] += tag == "p"
        heads[i] += tag in ("h1", "h2", "h3")
        subs[i] += 1
    for i in range(n - 1, 0, -1):
        p = parent[i]
        for a in (chars, linked, punct, words, blocks, paras, heads, subs, lex):
            a[p] += a[i]
        if first[i] >= 0 and (first[p] < 0 or first[i] < first[p]):
            first[p] = first[i]
    total = max(1.0, chars[0])
    par = np.maximum(np.array(parent), 0)
    sib = np.maximum(1, kids[par])
    some = np.maximum(chars, 1)
    one_hot = np.zeros((n, len(TAGS)))
    at = {t: j for j, t in enumerate(TAGS)}
    same: dict[tuple[int, str], int] = {}
    order = np.zeros(n)
    for i, t in enumerate(page.tag):
        if t in at:
            one_hot[i, at[t]] = 1
        order[i] = same.get((parent[i], t), 0)
        same[parent[i], t] = int(order[i]) + 1
    alike = np.array([same[parent[i], page.tag[i]] for i in range(n)], float)
    mean = chars[par] / sib
    link_share = linked / some
    p_share = linked[par] / np.maximum(chars[par], 1)
    cols = [
        depth, np.log1p(chars), np.log1p(own), chars / total, link_share, p_share, punct / some, words / some, np.log1p(blocks), np.log1p(kids), np.log1p(paras), heads,
        np.log1p(chars / subs), np.maximum(first, 0) / total, np.log1p(sib), np.log1p(alike), order / alike, np.log1p(chars) - np.log1p(mean), hidden, in_article, lex / np.maximum(1, blocks), np.log1p(chars[par]), own / some, np.log1p(lex),
    ]
    return np.column_stack([one_hot, good, bad, up_good, up_bad, *cols]).astype(np.float32)


class Trees:
    """Gradient-boosted trees for a yes-or-no target; complete trees on quantile bins."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.l2 = trees, depth, rate, bins, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, f = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        b = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)]).astype(np.int64)
        share = y.mean()
        self.bias = float(np.log(share / (1 - share)))
        self.feature, self.cut, self.leaf = [], [], []
        z = np.full(n, self.bias)
        offset = np.arange(f) * self.bins
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            feature, cut = [], []
            for level in range(self.depth):
                width = 1 << level
                cell = (node[:, None] * (f * self.bins) + offset + b).ravel()
                gs = np.bincount(cell, np.repeat(g, f), width * f * self.bins).reshape(width, f, self.bins).cumsum(axis=2)
                hs = np.bincount(cell, np.repeat(h, f), width * f * self.bins).reshape(width, f, self.bins).cumsum(axis=2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                gain[:, :, -1] = 0
                best = gain.reshape(width, -1).argmax(axis=1)
                bf, bc = best // self.bins, best % self.bins
                feature.append(bf)
                cut.append(bc)
                node = node * 2 + (b[np.arange(n), bf[node]] > bc[node])
            gs = np.bincount(node, g, 1 << self.depth)
            hs = np.bincount(node, h, 1 << self.depth)
            leaf = self.rate * gs / (hs + self.l2)
            z += leaf[node]
            self.feature.append(feature)
            self.cut.append(cut)
            self.leaf.append(leaf)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)])
        rows = np.arange(len(x))
        z = np.full(len(x), self.bias)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for bf, bc in zip(feature, cut):
                node = node * 2 + (b[rows, bf[node]] > bc[node])
            z += leaf[node]
        return z


def decode(page: Page, z: np.ndarray) -> np.ndarray:
    """The likeliest labels (kept or not) of all elements, given their log-odds, where nothing is kept inside what is dropped."""
    n = len(z)
    kept = np.zeros(n)  # best gain of the subtree if the element is kept, against dropping it whole
    for i in range(n - 1, 0, -1):
        kept[i] += z[i]
        if kept[i] > 0:
            kept[page.parent[i]] += kept[i]
    label = np.zeros(n, bool)
    label[0] = True
    for i in range(1, n):
        label[i] = label[page.parent[i]] and kept[i] > 0
    return label


def assemble(page: Page, label: np.ndarray) -> str:
    out, block = [], []
    for piece in [*page.flow, None]:
        if piece is None:
            if block and (s := " ".join("".join(block).split())):
                out.append(s)
            block = []
        elif label[piece[0]]:
            block.append(piece[2])
    return "\n".join(out)


def texts(model: Trees, sources: list[str | None]) -> list[str]:
    """The main text of each page; the trees look at all elements of the batch at once."""
    pages = [Page(s or "") for s in sources]
    rows = [features(p) for p in pages]
    z = model.margin(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for p, r in zip(pages, rows):
        out.append(assemble(p, decode(p, z[at : at + len(r)])))
        at += len(r)
    return out


# --- training pages: known parts in many layouts -----------------------------------------------------------------


class _Maker:
    """Makes pages whose elements are labelled: tags carry a mark that tells kept from dropped."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(("ta", "re", "on", "el", "is", "mo", "ver", "an", "den", "qu", "es", "lo")) for _ in range(self.r.randint(1, 4)))

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(lo, hi)))

    def prose(self, lo: int, hi: int) -> str:
        return " ".join(f"{self.words(1, 16).capitalize()}{self.r.choice('....,?!')}" for _ in range(self.r.randint(lo, hi)))

    def links(self, lo: int, hi: int, item: str = "li") -> str:
        return "".join(f'<{item}><a href="/x">{self.words(1, 4)}</a></{item}>' for _ in range(self.r.randint(lo, hi)))

    def attr(self, *names: str, p: float = 0.7) -> str:
        if self.r.random() > p:
            return ""
        name = self.r.choice(names)
        return f' {self.r.choice(("class", "class", "id"))}="{self.r.choice(("", "", "js-", "site-", "c-"))}{name}{self.r.choice(("", "", "-wrap", " block", "_1"))}"'

    def article(self) -> str:
        """Kept elements, with a few dropped ones inside."""
        r = self.r
        out = []
        if r.random() < 0.85:
            out.append(f"<h1>{self.words(2, 12)}</h1>")
        if r.random() < 0.2:
            out.append(self.drop(self.byline()))
        small, plain = r.random() < 0.25, r.random() < 0.2
        for _ in range(r.choice((0, 1, 1, 2, 3, 5, 8, 12, 20))):
            x = r.random()
            if x < 0.62:
                t = "div" if plain and r.random() < 0.6 else "p"
                out.append(f"<{t}>{self.prose(1, 2 if small else 12)}</{t}>")
            elif x < 0.70:
                out.append(f"<p><b>{self.prose(1, 3)}<br>")
            elif x < 0.76:
                out.append(f"<h2>{self.words(1, 8)}</h2>")
            elif x < 0.81:
                out.append("<ul>" + "".join(f"<li>{self.words(2, 20)}" + r.choice(("</li>", "")) for _ in range(r.randint(2, 6))) + "</ul>")
            elif x < 0.84:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.words(1, 5)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 5))) + "</table>")
            elif x < 0.87:
                out.append(f"<blockquote><p>{self.prose(1, 3)}</p></blockquote>")
            elif x < 0.89:
                out.append(f"<pre>{self.words(4, 30)}</pre>")
            elif x < 0.92:
                out.append(f'<p>{self.words(3, 12)} <a href="/y">{self.words(1, 4)}</a> {self.prose(1, 4)}</p>')
            elif x < 0.93:
                out.append(f"<figure>{r.choice(('<img src=x>', f'<svg viewBox=0><text>{self.words(1, 4)}</text></svg>'))}<figcaption>{self.words(3, 12)}</figcaption></figure>")
            elif x < 0.94:
                out.append(f"<p>{self.prose(1, 2)} <math><mi>{self.word()}</mi><mo>=</mo><mn>{r.randint(1, 99)}</mn></math> {self.words(2, 9)}.</p>")
            elif x < 0.945:
                out.append(f"<object data=x>{self.prose(1, 2)}</object>")
            elif x < 0.952:
                out.append(f'<p><a href="/z">{self.words(2, 14)}{r.choice(("", ".", "?"))}</a></p>')
            elif x < 0.972:
                out.append(f"<section{self.attr('more', 'more', 'more', 'part', 'intro', 'details', 'notes', p=0.8)}><h2>{self.words(1, 6)}</h2>{''.join(f'<p>{self.prose(1, 6)}</p>' for _ in range(r.randint(1, 3)))}</section>")
            elif x < 0.975:
                out.append(f"{self.prose(1, 4)}<br>{self.prose(0, 3)}")
            else:
                out.append(self.drop(self.inner()))
            if r.random() < 0.08:
                out.append(self.drop(r.choice((self.unseen, self.inner, self.aside))()))
        if r.random() < 0.25:
            out.append(self.drop(f"<footer{self.attr('entry-footer', 'meta', 'tags', p=0.4)}>{self.prose(1, 2)}{self.links(0, 3, 'span')}</footer>"))
        return "".join(out)

    def unseen(self) -> str:
        """A part that a reader does not see."""
        r = self.r
        how = r.choice((" hidden", ' style="display:none"', ' style="display: none"', ' aria-hidden="true"', ' style="visibility:hidden"', ' hidden=""'))
        t = r.choice(("div", "p", "section", "span"))
        return f"<{t}{self.attr('text', 'note', 'content', p=0.3)}{how}>{self.prose(1, 4) if t in ('p', 'span') or r.random() < 0.5 else f'<p>{self.prose(1, 4)}</p>'}</{t}>"

    def aside(self) -> str:
        """A sidebar of prose."""
        head = f"<h3>{self.words(1, 4)}</h3>" if self.r.random() < 0.4 else ""
        return f'<aside{self.attr("related", "sidebar", "box", p=0.4)}>{head}<p>{self.prose(1, 5)}</p></aside>'

    def byline(self) -> str:
        r = self.r
        said = f"{r.choice(('By', 'Von', 'Par', 'Posted by', ''))} {self.words(1, 3).title()}{r.choice(('', f', {r.randint(1, 28)} {self.word()} {r.randint(1999, 2030)}'))}"
        return f"<{(t := r.choice(('p', 'div', 'span')))} class=\"{r.choice(('byline', 'author', 'meta', 'post-meta', 'dateline', 'entry-meta', 'published'))}\">{said}</{t}>"

    def inner(self) -> str:
        r = self.r
        return r.choice((
            lambda: f'<div class="{r.choice(("ad", "ads", "advert", "ad-slot", "sponsored", "promo"))}">{self.prose(1, 3)}</div>',
            lambda: f'<div class="{r.choice(("share", "social-share", "sharing"))}">{self.links(2, 5, "span")}</div>',
            lambda: f'<aside{self.attr("related", "sidebar", p=0.5)}>{self.words(1, 3)}<ul>{self.links(2, 6)}</ul></aside>',
            self.aside,
            lambda: f'<div class="{r.choice(("newsletter", "subscribe"))}"><p>{self.prose(1, 2)}</p></div>',
        ))()

    def drop(self, s: str) -> str:
        return f"\x1c{s}\x1d"

    def bare(self) -> str:
        """A page of few elements: loose text, inline tags, a paragraph or two, with or without a body."""
        r = self.r
        loose = lambda: self.prose(1, 6) if r.random() < 0.6 else f"<{(t := r.choice(('b', 'i', 'em', 'strong', 'a href=x')))}>{self.words(1, 5)}</{t[0:6].split()[0]}> {self.prose(0, 4)}"
        kept = "".join(r.choice((loose, loose, lambda: f"<p>{self.prose(1, 6)}</p>", lambda: f"{self.prose(1, 3)}<br>"))() for _ in range(r.choice((1, 1, 2, 3, 5))))
        more = self.drop(f"<nav>{self.links(2, 6, 'span')}</nav>") if r.random() < 0.2 else ""
        return r.choice(("{}", "<body>{}", "<html><body>{}</body></html>", "<html><head><title>x</title></head><body>{}</body></html>", "<title>x</title>{}")).format(f"{more}\x1e{kept}\x1f")

    def page(self) -> str:
        """Text between \\x1c and \\x1d is dropped, text between \\x1e and \\x1f is the article; the marks count as white space."""
        r = self.r
        if r.random() < 0.1:
            return self.bare()
        tops, ends = [], []
        if r.random() < 0.15:
            tops.append(r.choice((lambda: f"<noscript>{self.prose(1, 2)}</noscript>", lambda: f'<a href="#x">{self.words(1, 3)}</a>', lambda: " | ".join(f'<a href="/{i}">{self.words(1, 2)}</a>' for i in range(r.randint(2, 7))), lambda: f"<video src=x>{self.words(3, 8)}</video>"))())
        if r.random() < 0.75:
            tops.append(r.choice((lambda: f"<nav{self.attr('nav', 'menu', p=0.3)}><ul>{self.links(2, 12)}</ul></nav>", lambda: f"<div{self.attr('nav', 'navbar', 'menu', 'breadcrumbs', p=0.9)}>{self.links(2, 10, 'span')}</div>", lambda: f"<ul{self.attr('menu', 'navigation')}>{self.links(3, 12)}</ul>"))())
        if r.random() < 0.5:
            tops.append(f"<header{self.attr('header', 'masthead', p=0.4)}><a href=/>{self.words(1, 3)}</a><p>{self.words(2, 8)}</p></header>" if r.random() < 0.6 else f"<div class=\"header\"><h2>{self.words(1, 4)}</h2></div>")
        for _ in range(r.choice((0, 1, 1, 2))):
            tops.append(f'<div class="{r.choice(("ad", "ads", "ad", "banner", "advert", "sponsor"))}">{self.prose(1, 3)}</div>')
        if r.random() < 0.3:
            (tops if r.random() < 0.5 else ends).append(f"<{(t := r.choice(('div', 'section', 'aside')))} {r.choice(('class', 'id'))}=\"{r.choice(('cookie-notice', 'consent', 'gdpr-banner', 'notice', 'newsletter-popup', 'cookie-bar', 'alert'))}\"><p>{self.prose(1, 3)}</p><button>OK</button></{t}>")
        if r.random() < 0.45:
            side = r.choice((f"<aside{self.attr('sidebar', 'widget', p=0.6)}>", '<div class="sidebar">', '<div id="side-rail">'))
            body = "".join(r.choice((lambda: f"<h3>{self.words(1, 3)}</h3><ul>{self.links(2, 8)}</ul>", lambda: f"<p>{self.prose(1, 3)}</p>"))() for _ in range(r.randint(1, 4)))
            (tops if r.random() < 0.4 else ends).append(side + body + ("</aside>" if side.startswith("<aside") else "</div>"))
        if r.random() < 0.35:
            one = lambda: f"<{(t := r.choice(('li', 'div', 'article')))} class=\"comment\"><b>{self.word()}</b><p>{self.prose(1, 4)}</p></{t}>"
            ends.append(f"<{(t := r.choice(('section', 'div', 'ol')))} {r.choice(('class', 'id'))}=\"{r.choice(('comments', 'discussion', 'comment-list', 'replies', 'respond'))}\"><h3>Comments</h3>{''.join(one() for _ in range(r.randint(1, 6)))}</{t}>")
        if r.random() < 0.3:
            ends.append(f"<form{self.attr('search', 'login', 'signup', p=0.5)}><label>{self.words(1, 3)}</label><input><p>{self.words(1, 8)}</p></form>")
        if r.random() < 0.3:
            ends.append(f"<{(t := r.choice(('section', 'div')))} class=\"{r.choice(('related', 'more-stories', 'recommended'))}\"><h2>{self.words(1, 3)}</h2><ul>{self.links(2, 8)}</ul></{t}>")
        if r.random() < 0.1:
            (tops if r.random() < 0.5 else ends).append(self.unseen())
        r.shuffle(ends)
        if r.random() < 0.85:
            ends.append(f"<footer{self.attr('footer', p=0.3)}>&copy; {self.words(1, 3)} &middot; {self.prose(1, 2)}{self.links(0, 4, 'span')}</footer>" if r.random() < 0.75 else f'<div class="{r.choice(("footer", "copyright", "site-footer"))}"><p>&copy; {self.prose(1, 2)}</p></div>')
        main = ""
        if r.random() < 0.96:
            wrap = r.choice(("article", "article", "article", "main", "div", "div", "section", "none", "td"))
            body = self.article()
            main = f"<{wrap}{self.attr('content', 'article', 'post', 'entry-content', 'story', 'main', p=0.9 if wrap in ('div', 'section') else 0.3)}>{body}</{wrap}>" if wrap != "none" else body
            if wrap == "td":  # a table for layout
                main = f"<table><tr>{main}</tr></table>"
            if wrap == "article" and r.random() < 0.2:
                main = f"<main>{main}</main>"
        drop = self.drop
        s = "".join(map(drop, tops)) + f"\x1e{main}\x1f" + "".join(map(drop, ends))
        for _ in range(r.choice((0, 0, 1, 2))):
            s = f'<div{self.attr("page", "wrapper", "container", "site", p=0.6)}>{s}</div>'
        return f"<!DOCTYPE html><html><head><title>x</title></head><body>{s}{r.choice(('</body></html>', ''))}"


def labelled(count: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the elements of generated pages; an element is kept if it is of the article or holds it."""
    maker = _Maker(seed)
    xs, ys = [], []
    for _ in range(count):
        marked = maker.page()
        page = Page(marked)
        n = len(page.tag)
        keep = np.zeros(n, bool)
        drop = inside = 0
        for piece in page.flow:
            if piece is None:
                continue
            for part in re.split(r"([\x1c-\x1f])", piece[2]):
                if part in ("\x1c", "\x1d"):
                    drop += 1 if part == "\x1c" else -1
                elif part in ("\x1e", "\x1f"):
                    inside = part == "\x1e"
                elif part.strip() and inside and not drop:
                    keep[piece[0]] = True
        for i in range(n - 1, 0, -1):
            if keep[i]:
                keep[page.parent[i]] = True
        clean = Page(re.sub(r"[\x1c-\x1f]", "", marked))
        assert clean.tag == page.tag
        some = features(clean)
        has = some[:, len(TAGS) + 2 * (1 + len(BAD)) + 1] > 0
        has[0] = False
        xs.append(some[has])
        ys.append(keep[has])
    return np.concatenate(xs), np.concatenate(ys).astype(float)


@functools.cache
def trained(pages: int = 500, seed: int = 11) -> Trees:
    return Trees().fit(*labelled(pages, seed))


def extract(df: DataFrame, html: str = "html", out: str = "text", model: Trees | None = None) -> DataFrame:
    """Adds the main text of every whole page."""
    keep = [c for c in extra_columns(df, {out}) if c != html]
    base = df.select(*keep, html)
    schema = T.StructType([*base.select(*keep).schema.fields, T.StructField(out, T.StringType())])
    shared = df.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                got = texts(shared.value, part.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(got, pa.string())], names=[*keep, out])

    return base.mapInArrow(run, schema)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op2_html": op2_html}
