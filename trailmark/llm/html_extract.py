"""Main-text extraction by gradient-boosted trees over DOM nodes.

A page becomes a tree of block nodes (inline markup belongs to its block; text beside blocks is a node of its own). Each node
has features of its subtree (text, links, density), its attribute tokens, its depth, its siblings and what it lies in. Boosted
trees give the log-odds that it holds main text. The decoding is hierarchical: a node is open or shut, under a shut node
everything is shut, and the assignment with the largest likelihood is found by one pass up and one down the tree, so no
text is kept inside a rejected block and no block is rejected for a part that is not main text.

The trees are trained on pages made up by `made_page`, whose layouts, names and nesting vary and whose main text is
known; the seed is fixed, so every process has the same model, whatever the corpus.
"""

from __future__ import annotations

import functools
import html
import random
import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm import texthash as th
from trailmark.llm.boosting import Boosted

# Elements by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noscript noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var".split())
NEVER = frozenset("svg template select button object canvas map audio video datalist head math".split())
GROUPS = (
    "article", "main", "section", "div", "p", "h1", "h2 h3 h4 h5 h6 hgroup", "li dt dd", "ul ol dl menu", "nav", "header", "footer", "aside", "form fieldset legend input output",
    "table tbody thead tfoot tr td th caption", "blockquote pre", "body html", "#text", "figure figcaption picture", "dialog details summary", "address center",
)
GROUP = {tag: i for i, tags in enumerate(GROUPS) for tag in tags.split()}
#: Opening one of these closes an open element of the second set, unless one of the third lies between.
CLOSES = {t: (frozenset(a.split()), frozenset(b.split())) for t, a, b in (
    ("li", "li", "ul ol menu"), ("dt", "dt dd", "dl"), ("dd", "dt dd", "dl"), ("tr", "tr td th", "table"), ("td", "td th", "tr table"), ("th", "td th", "tr table"),
    ("tbody", "tbody thead tfoot tr td th", "table"), ("thead", "tbody thead tfoot tr td th", "table"), ("tfoot", "tbody thead tfoot tr td th", "table"), ("option", "option", "select"), ("body", "head", ""),
)}
CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
P_SCOPE = frozenset("table td th caption button object template".split())
# Tokens of class, id and role by what they tell.
TOKENS = (
    "article post entry story content main body text blog page prose richtext articlebody maintext",
    "nav menu navbar navigation breadcrumb breadcrumbs topbar toc tabs pagination pager skip",
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner adsense dfp commercial teaser",
    "comment comments reply replies disqus discussion respond response responses commentlist reader readers feedback thread talkback opinions",
    "footer foot copyright colophon legal imprint bottom",
    "header head masthead branding logo top site",
    "sidebar side aside widget widgets rail complementary related recommended more popular",
    "cookie cookies consent gdpr notice notification alert message popup modal overlay dialog warning paywall privacy",
    "form search login signup subscribe newsletter contact searchbox register input",
    "share social sharing follow tweet facebook buttons toolbar tools meta tags byline author",
)
TOKEN = {w: i for i, ws in enumerate(TOKENS) for w in ws.split()}
_TAG = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
_QUOTE = re.compile(r"[\"'>]")
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|aria-label|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PART = re.compile(r"[a-z]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}


class Tree:
    """The block nodes of a page, parents first, and its text in order as (node, text); node -1 is a break between blocks."""

    __slots__ = ("tag", "parent", "tokens", "hidden", "names", "texts", "links", "marks")

    def __init__(self) -> None:
        self.tag: list[str] = []
        self.parent: list[int] = []
        self.tokens: list[int] = []
        self.hidden: list[bool] = []
        self.names: list[int] = []  # a hash of the class
        self.texts: list[tuple[int, str]] = []
        self.links: list[int] = []  # link characters by node
        self.marks: list[str] = []  # the value of data-k, only in pages made for training

    def add(self, tag: str, parent: int, attrs: str) -> int:
        bits, hidden, mark, named = 0, False, "", 0
        if attrs:
            for name, a, b, c in _ATTR.findall(attrs):
                value = (a or b or c).lower()
                name = name.lower()
                if name == "style":
                    hidden |= "display:none" in value.replace(" ", "")
                elif name == "hidden" or name == "aria-hidden" and value == "true":
                    hidden = True
                elif name != "aria-label":
                    if name == "class":
                        named = zlib.crc32(value.encode("utf-8", "replace"))
                    for w in _PART.findall(value):
                        k = TOKEN.get(w)
                        if k is not None:
                            bits |= 1 << k
            if "data-k=" in attrs:
                mark = attrs.split("data-k=", 1)[1][:1]
        self.tag.append(tag)
        self.parent.append(parent)
        self.tokens.append(bits)
        self.hidden.append(hidden)
        self.names.append(named)
        self.links.append(0)
        self.marks.append(mark)
        return len(self.tag) - 1


class _Tags:
    """Finds the ends of tags; a quoted value may hold `>`, but once a quote has no partner, quotes no longer count.

    Each search goes on from the one before or is the last of its kind, so a page takes time in proportion to its length.
    """

    def __init__(self, page: str) -> None:
        self.page, self.last, self.quotes = page, page.rfind(">"), True

    def end(self, at: int) -> int:
        """The place of the `>` that ends a tag open at `at`; there is one, as at <= last."""
        page = self.page
        plain = page.find(">", at)
        if not self.quotes:
            return plain
        while m := _QUOTE.search(page, at):
            if m[0] == ">":
                return m.start()
            at = page.find(m[0], m.end()) + 1
            if not at or at > self.last:
                break
        self.quotes = False
        return plain


def parse(page: str) -> Tree:
    """A forgiving reading of the markup: unknown ends are ignored, open elements end with their parents or where HTML ends them.

    What follows the last `>` is text. The open elements are also held by name, so that none of the rules walks down the stack.
    """
    tree = Tree()
    root = tree.add("html", -1, "")
    stack = [("html", root)]  # (element, its node)
    places: dict[str, list[int]] = {"html": [0]}  # by element: where on the stack it is open
    blocks, scopes = [0], []  # where blocks are open; where P_SCOPE and p are
    tags = _Tags(page)
    at, size = 0, len(page)
    anchors = 0
    texts = tree.texts

    def push(tag: str, node: int) -> None:
        depth = len(stack)
        places.setdefault(tag, []).append(depth)
        if tag not in INLINE:
            blocks.append(depth)
            if tag == "p" or tag in P_SCOPE:
                scopes.append(depth)
        stack.append((tag, node))

    def pop_to(depth: int) -> None:
        nonlocal anchors
        while len(stack) > depth:
            tag, _ = stack.pop()
            places[tag].pop()
            if tag == "a":
                anchors -= 1
            elif tag not in INLINE:
                blocks.pop()
                if scopes and scopes[-1] == len(stack):
                    scopes.pop()
                texts.append((-1, " "))

    def put(raw: str) -> None:
        if raw:
            if "&" in raw:
                raw = html.unescape(raw)
            node = stack[-1][1]
            texts.append((node, raw))
            if anchors:
                tree.links[node] += len(raw)

    while at < size:
        m = _TAG.search(page, at)
        if not m or (m.start() > tags.last and m[0] != "<!--"):
            put(page[at:])
            break
        put(page[at : m.start()])
        if m[0] == "<!--":
            end = page.find("-->", m.end())
            at = size if end < 0 else end + 3
            continue
        if m.end() > tags.last + 1:
            put(page[m.start() :])
            break
        close = tags.end(m.end())
        at = close + 1
        end, tag, attrs = m[1], m[2], page[m.end() : close]
        if not tag:
            continue
        tag = tag.lower()
        if end:
            if places.get(tag) and tag not in ("html", "body"):
                d = places[tag][-1]
                # an inline end inside a block that opened after it ends nothing beyond that block
                if tag not in INLINE or blocks[-1] < d:
                    pop_to(d)
            elif tag == "br":
                texts.append((-1, " "))
            continue
        if tag in VOID:
            if tag in ("br", "hr", "input"):
                texts.append((-1, " "))
            continue
        if tag in RAW:
            raw_end = _RAW_END[tag].search(page, at, tags.last + 1)
            at = raw_end.end() if raw_end else size
            if tag not in ("script", "style", "noscript"):
                texts.append((-1, " "))
            continue
        if tag in INLINE:
            if tag == "a":
                anchors += 1
            push(tag, stack[-1][1])
            continue
        if tag in ("html", "body") and places.get(tag):
            continue
        if tag in CLOSES_P and scopes and stack[scopes[-1]][0] == "p":
            pop_to(scopes[-1])
        if tag in CLOSES:
            those, stops = CLOSES[tag]
            stop = max((places[t][-1] for t in stops if places.get(t)), default=0)
            lowest = min((places[t][i] for t in those if places.get(t) and (i := bisect_right(places[t], stop)) < len(places[t])), default=None)
            if lowest is not None:
                pop_to(lowest)
        texts.append((-1, " "))
        node = tree.add(tag, stack[-1][1], attrs)
        push(tag, node)
        if attrs.endswith("/") and tag in ("path", "svg"):
            pop_to(len(stack) - 1)
    # Text beside blocks gets a node of its own, so that it can be judged apart from them.
    mixed = set(tree.parent)
    for i, (node, text) in enumerate(texts):
        if node in mixed and not text.isspace():
            leaf = tree.add("#text", node, "")
            tree.marks[leaf] = tree.marks[node]
            texts[i] = (leaf, text)
    return tree


N_TOKENS = len(TOKENS)
_BITS = np.arange(N_TOKENS)
_HOLD = ("article", "main", "nav", "header", "footer", "aside", "form", "table", "ul", "blockquote")


def features(tree: Tree) -> np.ndarray:
    """A row for each node."""
    n = len(tree.tag)
    parent = np.array(tree.parent)
    chars, words, stops, links, rights = (np.zeros(n) for _ in range(5))
    begin = np.full(n, np.inf)
    done = 0
    for node, text in tree.texts:
        if node >= 0:
            k = len(text)
            chars[node] += k
            words[node] += text.count(" ") + 1
            stops[node] += text.count(".") + text.count(",")
            if "\u00a9" in text or "opyright" in text or "ights reserved" in text:
                rights[node] += 1
            if begin[node] > done:
                begin[node] = done
            done += k
    links += tree.links
    own = chars.copy()
    depth, below, kids = np.zeros(n), np.ones(n), np.zeros(n)
    group = np.array([GROUP.get(t, 3) for t in tree.tag])
    bits = np.array(tree.tokens)
    hold = np.zeros(n, np.int64)
    above = np.zeros(n, np.int64)
    tags = tree.tag
    rank, same, repeated, inner = (np.zeros(n) for _ in range(4))
    seen: dict[tuple[int, int], int] = {}
    alike: dict[tuple, int] = {}
    before = np.full(n, -1)
    last: dict[int, int] = {}
    for i in range(n):
        p = tree.parent[i]
        if p >= 0:
            depth[i] = depth[p] + 1
            above[i] = above[p] | bits[p]
            hold[i] = hold[p]
            kids[p] += 1
            rank[i] = kids[p]
            key = (p, int(group[i]))
            seen[key] = seen.get(key, 0) + 1
            key = (p, tags[i], tree.names[i])
            alike[key] = alike.get(key, 0) + 1
            before[i] = last.get(p, -1)
            last[p] = i
        if tags[i] in _HOLD:
            hold[i] |= 1 << _HOLD.index(tags[i])
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        for a in (chars, words, stops, links, below, rights):
            a[p] += a[i]
        if begin[i] < begin[p]:
            begin[p] = begin[i]
    for i in range(n):
        same[i] = seen.get((tree.parent[i], int(group[i])), 1)
        repeated[i] = alike.get((tree.parent[i], tags[i], tree.names[i]), 1)
        if i and tags[i] not in ("p", "#text") and repeated[i] > inner[tree.parent[i]]:
            inner[tree.parent[i]] = repeated[i]
    total = max(1.0, chars[0])
    begin[~np.isfinite(begin)] = 0
    density = links / np.maximum(chars, 1)
    up = np.maximum(parent, 0)
    prior = np.where(before >= 0, density[before], -1.0)
    prior_size = np.where(before >= 0, np.log1p(chars[before]), -1.0)
    after = np.full(n, -1)
    after[before[before >= 0]] = np.flatnonzero(before >= 0)
    follow = np.where(after >= 0, density[after], -1.0)
    columns = [
        depth, np.log1p(chars), np.log1p(words), density, stops / np.maximum(words, 1), chars / np.maximum(words, 1), np.log1p(below), np.log1p(chars / below), np.log1p(own), own / np.maximum(chars, 1),
        chars / total, begin / total, (total - begin - chars) / total, rank, rank / np.maximum(kids[up], 1), same, kids, prior, prior_size, follow,
        density[up], np.log1p(chars[up]), chars / np.maximum(chars[up], 1), group[up], np.array(tree.hidden, float), np.full(n, np.log1p(total)),
        repeated, inner, repeated[up], inner[up], np.minimum(rights, 3), rights / below,
    ]
    flags = [(group[:, None] == np.arange(len(GROUPS))), (bits[:, None] >> _BITS & 1), (above[:, None] >> _BITS & 1), (hold[:, None] >> np.arange(len(_HOLD)) & 1)]
    return np.concatenate([np.stack(columns, 1), *flags], 1).astype(np.float32)


def tied(tree: Tree, odds: np.ndarray) -> np.ndarray:
    """The odds with those of like places in the items of a list evened out: each node has the mean of all with its path in an item.

    Items are the li, dt, dd and tr of one parent, and three or more children, all of one element and class, that begin alike.
    """
    n = len(tree.tag)
    kids: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        kids[tree.parent[i]].append(i)
    place: list[tuple | None] = [None] * n
    groups: dict[tuple, list[int]] = {}
    alike: dict[int, bool] = {}
    for i in range(1, n):
        p = tree.parent[i]
        if tree.tag[i] in ("li", "dt", "dd", "tr"):
            place[i] = (p, tree.tag[i])
        elif place[p] is not None:
            place[i] = (*place[p], tree.tag[i])
        elif tree.tag[i] not in ("p", "#text") and len(kids[p]) > 2:
            if p not in alike:
                alike[p] = len({(tree.tag[k], tree.names[k], tree.tag[kids[k][0]] if kids[k] else "") for k in kids[p]}) == 1
            if alike[p]:
                place[i] = (p, tree.tag[i])
        if place[i] is not None and len(place[i]) < 8:
            groups.setdefault(place[i], []).append(i)
    out = odds.copy()
    for some in groups.values():
        if len(some) > 1:
            out[some] = odds[some].mean()
    return out


def decode(tree: Tree, odds: np.ndarray) -> np.ndarray:
    """Which nodes are open: the likeliest assignment in which no open node lies under a shut one. The root is open."""
    n = len(tree.tag)
    yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    shut, free = no.copy(), yes.copy()
    never = np.array([t in NEVER for t in tree.tag])
    free[never] = -np.inf
    open_ = np.zeros(n, bool)
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        shut[p] += shut[i]
        free[p] += max(free[i], shut[i])
    open_[0] = True
    for i in range(1, n):
        open_[i] = open_[tree.parent[i]] and free[i] > shut[i]
    return open_


def main_text(tree: Tree, open_: np.ndarray) -> str:
    return " ".join("".join([t for node, t in tree.texts if node < 0 or open_[node]]).split())


# -- training pages ----------------------------------------------------------------------------------------------------

# Names that layouts use for their parts.
_NAMES = {
    "main": "article post entry-content story-body post-content content article-body main-content text blog-post page-content",
    "menu": "nav menu navbar main-menu site-navigation breadcrumbs tabs top-menu",
    "ad": "ad ads advert advertisement sponsored promo ad-slot ad-banner sponsor-box adsense",
    "comments": "comments comment-list reader-comments replies discussion disqus respond thread opinions talkback",
    "foot": "footer site-footer foot copyright colophon legal",
    "head": "header site-header masthead top branding page-head",
    "side": "sidebar side aside widget related more-stories rail popular recommended",
    "notice": "cookie-notice cookie consent gdpr-banner notice alert popup modal newsletter-popup privacy-notice",
    "form": "search-form login newsletter subscribe signup contact-form",
    "share": "share social-buttons tags post-meta toolbar author-box",
    "byline": "byline author post-meta meta dateline",
    "plain": "wrap container row inner col box group block layout x1 c2 grid",
}
_ASIDE = {"menu": "nav", "foot": "footer", "head": "header", "side": "aside", "comments": "section", "form": "form"}


class Maker:
    """A page for training; elements of the main text carry data-k=1, those of other parts data-k=0, wrappers nothing.

    A page draws its own habits: vocabulary, punctuation, how it names its parts (telling, neutral or generated names, or none),
    which elements it uses, and its skeleton: a holder element, none at all, a table for the layout, the headline beside the holder.
    """

    def __init__(self, rng: random.Random) -> None:
        self.rng = rng
        self.lexicon = ["".join(rng.choice("abcdefghijklmnoprstuvyz") for _ in range(rng.randint(2, 10))) for _ in range(rng.randint(20, 90))]
        self.noise = rng.choice(["", "", "", "", *"!?;:*#%$|~=+-/@", "&amp;", "&lt;", "&quot;"])
        self.loud = rng.random() < 0.08
        self.generated = rng.random() < 0.2
        self.semantic = rng.choice([0.0, 0.4, 0.6, 0.9, 1.0])
        self.comment_names = rng.random() < 0.6

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def words(self, n: int) -> str:
        rng, out = self.rng, []
        for _ in range(n):
            w = rng.choice(self.lexicon)
            w = w.upper() if self.loud else w
            out.append(w + (self.noise * rng.randint(0, 3) if self.noise and self.chance(0.5) else rng.choice(["", "", "", "", "", ",", "."])))
        text = " ".join(out)
        return text[:1].upper() + text[1:] + rng.choice([".", "", ""])

    def name(self, kind: str, strong: float = 0.75) -> str:
        rng = self.rng
        if self.generated:
            return f' class="{rng.choice(["css-", "_", "sc-", ""])}{"".join(rng.choice("abcdefxyzXYZ0123456789") for _ in range(6))}"' if self.chance(0.8) else ""
        kind = kind if self.chance(strong) else "plain"
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice(_NAMES[kind].split())}"' if self.chance(0.93) else ""

    def el(self, tag: str, inner: str, k: int | None, attrs: str = "") -> str:
        mark = "" if k is None else f" data-k={k}"
        return f"<{tag}{attrs}{mark}>{inner}</{tag}>"

    def link(self, n: int = 1) -> str:
        return f'<a href="/x">{self.words(n)}</a>'

    def links(self, k: int) -> str:
        rng = self.rng
        items = [self.link(rng.randint(1, 3)) for _ in range(rng.randint(2, 9))]
        form = rng.random()
        if form < 0.6:
            return self.el("ul", "".join(self.el("li", x, k) for x in items), k)
        return self.el("div", rng.choice([" | ", " ", "", " &middot; "]).join(items), k, self.name("menu", 0.5)) if form < 0.8 else " ".join(items)

    def paragraph(self, k: int, low: int = 1, high: int = 80) -> str:
        rng = self.rng
        text = self.words(rng.choice([rng.randint(low, 6), rng.randint(8, high), rng.randint(20, high)]))
        if self.chance(0.2):
            tag = rng.choice("b i em strong span code".split())
            text = f"<{tag}>{text}</{tag}>" if self.chance(0.5) else text + " " + self.link() + " " + self.words(3)
        if self.chance(0.1):
            return f"<p data-k={k}>" + (f"<{rng.choice(['b', 'i', 'font'])}>" if self.chance(0.4) else "") + text + ("<br>" if self.chance(0.4) else "")
        return self.el("p", text, k)

    def comments(self) -> str:
        """A list of readers' remarks, told by its repeated items with an author each; names only where the page gives any."""
        rng, k = self.rng, 0
        item, cls = rng.choice(["div", "li", "article", "section"]), rng.choice(["", "", f' class="{rng.choice(["comment", "reply", "item", "c", "entry", "msg"])}"'])
        who = rng.choice(["span", "strong", "b", "cite", "h4", "div"])
        date = self.chance(0.5)
        items = []
        for _ in range(rng.randint(1, 6)):
            head = self.el(who, self.words(rng.randint(1, 2)) + (f" <time>{rng.randint(1, 28)} {self.words(1)} 20{rng.randint(10, 29)}</time>" if date else ""), k) if self.chance(0.8) else ""
            items.append(self.el(item, head + (self.paragraph(k, 1, 60) if self.chance(0.75) else self.words(rng.randint(1, 40))) + (self.link() if self.chance(0.3) else ""), k, cls))
        inner = "".join(items)
        if item == "li":
            inner = self.el(rng.choice(["ul", "ol"]), inner, k)
        heading = self.el(rng.choice(["h2", "h3", "h4"]), (f"{rng.randint(1, 90)} " if self.chance(0.4) else "") + self.words(rng.randint(1, 2)), k) if self.chance(0.7) else ""
        return heading + inner

    def aside(self, kind: str) -> str:
        """A part that is not main text."""
        rng, k = self.rng, 0
        tag = _ASIDE.get(kind, "div")
        strong = tag != "div" and self.chance(self.semantic)
        tag = tag if strong and tag != "section" else rng.choice(["div", "div", "section"])
        attrs = self.name(kind, 0.45 if strong else 1.0)
        if kind == "comments" and not self.comment_names:
            attrs = self.name("plain", 1.0)
        elif not self.generated and not strong and not attrs:
            attrs = f' class="{rng.choice(_NAMES[kind].split())}"'
        if kind == "menu":
            inner = self.links(k)
        elif kind == "comments":
            inner = self.comments()
        elif kind == "form":
            inner = f"<label>{self.words(1)}</label><input name=q><button>{self.words(1)}</button>" + (self.el("p", self.words(rng.randint(2, 14)), k) if self.chance(0.5) else "")
            if tag != "form":
                inner = f"<form>{inner}</form>"
        elif kind == "foot":
            sign = rng.choice(["&copy;", "\u00a9", "Copyright", "Copyright &copy;", "(c)"]) + (f" {rng.randint(1998, 2030)}" if self.chance(0.5) else "")
            line = f"{sign} {self.words(rng.randint(1, 4))}{rng.choice(['', ' &middot;', ' |', '.', ' -'])} {self.words(rng.randint(0, 20))}"
            inner = rng.choice([line, self.el("p", line, k), self.links(k) + self.el("p", self.words(rng.randint(2, 20)), k), self.links(k) + line])
        elif kind == "head":
            inner = rng.choice([self.el("h1", self.words(2), k) + self.links(k), self.el("div", self.link(2), k, self.name("head", 0.5)) + self.el("p", self.words(4), k), self.words(rng.randint(1, 8)), self.link(2) + self.links(k)])
        elif kind == "side":
            inner = (self.el("h3", self.words(2), k) if self.chance(0.8) else "") + rng.choice([self.links(k), "".join(self.paragraph(k, 1, 40) for _ in range(rng.randint(1, 3))) if not self.generated or strong else self.links(k), self.links(k) + self.paragraph(k, 1, 30)])
        elif kind in ("share", "byline"):
            inner = rng.choice([self.links(k), f"{self.words(2)} {self.link(1)} {self.link(1)}", f"{self.words(2)} <time>{rng.randint(1, 28)} {self.words(1)} 2024</time>"])
        else:
            inner = rng.choice([self.words(rng.randint(1, 30)), self.paragraph(k, 1, 30), self.words(rng.randint(3, 15)) + f"<button>{self.words(1)}</button>", self.el("p", self.words(rng.randint(3, 20)) + " " + self.link(2), k)])
        return self.el(tag, inner, k, attrs)

    def headline(self) -> str:
        return self.el(self.rng.choice(["h1", "h1", "h1", "h2"]), self.words(self.rng.randint(1, 10)), 1)

    def body(self, headed: bool) -> str:
        rng = self.rng
        parts = []
        if headed:
            head = self.headline()
            if self.chance(0.2):
                head = self.el(rng.choice(["header", "div", "header"]), head + (self.aside("byline") if self.chance(0.6) else "") + (self.el("p", self.words(rng.randint(5, 25)), 1) if self.chance(0.3) else ""), 1 if self.chance(0.5) else None)
            parts.append(head)
            if self.chance(0.15):
                parts.append(self.aside("byline"))
        style, count = rng.random(), rng.choice([0, 1, 1, 2, 3, 5, 9, 14])
        if style < 0.14:  # an article that is a list, most of it
            parts += [self.listing() for _ in range(rng.randint(1, 2))]
            count = rng.choice([0, 0, 1, 2])
        elif style < 0.18:  # an article of a word or two
            parts.append(self.el("p", self.words(rng.randint(1, 3)), 1))
            count = 0
        links = 0.9 if style > 0.94 else 0.03
        for _ in range(count):
            x = rng.random()
            if x < 0.72:
                parts.append(self.linked() if self.chance(links) else self.paragraph(1))
            elif x < 0.78:
                parts.append(self.el(rng.choice(["h2", "h3"]), self.words(rng.randint(1, 6)), 1))
            elif x < 0.84:
                parts.append(self.listing())
            elif x < 0.87:
                parts.append(self.el("blockquote", self.paragraph(1), 1))
            elif x < 0.90:
                parts.append(self.el("table", "".join(self.el("tr", "".join(self.el(rng.choice(["td", "td", "th"]), self.words(rng.randint(1, 4)), 1) for _ in range(3)), 1) for _ in range(rng.randint(1, 4))), 1))
            elif x < 0.94:
                parts.append(self.el(rng.choice(["div", "section"]), self.paragraph(1) + self.paragraph(1), 1, self.name("plain")))
            elif x < 0.97:
                parts.append(self.el("pre", self.words(rng.randint(3, 30)), 1))
            else:
                parts.append(self.el("figure", self.el("figcaption", self.words(rng.randint(3, 15)), 1), 1))
        if not parts or self.chance(0.08):
            parts.append(self.el("div", self.words(rng.randint(1, 60)), 1))
        return "".join(self.mixed(parts))

    def listing(self) -> str:
        """A list in the main text: of words, sentences or links among them, of paragraphs, or of items with headings of their own."""
        rng = self.rng
        kind, head = rng.random(), rng.choice(["h2", "h3", "h4", "strong", "b"])
        item, holder = ("li", rng.choice(["ul", "ol"])) if self.chance(0.65) else (rng.choice(["div", "section", "article"]), "div")
        if kind < 0.4:
            some = [self.words(rng.randint(1, 14)) for _ in range(rng.randint(2, 6))]
        elif kind < 0.5:
            some = [self.words(rng.randint(4, 30)) + " " + self.link(rng.randint(1, 4)) + rng.choice(["", ".", " " + self.words(5)]) for _ in range(rng.randint(2, 6))]
        elif kind < 0.65:
            some = [self.paragraph(1, 3, 50) for _ in range(rng.randint(1, 6))]
        elif kind < 0.75:
            pairs = "".join(self.el("dt", self.words(rng.randint(1, 4)), 1) + self.el("dd", self.words(rng.randint(3, 40)), 1) for _ in range(rng.randint(1, 6)))
            return self.el("dl", pairs, 1)
        else:
            text = lambda: self.words(rng.randint(4, 60)) if self.chance(0.5) else "".join(self.paragraph(1, 5, 60) for _ in range(rng.randint(1, 2)))
            some = [self.el(head, self.words(rng.randint(1, 6)), 1) + text() for _ in range(rng.randint(2, 7))]
        return self.el(holder, "".join(self.el(item, x, 1) for x in some), 1)

    def linked(self) -> str:
        """A paragraph that is a link as a whole, or nearly so."""
        text = f'<a href="/{self.rng.randint(1, 99)}">{self.words(self.rng.randint(6, 50))}</a>'
        return self.el("p", text + (" " + self.words(self.rng.randint(1, 4)) if self.chance(0.3) else ""), 1)

    def mixed(self, parts: list[str]) -> list[str]:
        """Parts of the main text with some others between and after them."""
        first = 1 if len(parts) > 1 else 0
        for kind in ("ad", "share", "form", "side", "notice"):
            if self.chance(0.1):
                parts.insert(self.rng.randint(first, len(parts)), self.aside(kind))
        if self.chance(0.08):
            parts.append(self.aside("foot"))
        if self.chance(0.15):
            parts.append(self.aside("comments"))
        return parts

    def wrapped(self, inner: str, p: float) -> str:
        while self.chance(p):
            inner = self.el(self.rng.choice(["div", "div", "section", "center"]), inner, None, self.name("plain", 1.0))
            p /= 2
        return inner

    def page(self) -> str:
        rng = self.rng
        headed, beside = self.chance(0.85), self.chance(0.25)
        text = self.body(headed and not beside)
        holder, telling = rng.random(), "" if self.generated else f' {rng.choice(["class", "id"])}="{rng.choice(_NAMES["main"].split())}"'
        some = self.name("main", 0.6) if self.chance(0.4) else ""
        if holder < 0.4:
            main = self.el("article", text, 1, some)
        elif holder < 0.55:
            main = self.el("main", text, 1, some)
        elif holder < 0.85:
            main = self.el(rng.choice(["div", "section", "div"]), text, 1, telling or self.name("plain"))
        else:
            main = text  # beside the other parts, without a holder
        if headed and beside:
            head = self.headline() + (self.aside("byline") if self.chance(0.3) else "")
            while self.chance(0.5):
                head = self.el(rng.choice(["div", "div", "section", "header"]), head, None, self.name(rng.choice(["plain", "plain", "head"]), 1.0))
            if self.chance(0.4):  # the text stands in columns of its own below
                main = self.el("div", main + (self.aside("side") if self.chance(0.5) else ""), None, self.name("plain", 1.0))
            main = head + main
        before = [self.aside(k) for k in ("notice", "head", "menu", "ad", "form", "side") if self.chance(0.35) and not (self.generated and k in ("notice", "ad"))]
        after = [self.aside(k) for k in ("share", "side", "comments", "ad", "form", "notice", "foot") if self.chance(0.35) and not (self.generated and k in ("notice", "ad"))]
        rng.shuffle(before)
        if self.chance(0.12):  # the layout is a table: menus and text in cells
            rows = [before, [self.el("td", main + (after.pop(0) if after and self.chance(0.5) else ""), None)], after]
            rows[1].insert(0, self.el("td", self.links(0), 0)) if self.chance(0.6) else None
            cells = ["".join(self.el("tr", self.el("td", x, None), None) for x in rows[0]), self.el("tr", "".join(rows[1]), None), "".join(self.el("tr", self.el("td", x, None), None) for x in rows[2])]
            inner = self.el("table", "".join(cells), None)
        else:
            if self.chance(0.5):
                main = self.el("div", (rng.choice(before) if before and self.chance(0.2) else "") + main + (after.pop(0) if after and self.chance(0.4) else ""), None, self.name("plain", 1.0))
            inner = "".join(before) + self.wrapped(main, 0.2) + "".join(after)
        inner = self.wrapped(inner, 0.3)
        return f"<!DOCTYPE html><html><head><title>{self.words(4)}</title><style>p{{margin:0}}</style></head><body>{inner}" + ("</body></html>" if self.chance(0.9) else "")


def made_page(rng: random.Random) -> str:
    """A page of a layout that has been drawn at random."""
    return Maker(rng).page()


def truth(tree: Tree) -> np.ndarray:
    """For pages of `made_page`: which nodes hold main text."""
    n = len(tree.tag)
    y = np.zeros(n, bool)
    inside = [""] * n
    for i in range(n):
        inside[i] = tree.marks[i] or (inside[tree.parent[i]] if i else "")
        y[i] = inside[i] == "1"
    for i in range(n - 1, 0, -1):
        y[tree.parent[i]] |= y[i]
    y[0] = True
    return y


@functools.lru_cache(1)
def model(pages: int = 3000, seed: int = 11) -> Boosted:
    rng = random.Random(seed)
    trees = [parse(made_page(rng)) for _ in range(pages)]
    x, y = np.concatenate([features(t) for t in trees]), np.concatenate([truth(t) for t in trees])
    return Boosted(trees=110, depth=6, rows=0.4).fit(x, y.astype(float))


def extract(pages: list[str], boosted: Boosted) -> list[str]:
    """The main text of each page, '' where there is none."""
    trees = [parse(p) for p in pages]
    rows = [features(t) for t in trees]
    odds = boosted.log_odds(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for tree, x in zip(trees, rows, strict=True):
        out.append(main_text(tree, decode(tree, tied(tree, odds[at : at + len(x)]))))
        at += len(x)
    return out


def main_texts(spark, pages: DataFrame) -> DataFrame:
    """A row for each row of `pages` (page_id, url, html): page_id, url, text, n_chars (code points).

    Null and empty pages have the text ''; whole pages are read, nothing is cut, in time in proportion to their length. Repeated rows
    stay, other columns are ignored, an empty table gives no row.
    """
    rows = pages.select(F.col("page_id"), F.col("url"), F.col("html").cast("string").alias("html"))
    shared = spark.sparkContext.broadcast(model())
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches):
        for batch in batches:
            for part in th.slices(batch, "html", most=1 << 20):
                texts = extract([p or "" for p in part.column(2).to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
