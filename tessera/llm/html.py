"""Main text of web pages by a tree-structured graphical model over DOM nodes.

Every element is a node with two states, content or not.  Its own features (tag, words of class and id, share of text in links,
length and marks of its text) give a node potential, parent and child are tied by a pair potential, and sum-product messages, up and
then down the tree, give the marginal of every node exactly.  Potentials are estimated with smoothing from labelled pages; the
labelled pages are composed by labelled_pages() from a grammar of page layouts, which marks each block as content or not when it
writes it, so that a label never comes from the words and tags that features look at.  The text of nodes whose marginal for content is
at least 0.5 is kept: blocks in page order, white space inside a block as one space, blocks joined by an empty line.

Null and empty pages give an empty text.  Pages without markup are one block of content.  Broken pages (cut tags, missing ends) are
read as browsers do in outline.  A marginal of exactly 0.5 is kept.  Very long pages are read whole.  Null ids and repeated rows pass
through, one output row each; an empty table gives none; other columns take no part, whatever their names.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
SPACE = re.compile(r"\s+")
#: Elements by the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe select".split())
#: Those of them that reach to the end of the page if they aren't closed; of the others, only the tag is left out.
TO_END = frozenset("script style textarea title".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of class and id attributes by what they tell.
HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar pagination pager skip tabs sitemap",
    "edge": "header footer masthead foot head top bottom copyright legal banner logo colophon",
    "side": "sidebar side aside widget widgets related recommended trending popular more rail promo teaser archive tags tag",
    "notice": "cookie cookies consent notice alert gdpr popup modal overlay message warning subscribe newsletter paywall signup disclaimer",
    "advert": "ad ads advert advertisement adbox sponsor sponsored sponsors promotion dfp banner-ad",
    "talk": "comment comments reply replies discussion respond disqus reviews reader feedback thread",
    "form": "form search login share social sharing buttons contact",
    "main": "article content main post entry story body text page-content post-content entry-content article-body prose maintext",
}
HINT_OF = {w: kind for kind, words in HINTS.items() for w in words.split()}


class Node:
    __slots__ = ("anchors", "attrs", "children", "links", "parent", "tag", "texts", "total")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node] = []
        self.texts: list[str] = []
        self.total = self.links = self.anchors = 0


def parse(page: str) -> tuple[list[Node], list[tuple]]:
    """Nodes, parents before children, and the stream of (node, text) and (None, '') for the edges of blocks."""
    root = Node("#root", "", None)
    nodes, stream, stack, at = [root], [], [root], 0
    n = len(page)

    def say(raw: str) -> None:
        if raw:
            text = entities.unescape(raw)
            stack[-1].texts.append(text)
            stream.append((stack[-1], text))

    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            if tag in BLOCK:
                stream.append((None, ""))
            continue
        if not m[4]:  # a tag that the end of the page cuts off
            break
        if tag in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else n if tag in TO_END else at
            continue
        if tag in BLOCK:
            stream.append((None, ""))
            shut = {"p"} | CLOSED_BY.get(tag, set())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in shut:
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK and stack[i].tag not in shut:
                    break
        if tag == "br":
            stack[-1].texts.append(" ")
            stream.append((stack[-1], " "))
        if tag in VOID:
            continue
        node = Node(tag, " ".join(x.strip("\"'").lower() for x in ATTRIBUTE.findall(m[3])) if m[3] else "", stack[-1])
        stack[-1].children.append(node)
        nodes.append(node)
        if not m[3].endswith("/"):
            stack.append(node)
    for node in reversed(nodes):
        own = sum(map(len, node.texts))
        node.total += own
        if node.tag in ("a", "button"):
            node.links = node.total
            node.anchors = 1
        if node.parent:
            node.parent.total += node.total
            node.parent.links += node.links
            node.parent.anchors += node.anchors
    return nodes, stream


def features(node: Node) -> list[str]:
    """Names of what a node shows; one of each kind, but of hints as many as its attributes have."""
    fragment = node.parent is None and not any(c.tag in ("html", "body", "head") for c in node.children)
    out = ["tag=#fragment" if fragment else "tag=" + node.tag]
    hints = {HINT_OF[w] for w in re.split(r"[^a-z]+", node.attrs) if w in HINT_OF} if node.attrs else ()
    out += ["hint=" + h for h in hints]
    if not hints:
        out.append("hint=other" if node.attrs else "hint=none")
    own = sum(len(t.strip()) for t in node.texts)
    out.append(f"own={min(4, int(math.log2(own + 1)) // 2) if own else -1}")
    if node.tag not in ("#root", "html", "body"):
        out.append(f"sub={min(4, int(math.log2(node.total + 1)) // 2)}")
    share = node.links / node.total if node.total else 0
    if node.anchors:  # many links of a word or two make a menu, a linked sentence doesn't
        out.append(f"link={1 if share < 0.25 else 2 if share < 0.6 else 3}/{min(3, int(node.links / node.anchors) // 20)}")
    else:
        out.append("link=0")
    if own:
        text = "".join(node.texts)
        out.append(f"stops={min(3, text.count('. ') + text.count(', ') + text.rstrip().endswith(('.', '!', '?')))}")
        if "©" in text or "|" in text:
            out.append("mark=edge")
    return out


class TreeModel:
    """Node and pair potentials as logarithms; state 1 is content."""

    def __init__(self):
        self.pair = np.zeros((2, 2))
        self.root = np.zeros(2)
        self.weights: dict[str, tuple[float, float]] = {}

    def fit(self, pages: list[tuple[str, list[int]]]) -> TreeModel:
        """pages: html and the state of every node in parse()'s order; smoothed maximum likelihood of the generative tree."""
        pair, root, counts, kinds, totals = np.ones((2, 2)), np.ones(2), {}, {}, {}
        for page, states in pages:
            nodes, _ = parse(page)
            of = {id(x): s for x, s in zip(nodes, states, strict=True)}
            root[states[0]] += 1
            for x in nodes:
                s = of[id(x)]
                if x.parent:
                    pair[of[id(x.parent)], s] += 1
                for f in features(x):
                    counts.setdefault(f, [0, 0])[s] += 1
                    kind = f.split("=")[0]
                    kinds.setdefault(kind, set()).add(f)
                    totals.setdefault(kind, [0, 0])[s] += 1
        self.pair = np.log(pair / pair.sum(1, keepdims=True))
        self.root = np.log(root / root.sum())
        for f, c in counts.items():
            kind = f.split("=")[0]
            self.weights[f] = tuple(math.log((c[s] + 0.5) / (totals[kind][s] + 0.5 * len(kinds[kind]) + 0.5)) for s in (0, 1))
        return self

    def marginals(self, nodes: list[Node]) -> dict[int, float]:
        """The probability of content of every node, by one pass of messages up the tree and one down."""
        p = self.pair
        up = {id(x): [0.0, 0.0] for x in nodes}
        message = {}
        for x in nodes:
            own = up[id(x)]
            for f in features(x):
                w = self.weights.get(f)
                if w:
                    own[0] += w[0]
                    own[1] += w[1]
        (p00, p01), (p10, p11) = p.tolist()
        for x in reversed(nodes):
            own = up[id(x)]
            if x.parent is None:
                continue
            m = _add(p00 + own[0], p01 + own[1]), _add(p10 + own[0], p11 + own[1])
            message[id(x)] = m
            above = up[id(x.parent)]
            above[0] += m[0]
            above[1] += m[1]
        belief, out = {}, {}
        for x in nodes:
            own = up[id(x)]
            if x.parent is None:
                b = own[0] + self.root[0], own[1] + self.root[1]
            else:
                above, m = belief[id(x.parent)], message[id(x)]
                c0, c1 = above[0] - m[0], above[1] - m[1]
                b = own[0] + _add(c0 + p00, c1 + p10), own[1] + _add(c0 + p01, c1 + p11)
            belief[id(x)] = b
            out[id(x)] = 1 / (1 + math.exp(min(700, b[0] - b[1])))
        return out

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        nodes, stream = parse(page)
        if len(nodes) == 1:
            return SPACE.sub(" ", "".join(t for _, t in stream)).strip()
        share = self.marginals(nodes)
        blocks, own = [], []
        for node, text in [*stream, (None, "")]:
            if node is None:
                block = SPACE.sub(" ", "".join(own)).strip()
                if block:
                    blocks.append(block)
                own = []
            elif share[id(node)] >= 0.5:
                own.append(text)
        return "\n\n".join(blocks)


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a))


#: What the grammar writes into a tag that is content, and into one that isn't; both are taken out again.
GOOD, BAD = "\x01", "\x02"


def labelled_pages(n: int = 1200, seed: int = 17) -> list[tuple[str, list[int]]]:
    """Pages composed from a grammar of layouts, with the state of every node: that of the nearest marked node above it or itself."""
    rng = random.Random(seed)
    out = []

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice("abcdefghilmnoprstuéü") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(low, high)))

    def sentences(low: int = 1, high: int = 6) -> str:
        joint = lambda: rng.choice([", ", ". ", " ", " "])
        return "".join(words(3, 9).capitalize() + joint() + words(1, 6) + rng.choice([". ", ". ", ". ", "! ", "? "]) for _ in range(rng.randint(low, high))).strip()

    def prose() -> str:
        text = rng.choices([lambda: sentences(), lambda: words(1, 5).capitalize() + rng.choice(["", ".", "!"]), lambda: words(8, 60), lambda: f"{words(1, 2)} " * rng.randint(5, 40)], [12, 3, 2, 1])[0]()
        for _ in range(rng.choice([0, 0, 1, 2])):
            tag, w = rng.choice(["b", "i", "em", "strong", 'a href="/x"', "span", "code", 'a class="ref" href="#n"']), words(1, 3)
            text = text.replace(" ", f" <{tag}>{w}</{tag.split()[0]}> ", 1)
        return text

    def attr(*names: str, chance: float = 0.8) -> str:
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice(names)}"' if rng.random() < chance else ""

    def plain() -> str:
        return attr("box", "c1", "col2", "row", "zone-3", "block-12", "x7", "inner", "wrap", "module", chance=0.4)

    def entry() -> str:
        return rng.choice([lambda: words(1, 3), lambda: words(1, 2).capitalize(), lambda: words(1, 2) + rng.choice([",", "."])])()

    def links(low: int, high: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{entry()}</a></li>' for i in range(rng.randint(low, high))) + "</ul>"

    def bar(low: int, high: int) -> str:
        return rng.choice([" ", " | ", " &middot; ", ""]).join(f'<a href="/{i}">{entry()}</a>' for i in range(rng.randint(low, high)))

    def comments() -> str:
        one = rng.choice([
            lambda: f'<div class="comment"><p>{prose()}</p></div>',
            lambda: f'<li class="comment"><b>{words(1, 2)}</b> <p>{prose()}</p></li>',
            lambda: f"<div><span>{words(1, 2)}</span><p>{prose()}</p></div>",
            lambda: f'<p class="reply">{prose()}</p>',
        ])
        return "".join(one() for _ in range(rng.randint(1, 5)))

    def junk() -> str:
        return rng.choice([
            lambda: f"<nav{BAD}>{rng.choice([links, bar])(2, 9)}</nav>",
            lambda: f'<div{BAD}{attr("menu", "nav", "navbar", "topbar", "breadcrumbs", "tabs")}>{rng.choice([links, bar])(3, 9)}</div>',
            lambda: f"<ul{BAD}{plain()}>" + links(3, 9)[4:],
            lambda: f'<p{BAD}>{bar(3, 8)}</p>',
            lambda: f'<aside{BAD}{attr("sidebar", "related", "widget", "rail")}><h3>{words(1, 3)}</h3>{links(2, 6)}<p>{rng.choice([words(4, 20), sentences(1, 2)])}</p></aside>',
            lambda: f'<div{BAD} class="{rng.choice(["sidebar", "related", "widget", "trending", "recommended"])}"><h4>{words(1, 3)}</h4>{links(2, 6)}</div>',
            lambda: f'<div{BAD} class="{rng.choice(["cookie-notice", "cookie", "consent", "notice", "newsletter", "gdpr-banner", "alert"])}"><p>{sentences(1, 2)}</p><button>{words(1, 2)}</button></div>',
            lambda: f'<p{BAD} class="{rng.choice(["notice", "cookie", "disclaimer", "subscribe"])}">{sentences(1, 2)}</p>',
            lambda: f'<{(tag := rng.choice(["div", "div", "div", "section", "aside", "p"]))}{BAD} {rng.choice(["class", "class", "id"])}="{rng.choice(["ad", "ad", "ads", "advert", "sponsored", "ad-box", "promo", "dfp-slot", "advertisement"])}">{rng.choice([sentences, prose, lambda: words(3, 12)])()}</{tag}>',
            lambda: f'<form{BAD} action="/s"{attr("search", "login", "subscribe")}><label>{words(1, 4)}</label><input name="q"><button>{words(1, 2)}</button></form>',
            lambda: f'<section{BAD}{attr("comments", "comment-list", "discussion", "responses")}><h3>{words(1, 2)}</h3>{comments()}</section>',
            lambda: f'<div{BAD} {rng.choice(["class", "id"])}="{rng.choice(["comments", "disqus", "replies", "reader-comments"])}">{comments()}</div>',
            lambda: f'<div{BAD} class="share">{bar(2, 4)}</div>',
        ])()

    def block() -> str:
        return rng.choices([
            lambda: f"<p{GOOD}>{prose()}</p>",
            lambda: f"<p{GOOD}>{prose()}",
            lambda: f"<p{GOOD}><b>{prose()}<br>",
            lambda: f"<p{GOOD}{plain()}>{prose()}</p>",
            lambda: f'<p{GOOD}><a href="/y">{rng.choice([sentences(1, 2), words(3, 7).capitalize()])}</a></p>',
            lambda: f"<h2{GOOD}>{words(1, 6)}</h2>",
            lambda: f"<h3{GOOD}>{words(1, 6)}</h3>",
            lambda: f"<blockquote{GOOD}><p>{prose()}</p></blockquote>",
            lambda: f"<ul{GOOD}>" + "".join(f"<li>{rng.choice([words(2, 15), sentences(1, 2)])}</li>" for _ in range(rng.randint(2, 5))) + "</ul>",
            lambda: f"<ol{GOOD}>" + "".join(f'<li>{sentences(1, 1)} <a href="/r">{words(1, 2)}</a></li>' for _ in range(rng.randint(2, 5))) + "</ol>",
            lambda: f"<dl{GOOD}>" + "".join(f"<dt>{words(1, 3)}<dd>{sentences(1, 2)}" for _ in range(rng.randint(1, 4))) + "</dl>",
            lambda: f"<div{GOOD}{plain()}>{prose()}</div>",
            lambda: f'<figure{GOOD}><img src="i.png"><figcaption>{rng.choice([words(3, 12), sentences(1, 1)])}</figcaption></figure>',
            lambda: f"<table{GOOD}>" + "".join(f"<tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>",
            lambda: f"<pre{GOOD}>{words(3, 20)}</pre>",
        ], [14, 5, 2, 3, 2, 2, 1, 1, 2, 1, 1, 2, 1, 1, 1])[0]()

    def body(mixed: float = 0.12) -> str:
        parts = [f"<h1{GOOD}>{words(2, 9)}{rng.choice(['', '', '.'])}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 8, 12])):
            parts.append(block())
            if rng.random() < mixed:
                parts.append(junk())
        return "".join(parts)

    def main() -> str:
        return rng.choices([
            lambda: f'<article{GOOD}{attr("post", "article", "story", "entry")}>{body()}</article>',
            lambda: f"<article{GOOD}>{body()}</article>",
            lambda: f"<main><article{GOOD}>{body()}</article></main>",
            lambda: f"<main{GOOD}>{body()}</main>",
            lambda: f'<div{GOOD} class="{rng.choice(["content", "main", "post", "entry-content", "article-body", "story"])}">{body()}</div>',
            lambda: f'<div id="wrap"><div{GOOD} id="{rng.choice(["content", "main"])}">{body()}</div></div>',
            lambda: f"<div{plain()}><div{GOOD}{plain()}>{body()}</div></div>",
            lambda: f"<section{GOOD}{plain()}>{body()}</section>",
            lambda: body(),
            lambda: f"<table><tr><td{BAD}>{bar(3, 6)}</td><td{GOOD}>{body(0)}</td></tr></table>",
        ], [3, 8, 3, 2, 4, 2, 3, 2, 3, 1])[0]()

    def page() -> str:
        if rng.random() < 0.15:  # fragments: what stands at their root is content, unless it is marked as something else
            return "".join(f"<p{GOOD}>{rng.choice([prose(), words(1, 6).capitalize()])}</p>" if rng.random() < 0.9 else junk() for _ in range(rng.randint(1, 3)))
        if rng.random() < 0.05:
            return "<html><body>" + "".join(f"<p{GOOD}>{prose()}</p>" for _ in range(rng.randint(1, 3))) + "</body></html>"
        head = f'<{(tag := rng.choice(["header", "header", "div"]))}{BAD}{attr("header", "masthead", "top", chance=1.0 if tag == "div" else 0.5)}>{rng.choice([words(1, 4), links(2, 5), bar(2, 5), f"<h2>{words(1, 3)}</h2>{bar(2, 5)}"])}</{tag}>' if rng.random() < 0.4 else ""
        foot = rng.choice([
            lambda: f"<footer{BAD}>&copy; {words(1, 3)} &middot; {rng.choice([words(2, 14).capitalize() + '.', sentences(1, 3)])}</footer>",
            lambda: f"<footer{BAD}>{rng.choice([bar(2, 6), sentences(1, 2)])}</footer>",
            lambda: f'<div{BAD} class="{rng.choice(["footer", "copyright", "legal"])}"><p>&copy; {words(2, 8)}</p></div>',
            lambda: f"<p{BAD}><small>&copy; {words(1, 5)}</small></p>",
            lambda: "",
        ])()
        some = lambda: "".join(junk() for _ in range(rng.choice([0, 0, 1, 1, 2, 3])))
        return f"<html><head><meta charset=utf-8></head><body>{head}{some()}{main()}{some()}{foot}</body></html>"

    for _ in range(n):
        own = page()
        marked, _ = parse(own.replace(GOOD, ' id="cccc"').replace(BAD, ' id="jjjj"'))
        clean = own.replace(GOOD, "").replace(BAD, "")
        nodes, _ = parse(clean)
        states: dict[int, int] = {}
        for a in marked:
            states[id(a)] = 1 if "cccc" in a.attrs else 0 if "jjjj" in a.attrs else states[id(a.parent)] if a.parent else int("<body>" not in own)
        if len(nodes) == len(marked):
            out.append((clean, [states[id(a)] for a in marked]))
    return out


_MODEL: list[TreeModel] = []


def trained() -> TreeModel:
    """The model fitted on labelled_pages(), once per process."""
    if not _MODEL:
        _MODEL.append(TreeModel().fit(labelled_pages()))
    return _MODEL[0]


def extract_pages(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in slices(batches, "html"):
            texts = [own.extract(x) for x in b.column("html").to_pylist()]
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
