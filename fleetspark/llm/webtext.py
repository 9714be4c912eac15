"""Extracts the main text of web pages with a tree-structured graphical model.

A page becomes a tree of its block elements. Each has a hidden state, main text or not. What an element looks like (its tag,
its names, the landmarks it lies in, its own text) is a potential of its own, and a potential of each state pair links it to
its parent. Sum-product messages go up the tree and down again and give the marginal of every element; text whose element is
more likely main than not is kept, in page order. All trees of a batch are one forest, handled level by level.

Weights are fitted to labelled pages, by gradient ascent on the conditional likelihood of their states. ``labelled_pages``
writes pages of many layouts with known main text; ``train`` takes any others.

Defined results: null, empty and textless pages have an empty text; white space inside a block, no-break spaces too, is one
space; ``br`` is white space; text outside of all tags belongs to the page's root; unclosed and stray tags are mended as
browsers do, roughly; scripts, styles, form controls, media, comments and the head never have text. A head ends at the first
text or start tag that cannot stand in it. Other such elements end at their end tag or when a block around them ends, drawings
and formulas at ``/>`` or a block element too; one without an end tag in the rest of the page ends at the next block element.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages that are taken as one forest, by characters; training pages, gradient steps, their size, the penalty on weights.
CHUNK_CHARS = 1_500_000
PAGES, STEPS, RATE, PENALTY = 400, 250, 0.1, 0.02

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z)"""
                   r"""|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)""", re.DOTALL)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)

#: How HTML treats its elements.
UNREAD = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "select", "button", "object",
          "canvas", "audio", "video", "head"}
RAW = {"script", "style", "textarea", "title", "iframe"}
HEAD = {"title", "style", "script", "noscript", "template", "meta", "link", "base", "basefont", "bgsound", "noframes", "head", "html"}
FOREIGN = {"svg", "math"}
#: Unread elements that may hold others of their kind.
NESTED = FOREIGN | {"object", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
GROUPS = {
    "title": ["h1", "h2"], "heading": ["h3", "h4", "h5", "h6"], "paragraph": ["p"], "item": ["li", "dt", "dd"], "list": ["ul", "ol", "dl", "menu"],
    "cell": ["td", "th", "caption"], "table": ["table", "tr", "tbody", "thead", "tfoot"], "quote": ["pre", "blockquote"], "div": ["div", "center"],
    "section": ["section", "details", "summary", "hgroup"], "article": ["article"], "main": ["main"], "nav": ["nav"], "header": ["header"],
    "footer": ["footer", "address"], "aside": ["aside"], "form": ["form", "fieldset", "legend"], "figure": ["figure", "figcaption"],
    "page": ["html", "body"], "dialog": ["dialog"],
}
GROUP_OF = {tag: g for g, tags in GROUPS.items() for tag in tags}
CLOSES_P = set(GROUP_OF) - {"html", "body"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = {"ul", "ol", "dl", "menu", "table", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "body"}
#: What parts of pages are commonly named.
HINTS = {
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner adbox adsense",
    "menu": "nav navigation menu menubar breadcrumb breadcrumbs pager pagination tabs navbar toc",
    "top": "header masthead top topbar logo brand",
    "bottom": "footer foot bottom copyright legal colophon",
    "side": "side sidebar widget rail related recommended recommendations trending popular more teaser complementary",
    "notice": "cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup alert paywall dialog",
    "comment": "comment comments disqus reply replies discussion respond feedback reader",
    "share": "share sharing social follow tags tag",
    "form": "form search login contact",
    "meta": "byline author date meta timestamp",
    "content": "content article post entry story main text prose body",
}
HINT_OF = {word: h for h, words in HINTS.items() for word in words.split()}
LANDMARKS = ["article", "main", "nav", "header", "footer", "aside", "form", "dialog"]
CUES = re.compile(r"©|\bcopyright\b|all rights|\bcookies?\b|subscribe|sign up|log ?in|newsletter|advert|sponsor|\bshare\b|\bcomments?\b|\breply\b|terms of|privacy", re.IGNORECASE)

FEATURES = ([f"tag {g}" for g in [*GROUPS, "other"]] + [f"name {h}" for h in HINTS] + [f"in {m}" for m in LANDMARKS] + [f"under {h}" for h in HINTS]
            + ["no text", "text to 25", "text to 80", "text to 200", "long text", "some links", "many links", "all links", "sentence", "comma",
               "capital only", "cue", "bias"])
AT = {name: i for i, name in enumerate(FEATURES)}
_TAG = {tag: AT[f"tag {g}"] for tag, g in GROUP_OF.items()}


class Page:
    """parents, features (a list of numbers) of block elements; blocks: (element, text)."""

    def __init__(self, source: str):
        self.parents, self.features, self.blocks = [-1], [], []
        self.tags, self.names, self.around = ["body"], [frozenset()], [frozenset()]
        self._read(source)
        self._describe()

    def _read(self, source: str) -> None:
        node, position, size = 0, 0, len(source)
        pending: list[str] = []
        linked, inside_link, unread = 0, 0, None
        # of the unread element: how many of its kind are open, blocks open inside, HTML inside of a drawing, whether it is closed at all
        depth, inner, embedded, closed = 0, [], 0, True
        never_closed: set[str] = set()
        self.link_share: list[float] = []

        def flush():
            nonlocal linked
            if pending:
                text = " ".join("".join(pending).split())
                if text:
                    self.blocks.append((node, text))
                    self.link_share.append(linked / max(len(text), 1))
                pending.clear()
            linked = 0

        def text(piece):
            nonlocal linked
            if piece:
                if "&" in piece:
                    piece = entities.unescape(piece)
                pending.append(piece)
                if inside_link:
                    linked += len(piece.strip())

        def after_raw(tag):
            closing = re.compile(rf"</{tag}", re.IGNORECASE).search(source, position)
            return size if closing is None else (source.find(">", closing.end()) + 1 or size)

        def ends_block(tag, ending):
            """Whether the tag ends an open block, by name or as the next one of a list or table."""
            if tag in ("html", "body"):
                return True
            up, wanted = node, {tag} if ending else SIBLINGS.get(tag, set())
            while up and self.tags[up] not in wanted and (ending or self.tags[up] not in SCOPE):
                up = self.parents[up]
            return bool(up) and self.tags[up] in wanted

        while position < size:
            m = TOKEN.search(source, position)
            until = size if m is None else m.start()
            if unread == "head" and source[position:until].strip():
                unread = None
            if until > position and not unread:
                text(source[position:until])
            if m is None:
                break
            position = m.end()
            tag = m["tag"] or m["tag2"]
            if tag is None:
                continue
            tag, ending = tag.lower(), bool(m["end"] or m["end2"])
            attrs = m["attrs"] or m["attrs2"] or ""
            if unread == "head":
                if ending and tag not in ("head", "body", "html") or not ending and tag in HEAD - UNREAD:
                    continue
                if not ending and tag in ("noscript", "template"):
                    # skipped if it ends inside the head; if not, what follows tells where the head ends
                    closing = re.compile(rf"</{tag}[^>]*>|</head|<body", re.IGNORECASE).search(source, position)
                    if closing and closing[0].lower().startswith(f"</{tag}"):
                        position = closing.end()
                    continue
                if not ending and tag == "head":
                    continue
                if ending or tag not in HEAD:
                    unread = None
                if ending and tag == "head":
                    continue
            elif unread:
                if tag == unread:
                    depth += -1 if ending else tag in NESTED and not attrs.endswith("/")
                    if not depth:
                        unread = None
                    continue
                if not ending and tag in RAW and not (unread in FOREIGN and tag == "title"):
                    position = after_raw(tag)
                    continue
                if tag == "foreignobject":
                    embedded += -1 if ending else 1
                    continue
                if tag not in GROUP_OF and ("-" not in tag or unread in FOREIGN):
                    continue
                if not ending and not (closed and (unread not in FOREIGN or embedded > 0)) or not inner and ends_block(tag, ending):
                    unread = None
                elif not ending:
                    inner.append(tag)
                    continue
                elif tag in inner:
                    while inner.pop() != tag:
                        pass
                    continue
                elif ends_block(tag, ending):
                    unread = None
                else:
                    continue
            if not ending and tag in UNREAD:
                if tag in RAW:
                    position = after_raw(tag)
                elif not (tag in FOREIGN and attrs.endswith("/")):
                    if tag not in never_closed and not re.compile(rf"</{tag}(?![^\s/>])", re.IGNORECASE).search(source, position):
                        never_closed.add(tag)
                    unread, depth, inner, embedded, closed = tag, 1, [], 0, tag not in never_closed
                continue
            if tag == "br":
                text(" ")
            elif tag == "hr":
                flush()
            elif tag in VOID:
                continue
            elif tag == "a":
                inside_link = 0 if ending else 1
            elif tag in GROUP_OF or "-" in tag:
                flush()
                inside_link = 0
                if tag in ("html", "body"):
                    continue
                if ending:
                    up = node
                    while up and self.tags[up] != tag:
                        up = self.parents[up]
                    if up:
                        node = self.parents[up]
                    continue
                if tag in CLOSES_P and self.tags[node] == "p":
                    node = self.parents[node]
                if tag in SIBLINGS:
                    up = node
                    while up and self.tags[up] not in SIBLINGS[tag] and self.tags[up] not in SCOPE:
                        up = self.parents[up]
                    if up and self.tags[up] in SIBLINGS[tag]:
                        node = self.parents[up]
                names = frozenset()
                if attrs and "=" in attrs:
                    words = re.split(r"[^a-z]+", " ".join(x.strip("\"'") for x in NAMED.findall(attrs)).lower())
                    names = frozenset(HINT_OF[w] for w in words if w in HINT_OF)
                around = self.around[node] | {f"in {self.tags[node]}"} if self.tags[node] in LANDMARKS else self.around[node]
                around = around | {f"under {h}" for h in self.names[node]} if self.names[node] else around
                self.parents.append(node)
                self.tags.append(tag)
                self.names.append(names)
                self.around.append(around)
                node = len(self.parents) - 1
        flush()

    def _describe(self) -> None:
        own: dict[int, list[int]] = {}
        for i, (node, _) in enumerate(self.blocks):
            own.setdefault(node, []).append(i)
        for node, tag in enumerate(self.tags):
            found = [_TAG.get(tag, AT["tag other"]), AT["bias"]]
            found += [AT[f"name {h}"] for h in self.names[node]]
            found += [AT[a] for a in self.around[node]]
            parts = own.get(node)
            if not parts:
                found.append(AT["no text"])
            else:
                text = " ".join(self.blocks[i][1] for i in parts)
                n = len(text)
                found.append(AT["text to 25"] if n <= 25 else AT["text to 80"] if n <= 80 else AT["text to 200"] if n <= 200 else AT["long text"])
                share = sum(self.link_share[i] * len(self.blocks[i][1]) for i in parts) / n
                if share > 0:
                    found.append(AT["all links"] if share > 0.8 else AT["many links"] if share > 0.3 else AT["some links"])
                if text.rstrip()[-1:] in ".!?:\"”":
                    found.append(AT["sentence"])
                if "," in text:
                    found.append(AT["comma"])
                if text.isupper():
                    found.append(AT["capital only"])
                if n < 400 and CUES.search(text):
                    found.append(AT["cue"])
            self.features.append(found)


class Forest:
    """The trees of some pages as one graph, in flat arrays."""

    def __init__(self, pages: list[Page]):
        sizes = [len(p.parents) for p in pages]
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
        self.parent = np.concatenate([np.array(p.parents) + f for p, f in zip(pages, self.first, strict=False)]).astype(int)
        self.parent[self.first[:-1]] = -1
        flat = [f for p in pages for f in p.features]
        self.node = np.repeat(np.arange(len(flat)), [len(f) for f in flat])
        self.feature = np.array([x for f in flat for x in f], int)
        depth = np.zeros(len(flat), int)
        for i in np.flatnonzero(self.parent >= 0):
            depth[i] = depth[self.parent[i]] + 1
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)

    def marginals(self, weights: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of main text of each element, and of each state pair (parent, child) summed over all edges."""
        n = len(self.parent)
        alone = np.zeros((n, 2))
        alone[:, 1] = np.bincount(self.node, weights[self.feature], n)
        below, up = np.zeros((n, 2)), np.zeros((n, 2))
        for level in self.levels[:0:-1]:
            sent = np.logaddexp.reduce((alone[level] + below[level])[:, None, :] + pair, axis=2)
            up[level] = sent
            np.add.at(below, self.parent[level], sent)
        down = np.zeros((n, 2))
        edges = np.zeros((2, 2))
        for level in self.levels[1:]:
            parent = self.parent[level]
            rest = alone[parent] + below[parent] + down[parent] - up[level]
            joint = rest[:, :, None] + pair
            down[level] = np.logaddexp.reduce(joint, axis=1)
            joint = joint + (alone[level] + below[level])[:, None, :]
            joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
            edges += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(0)
        total = alone + below + down
        return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -50, 50))), edges


class Model:
    def __init__(self, weights: np.ndarray, pair: np.ndarray):
        self.weights, self.pair = weights, pair

    def texts(self, sources: list[str]) -> list[str]:
        """Main text of each page."""
        pages = [Page(s) for s in sources]
        if not pages:
            return []
        forest = Forest(pages)
        main, _ = forest.marginals(self.weights, self.pair)
        return ["\n".join(t for node, t in page.blocks if main[first + node] >= 0.5) for page, first in zip(pages, forest.first, strict=False)]


def states(page: Page, main_text: str) -> np.ndarray:
    """Labels of a page's elements: those with text by whether it is part of the main text, others by most of what is below."""
    wanted = set(main_text.split("\n"))
    yes, all_ = np.zeros(len(page.parents)), np.zeros(len(page.parents))
    for node, text in page.blocks:
        all_[node] += len(text)
        yes[node] += len(text) * (text in wanted)
    own = all_ > 0
    label = yes > all_ / 2
    for i in range(len(page.parents) - 1, 0, -1):
        yes[page.parents[i]] += yes[i]
        all_[page.parents[i]] += all_[i]
    return np.where(own, label, yes * 2 > all_).astype(float)


def train(labelled: list[tuple[str, str]], steps: int = STEPS) -> Model:
    """Fits the model to (html, main text with one block a line)."""
    pages = [Page(h) for h, _ in labelled]
    forest = Forest(pages)
    label = np.concatenate([states(p, t) for p, (_, t) in zip(pages, labelled, strict=True)])
    child = forest.parent >= 0
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[forest.parent[child]].astype(int), label[child].astype(int)), 1)
    x = np.zeros(len(FEATURES) + 4)
    mean, square = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        main, edges = forest.marginals(x[:-4], x[-4:].reshape(2, 2))
        gradient = np.append(np.bincount(forest.feature, (label - main)[forest.node], len(FEATURES)), (seen - edges).ravel()) / len(pages) - PENALTY * x / 10
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        x = x + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    return Model(x[:-4], x[-4:].reshape(2, 2))


def labelled_pages(count: int = PAGES, seed: int = 11) -> list[tuple[str, str]]:
    """Pages of random layouts, in which parts are told by tags, by names, or hardly, with their main text."""
    rng = random.Random(seed)
    syllables = [a + b for a in "b c d f g l m n p r s t v th st er an".split() for b in "a e i o u en on al".split()]

    def word():
        return "".join(rng.choices(syllables, k=rng.randint(1, 3)))

    def words(low, high):
        return " ".join(word() for _ in range(rng.randint(low, high)))

    def sentence(low=4, high=16):
        return words(low, high).capitalize() + rng.choice([".", ".", ".", "?", "!"])

    def prose(low, high):
        return " ".join(sentence() + ("" if rng.random() < 0.6 else f" {word().capitalize()}, {sentence()}") for _ in range(rng.randint(low, high)))

    def link(low=1, high=3):
        return f'<a href="/{word()}">{words(low, high)}</a>'

    def named(kind, tag):
        return f'<{tag} {rng.choice(["class", "id"])}="{rng.choice(["", word() + "-"])}{rng.choice(HINTS[kind].split())}{rng.choice(["", "-" + word()])}">', f"</{tag}>"

    def part(kind, tag, plain=0.0):
        """Opening and closing tag of a part: its own element, a named one, or a plain div."""
        r = rng.random()
        if r < plain:
            return "<div>", "</div>"
        return (f"<{tag}>", f"</{tag}>") if r < 0.5 and tag != "div" else named(kind, rng.choice(["div", "section", tag]))

    def menu():
        a, z = part("menu", "nav", 0.15)
        links = [link() for _ in range(rng.randint(3, 8))]
        inner = "".join(f"<li>{x}</li>" for x in links)
        return a + (f"<ul>{inner}</ul>" if rng.random() < 0.7 else " | ".join(links)) + z

    def top():
        a, z = part("top", "header")
        return a + rng.choice([f"<div>{words(1, 3)}</div>", f"<p>{sentence(2, 6)}</p>", f"<h2>{words(1, 3)}</h2>"]) + (menu() if rng.random() < 0.4 else "") + z

    def bottom():
        a, z = part("bottom", "footer")
        return a + rng.choice([f"&copy; {words(1, 3)} &middot; {prose(1, 3)}", f"<p>© 2024 {words(1, 4)}. All rights reserved.</p><p>{prose(1, 2)}</p>",
                               f"<p>{prose(1, 2)}</p><ul><li>{link()}</li><li>{link()}</li></ul>"]) + z

    def side():
        a, z = part("side", "aside")
        inner = "".join(f"<li>{link(2, 6)}</li>" for _ in range(rng.randint(2, 6)))
        return a + f"<h3>{words(1, 3)}</h3>" + rng.choice([f"<ul>{inner}</ul>", f"<p>{prose(1, 3)}</p>", f"<p>{prose(1, 2)}</p><ul>{inner}</ul>"]) + z

    def notice():
        a, z = part("notice", rng.choice(["div", "dialog"]))
        return a + rng.choice([f"<p>We use cookies. {prose(1, 2)}</p>", f"<p>{prose(1, 2)}</p>", prose(1, 2)]) + rng.choice(["", f"<button>{word()}</button>"]) + z

    def advert():
        a, z = named("ad", rng.choice(["div", "div", "aside", "section"]))
        return a + rng.choice([prose(1, 3), f"<p>{prose(1, 2)}</p>", f"<a href='/x'>{prose(1, 1)}</a>", f"{sentence()}\n{sentence()}"]) + z

    def form():
        a, z = rng.choice([("<form>", "</form>"), (f'<form class="{word()}">', "</form>")])
        return a + f"<p>{sentence()}</p><label>{words(1, 2)}</label><input name=x><button>{word()}</button>" + z

    def comments():
        a, z = named("comment", rng.choice(["section", "div", "div"]))
        one = rng.choice(["<div class=comment><p>%s</p></div>", "<li><p>%s</p></li>", "<article class=\"comment\"><h4>" + word() + "</h4><p>%s</p></article>", "<p>%s</p>"])
        return a + f"<h3>{words(1, 2)}</h3>" + "".join(one % prose(1, 4) for _ in range(rng.randint(1, 5))) + z

    def share():
        a, z = named("share", "div")
        return a + " ".join(link(1, 1) for _ in range(rng.randint(2, 4))) + z

    def body():
        """Blocks of an article, html and text."""
        html, text = [], []

        def add(pattern, *inner):
            html.append(pattern % inner)
            text.extend(inner)

        title = rng.choice([words(3, 9), sentence()])
        if rng.random() < 0.9:
            add(rng.choice(["<h1>%s</h1>", "<h1 class=title>%s</h1>", "<header><h1>%s</h1></header>", "<h2>%s</h2>"]), title)
        for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 12])):
            r = rng.random()
            if r < 0.62:
                add(rng.choice(["<p>%s</p>", "<p>%s</p>", "<p>%s", "<p><b>%s</b><br></p>", "<div>%s</div>"]), prose(1, 6))
            elif r < 0.68:
                add("<p>%s</p>", words(1, 4))
            elif r < 0.76:
                add(rng.choice(["<h2>%s</h2>", "<h3>%s</h3>"]), words(2, 6))
            elif r < 0.84:
                add("<ul><li>%s</li><li>%s</li></ul>", words(2, 9), sentence())
            elif r < 0.88:
                add("<blockquote><p>%s</p></blockquote>", prose(1, 2))
            elif r < 0.91:
                add("<table><tr><td>%s</td><td>%s</td></tr></table>", words(1, 3), words(1, 3))
            elif r < 0.94:
                add("<pre>%s</pre>", words(3, 9))
            elif r < 0.96:
                add("<figure><img src=x><figcaption>%s</figcaption></figure>", sentence())
            else:
                html.append(advert())
        return "".join(html), text

    pages = []
    for _ in range(count):
        html, text = body()
        a, z = rng.choice([("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"),
                           named("content", "div"), named("content", "section"), ("<div>", "</div>")])
        extra = [x() for x, p in ((share, 0.2), (comments, 0.3), (advert, 0.15), (form, 0.1), (side, 0.15)) if rng.random() < p]
        inside = "".join(x for x in extra if rng.random() < 0.4)
        before = [x() for x, p in ((top, 0.5), (menu, 0.7), (notice, 0.35), (advert, 0.5), (side, 0.2), (form, 0.1)) if rng.random() < p]
        after = [x for x in extra if x not in inside] + [x() for x, p in ((side, 0.3), (advert, 0.15), (form, 0.1), (bottom, 0.8), (notice, 0.1)) if rng.random() < p]
        head = f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{words(2, 6)}</title><style>p{{margin:0}}</style></head><body>"
        pages.append((head + "".join(before) + a + html + inside + z + "".join(after) + "</body></html>", "\n".join(text)))
    return pages


@lru_cache(maxsize=1)
def default_model() -> Model:
    return train(labelled_pages())


def main_texts(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    model = model or default_model()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = batch.column(2).to_pylist()
            found, first, held = [], 0, 0
            for i, source in enumerate(sources):
                held += len(source)
                if held > CHUNK_CHARS or i == len(sources) - 1:
                    found += model.texts(sources[first:i + 1])
                    first, held = i + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return plain.mapInArrow(rows, "page_id bigint, url string, text string, n_chars bigint")
