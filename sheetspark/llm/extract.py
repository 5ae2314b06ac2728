"""Main text of HTML pages by a tree-structured graphical model.

Every element of a page is a node that is content or not. A node's own potential comes from its
features: its tag, words of its class, id and role, how much text it holds, how much of that is links,
how its text reads. A potential between parent and child says how likely a child is what its parent is;
there is one for each kind of child. Sum-product messages go up from the leaves to the root and down
again, level by level for all pages of a batch side by side, and give every element's marginal
probability. The text right under elements with a marginal of a half or more is kept, in page order.

Weights are those of greatest likelihood on labelled pages. ``labelled_pages`` makes these by rule:
articles in various layouts, with and without telling class names, among menus, notices, adverts,
sidebars, forms, reader comments and footers.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import DataFrame

from .common import pick, text_batches
from .dom import INLINE, Page

#: Groups of tags, and words of class, id and role that tell something.
TAGS = {
    "article": "article main", "section": "section", "div": "div center", "p": "p", "head": "h1 h2 h3 h4 h5 h6 hgroup", "list": "ul ol dl menu", "item": "li dt dd",
    "table": "table tbody thead tfoot tr td th caption", "quote": "blockquote pre figure figcaption address details summary", "nav": "nav", "header": "header", "footer": "footer",
    "aside": "aside dialog", "form": "form fieldset button label input legend output select optgroup option datalist", "link": "a", "page": "#root html body", "meta": "head",
}
WORDS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager tabs toolbar skip",
    "head": "header masthead topbar top logo branding", "foot": "footer foot bottom copyright colophon contentinfo legal",
    "side": "sidebar side aside complementary rail related recommended more widget popular trending tags",
    "notice": "cookie cookies consent notice banner alert popup modal overlay dialog gdpr warning message",
    "advert": "ad ads adv advert advertisement advertising sponsor sponsored promo promotion teaser outbrain taboola",
    "form": "form search login signup subscribe newsletter register contact", "share": "share social follow buttons byline author meta date",
    "comment": "comment comments reply replies disqus respond discussion feedback reviews reader",
    "content": "content article post entry story main body text page single blog news maincontent prose", "hidden": "hidden none invisible",
}
_GROUP = {tag: group for group, tags in TAGS.items() for tag in tags.split()}
_HINT = {word: group for group, words in WORDS.items() for word in words.split()}
_SPLIT = re.compile(r"[^a-z]+")
NAMES = [
    "any", *[f"tag {g}" for g in TAGS], "tag inline", "tag other", *[f"word {g}" for g in WORDS], *[f"size {i}" for i in range(6)], *[f"links {i}" for i in range(4)],
    "sentence", "marks no sentence", "under body", *[f"own {i}" for i in range(3)], *[f"share {i}" for i in range(4)],
]
_NUMBER = {n: i for i, n in enumerate(NAMES)}
EDGES = ["inline", "block", "section", "told", "page", "empty", "named"]
#: Elements without any text say nothing of what is around them: no features, and an edge without weights.
EMPTY = 5


def features(page: Page) -> tuple[list[list[int]], list[int], list[int]]:
    """Each element's feature numbers, the kind of its edge to its parent, and its depth."""
    n = len(page.tags)
    own, links, stops = [0] * n, [0] * n, [0] * n
    for at, text, _ in page.texts:
        stripped = text.strip()
        own[at] += len(stripped)
        stops[at] += stripped.count(". ") + stripped.endswith((".", "!", "?"))
    size = own[:]
    for i in range(n - 1, 0, -1):
        if page.tags[i] == "a":
            links[i] = size[i]
        up = page.parents[i]
        size[up] += size[i]
        links[up] += links[i]
        stops[up] += stops[i]
    rows, edges, depths = [], [], [0] * n
    for i, tag in enumerate(page.tags):
        up = page.parents[i]
        if up >= 0:
            depths[i] = depths[up] + 1
        if not size[i]:
            rows.append([])
            edges.append(EMPTY)
            continue
        group = _GROUP.get(tag) or ("inline" if tag in INLINE else "other")
        row = [0, _NUMBER[f"tag {group}"]]
        hints = {_HINT[w] for w in _SPLIT.split(page.marks[i]) if w in _HINT} if page.marks[i] else ()
        row += [_NUMBER[f"word {h}"] for h in hints]
        row.append(_NUMBER[f"size {min(5, size[i].bit_length() // 2)}"])
        row.append(_NUMBER[f"links {min(3, 4 * links[i] // size[i]) if size[i] else 0}"])
        row.append(_NUMBER[f"own {min(2, own[i].bit_length() // 4)}"])
        part = size[i] / size[0]  # of the page's text
        row.append(_NUMBER[f"share {(part >= 0.05) + (part >= 0.2) + (part >= 0.5)}"])
        if stops[i]:
            row.append(_NUMBER["sentence"])
        elif size[i]:
            row.append(_NUMBER["marks no sentence"])
        if up >= 0 and _GROUP.get(page.tags[up]) == "page" and group != "page":
            row.append(_NUMBER["under body"])
        rows.append(row)
        edges.append(4 if group == "page" else 6 if hints and not set(hints) - {"content"} else 3 if hints or group in ("nav", "aside", "footer", "header", "form") else 0 if tag in INLINE else 2 if group in ("section", "article", "div") else 1)
    return rows, edges, depths


class Forest:
    """The elements of many pages as arrays, by depth."""

    def __init__(self, pages: list[Page]):
        made = [features(p) for p in pages]
        self.starts = np.cumsum([0] + [len(p.tags) for p in pages])
        self.parents = np.concatenate([np.array(p.parents) + s for p, s in zip(pages, self.starts)]) if pages else np.zeros(0, int)
        counts = np.array([len(r) for rows, _, _ in made for r in rows], np.int64)
        self.flat = np.fromiter((f for rows, _, _ in made for r in rows for f in r), np.int64)
        self.owner = np.repeat(np.arange(len(counts)), counts)
        self.edges = np.array([e for _, es, _ in made for e in es], np.int64)
        depth = np.array([d for _, _, ds in made for d in ds], np.int64)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []

    def marginals(self, weights: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each node's probability of being content, and of (parent, child) states for its edge."""
        n = len(self.edges)
        alone = np.zeros((n, 2))
        alone[:, 1] = np.bincount(self.owner, weights[self.flat], n)
        gathered, up = alone.copy(), np.zeros((n, 2))
        for level in self.levels[:0:-1]:  # towards the root
            up[level] = _log_sum(pair[self.edges[level]] + gathered[level][:, None, :], 2)
            for s in (0, 1):
                gathered[:, s] += np.bincount(self.parents[level], up[level, s], n)
        belief, both = gathered.copy(), np.zeros((n, 2, 2))
        for level in self.levels[1:]:  # and back
            above = belief[self.parents[level]] - up[level]
            joint = above[:, :, None] + pair[self.edges[level]] + gathered[level][:, None, :]
            belief[level] = _log_sum(joint, 1)
            joint = np.exp(joint - joint.max((1, 2), keepdims=True))
            both[level] = joint / joint.sum((1, 2), keepdims=True)
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), both


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def train(pages: list[tuple[Page, list[int]]], rounds: int = 250, rate: float = 0.3, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Node and edge weights of greatest likelihood for labelled pages, (page, 0 or 1 of each element)."""
    forest = Forest([p for p, _ in pages])
    gold = np.concatenate([np.array(y) for _, y in pages])
    children = np.concatenate(forest.levels[1:])
    gold_pair = np.zeros((len(EDGES), 2, 2))
    np.add.at(gold_pair, (forest.edges[children], gold[forest.parents[children]], gold[children]), 1)
    weights, pair = np.zeros(len(NAMES)), np.zeros((len(EDGES), 2, 2))
    sums = [np.full_like(weights, 1e-8), np.full_like(pair, 1e-8)]
    for _ in range(rounds):
        p, both = forest.marginals(weights, pair)
        g = np.bincount(forest.flat, (gold - p)[forest.owner], len(NAMES))
        g_pair = gold_pair.copy()
        for e in range(len(EDGES)):
            g_pair[e] -= both[children][forest.edges[children] == e].sum(0)
        g_pair[EMPTY] = 0
        for w, grad, s in ((weights, g, sums[0]), (pair, g_pair, sums[1])):
            grad = grad - decay * len(gold) * w * 0.1
            s += grad * grad
            w += rate * grad / np.sqrt(s)
    return weights, pair


def labelled_pages(seed: int = 5, n: int = 400) -> list[tuple[str, str]]:
    """Pages by rule from a seed: (html, main text). Content elements are marked by an attribute ``data-y``."""
    rng = random.Random(seed)

    def word():
        return "".join(rng.choice(("an", "be", "co", "du", "el", "fi", "go", "hu", "is", "ka", "lo", "mi", "ne", "or", "pu", "ra", "st", "te", "un", "ve")) for _ in range(rng.randint(1, 4)))

    def words(a, b):
        return " ".join(word() for _ in range(rng.randint(a, b)))

    def sentences(a, b):
        return " ".join(words(3, 14).capitalize() + rng.choice((".", ".", ".", "!", "?")) for _ in range(rng.randint(a, b)))

    def links(a, b, item="li", sep=""):
        made = sep.join((f"<{item}>" if item else "") + f'<a href="/{word()}">{words(1, 3)}</a>' + (f"</{item}>" if item else "") for _ in range(rng.randint(a, b)))
        return f"<ul>{made}</ul>" if item == "li" else made

    def named(*options):
        return rng.choice(options)

    def boiler():
        return rng.choice((
            lambda: f"<nav>{links(3, 9)}</nav>", lambda: f'<div class="{named("menu", "navbar", "breadcrumbs")}">{links(3, 8)}</div>', lambda: f'<div id="menu">{links(3, 8, "", " | ")}</div>',
            lambda: f'<header class="{named("top", "site-header", "")}"><a href="/">{words(1, 2)}</a>{links(2, 6)}<p>{words(2, 8)}</p></header>', lambda: f"<header><p>{sentences(1, 1)}</p></header>",
            lambda: f'<div class="{named("ad", "ads", "advert", "sponsored", "ad-banner")}">{sentences(1, 2)}</div>', lambda: f'<div class="promo"><p>{sentences(1, 2)}</p></div>',
            lambda: f'<div class="{named("cookie-notice", "cookie", "notice", "consent", "alert")}"><p>{sentences(1, 3)}</p><button>{words(1, 2)}</button></div>',
            lambda: f'<aside><h3>{words(1, 3)}</h3>{links(3, 7)}<p>{sentences(1, 2)}</p></aside>', lambda: f'<div class="sidebar"><h2>{words(1, 3)}</h2><p>{sentences(1, 3)}</p>{links(2, 5)}</div>',
            lambda: f'<form action="/s"><label>{words(1, 2)}</label><input name="q"><button>{words(1, 1)}</button><p>{sentences(1, 1)}</p></form>', lambda: f'<div class="newsletter"><form><p>{sentences(1, 1)}</p></form></div>',
        ))()

    def after():
        return rng.choice((
            lambda: f"<footer>&copy; {words(1, 2)} &middot; {sentences(1, 3)}</footer>", lambda: f'<footer id="{named("footer", "colophon", "bottom")}"><div class="{named("site-info", "inner", "")}">{sentences(1, 3)}</div></footer>', lambda: f'<div id="footer"><p>{sentences(1, 2)}</p>{links(2, 5, "", " | ")}</div>',
            lambda: f'<section class="{named("comments", "comment-list")}"><h2>{words(1, 2)}</h2>' + "".join(f'<div class="comment"><p>{sentences(1, 3)}</p></div>' for _ in range(rng.randint(1, 4))) + "</section>",
            lambda: f'<div id="comments"><ol>' + "".join(f"<li><b>{word()}</b><p>{sentences(1, 4)}</p></li>" for _ in range(rng.randint(1, 4))) + "</ol></div>",
            lambda: f'<div class="related"><h3>{words(1, 3)}</h3>{links(3, 6)}</div>', lambda: f'<div class="share">{links(2, 4, "", " ")}</div>',
        ))()

    def inner():
        body = f"<h1 data-y>{words(2, 12)}</h1>" if rng.random() < 0.8 else ""
        if body and rng.random() < 0.25:
            body = f'<{named("header", "div")} data-y class="{named("entry-header", "post-header", "title", "")}">{body}</header>'
            body = body if body.startswith("<header") else body.replace("</header>", "</div>")
        if rng.random() < 0.15:
            body += f'<div class="{named("byline", "meta", "author")}">{words(1, 4)}</div>'
        for _ in range(rng.randint(1, 7)):
            text = rng.choice((sentences(1, 8), words(1, 6) + ".", words(5, 40), sentences(2, 3) + f' <a data-y href="/x">{words(1, 4)}</a> ' + sentences(1, 2), f"<em data-y>{words(1, 4)}</em> {sentences(1, 4)}"))
            body += rng.choice((f"<p data-y>{text}</p>", f"<p data-y>{text}</p>", f"<p data-y>{text}", f"<p data-y><b data-y>{text}<br>", f"<div data-y>{text}</div>"))
            body += rng.choice(("", "", "", f"<h2 data-y>{words(1, 6)}</h2>", f"<ul data-y><li data-y>{words(1, 9)}</li><li data-y>{sentences(1, 2)}</li></ul>", f"<blockquote data-y>{sentences(1, 3)}</blockquote>", f"<table data-y><tr data-y><td data-y>{words(1, 3)}</td><td data-y>{words(1, 3)}</td></tr></table>"))
            if rng.random() < 0.08:
                body += f'<div class="ad">{sentences(1, 1)}</div>'
        return body

    pages = []
    for _ in range(n):
        post = f'<article data-y class="{named("post", "entry", "hentry", "story")}">'
        open_, close = rng.choice((
            ("<article data-y>", "</article>"), ("<article data-y>", "</article>"), ("<main data-y>", "</main>"), ("<main data-y><article data-y>", "</article></main>"),
            (f'<div data-y class="{named("content", "post", "entry-content", "article-body")}">', "</div>"), (f'<div data-y id="{named("content", "main", "story")}">', "</div>"), ("<div data-y>", "</div>"), ("<section data-y>", "</section>"),
            (f'<div data-y class="{word()}"><div data-y>', "</div></div>"),
            (f'<div data-y id="{named("content", "primary", "main")}" class="{named("site-content", "content-area", "")}"><main data-y>{post}<div data-y class="{named("entry-content", "post-body", "text")}">', f"</div></article>{after() if rng.random() < 0.6 else ''}</main></div>"),
            (f'<table data-y width="100%"><tr><td colspan="2">{links(2, 5, "", " | ")}</td></tr><tr data-y><td class="{named("menu", "left", "")}">{links(2, 6, "", "<br>")}</td><td data-y>', f'</td></tr><tr><td colspan="2"><font size="1">{rng.choice(("&copy; ", "Copyright ", ""))}{sentences(1, 2)}</font></td></tr></table>'),
        ))
        before = "".join(boiler() for _ in range(rng.randint(0, 3)))
        behind = "".join(rng.choice((after, boiler))() for _ in range(rng.randint(0, 3)))
        body = rng.choice(("<body data-y>", "<body data-y>", f'<body data-y class="{named("home blog", "single", "page", "news article", "no-sidebar")}">'))
        page = f"<body data-y>{before}{open_}{inner()}{close}{behind}"
        wrap = rng.random() < 0.3
        pages.append(f'<!DOCTYPE html><html data-y><head><meta charset="utf-8"><title>{words(2, 6)}</title><script>var x="</p>";</script></head>' + (page.replace("<body data-y>", f'{body}<div data-y class="{named("wrapper", "site", "container", "page")}">') + "</div>" if wrap else page.replace("<body data-y>", body)) + "</body></html>")
    return pages


def gold(source: str) -> tuple[Page, list[int]]:
    """The page without its marks, and which elements have them."""
    marked = []

    def note(m):
        marked.append(m[0].endswith("data-y"))
        return m[0].removesuffix(" data-y")

    plain = re.sub(r"<[a-zA-Z][^\s/>]*(?: data-y)?", note, source)
    page = Page(plain)
    names = [m.lower() for m in re.findall(r"<([a-zA-Z][^\s/>]*)", source)]
    from .dom import RAW, VOID

    inside = [y for n, y in zip(names, marked) if n not in VOID and n not in RAW]
    return page, [1, *map(int, inside)]


_trained: list[tuple[np.ndarray, np.ndarray]] = []


def model() -> tuple[np.ndarray, np.ndarray]:
    """Weights trained on the labelled pages, once for a process."""
    if not _trained:
        _trained.append(train([gold(p) for p in labelled_pages()]))
    return _trained[0]


def main_texts(sources: list[str | None], weights: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """The main text of each page: white space of a block as one space, blocks joined by one space."""
    pages = [Page(s) for s in sources]
    forest = Forest(pages)
    content = forest.marginals(*weights)[0] >= 0.5
    out = []
    for page, start in zip(pages, forest.starts):
        parts = []
        for at, text, broken in page.texts:
            if broken:
                parts.append(" ")
            if content[start + at]:
                parts.append(text)
        out.append(" ".join("".join(parts).split()))
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights=None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    Defined cases: null or empty html, or a page without content, gives an empty text; broken markup is
    read as far as it goes; repeated rows get equal values; null ids and urls are carried along; an empty
    table gives no rows; other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(weights or model())

    def run(batches):
        import pyarrow as pa

        for batch in text_batches(batches, 4 << 20):
            texts = main_texts(batch.column(2).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    chosen = pick(pages, page_id=id_col, url=url_col, html=html_col).selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "cast(html as string) html")
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")
