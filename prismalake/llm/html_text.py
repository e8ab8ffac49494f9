"""Main text of web pages by a maximum-scoring subsequence.

A page becomes a sequence of words and tags. Words score positive; inside links
and inside containers that look like menus, adverts or comments they score
negative. Tags score negative, by weights learned from labelled pages (html and
main text). One linear scan finds the contiguous run of words and tags with the
largest sum; the blocks that it touches, without those of negative containers,
are the text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Fixed element names. What stands in RAW elements is never markup or text, up to their end tag.
RAW = ("script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements of other vocabularies, in which a slash closes a tag.
FOREIGN = {"svg", "math"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "head",
    "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th",
    "thead", "tr", "ul",
}
#: Elements the page and the article are made of: their names and classes never speak against them.
KEEP = {"html", "body", "main", "article"}

#: Fixed scores of containers by element.
BY_TAG = {
    "nav": -4, "aside": -4, "footer": -4, "menu": -4, "dialog": -4, "button": -4, "select": -4, "head": -9, "svg": -9, "math": -9, "noscript": -4,
    "template": -9, "object": -4, "canvas": -4, "video": -4, "audio": -4, "form": -2, "fieldset": -2,
}
#: Fixed scores of containers by parts of their class, id and role values: menus, adverts, notices, comments and the like;
#: words that name such things or a part of an article; words that name articles.
STRONG, WEAK, GOOD = -4, -2, 2
STRONG_PARTS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promoted", "banner",
    "nav", "navbar", "navigation", "navigate", "menu", "menus", "breadcrumb", "breadcrumbs", "sidebar", "aside", "widget", "widgets", "footer", "masthead",
    "topbar", "toolbar", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "overlay", "newsletter", "subscribe",
    "subscription", "signup", "login", "related", "recommended", "recommendations", "comment", "comments", "commentlist", "respond", "disqus",
    "pagination", "pager", "copyright", "disclaimer", "complementary", "contentinfo", "outbrain", "taboola", "dismiss",
}
WEAK_PARTS = {
    "promotion", "side", "header", "alert", "form", "search", "share", "sharing", "social", "reply", "replies", "discussion", "tags", "legal", "skip",
}
GOOD_PARTS = {
    "article", "story", "post", "entry", "content", "body", "text", "main", "news", "blog", "page", "chapter", "report", "recipe", "lead",
}
SCORES = dict.fromkeys(STRONG_PARTS, STRONG) | dict.fromkeys(WEAK_PARTS, WEAK) | dict.fromkeys(GOOD_PARTS, GOOD)
#: A doubtful container (a negative score above STRONG) is text after all with so many words of running text, twice as many as in its links.
RUNNING_WORDS, RUNNING_BLOCK = 40, 12

#: A tag: quotation marks only count behind an equals sign, and only if they close.
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+)(?:>|$)|[^<]+|<",
    re.S,
)
ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|aria-hidden|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s"'/>]|$)""", re.I)
PART = re.compile(r"[A-Za-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
SPACE = re.compile(r"\s+")

WORD_SCORE = 1.0
LINK_SCORE = -0.5
#: Words of negative containers never reach the text, so they only hold a region together less well.
EXCLUDED_SCORE = -0.25
#: Words beside the article, on pages that mark one; and the share of a tag's weight that counts inside it.
BESIDE_SCORE = -1.0
INSIDE_SHARE = 0.05
UNKNOWN_TAG = -0.1

#: Labelled pages, html and main text, from which the tags' weights are learned.
LABELLED = (
    ("<html><head><title>t</title></head><body><header><a>site</a></header><nav><ul><li><a>one</a></li><li><a>two</a></li><li><a>three</a></li></ul></nav><div><a>advert</a></div>"
     "<article><h1>Title</h1><p>First <b>bold</b> line<br>goes on.</p><p>Second.</p><p>Third.</p></article><footer><p>about</p><a>legal</a></footer></body></html>",
     "Title\nFirst bold line goes on.\nSecond.\nThird."),
    ("<html><body><div><ul><li><a>home</a></li><li><a>shop</a></li></ul></div><main><h1>Head</h1><h2>Part</h2><p>A <i>b</i> c <a>d</a>.</p><ul><li>first</li><li>second</li></ul>"
     "<blockquote><p>said</p></blockquote><p>An <em>e</em> and <strong>s</strong> and <code>k</code>.</p></main><aside><h3>more</h3><ul><li><a>x</a></li><li><a>y</a></li></ul></aside>"
     "<form><label>mail</label><input><button>send</button></form><footer><p>imprint</p></footer></body></html>",
     "Head\nPart\nA b c d.\nfirst\nsecond\nsaid\nAn e and s and k."),
    ("<html><body><div><div><a>top</a><a>login</a></div></div><div><section><h2>Story</h2><p>It began.</p><figure><img><figcaption>seen</figcaption></figure><p>It went on.</p>"
     "<table><tr><th>year</th><td>one</td></tr><tr><th>sum</th><td>two</td></tr></table><pre>code</pre><ol><li>step</li></ol><p>It <span>ended</span>.</p></section></div>"
     "<div><form><label>name</label><input><button>go</button></form></div><div><ul><li><a>next</a></li><li><a>last</a></li></ul></div></body></html>",
     "Story\nIt began.\nseen\nIt went on.\nyear\none\nsum\ntwo\ncode\nstep\nIt ended."),
)


@dataclass
class Node:
    """An open element, or a container whose words are counted until the page ends."""

    name: str
    link: bool = False
    score: int = 0  # negative: a container that may be left out
    running: int = 0
    linked: int = 0
    above: Node | None = None  # the nearest container around it


@dataclass
class Page:
    """The word and tag sequence of a page: (score, words, block, container) of each run of words, (weight, 0, -1, None) of each tag."""

    events: list[tuple[float, int, int, Node | None]] = field(default_factory=list)
    blocks: list[str] = field(default_factory=list)
    around: list[Node | None] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)


def container_score(tag: str, attrs: str, in_article: bool) -> int:
    """Negative if an element's name, class, id or role speaks against its words."""
    score = BY_TAG.get(tag, 0)
    if tag == "header" and not in_article:  # an article's own header holds its title
        score = STRONG
    if tag in KEEP or not attrs or "=" not in attrs and "hidden" not in attrs:
        return score
    good = bad = 0
    for m in ATTR.finditer(attrs):
        key, value = m.group(1).lower(), (m.group(2) or "").strip("\"'")
        if key == "hidden" and value.lower() != "false" or key == "aria-hidden" and value.lower() == "true":
            return -9
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return -9
        elif key in ("class", "id", "role"):
            for p in PART.findall(CAMEL.sub(" ", value)):
                x = SCORES.get(p.lower(), 0)
                good, bad = max(good, x), min(bad, x)
    # an article's name takes back a doubt, but not what names a menu, an advert or comments
    return min(score, bad + good if bad > STRONG else bad)


def parse(page: str, weights: dict[str, float]) -> Page:
    """Words, tags, blocks and containers of a page in one pass."""
    out = Page()
    stack: list[Node] = []
    n_open: Counter[str] = Counter()  # elements of the stack by name
    n_link = in_article = in_body = foreign = 0
    marked = re.search(r"<(article|main)[\s>]", page, re.I) is not None
    parts: list[str] = []
    runs: list[tuple[int, bool]] = []  # words of the open block, and whether they are linked
    around: Node | None = None
    block_around: Node | None = None

    def flush() -> None:
        nonlocal parts, runs
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            if text:
                k, c = len(out.blocks), block_around
                out.blocks.append(text)
                out.around.append(c)
                plain, linked = sum(n for n, x in runs if not x), sum(n for n, x in runs if x)
                up = c
                while up is not None:  # containers around containers are few
                    up.running += plain if plain >= RUNNING_BLOCK else 0
                    up.linked += linked
                    up = up.above if up.score > STRONG else None
                for n, x in runs:
                    out.events.append((BESIDE_SCORE if marked and not in_body else LINK_SCORE if x and not in_body else WORD_SCORE, n, k, c))
        parts, runs = [], []

    def close(at: int) -> None:
        nonlocal n_link, in_article, in_body, foreign, around
        for x in stack[at:]:
            n_open[x.name] -= 1
            n_link -= x.link
            in_article -= x.name == "article"
            in_body -= x.name in ("article", "main")
            foreign -= x.name in FOREIGN
        del stack[at:]
        around = None if not stack else stack[-1] if stack[-1].score < 0 else stack[-1].above

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        name = m.group(2)
        if name is None:
            piece = m.group()
            if piece[0] == "<" and len(piece) > 1:
                continue
            # a run of text may hold lone "<" signs; references are decoded once the run is whole
            text = html.unescape(piece) if "&" in piece else piece
            parts.append(text)
            if k := len(text.split()):
                if not runs:
                    block_around = around
                runs.append((k, n_link > 0))
            continue
        name, closing = name.lower(), bool(m.group(1))
        if name in BLOCK:
            flush()
        elif name == "br":
            parts.append(" ")
        out.events.append((weights.get(name, UNKNOWN_TAG) * (INSIDE_SHARE if in_body else 1.0), 0, -1, None))
        out.tags.append(name)
        if closing:
            if n_open[name]:
                k = len(stack) - 1
                while stack[k].name != name:
                    k -= 1
                if any(x.score < 0 for x in stack[k:]):
                    flush()
                close(k)
            continue
        if name in RAW:
            end = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            at = page.find(">", end.start()) + 1 or n if end else n
            continue
        if name in VOID or m.group().endswith("/>") and (foreign or name in FOREIGN):
            continue
        if name in ("p", "li", "option", "td", "th", "tr", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6"):
            k = _implied_end(stack, name) if n_open[name] else None
            if k is not None:
                close(k)
        score = container_score(name, m.group(3), in_article > 0)
        if score < 0:
            flush()
        node = Node(name, name == "a", score, above=around)
        stack.append(node)
        n_open[name] += 1
        n_link += node.link
        in_article += name == "article"
        in_body += name in ("article", "main")
        foreign += name in FOREIGN
        if score < 0:
            around = node
    flush()
    return out


def _implied_end(stack: list[Node], name: str) -> int | None:
    """Place of the open element that ends where the next of its kind begins."""
    limit = {"p": BLOCK - {"p"}, "li": {"ul", "ol", "menu"}}.get(name, {"table", "dl", "div", "article", "section", "body", "select"} - {name})
    for k in range(len(stack) - 1, -1, -1):
        if stack[k].name == name:
            return k
        if stack[k].name in limit:
            return None
    return None


def left_out(c: Node | None) -> bool:
    """Whether a container, or one around it, is no part of the text."""
    while c is not None:
        if c.score <= STRONG or c.running < RUNNING_WORDS or c.running < 2 * c.linked:
            return True
        c = c.above
    return False


def best_region(events: Iterable[tuple[float, int]]) -> tuple[int, int]:
    """First and last + 1 of the contiguous events (score, words; a tag has 0 words) with the largest sum (earliest, then shortest, on ties).

    A run of equal words is one event: the sum inside it only rises or only falls.
    """
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for k, (score, words) in enumerate(events):
        if total <= 0:
            total, start = 0.0, k
        total += score * (words or 1)
        if total > best:
            best, found = total, (start, k + 1)
    return found


def learn(labelled: Iterable[tuple[str, str]]) -> dict[str, float]:
    """Negative score of each tag: how much likelier it is outside the main text, at most 2, at least 0.02.

    A tag of a labelled page (html, main text) is inside if it stands between
    the first and the last block of the main text and in no container that is
    left out.
    """
    inside: Counter[str] = Counter()
    outside: Counter[str] = Counter()
    for page, text in labelled:
        got, lines = parse(page, {}), set(text.split("\n"))
        own = [k for k, b in enumerate(got.blocks) if b in lines and not left_out(got.around[k])]
        tags, block = iter(got.tags), -1
        for _, words, k, c in got.events:
            if words:
                block = max(block, k)
            else:
                (inside if own and own[0] <= block < own[-1] else outside)[next(tags)] += 1
    n_in, n_out = sum(inside.values()) or 1, sum(outside.values()) or 1
    return {t: -min(2.0, max(0.02, math.log((outside[t] + 0.5) / n_out) - math.log((inside[t] + 0.5) / n_in))) for t in inside | outside}


@lru_cache(maxsize=1)
def tag_weights() -> dict[str, float]:
    return learn(LABELLED)


def main_text(page: str | None, weights: dict[str, float] | None = None) -> str:
    """Main text of a page: blocks joined by a line break; empty for null, empty and wordless pages."""
    if not page:
        return ""
    got = parse(page, tag_weights() if weights is None else weights)
    out = {id(c): left_out(c) for c in got.around if c is not None}
    gone = [c is not None and out[id(c)] for c in got.around]
    a, b = best_region((EXCLUDED_SCORE if words and gone[k] else score, words) for score, words, k, _ in got.events)
    inside = [k for _, words, k, _ in got.events[a:b] if words]
    return "\n".join(t for k, t in enumerate(got.blocks) if inside and inside[0] <= k <= inside[-1] and not gone[k])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled: Iterable[tuple[str, str]] | None = None) -> DataFrame:
    """id, url, ``text`` and ``n_chars`` (code points) of every page row; narrow.

    ``labelled`` (html, main text) pages replace the built-in ones. Null, empty
    and wordless html gives an empty text, null ids and urls stay null, repeated
    rows give a row each, a very long page is read whole, an empty table gives
    no rows; other columns, whatever their names, are ignored.
    """
    weights = None if labelled is None else learn(labelled)

    def rows(cols):
        ids, urls, pages_ = cols
        texts = [main_text(p, weights) for p in pages_]
        return [ids, urls, texts, [len(t) for t in texts]]

    kind = pages.select(id_col).schema[0].dataType.simpleString()
    out = map_rows(
        pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("u"), F.col(html_col).cast("string").alias("h")),
        rows,
        f"id {kind}, u string, text string, n_chars long",
    )
    return out.withColumnRenamed("id", id_col).withColumnRenamed("u", url_col)


def contract(pages: DataFrame) -> DataFrame:
    """A row a page of ``extract``, whose docstring defines nulls, empty and long pages, ties, repeats, empty tables and further columns."""
    return extract(pages)
