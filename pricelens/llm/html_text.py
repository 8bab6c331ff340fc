"""Main text of web pages by composite text density.

A page is parsed into its elements. Each element has a density: characters for each tag, adjusted by how much of it is
links, compared with the share of links in the whole body. The sum of its children's densities tells a container of prose
from its surroundings. The densest element and its path up to the body give a threshold, the lowest density on that path;
of the elements at or above it the one with the largest sum of child densities holds the article.

What is no article by its meaning (menus, footers, sidebars, adverts, forms, notices, comments, scripts) is left out of all
sums and of the text.
"""

from __future__ import annotations

import bisect
import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A comment, a tag with quoted values, or a declaration. Whoever uses it knows that a > follows (see Tags).
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<(?:[!?]|/(?![A-Za-z]))[^>]*>|<(?=/?[A-Za-z])""", re.DOTALL)
QUOTED = re.compile("[\"'>]")
NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
#: An attribute and its value, parsed whole, so that a name inside a value or a longer name is none.
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Elements without content, and those whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg xmp".split())
#: Elements that only mark text up; they are no tags to the densities.
INLINE = frozenset("abbr b bdi bdo big br cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements that start a line of their own.
BLOCK = frozenset(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
#: Elements and names of classes, ids and roles that are no article.
OUTSIDE = frozenset("nav footer aside form button select option menu dialog head object canvas audio video label input".split()) | RAW
NAMES = frozenset(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent contentinfo disqus disclaimer footer gdpr login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo related replies reply search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
#: Words beside such a name that leave its meaning; with others (has-sidebar, page-with-menu, comments-open) the name is another's.
BESIDE = frozenset("area bar block body bottom box button buttons container form global group header icon icons inner item items left link links list main outer page post posts primary right secondary section site slot top unit wrap wrapper".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
#: An element that starts closes these, where they are open above it without one of the second set between.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
CELLS = frozenset(("td", "th", "table"))
SCOPES = frozenset("table td th li div article section main body html aside nav header footer form blockquote button".split())


def named(value: str) -> bool:
    """Whether a class, id or role has a token that names no article: listed words, with others only that leave their meaning."""
    for token in value.lower().split():
        parts = [x for x in re.split("[_-]", token) if x]
        if any(x in NAMES for x in parts) and all(x in NAMES or x in BESIDE or x.isdigit() for x in parts):
            return True
    return False


class Tags:
    """The tags of a source in order. Every step is linear in the source's length, also where quotes or brackets don't close."""

    def __init__(self, source: str):
        self.source, self.last = source, source.rfind(">")
        self.places: list[int] | None = None

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, name, closes, attributes) of the next tag from a place on; comments and declarations have no name. None
        where no > is left. A tag ends at the first > outside of quotes, at the first of all if quotes don't close."""
        if at > self.last:
            return None
        m = TOKEN.search(self.source, at) if self.places is None else None
        if self.places is None and (m is None or m.end() > m.start() + 1):
            return m and (m.start(), m.end(), m[2] or "", bool(m[1]), m[3] or "")
        start = m.start() if m else at
        if self.places is None:  # a scan for the end of a tag failed: look ends up from now on
            self._ends()
        return self._slow(start)

    def _ends(self) -> None:
        """Of each quote and bracket where a tag ends that is open there, -1 if nowhere."""
        self.places, kinds = [], []
        for m in QUOTED.finditer(self.source):
            self.places.append(m.start())
            kinds.append(m[0])
        self.ends, later = [-1] * (len(kinds) + 1), {}
        for i in range(len(kinds) - 1, -1, -1):
            if kinds[i] == ">":
                self.ends[i] = self.places[i]
            elif kinds[i] in later:
                self.ends[i] = self.ends[later[kinds[i]] + 1]
            later[kinds[i]] = i

    def _slow(self, at: int) -> tuple[int, int, str, bool, str] | None:
        source = self.source
        while 0 <= (at := source.find("<", at)) < self.last:
            if m := NAME.match(source, at):
                end = self.ends[bisect.bisect_left(self.places, m.end())]
                end = source.find(">", m.end()) if end < 0 else end
                return (at, end + 1, m[2], bool(m[1]), source[m.end() : end]) if end >= 0 else None
            if source.startswith("<!--", at):
                end = source.find("-->", at + 4)
                return at, end + 3 if end >= 0 else len(source), "", False, ""
            if source[at + 1 : at + 2] in ("!", "?", "/"):
                return at, source.find(">", at) + 1, "", False, ""
            at += 1
        return None


class Page:
    """Elements in page order: tag, parent, the first element behind it, whether it is outside; pieces of text in order."""

    def __init__(self, source: str):
        self.tag, self.parent, self.end, self.out = ["#page"], [-1], [0], [False]
        #: Elements that their name alone says are no article.
        self.named = [False]
        #: (element, text) in page order; text None: a line ends here.
        self.pieces: list[tuple[int, str | None]] = []
        self.stack = [0]
        #: By tag, the depths at which it is open.
        self.open: dict[str, list[int]] = defaultdict(list)
        at, end, tags = 0, len(source), Tags(source)
        while at < end:
            found = tags.next(at)
            if found is None:  # no tag can end any more; an open comment hides the rest
                hidden = source.find("<!--", at)
                self._text(source[at:] if hidden < 0 else source[at:hidden])
                break
            start, after, name, closes, attributes = found
            self._text(source[at:start])
            at, name = after, name.lower()
            if not name:
                continue
            if closes:
                self._close(name)
                continue
            self._open(name, attributes)
            if name in RAW and self.tag[self.stack[-1]] == name:
                close = re.compile(rf"</{re.escape(name)}\b", re.IGNORECASE).search(source, at)
                at = source.find(">", close.end()) + 1 if close else 0
                at = at or end
                self._close(name)
        for node in self.stack:
            self.end[node] = len(self.tag)
        self._leave_named()

    def _leave_named(self) -> None:
        """Puts outside what is named so, but never what holds an article, or in a page without one most of the text."""
        n = len(self.tag)
        chars, holds = [0] * n, [False] * n
        for node, text in self.pieces:
            if text and not self.out[node]:
                chars[node] += len(" ".join(text.split()))
        for node in range(n - 1, 0, -1):
            if not self.out[node]:
                chars[self.parent[node]] += chars[node]
                own = self.tag[node] in ("article", "main") and not self.named[node]
                holds[self.parent[node]] = holds[self.parent[node]] or holds[node] or own
        for node in range(1, n):
            cut = self.named[node] and self.tag[node] not in ("body", "html", "article", "main")
            kept = holds[node] or not holds[0] and 2 * chars[node] > chars[0]
            self.out[node] = self.out[node] or self.out[self.parent[node]] or cut and not kept

    def _text(self, text: str) -> None:
        if text:
            self.pieces.append((self.stack[-1], text))

    def _open(self, name: str, attributes: str) -> None:
        if name in ("html", "head", "body") and self.open[name]:
            return
        if name == "body" and self.open["head"]:
            self._close("head")
        if name in BLOCK:  # a paragraph can't hold blocks
            self._close_above({"p"}, SCOPES)
        if name in CLOSES:
            self._close_above(*CLOSES[name])
        above = self.stack[-1]
        node = len(self.tag)
        self.tag.append(name)
        self.parent.append(above)
        self.end.append(node + 1)
        out = self.out[above] or name in OUTSIDE or name == "header" and not self.open["article"]
        known: dict[str, str] = {}
        for kind, value in ATTRIBUTE.findall(attributes) if attributes else ():
            known.setdefault(kind.lower(), value.strip("\"'"))
        self.named.append(bool(known) and any(named(known[kind]) for kind in ("class", "id", "role") if kind in known))
        if known and name not in ("body", "html", "article", "main"):
            out = out or "hidden" in known or bool(HIDDEN.search(known.get("style", "")))
        self.out.append(out)
        if name in BLOCK:
            self.pieces.append((node, None))
        elif name in ("br", "td", "th"):
            self.pieces.append((node, " "))
        if name not in VOID:
            self.open[name].append(len(self.stack))
            self.stack.append(node)

    def _pop(self, to: int) -> None:
        while len(self.stack) > to:
            node = self.stack.pop()
            self.open[self.tag[node]].pop()
            self.end[node] = len(self.tag)
            if self.tag[node] in BLOCK:
                self.pieces.append((node, None))

    def _deepest(self, names: set[str] | frozenset) -> int:
        depth = 0
        for name in names:
            if (at := self.open.get(name)) and at[-1] > depth:
                depth = at[-1]
        return depth

    def _close_above(self, names: set[str], scopes: frozenset | set) -> None:
        """Closes the lowest open element of names that stands above all open scopes."""
        if not self._deepest(names):
            return
        scope = self._deepest(scopes)
        lowest = [x[i] for x in map(self.open.get, names) if x and (i := bisect.bisect_right(x, scope)) < len(x)]
        if lowest:
            self._pop(min(lowest))

    def _close(self, name: str) -> None:
        depth = self.open[name][-1] if self.open.get(name) else 0
        if depth and (name in BLOCK or self._deepest(CELLS) <= depth):
            self._pop(depth)

    def densities(self) -> tuple[list[float], list[float], list[int], list[int]]:
        """Of each element the composite text density, the sum of those of its children, its characters and
        those in links.

        With c characters, of which l in links, and t tags, of which k links, density is c / t * log(c / l * t / k) to the base
        ln(c / (c - l) * l + L / C * c + e), where L / C is the whole body's share of links; what would divide by 0 counts as 1."""
        n = len(self.tag)
        chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for node in range(1, n):
            in_link[node] = self.tag[node] == "a" or in_link[self.parent[node]]
        for node, text in self.pieces:
            if text and not self.out[node]:
                size = len(" ".join(text.split()))
                chars[node] += size
                links[node] += size * in_link[node]
        for node in range(n - 1, 0, -1):
            if self.out[node]:
                continue
            above = self.parent[node]
            chars[above] += chars[node]
            links[above] += links[node]
            tags[above] += tags[node] + (self.tag[node] not in INLINE)
            link_tags[above] += link_tags[node] + (self.tag[node] == "a")
        whole = links[0] / max(1, chars[0])
        density, total = [0.0] * n, [0.0] * n
        for node in range(n - 1, -1, -1):
            c, t, linked = chars[node], max(1, tags[node]), max(1, links[node])
            inline = self.tag[node] in INLINE  # its text is its block's
            if c and not self.out[node] and not inline:
                base = math.log(c / max(1, c - links[node]) * linked + whole * c + math.e)
                density[node] = c / t * math.log(max(1.0, c / linked * t / max(1, link_tags[node]))) / math.log(base)
            if node:
                total[self.parent[node]] += total[node] if inline else density[node]
        return density, total, chars, links

    def main(self) -> int:
        """The element that holds the article: the largest sum of child densities among those in the body at or above the lowest
        density on the path from the densest one to the body; the body itself only if its own paragraphs are the article. One in
        sections has its text in several subtrees: the element widens to its parent where another child is at least half as dense, where all else is
        headings, or where it is one paragraph and most of the rest is no links."""
        density, total, chars, links = self.densities()
        body = self.tag.index("body") if "body" in self.tag else 0
        inside = range(body, self.end[body])
        at = max(inside, key=lambda i: (density[i], -i))
        threshold = density[at]
        while at > body:
            at = self.parent[at]
            if self.tag[at] not in INLINE:
                threshold = min(threshold, density[at])
        best = max((i for i in inside if i > body and density[i] >= threshold), key=lambda i: (total[i], density[i], -i), default=body)
        heads = [0] * len(self.tag)
        dense: dict[int, list[tuple[float, int]]] = {}
        for i in range(body + 1, self.end[body]):
            if density[i]:
                dense[self.parent[i]] = sorted([*dense.get(self.parent[i], []), (density[i], i)])[-2:]
                heads[self.parent[i]] += chars[i] * (self.tag[i] in HEADINGS)
        while best > body and ((above := self.parent[best]) > body or not total[best]):
            other = max((d for d, i in dense.get(above, []) if i != best), default=0.0)
            rest, linked = chars[above] - chars[best], links[above] - links[best]
            if 2 * other < density[best] and heads[above] < rest and (total[best] or 2 * linked > rest):
                break
            best = above
        return best

    def text(self) -> str:
        node = self.main()
        first, last = node, self.end[node]
        lines: list[list[str]] = [[]]
        for owner, text in self.pieces:
            if text is None:
                lines.append([])
            elif first <= owner < last and not self.out[owner]:
                lines[-1].append(text)
        joined = (" ".join(entities.unescape("".join(x)).split()) for x in lines)
        return "\n".join(x for x in joined if x)


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def extract(pages: DataFrame) -> DataFrame:
    """The pages with text, the article's (empty if none), and n_chars, its code points.

    Lines are blocks in page order; white space inside a block is one space. Null and empty html has no text, a very long one is
    read whole in linear time. A page is handled by itself, so repeated rows agree; an empty table gives no rows. Existing columns of these names are replaced."""

    @F.pandas_udf("string")
    def cleaned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sources in batches:
            yield pd.Series([main_text(x) for x in sources], dtype=object)

    return pages.withColumn("text", cleaned("html")).withColumn("n_chars", F.char_length("text").cast("long"))
