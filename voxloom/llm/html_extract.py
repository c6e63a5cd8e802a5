"""HTML extraction by composite text density.

A page becomes a tree of its elements. For every node the characters, tags, link characters and link tags below it are
counted, and its composite text density is computed: characters per tag, with a logarithm whose argument falls and
whose base grows with the share of link text. The density sum of a node adds up the densities of its children; the
node with the largest sum is the densest. The smallest density on its path to the body is the threshold.

The article is the subtree of the highest node on that path up to which no density falls under `HELD` of the densest
node's (a heading or a short section doesn't split an article, boilerplate beside it does). Elsewhere in the body,
subtrees next to the path count if they are at least as dense as the threshold and aren't mostly links.

Elements that are never article (menus, page headers and footers, side bars, notices, adverts, forms, scripts, styles,
reader comments) add to the counts of what is above them, but are no part of sums and results. They are known by tag,
role, class or id. Class and id count by whole names, and yield where the element holds the page's article or most of
the text around it.

Defined results: null and empty pages give an empty text; broken markup (tags not closed, pages cut short) is read as
far as it goes, in time that grows with the page's length; white space, `br` and no-break spaces within a block become
one space; pages of any length are read whole, one at a time; ties of sums go to the node that begins first; equal
pages give equal texts, repeated rows repeat; an empty table gives no rows; other columns pass through `extract`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ROWS_AT_ONCE, arrow_batches, give_back, table, with_columns

#: What may begin at a `<`: a comment, a tag, or a declaration.
MARKUP = re.compile(r"<(?:(!--)|(/?)([a-z][a-z0-9:-]*)|[!?/])", re.I)
#: The rest of a tag; a quoted value may hold `>`.
QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
#: Elements whose content is no markup, and which are left out.
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style title textarea noscript iframe template svg xmp".split()}
#: Characters, as a multiple of the page's, that tags with open quotes may cost; beyond, a tag ends at the next `>`.
OPEN_QUOTES = 4
#: Share of the densest node's density that nodes above it must have to be taken whole.
HELD = 0.5
#: A name and its value: quoted (to the end, if the quote isn't closed), bare or none.
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*+=\s*+(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s\"'>][^\s>]*)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are never part of an article.
NOISE_TAGS = frozenset("head nav footer aside form button select dialog menu canvas object audio video input".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
#: Class and id names that mark such elements; alone, together, or with the parts below before and after them.
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar comment comments commentlist cookie cookies"
    " consent gdpr notice notices popup modal share sharing social breadcrumb breadcrumbs menu nav navbar navigation footer related newsletter subscribe"
    " subscription disqus respond replies toolbar pagination pager skip masthead topbar widget widgets".split()
)
NAMES_BEFORE = frozenset("site page main top bottom left right primary secondary global article post entry user reader google mobile".split())
NAMES_AFTER = frozenset(
    "wrap wrapper container content inner outer area box bar block panel section region list item items link links button buttons form body text icon icons"
    " unit slot post posts article articles story stories overlay message signup title top bottom left right primary secondary main".split()
)
COMMENT_NAMES = frozenset("comment comments commentlist disqus respond replies".split())
HEADER_NAMES = frozenset(("header", "site-header", "page-header", "top-header"))
#: A start tag of the first kind ends an open element of the second.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = frozenset("ul ol dl table div article section main body td th".split())


#: Elements whose own header belongs to the text.
CONTENT_TAGS = ("article", "main")
#: Marked elements yield together if they hold more than this share of the plain text.
TOGETHER = 0.75
#: How an element is marked: not at all, by a name, by a name of reader comments (these two can yield), for good.
CLEAN, NAMED, COMMENTS, NEVER = range(4)


def _attributes(attrs: str) -> dict[str, str]:
    """Values by name, in lower case; of a name that is repeated, the first counts."""
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(attrs):
        found.setdefault(name.lower(), next((v for v in values if v), "").lower())
    return found


def _named(word: str) -> int:
    """The mark of one whole class or id name."""
    parts = [x for x in re.split(r"[^a-z]+", word) if x]
    first, last = 0, len(parts)
    while first < last and parts[first] in NAMES_BEFORE:
        first += 1
    while first < last and parts[last - 1] in NAMES_AFTER:
        last -= 1
    if first == last or not NOISE_NAMES.issuperset(parts[first:last]):
        return CLEAN
    return NAMED if COMMENT_NAMES.isdisjoint(parts[first:last]) else COMMENTS


def _noise(tag: str, attrs: str, in_article: bool) -> int:
    if tag in NOISE_TAGS or tag == "header" and not in_article:
        return NEVER
    if not attrs or tag in ("html", "body"):
        return CLEAN
    found = _attributes(attrs)
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role") in NOISE_ROLES:
        return NEVER
    words = [*found.get("class", "").split(), *found.get("id", "").split()]
    return max((NAMED if w in HEADER_NAMES and not in_article else _named(w) for w in words), default=CLEAN)


def tags(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Start and end of each piece of markup; its tag in lower case (empty if it's none), whether it closes, attributes."""
    n, last, spent, at = len(html), html.rfind(">"), 0, html.find("<")
    while at >= 0:
        m, end, tag, closes, attrs = MARKUP.match(html, at), at + 1, "", False, ""
        if m is None:
            at = html.find("<", end)
            continue
        if m[1]:
            end = html.find("-->", at + 4)
            end = n if end < 0 else end + 3
        elif at > last:  # a tag that the page's end cuts
            if html.find("<", end) >= 0:
                at = html.find("<", end)
                continue
            end = n
        elif m[3] and not m[2] and m[3].lower() in RAW:
            close = RAW[m[3].lower()].search(html, html.find(">", at))
            end = close.end() if close else n
        elif m[3]:
            tag, closes = m[3].lower(), bool(m[2])
            whole = QUOTED.match(html, m.end()) if spent <= OPEN_QUOTES * n else None
            if whole is None:
                spent += n - at
            end = whole.end() if whole else html.find(">", at) + 1
            attrs = html[m.end() : end - 1]
        else:
            end = html.find(">", at) + 1
        yield at, end, tag, closes, attrs
        at = html.find("<", end)


class _Open:
    """The open elements, with the places of each tag on the stack, so that none is searched for."""

    def __init__(self) -> None:
        self.nodes, self.tags, self.of, self.blocks, self.holders = [0], ["#root"], {}, [], []

    def push(self, node: int, tag: str) -> None:
        k = len(self.nodes)
        self.nodes.append(node)
        self.tags.append(tag)
        self.of.setdefault(tag, []).append(k)
        if tag in BLOCK:
            self.blocks.append(k)
        if tag in HOLDERS:
            self.holders.append(k)

    def last(self, tag: str) -> int:
        found = self.of.get(tag)
        return found[-1] if found else 0

    def pop(self) -> tuple[int, str]:
        tag = self.tags.pop()
        self.of[tag].pop()
        if tag in BLOCK:
            self.blocks.pop()
        if tag in HOLDERS:
            self.holders.pop()
        return self.nodes.pop(), tag


class Page:
    """The tree of a page: arrays over nodes, parents before children; texts and block borders in page order."""

    def __init__(self, html: str) -> None:
        self.parent, self.tag, self.gone = [-1], ["#root"], [False]
        self.texts: list[tuple[int, str | None]] = []  # None is a block border
        self.marked: dict[int, int] = {}  # elements marked by a name
        self.body = 0
        self.chars, self.tags, self.link_chars, self.link_tags = [0], [0], [0], [0]
        self.open, self.noisy, self.articles, self.links, at = _Open(), 0, 0, 0, 0
        for start, end, tag, closes, attrs in tags(html):
            if start > at:
                self._text(html[at:start])
            at = end
            if tag and closes:
                self._end(tag)
            elif tag in VOID:
                self._void(tag)
            elif tag:
                self._start(tag, attrs)
        if at < len(html):
            self._text(html[at:])
        self._drop_marked()
        self._add_up()

    def _end(self, tag: str) -> None:
        """An end tag closes the nearest open element of its name; one of an inline element doesn't reach out of a block."""
        if tag == "p" and not self.noisy:
            self.texts.append((self.open.nodes[-1], None))
        k = self.open.last(tag)
        if k and (tag in BLOCK or not self.open.blocks or self.open.blocks[-1] < k):
            self._pop(k)

    def _void(self, tag: str) -> None:
        node = self.open.nodes[-1]
        if not self.noisy and tag in ("hr", "br"):
            self.texts.append((node, None if tag == "hr" else " "))
        self.tags[node] += 1

    def _start(self, tag: str, attrs: str) -> None:
        ends = ENDS.get(tag) or ({"p"} if tag in BLOCK else ())
        k = max((self.open.last(t) for t in ends), default=0)
        holders = [h for h in self.open.holders[-1:] if self.open.tags[h] not in ends]
        if k and (not holders or holders[0] < k):
            self._pop(k)
        node = len(self.tag)
        self.parent.append(self.open.nodes[-1])
        self.tag.append(tag)
        self.open.push(node, tag)
        if tag == "body" and not self.body:
            self.body = node
        self.articles += tag in CONTENT_TAGS
        self.links += tag == "a"
        mark = NEVER if self.noisy else _noise(tag, attrs, self.articles > (tag in CONTENT_TAGS))
        if mark == NEVER:
            self.noisy += 1  # all within is left out
        elif mark:
            self.marked[node] = mark
        self.gone.append(mark == NEVER)
        self.chars.append(0)
        self.link_chars.append(0)
        self.tags.append(1)
        self.link_tags.append(int(tag == "a"))
        if tag in BLOCK:
            self.texts.append((0, None))

    def _pop(self, k: int) -> None:
        self.noisy = max(0, self.noisy - (len(self.open.nodes) - k))
        while len(self.open.nodes) > k:
            _, tag = self.open.pop()
            self.articles -= tag in CONTENT_TAGS
            self.links -= tag == "a"
            if tag in BLOCK:
                self.texts.append((0, None))

    def _text(self, raw: str) -> None:
        s, node = unescape(raw) if "&" in raw else raw, self.open.nodes[-1]
        if not self.noisy:
            self.texts.append((node, s))
        n = sum(map(len, s.split()))
        self.chars[node] += n
        if self.links:
            self.link_chars[node] += n

    def _drop_marked(self) -> None:
        """Leave out the elements marked by a name, except those that hold the page's article or most of the text.

        The article is the longest element of that tag without a mark, or else of main. An element in it yields if it
        holds most of the article's characters. Outside, an element yields if it holds the article, and, on a page
        that names no article or only one in a marked element, if it holds most of the page's characters. Elements of
        text, not of links, that together hold nearly all plain text of the article or page yield together. Reader
        comments, often longer than the article, yield to characters only if they hold all of them."""
        marks = {k: m for k, m in self.marked.items() if self.tag[k] not in ("article", "main")}
        if not marks:
            return
        n = len(self.tag)
        chars = [0 if out else c for c, out in zip(self.chars, self.gone, strict=True)]
        for node in range(n - 1, 0, -1):
            chars[self.parent[node]] += chars[node]
        for tag in ("article", "main"):
            article = max((k for k in range(n) if self.tag[k] == tag and chars[k] and k not in self.marked), key=lambda k: (chars[k], -k), default=0)
            if article:
                break
        holders, k = {article}, article
        while k:
            k = self.parent[k]
            holders.add(k)
        named = article and holders.isdisjoint(marks)
        linked = [0 if out else c for c, out in zip(self.link_chars, self.gone, strict=True)]
        for node in range(n - 1, 0, -1):
            linked[self.parent[node]] += linked[node]

        def drop(yielding: set[int]) -> tuple[list[bool], list[int]]:
            """What is left out, and the highest elements that a name (none of comments) leaves out."""
            gone, inside, by_name = self.gone[:], [False] * n, []
            for node in range(n):
                above = self.parent[node] if node else 0
                inside[node] = node == article or node > 0 and inside[above]
                gone[node] = gone[node] or node > 0 and gone[above]
                if node in marks and not gone[node] and not (article and node in holders):
                    whole = chars[article if inside[node] else 0]
                    most = chars[node] == whole if marks[node] == COMMENTS else 2 * chars[node] > whole
                    gone[node] = not (most or node in yielding) or named and not inside[node]
                    if gone[node] and marks[node] == NAMED and not (named and not inside[node]):
                        by_name.append(node)
            return gone, by_name

        gone, by_name = drop(set())
        plain = [c - k for c, k in zip(chars, linked, strict=True)]
        text = {k for k in by_name if 2 * linked[k] < chars[k]}
        if len(text) > 1 and sum(plain[k] for k in text) > TOGETHER * plain[article if named else 0]:
            gone, _ = drop(text)
            for k in text:
                del self.marked[k]
        self.gone = gone
        self.texts = [x for x in self.texts if not gone[x[0]]]

    def _add_up(self) -> None:
        for node in range(len(self.tag) - 1, 0, -1):
            p = self.parent[node]
            for counts in (self.chars, self.tags, self.link_chars, self.link_tags):
                counts[p] += counts[node]

    def densities(self) -> list[float]:
        """Composite text density of every node."""
        c_body, lc_body = max(1, self.chars[self.body]), self.link_chars[self.body]
        out = []
        for c, t, lc, lt in zip(self.chars, self.tags, self.link_chars, self.link_tags, strict=True):
            if not c:
                out.append(0.0)
                continue
            t, plain = max(1, t), max(1, c - lc)
            base = math.log(c / plain * lc + lc_body / c_body * c + math.e)
            spread = math.log(c / max(1, lc) * t / max(1, lt)) / math.log(base) if base > 1.0000001 else math.log(c / max(1, lc) * t / max(1, lt)) / 1e-7
            out.append(c / t * max(0.0, spread))
        return out

    def sums(self, d: list[float]) -> list[float]:
        """Density sum of every node: the densities of its children, without those left out."""
        total = [0.0] * len(d)
        for node in range(1, len(d)):
            if not self.gone[node]:
                total[self.parent[node]] += d[node]
        return total

    def article(self) -> str:
        n, d = len(self.tag), self.densities()
        total = self.sums(d)
        inside = [False] * n
        for node in range(n):
            inside[node] = not self.gone[node] and (node == self.body or node > 0 and inside[self.parent[node]])
        best = max((i for i in range(n) if inside[i]), key=lambda i: (total[i] or d[i] / 2, -i), default=0)
        path = [best]
        while path[-1] not in (self.body, 0):
            path.append(self.parent[path[-1]])
        threshold, whole = min(d[i] for i in path), best
        for i in path[1:]:
            if d[i] < HELD * d[best]:
                break
            whole = i
        above, on_path = set(path[path.index(whole) + 1 :]), set(path)
        # 2: kept; 1: on the path above the article; 0: not
        state = [0] * n
        for node in range(n):
            if self.gone[node] or node in self.marked and node not in on_path:
                continue  # what a name marks is kept only around the densest node
            over = state[self.parent[node]] if node else 0
            if node == whole or over == 2:
                state[node] = 2
            elif node in above:
                state[node] = 1
            elif over == 1 and d[node] >= threshold and 2 * self.link_chars[node] < self.chars[node]:
                state[node] = 2
        blocks, now = [], []
        for node, s in [*self.texts, (0, None)]:
            if s is None:
                if now and (joined := " ".join("".join(now).split())):
                    blocks.append(joined)
                now = []
            elif state[node] == 2:
                now.append(s)
        return "\n".join(blocks)


def main_text(html: str | None) -> str:
    return Page(html).article() if html else ""


def extract(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Add the main text of each page."""
    return with_columns(df.drop(out), html, [T.StructField(out, T.StringType())], lambda: lambda pages: [pa.array([main_text(x) for x in pages], pa.string())])


def _extract_only(df: DataFrame) -> DataFrame:
    """Without sending the pages back from Python."""
    arrow_batches(df.sparkSession)
    names = ["page_id", "url", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                b = whole.slice(at, ROWS_AT_ONCE)
                yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array([main_text(x) for x in b["html"].to_pylist()], pa.string())], names=names)
        give_back()

    return df.mapInArrow(run, T.StructType([df.schema["page_id"], df.schema["url"], T.StructField("text", T.StringType())]))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _extract_only(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op7_html_extract": op7_html_extract}
ORACLE: dict[str, str] = {}
