"""Main text of web pages by composite text density.

A page is read into all its elements.  What can never be article text is left
out while reading: scripts, styles, forms, menus, footers and asides, known by
element or role.  Blocks that a class or id names as an advert, a notice, a
menu or reader comments go where the page has text about as dense outside of
them, whatever their size; a name never takes out an element that has an
article or main element in it.  A page header goes, but for one that stands
right in the core.

Every element then has its characters C, tags T, link characters LC and link
tags LT, and the link-adjusted characters per tag::

    density = C / T * log(C / LC * T / LT) / log(ln(C / (C - LC) * LC + LCb / Cb * C + e))

with the body's own counts Cb and LCb, zero counts taken as one, and the last
logarithm as one at least.  An element's score is the sum of its children's
densities (that of a block without blocks in it its own).  The block of the
greatest score is the article's core.  The least density on the path from the
body to it is the threshold: of what stands beside that path, elements at or
over the threshold belong to the article too.  What is under the threshold
because it is short, not because of links (a heading, a short paragraph), the
density cannot tell.  If less than half of its characters are links, it belongs
to the article in the innermost ``article`` (or else ``main``) element around
the core; on pages without these, where it is an element like the one of the
path that it stands beside, and has paragraphs, headings or list items or a
quarter of the threshold's density.

Text is cut into blocks at block elements; character references are decoded,
white space in a block becomes one space, empty blocks go, and blocks are
joined by a newline.

Defined results: null and empty pages, and pages without text, give an empty
text; unclosed and wrongly nested elements are closed like a browser would, an
unfinished tag or script at the end is ignored; repeated rows each get their
text; pages are whole, of any length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Element sets of the HTML standard: fixed values.
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main "
    "menu nav ol p pre search section summary table caption tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg canvas audio video select noframes xmp".split())
#: Of these, those whose start tag is taken as an empty element if the end tag is missing.
MEDIA = frozenset("iframe svg canvas audio video select".split())
#: Elements that a start tag closes if they are open: by the new element.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: An open element in one of these is not closed by what stands inside.
SCOPE = frozenset("table td th ul ol dl body html article section div main blockquote".split())
# What is not article text: own choice of elements, roles and class words.
NOT_TEXT = frozenset("nav aside footer form button menu dialog fieldset label option head search".split())
NOT_ROLE = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
NOT_CLASS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert "
    "popup modal overlay newsletter subscribe subscription signup sidebar sidenav menu menus nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus "
    "respond reply replies share sharing social related recommended recommendations widget toolbar login pagination pager hidden".split()
)
HEADERS = frozenset(["header", "masthead"])
#: Words that a boilerplate word can stand with in a name, and words of names that tell about the whole page.
NEUTRAL = frozenset(
    "list lists area section box bar body container block wrap wrapper group thread item items row inner panel panels link links button buttons icon icons post posts "
    "article articles story stories form text title header message messages content count slot unit zone top bottom left right small large".split()
)
WRAPPER = frozenset("has no with without is not open page layout".split())
#: What a name can be: nothing, a boilerplate name, a header outside an article.
PLAIN, BOILERPLATE, HEADER = range(3)
#: Blocks that hold an article's words; siblings of the core without any are judged by their density alone.
WORDS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd td figcaption".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)(>|\Z)|</[^>]*(?:>|\Z)", re.S
)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}


def _left_out(tag: str, attrs: str, inside: bool) -> tuple[bool, int]:
    """Whether an element is not article text, and what its name says; ``inside`` an article or main element page headers are its own."""
    if tag == "form":  # may be around a whole page
        return False, BOILERPLATE
    if tag in NOT_TEXT:
        return True, PLAIN
    kind = HEADER if tag == "header" and not inside else PLAIN
    if not attrs or tag in ("html", "body", "article", "main"):
        return False, kind
    given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or given.get("role", "").lower() in NOT_ROLE:
        return True, PLAIN
    if "display:none" in given.get("style", "").replace(" ", "").lower():
        return True, PLAIN
    names = {*given.get("class", "").lower().split(), given.get("id", "").lower()}
    if any(map(_named, names)):
        return False, BOILERPLATE
    return False, HEADER if not inside and names & HEADERS else kind


def _named(name: str) -> bool:
    """Whether a class or id names boilerplate: its last word is one of its words, or one stands beside neutral words.

    A word of a wrapper (``has-sidebar``, ``nav-open``) names something else.
    """
    parts = [x for x in re.split(r"[-_]+", name) if x]
    if not parts or WRAPPER & set(parts):
        return False
    if len(parts) == 1:  # also two words in one: commentlist
        return name in NOT_CLASS or any(name.startswith(x) and name[len(x) :] in NEUTRAL for x in NOT_CLASS if len(x) > 2)
    return parts[-1] in NOT_CLASS or (any(x in NOT_CLASS for x in parts) and all(x in NOT_CLASS or x in NEUTRAL for x in parts))


class Page:
    """Elements of a page in order, and the text runs of its blocks: pieces and the elements that they stand in."""

    def __init__(self, html: str):
        self.tag, self.parent, self.named = ["body"], [-1], [PLAIN]
        self.chars, self.tags, self.link_chars, self.link_tags = [0], [0], [0], [0]
        self.runs: list[list[tuple[int, str]]] = []
        self._read(html)
        self.out = [False] * len(self.tag)

    def _node(self, tag: str, parent: int, link: bool, named: int) -> int:
        for column, value in zip((self.tag, self.parent, self.named, self.chars, self.tags, self.link_chars, self.link_tags), (tag, parent, named, 0, 1, 0, int(link)), strict=True):
            column.append(value)
        return len(self.tag) - 1

    def _leave(self, left: set[int]) -> list[bool]:
        """These elements and all in them."""
        out = [i in left for i in range(len(self.tag))]
        for i in range(1, len(out)):  # parents come first
            out[i] |= out[self.parent[i]]
        return out

    def _path(self, i: int) -> list[int]:
        path = [i]
        while path[-1]:
            path.append(self.parent[path[-1]])
        return path

    def _core(self, total: list[float]) -> int:
        return max((i for i in range(len(self.tag)) if self.tag[i] in BLOCKS), key=lambda i: (total[i], i))

    def _named_out(self) -> set[int]:
        """Elements that their name leaves out.

        Boilerplate names count where the page has text of such density outside
        of them, a block at least half as dense as the densest of theirs; else
        they do not count for what holds the core.  They never count for what
        holds an article or main element.
        """
        n = len(self.tag)
        holds = [x in ("article", "main") for x in self.tag]
        for i in range(n - 1, 0, -1):
            holds[self.parent[i]] |= holds[i]
        headers = {i for i in range(n) if self.named[i] == HEADER and not holds[i]}
        names = {i for i in range(n) if self.named[i] == BOILERPLATE and not holds[i]}
        if not names:
            return headers
        self.out = self._leave(headers)
        density, total = self.densities()
        gone = self._leave(names)
        leaves = [i for i in range(n) if not self.out[i] and self.tag[i] in BLOCKS and self.leaf[i]]
        theirs, others = (max((density[i] for i in leaves if gone[i] == side), default=0.0) for side in (True, False))
        if 2 * others < theirs:
            names -= set(self._path(self._core(total)))
        return headers | names

    def _read(self, html: str) -> None:
        # open elements: name, node, left out, in a link, inside an article
        stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
        open_: dict[str, int] = {}
        run: list[tuple[int, str]] = []
        endless: set[str] = set()
        at = 0

        def end_run() -> None:
            if run:
                self.runs.append(run.copy())
                run.clear()

        def pop() -> None:
            name = stack.pop()[0]
            open_[name] -= 1
            if name in BLOCKS:
                end_run()

        def say(text: str) -> None:
            _, node, out, link, _ = stack[-1]
            if out or not text:
                return
            text = unescape(text) if "&" in text else text
            run.append((node, text))
            n = len(" ".join(text.split()))
            self.chars[node] += n
            if link:
                self.link_chars[node] += n

        while (m := _TOKEN.search(html, at)) is not None:
            say(html[at : m.start()])
            at = m.end()
            if m[2] is None:
                if m[0].startswith("<![CDATA["):
                    say(m[0][9:].removesuffix("]]>"))
                continue
            if not m[4]:  # an unfinished tag at the end
                break
            name = m[2].lower()
            if m[1]:  # end tag
                if name == "p" and not open_.get("p"):
                    end_run()
                elif open_.get(name) and name not in ("body", "html"):
                    while stack[-1][0] != name:
                        pop()
                    pop()
                continue
            if name in RAW:  # nothing in it is text
                close = None if m[3].endswith("/") or name in endless else _END[name].search(html, at)
                if close:
                    at = close.end()
                elif not m[3].endswith("/"):
                    endless.add(name)
                    if name not in MEDIA:  # the rest of the page is in it
                        at = len(html)
                continue
            if name in ("html", "body"):
                continue
            if name in BLOCKS and open_.get("p"):
                self._close(stack, {"p"}, pop)
            if name in CLOSES:
                self._close(stack, CLOSES[name], pop)
            _, node, out, link, inside = stack[-1]
            inside = inside or name in ("article", "main")
            named = PLAIN
            if not out:
                out, named = _left_out(name, m[3], inside)
            if name in BLOCKS:
                end_run()
            link = link or name == "a"
            if not out:
                node = self._node(name, node, link, named)
                if name == "br":
                    run.append((node, " "))
            if name not in VOID:
                stack.append((name, node, out, link, inside))
                open_[name] = open_.get(name, 0) + 1
        else:
            say(html[at:])
        while len(stack) > 1:
            pop()
        end_run()

    @staticmethod
    def _close(stack: list, names: set[str], pop) -> None:
        """Close the innermost open element of these names, unless a scope element stands between."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                while len(stack) > i:
                    pop()
                return
            if stack[i][0] in SCOPE:
                return

    def densities(self) -> tuple[list[float], list[float]]:
        """Density of each element, and the sum of its children's."""
        n = len(self.tag)
        c, t, lc, lt = ([0 if o else k for k, o in zip(x, self.out, strict=True)] for x in (self.chars, self.tags, self.link_chars, self.link_tags))
        for i in range(n - 1, 0, -1):
            for x in (c, t, lc, lt):
                x[self.parent[i]] += x[i]
        share = min(lc[0], c[0]) / max(c[0], 1)
        density, total, leaf = [0.0] * n, [0.0] * n, [True] * n
        for i in range(n):
            if c[i]:
                links = min(lc[i], c[i])
                plain = math.log(c[i] / max(links, 1) * max(t[i], 1) / max(lt[i], 1) + 1)
                base = math.log(math.log(c[i] / max(c[i] - links, 1) * links + share * c[i] + math.e))
                density[i] = c[i] / max(t[i], 1) * plain / max(base, 1.0)
        for i in range(n - 1, 0, -1):
            if not self.out[i]:
                leaf[self.parent[i]] &= self.tag[i] not in BLOCKS or self.tag[i] in VOID
                total[self.parent[i]] += density[i]
        self.leaf = leaf
        # fewer links than other text: not under the threshold for its links
        self.plain = [2 * min(lc[i], c[i]) < c[i] for i in range(n)]
        return density, [density[i] if leaf[i] else total[i] for i in range(n)]

    def text(self) -> str:
        if not self.runs:
            return ""
        left = self._named_out()
        self.out = self._leave(left)
        density, total = self.densities()
        n = len(self.tag)
        core = self._core(total)
        path = self._path(core)
        threshold = min(density[i] for i in path)
        room = next((i for kind in ("article", "main") for i in path if self.tag[i] == kind), None)
        within = set() if room is None else set(path[: path.index(room) + 1])
        # A header right in the core is its own.
        self.out = self._leave({i for i in left if self.named[i] != HEADER or self.parent[i] != core})
        words = [x in WORDS for x in self.tag]
        for i in range(n - 1, 0, -1):
            words[self.parent[i]] |= words[i] and not self.out[i]
        taken, on = [False] * n, set(path)
        below = {self.parent[i]: self.tag[i] for i in path if i}
        taken[core] = True
        for i in range(1, n):  # parents come first
            up = self.parent[i]
            if i != core and not self.out[i]:
                beside = up in on and i not in on
                # Outside an article a sibling of the same kind as the path's element goes by its own blocks.
                alike = self.plain[i] and self.tag[i] == below.get(up) and (words[i] or 4 * density[i] >= threshold)
                taken[i] = taken[up] or (beside and (density[i] >= threshold or (up in within and self.plain[i]) or (room is None and alike)))
        texts = (" ".join("".join(x for i, x in run if taken[i] or i in on or self.tag[i] == "br").split()) for run in self.runs)
        return "\n".join(x for x in texts if x)


def main_text(html: str | None) -> str:
    """The article text of one page."""
    return Page(html).text() if html else ""


def extract(df: DataFrame, html: str = "html", out: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add the main text of every page; ``keep`` are the columns kept (all, if not given)."""
    kept = [c for c in (df.columns if keep is None else keep) if c != out]
    source = df.select(*dict.fromkeys([*kept, html]))
    schema = T.StructType([df.schema[c] for c in kept]).add(out, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([main_text(x.as_py()) for x in b.column(html)], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), texts], names=[*kept, out])

    return source.mapInArrow(run, schema)
