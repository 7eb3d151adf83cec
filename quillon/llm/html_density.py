"""Main text of HTML pages by composite text density.

A tolerant parser turns a page into a tree: void elements hold nothing, a block start ends an
open paragraph, an end tag ends all that is open within its element and is ignored where there is
none, and what is never closed ends with what it stands in. Scripts, styles, templates and comments
are no text. White space is collapsed, and a text's characters are counted as it is then written.

For a node with C characters (LC of them within links) under T tags (LT of them links), the
composite density is C / T times the logarithm of (C / LC) (T / LT) to the base
ln(C LC / (C - LC) + C LCb / Cb + e), b being the body; counts of tags and links, and C - LC, are 1
at least. A density sum is the sum over a node's children. The node of the largest density sum is
content, and the least density on the path from it to the body, the body left out, is the threshold. From the body
down, each node that reaches the threshold marks the node of the largest sum in its own subtree.
The marked subtrees' text is the result, in the order of the page, a line for each block.

Edge cases. Null, empty and blank pages, and pages without text, give null text, density and threshold and
0 characters. Markup that breaks off counts as far as it goes; a "<" that starts no tag is text.
Ties go to the first node in the page. Without a body element the whole page is the body. Depth and
length have no bound; no recursion is used. Repeated rows are each extracted. Empty tables give no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(r"<(?:!--(?:.*?-->|.*\Z)|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*)(?:[^>\"'=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'=])*+>)", re.S)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
_SILENT = frozenset("script style noscript template iframe noembed noframes head title".split())
_BLOCK = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_LINES = _BLOCK | frozenset("br li dt dd tr td th caption body html option".split())
#: What a start tag ends, if it is open and none of the second set is open within it.
_ENDS = {t: (frozenset(["p"]), frozenset("table td th caption button object".split())) for t in _BLOCK}
_ENDS |= {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset("tr table".split())),
    "th": (frozenset(["td", "th"]), frozenset("tr table".split())),
    "tbody": (frozenset("thead tbody tfoot".split()), frozenset(["table"])),
    "tfoot": (frozenset("thead tbody tfoot".split()), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset()),
}


class Page:
    """The tree in arrays, nodes in the order of their start tags: ``tag``, ``parent``, ``end`` (one past the subtree), own texts as (node, text), of which an empty one breaks the line."""

    def __init__(self, markup: str) -> None:
        self.tag, self.parent, self.end = ["#page"], [-1], [0]
        self.texts: list[tuple[int, str]] = []
        self.body = 0
        stack, at, n = [0], 0, len(markup)
        # Where on the stack the open elements of each name are, so that no tag looks through the stack.
        self._open: dict[str, list[int]] = {"#page": [0]}
        silent, last = 0, markup.rfind(">")
        while at < n:
            # Behind the last ">" only a comment can begin.
            m = _TOKEN.search(markup, at) if at <= last or "<!" in markup[at:] else None
            stop = m.start() if m else n
            if stop > at and not silent:
                text = markup[at:stop]
                text = " ".join((html.unescape(text) if "&" in text else text).split())
                if text:
                    self.texts.append((stack[-1], text))
            if not m:
                break
            at = m.end()
            name = m.group(2)
            if not name:
                continue
            name = name.lower()
            if m.group(1):
                silent -= self._close(stack, {name})
                continue
            if name in _ENDS:
                ends, within = _ENDS[name]
                silent -= self._close(stack, ends, within)
            node = len(self.tag)
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.end.append(node + 1)
            if name == "body" and not self.body:
                self.body = node
            if name in _VOID:
                if name in _LINES:
                    self.texts.append((node, ""))
                continue
            self._open.setdefault(name, []).append(len(stack))
            stack.append(node)
            silent += name in _SILENT
            if name in _RAW:
                close = re.compile(f"</{name}(?=[\\s/>])[^>]*>?", re.I).search(markup, at)
                stop = close.start() if close else n
                if not silent and stop > at:
                    text = " ".join(markup[at:stop].split())
                    if text:
                        self.texts.append((node, text))
                at = close.end() if close else n
                silent -= self._close(stack, {name})
        self._close(stack, {"#page"})
        self.end[0] = len(self.tag)

    def _close(self, stack: list[int], names, within=frozenset()) -> int:
        """Ends the innermost open element of ``names`` and all in it, unless one of ``within`` is open in it; how many silent ones that ended."""
        open_ = self._open
        k = max((open_[t][-1] for t in names if open_.get(t)), default=-1)
        if k < 0 or any(open_[t][-1] > k for t in within if open_.get(t)):
            return 0
        silent = 0
        for x in stack[max(k, 1) :]:
            self.end[x] = len(self.tag)
            open_[self.tag[x]].pop()
            silent += self.tag[x] in _SILENT
        del stack[max(k, 1) :]
        return silent


def densities(page: Page) -> tuple[list[int], list[float], list[float]]:
    """(characters, composite density, density sum) of each node."""
    n = len(page.tag)
    chars, link_chars, tags, links = [0] * n, [0] * n, [0] * n, [0] * n
    inside = [False] * n
    for i in range(1, n):
        inside[i] = page.tag[i] == "a" or inside[page.parent[i]]
    for node, text in page.texts:
        chars[node] += len(text)
        if inside[node]:
            link_chars[node] += len(text)
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        chars[p] += chars[i]
        link_chars[p] += link_chars[i]
        tags[p] += tags[i] + 1
        links[p] += links[i] + (page.tag[i] == "a")
    share = link_chars[page.body] / max(chars[page.body], 1)
    density, sums = [0.0] * n, [0.0] * n
    for i in range(n):
        c, lc, t, lt = chars[i], link_chars[i], max(tags[i], 1), max(links[i], 1)
        if c:
            base = log(c / max(c - lc, 1) * lc + share * c + e)
            density[i] = c / t * log(c / max(lc, 1) * t / lt) / log(base) if base > 1 else c / t * log(c / max(lc, 1) * t / lt)
    for i in range(1, n):
        sums[page.parent[i]] += density[i]
    return chars, density, sums


def extract(markup: str | None) -> tuple[str | None, int, float | None, float | None]:
    """(text, its characters, largest density sum, threshold) of a page."""
    page = Page(markup or "")
    if not any(text for _, text in page.texts):
        return None, 0, None, None
    chars, density, sums = densities(page)
    n, body = len(page.tag), page.body
    if not chars[body]:
        body = 0
    # The first node of the largest sum in each subtree, from the last node up.
    best = list(range(n))
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        a, b = best[i], best[p]
        if sums[a] > sums[b] or sums[a] == sums[b] and a < b:
            best[p] = a
    top = best[body]
    threshold, node = density[top], top
    while node != body:
        threshold = min(threshold, density[node])
        node = page.parent[node]
    marked = bytearray(n)
    marked[top] = 1
    i, till = body, page.end[body]
    while i < till:
        if marked[i]:
            # A marked subtree is content as a whole.
            i = page.end[i]
        elif density[i] >= threshold:
            marked[best[i]] = 1
            i = page.end[i] if marked[i] else i + 1
        else:
            i = page.end[i]
    kept, i = [False] * n, 0
    for i in range(n):
        kept[i] = bool(marked[i]) or i > 0 and kept[page.parent[i]]
    # The block in which a text stands names its line.
    line = [0] * n
    for i in range(1, n):
        line[i] = i if page.tag[i] in _LINES else line[page.parent[i]]
    out: list[str] = []
    before = None
    for node, text in page.texts:
        if not text:
            before = None
            continue
        if not kept[node]:
            continue
        if before == line[node] and out:
            out[-1] += " " + text
        else:
            out.append(text)
        before = line[node]
    if not out:
        return None, 0, None, None
    text = "\n".join(out)
    return text, len(text), sums[top], threshold


def extract_pages(pages: DataFrame, column: str = "html", key: str = "page_id") -> DataFrame:
    """(key, main_text, n_chars, density_sum, threshold) of each page; one pass and no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [extract(x) for x in batch.column(1).to_pylist()]
            text, n, total, limit = zip(*rows) if rows else ((), (), (), ())
            rounded = [pa.array([None if x is None else round(x, 6) for x in c], pa.float64()) for c in (total, limit)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string()), pa.array(n, pa.int64()), *rounded], names=[key, "main_text", "n_chars", "density_sum", "threshold"])

    kind = dict(pages.dtypes)[key]
    return pages.select(key, column).mapInArrow(run, f"`{key}` {kind}, main_text string, n_chars long, density_sum double, threshold double")
