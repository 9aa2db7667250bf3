"""Main text of web pages by tree scoring.

Each paragraph earns points for its length and commas and passes them to its ancestors, less with distance; a
container's score is discounted by its link density. The best container, widened to the article element it lies
in, and those of its siblings that score well are kept; their blocks are returned in page order.

Parts outside the article are told by element, role and whole class names; a container that only its class speaks
against stays if it holds most of the page's prose. Elements left open take no text with them. A page of n
characters takes O(n) steps, however broken it is.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names and the words in class, id and role that mark parts outside the article.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title iframe noframes xmp".split())
#: Inline elements left out with all they hold: form controls with their labels, and media whose inside is shown only where they fail.
SKIPPED = frozenset("noscript template svg select object canvas audio video button label datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
OUTSIDE = frozenset("nav header footer aside form menu dialog fieldset head search".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies respond".split())
OUTSIDE_WORDS = COMMENT_WORDS | frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies footer header menu masthead modal nav "
    "navbar navigation newsletter notice notices pager pagination popup promo promoted related share sharing sidebar signup skip social sponsor "
    "sponsored subscribe toolbar widget".split())
#: Words that may stand beside them in a class name that still names such a part ("site-header", "related-posts").
PLAIN_WORDS = frozenset(
    "area bar body bottom box block button buttons col column container desktop fixed form global google group head icon icons image inner item items "
    "label left link links list main message mobile outer overlay page panel policy posts primary right row secondary section site slot sticky "
    "text this title top unit us widgets wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CONTAINERS = frozenset("div section ul ol dl table details center figure".split())
ARTICLE = frozenset(["article", "main"])
#: What a start tag closes when it is open: itself for items and cells.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = frozenset("html body table ul ol dl div article section main blockquote td th".split())
#: Ancestors that a paragraph's points reach.
LEVELS = 8

_MARKUP = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*+))")
_INSIDE = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_ATTRIBUTE = re.compile(r"""(?<![-\w:.])([a-zA-Z_:][-\w:.]*+)\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]++)""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_END = re.compile(r"</([a-zA-Z][^\s/>]*+)")
_ENDS = {name: re.compile(rf"<(/?){name}(?![^\s/>])[^>]*>|</?(?:article|main|body)\b", re.I) for name in SKIPPED}
_RAW_ENDS = {name: re.compile(rf"</{name}(?![^\s/>])[^>]*>", re.I) for name in RAW}


def _names_outside(value: str, whole_only: bool) -> int:
    """2 if class or id names a part with readers' comments, 1 another outside part, else 0."""
    for token in value.split():
        words = [w.lower() for w in _WORD.findall(token)]
        if len(words) > 1 and whole_only:
            continue
        if any(w in OUTSIDE_WORDS for w in words) and all(w in OUTSIDE_WORDS or w in PLAIN_WORDS for w in words):
            return 2 if any(w in COMMENT_WORDS for w in words) else 1
    return 0


class _Page:
    """Elements of a page as parallel lists, and its text as (element, text, in a link) runs."""

    def __init__(self, source: str):
        self.name, self.parent, self.mark = ["#root"], [-1], [0]
        self.runs: list[tuple[int, str | None, bool]] = []
        self._parse(source)
        self._settle()

    def _marked(self, name: str, attributes: str) -> int:
        """2 for a part that is surely outside, 1 for one that only its class or id speaks against, else 0."""
        if name in OUTSIDE:
            return 2
        if name in ("html", "body") or name in ARTICLE or "=" not in attributes:
            return 2 * ("hidden" in attributes.lower().split())
        found = 0
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            low = value.lower()
            if key == "role" and low in OUTSIDE_ROLES or key == "aria-hidden" and low == "true" or key == "style" and "display:none" in low.replace(" ", ""):
                return 2
            if key in ("class", "id") and name not in HEADINGS:
                found = max(found, _names_outside(value, name not in CONTAINERS))
        return 2 if "hidden" in _ATTRIBUTE.sub("", attributes).lower().split() else found

    def _settle(self) -> None:
        """Outside parts with all below them; a container with most of the page's prose is none by its class alone."""
        n = len(self.name)
        length, linked, sure = [0] * n, [0] * n, [m == 2 for m in self.mark]
        for k in range(1, n):
            sure[k] = sure[k] or sure[self.parent[k]]
        for element, text, link in self.runs:
            if text is not None and not sure[element]:
                length[element] += len(text)
                linked[element] += len(text) if link else 0
        for k in range(n - 1, 0, -1):
            length[self.parent[k]] += length[k]
            linked[self.parent[k]] += linked[k]
        self.outside = [False] * n
        for k in range(1, n):
            weak = self.mark[k] == 1 and not (2 * length[k] > length[0] and 4 * linked[k] < length[k])
            self.outside[k] = self.outside[self.parent[k]] or self.mark[k] == 2 or weak

    def _parse(self, source: str) -> None:
        self.open_, self.opened = [0], Counter()
        at, links, size, wasted = 0, 0, len(source), 0
        last_mark = source.rfind(">")
        last_end = {m[1].lower(): m.start() for m in _END.finditer(source)}
        while at < size:
            found = _MARKUP.search(source, at, last_mark + 1)
            if found is None:
                self.runs.append((self.open_[-1], source[at:], links > 0))
                break
            if found.start() > at:
                self.runs.append((self.open_[-1], source[at : found.start()], links > 0))
            at = found.end()
            if found[2] is None:
                close = "-->" if found[0] == "<!--" else ">"
                end = source.find(close, at)
                at = end + len(close) if end >= 0 else size
                continue
            name = found[2].lower()
            inside = _INSIDE.match(source, at) if wasted < 8 * size else None
            if inside:
                attributes, at = inside[1], inside.end()
            else:  # a quote or the tag is not closed: the tag ends at the next ">"
                wasted += size - at
                end = source.find(">", at)
                attributes, at = source[at:end], end + 1
            if found[1]:
                if name == "a":
                    links = 0
                if name in BLOCK:
                    if self.opened[name]:
                        self._close(next(k for k in range(len(self.open_) - 1, 0, -1) if self.name[self.open_[k]] == name))
                    self.runs.append((self.open_[-1], None, False))
                continue
            closed = last_end.get(name, -1) >= at
            if name in RAW:
                if closed and not attributes.endswith("/"):
                    end = _RAW_ENDS[name].search(source, at)
                    at = end.end() if end else size
                elif name in ("script", "style"):
                    at = size
            elif name in SKIPPED:
                end = _ENDS[name].search(source, at) if closed and not attributes.endswith("/") else None
                if end and end[1] == "/":
                    at = end.end()
            elif name == "a":
                links = int(closed)
            elif name in BLOCK:
                self._start(name, attributes)
            elif name in VOID:
                self.runs.append((self.open_[-1], " ", False))

    def _close(self, k: int) -> None:
        for element in self.open_[k:]:
            self.opened[self.name[element]] -= 1
        del self.open_[k:]

    def _start(self, name: str, attributes: str) -> None:
        if self.name[self.open_[-1]] == "p":
            self._close(len(self.open_) - 1)
        closes = CLOSES.get(name, ())
        if any(self.opened[c] for c in closes):
            for k in range(len(self.open_) - 1, 0, -1):
                other = self.name[self.open_[k]]
                if other in closes:
                    self._close(k)
                    if name != "tr" or other == "tr":
                        break
                elif other in SCOPE and not (name == "tr" and other in ("td", "th")):
                    break
        serial = len(self.name)
        self.name.append(name)
        self.parent.append(self.open_[-1])
        self.mark.append(self._marked(name, attributes))
        self.runs.append((serial, None, False))
        if name not in VOID:
            self.open_.append(serial)
            self.opened[name] += 1


def _blocks(page: _Page) -> list[tuple[int, str, int]]:
    """(element, text, characters in links) of each block of text in page order, outside parts left out."""
    out, held, linked, owner = [], [], 0, -1
    for element, text, link in [*page.runs, (-1, None, False)]:
        if text is None or element != owner:
            joined = " ".join(html.unescape("".join(held)).split()) if held else ""
            if joined:
                out.append((owner, joined, linked))
            held, linked, owner = [], 0, element
        if text is not None and not page.outside[element]:
            held.append(text)
            linked += len(text) if link else 0
    return out


def main_text(source: str | None) -> str:
    """Main text of a page; empty for null, empty or textless pages."""
    if not source:
        return ""
    page = _Page(source)
    blocks = _blocks(page)
    if not blocks:
        return ""
    n = len(page.name)
    score, length, linked = [0.0] * n, [0] * n, [0] * n
    for element, text, link in blocks:
        points = (1.0 if len(text) >= 25 else 0.0) + text.count(",") + min(len(text) / 100, 3.0)
        inner = page.name[element] in ("p", "pre", "td", "li", "blockquote", "dd", "h1", "h2", "h3", "h4", "h5", "h6")
        up, far = (page.parent[element] if inner else element), 0
        while up > 0 and far < LEVELS:
            score[up] += points / (1, 2)[far] if far < 2 else points / (3 * far)
            up, far = page.parent[up], far + 1
        length[element] += len(text)
        linked[element] += min(link, len(text))
    for k in range(n - 1, 0, -1):
        length[page.parent[k]] += length[k]
        linked[page.parent[k]] += linked[k]
    for k in range(n):
        score[k] *= 1 - (linked[k] / length[k] if length[k] else 0)
    best = max(range(n), key=lambda k: (score[k], -k))
    up = best
    while up > 0:
        if page.name[up] in ARTICLE:
            best = up
            break
        up = page.parent[up]
    keep = {best}
    if best:
        enough = max(10.0, 0.2 * score[best])
        for k in range(1, n):
            if page.parent[k] == page.parent[best] and k != best:
                density = linked[k] / length[k] if length[k] else 1
                if score[k] >= enough or page.name[k] == "p" and (length[k] > 80 and density < 0.25 or 0 < length[k] <= 80 and not linked[k]):
                    keep.add(k)
    kept: list[bool] = [False] * n
    for k in range(n):
        kept[k] = k in keep or (k > 0 and kept[page.parent[k]])
    return "\n".join(text for element, text, _ in blocks if kept[element])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``.

    A null or empty html has an empty text. Null ids and urls stay null, repeated rows stay, other columns are not
    read, an empty table gives an empty table. Whole pages are read, whatever their length.
    """

    def run(batches):
        for batch in batches:
            texts = []
            for at in range(0, batch.num_rows, 256):
                texts += [main_text((v or b"").decode("utf-8", "replace")) for v in batch.column(2).slice(at, 256).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return base.mapInArrow(run, "page_id long, url string, text string, n_chars long")
