"""Main-text extraction from HTML by tag path ratios.

Every text node has a root-to-leaf tag path, of the blocks it stands in. Per path, text length and punctuation are summed over its nodes;
a path's ratios are those sums over its number of nodes, and its score their product, widened by how much
the lengths and punctuation counts of its nodes vary (running prose varies, menus do not). Scores are smoothed
along the page with a Gaussian, so a short paragraph amid long ones keeps their score; the fused score of a node
is the geometric mean of its own and its smoothed score. Nodes whose fused score reaches SHARE of the page's mean,
weighted by length, are content, wherever on the page they stand.

Markup only lowers scores, and no node is kept or left for its name alone: those of parts whose tag, class, id or role names them as something else (unless they hold most of
the page's prose, as a form or a wrapper with a telling name may; much less within an article), and of what stands outside of article and main
elements that hold most of it. A name counts if all of its words are of parts of pages (`share-box`, not `share-price`). Navigation, scripts, styles and form controls are no text of an article at all.
Headings go with the content right below them, and blocks whose score is too low with the content on both sides, if they are no longer than that
and were not lowered; three links in a row as list items are a menu even there.

A null or empty page, or one without content, gives an empty text. Every row gives one row; repeated
rows repeat; a table without rows gives none. Columns other than the id, the url and the page are not read, whatever their
names. Broken markup is read as browsers read it in the main cases: unclosed paragraphs end at the next block, unclosed
elements at their parent's end, comments, scripts and tags cut off at the page's end. Time and memory are linear
in the page, however deep it nests.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, text_slices

#: Element kinds (fixed values, the HTML standard's names).
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
_CLOSES_P = _BLOCK - frozenset("body caption html option tbody td tfoot th thead title tr".split())
_IMPLIED = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
_SCOPE = frozenset("html body article section main div ul ol dl table tbody thead tfoot nav aside form footer header td th".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are never article text.
_NEVER = frozenset("head title nav aside footer menu dialog button select option textarea input iframe object svg canvas audio video noscript template label fieldset legend datalist map".split())
#: Elements that are something else unless they hold most of the page.
_OTHER = frozenset("form header".split())
#: Words of class, id or role that name a part which is not the article, and those that name readers' comments.
_NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox sponsor sponsored promo promotion banner navigation nav navbar navbox menu breadcrumb breadcrumbs header masthead footer colophon contentinfo sidebar complementary aside related recommended share sharing social cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login register search searchbox form widget pagination pager toolbar toc copyright legal disclaimer hidden skip".split()
)
_COMMENTS = frozenset("comment comments commentlist reply replies respond discussion disqus feedback".split())
#: Words that say where or how a part stands, not what it is about.
_PLACES = frozenset("box area section block wrap wrapper container inner outer list item items links link posts post bar top bottom left right main site page content body text header title head row col column panel group thread user reader readers users form module region zone slot unit buttons button icons icon small large global primary secondary first last inline container fluid id js".split())
#: First and last words that make a name tell of a page's state or layout instead of a part (`has-sidebar`, `search-page`).
_BEFORE = frozenset("has no with without not is can".split())
_AFTER = frozenset("fixed mode page layout width free ready enabled disabled open active".split())
_PARTS = _NAMED | _COMMENTS | _PLACES
_MAIN = frozenset(["article", "main"])
_ROOTS = frozenset(["", "html", "body"])
#: Up to a tag's end; a quote begins a value only right after an equals sign.
_ATTRIBUTES = r"""(?:=\s*(?:"[^"]*"|'[^']*')|[^>])*+"""
_RAW = "script|style|noscript|template|svg|iframe|textarea|title"
_TOKEN = re.compile(
    rf"<!--(?s:.*?)(?:-->|\Z)"
    rf"|<(?P<raw>{_RAW})\b{_ATTRIBUTES}>(?s:.*?)(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attr>{_ATTRIBUTES})>"
    rf"|</?[a-zA-Z!?][^>]*(?:>|\Z)",
    re.I,
)
_NAMES = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_PUNCT = re.compile(r"[,.;:!?，。；：！？、…]")

#: How wide the smoothing is, in text nodes; the share of the page's mean score that content reaches; the share of the
#: prose that protects a part from its name; the share of the prose that articles hold where they count; what lowered scores
#: keep: of parts by name, of those within an article, and of what stands outside of articles.
RADIUS, SHARE, MOST, HOLDS, LOWERED, NAMED_INSIDE, OUTSIDE = 2, 0.66, 0.5, 0.8, 0.1, 0.85, 0.25


def _names(attr: str) -> tuple[bool, bool, bool]:
    """Whether attributes hide an element, name it as something else, or as readers' comments."""
    hides = other = comments = False
    for m in _NAMES.finditer(attr):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.lower().replace(" ", ""):
            hides = True
        elif name in ("class", "id", "role"):
            for token in value.split():
                words = [w.lower() for w in _WORDS.findall(token)]
                if not words or words[0] in _BEFORE or words[-1] in _AFTER or not _PARTS.issuperset(words):
                    continue
                other |= not _NAMED.isdisjoint(words)
                comments |= not _COMMENTS.isdisjoint(words)
    return hides, other, comments


class Page:
    """A page's elements, in parallel lists by number (0: above all), and its text nodes: element, block, text."""

    def __init__(self, page: str):
        self.tag, self.parent, self.path, self.flags = [""], [-1], [0], [0]
        self.nodes: list[tuple[int, int, str]] = []
        self._paths: dict[tuple[int, str], int] = {}
        self._open = [0]  # the open elements
        self._at: dict[str, list[int]] = {}  # where each tag stands among them
        self.block = at = 0
        for m in _TOKEN.finditer(page):
            if m.start() > at:
                self._text(page[at : m.start()])
            at = m.end()
            if m["tag"] is not None:
                self._element(m["tag"].lower(), bool(m["end"]), m["attr"])
        self._text(page[at:])

    def _text(self, s: str) -> None:
        if s:
            self.nodes.append((self._open[-1], self.block, " " if s.isspace() else html.unescape(s) if "&" in s else s))

    def _close(self, names: frozenset[str], stop: frozenset[str]) -> bool:
        """Ends the nearest open element of the names, and all in it, unless one of stop is nearer."""
        last = lambda tags: max((self._at[t][-1] for t in tags if self._at.get(t)), default=0)
        place = last(names)
        if not place or last(stop) > place:
            return False
        while len(self._open) > place:
            self._at[self.tag[self._open.pop()]].pop()
        return True

    def _element(self, tag: str, end: bool, attr: str) -> None:
        if end:
            if self._close(frozenset([tag]), frozenset() if tag in _SCOPE else _SCOPE) and tag in _BLOCK:
                self.block += 1
            return
        if tag in _BLOCK:
            self.block += 1
            if tag != "html" and self._at.get("head"):
                self._close(frozenset(["head"]), frozenset())
            if tag in _CLOSES_P:
                self._close(frozenset("p"), _SCOPE)
        if tag in _IMPLIED:
            self._close(_IMPLIED[tag], _SCOPE - _IMPLIED[tag])
        if tag == "br":
            self.nodes.append((self._open[-1], self.block, " "))
        if tag in _VOID or attr.endswith("/"):
            return
        up = self._open[-1]
        flags = self.flags[up] & INHERITED
        hides, other, comments = _names(attr) if attr and tag not in _ROOTS else (False, False, False)
        flags |= LINK * (tag == "a") | ITEM * (tag == "li") | INSIDE * (tag in _MAIN) | NEVER * (tag in _NEVER)
        flags |= NAMED * other | HIDDEN * (hides or tag in _OTHER and not (tag == "header" and flags & INSIDE)) | COMMENTS * comments | HEADING * (tag in _HEADING)
        self.tag.append(tag)
        self.parent.append(up)
        # bold words and links are of their block's path
        self.path.append(self._paths.setdefault((self.path[up], tag), len(self._paths) + 1) if tag in _BLOCK else self.path[up])
        self.flags.append(flags)
        self._at.setdefault(tag, []).append(len(self._open))
        self._open.append(len(self.tag) - 1)


#: Flags of elements; the first five hold for all that stands in them.
LINK, ITEM, INSIDE, NEVER, HEADING, NAMED, COMMENTS, HIDDEN = (1 << i for i in range(8))
INHERITED = LINK | ITEM | INSIDE | NEVER | HEADING


def _sums(page: Page, weights: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For every element, the weights of the nodes in it; elements come after those they stand in."""
    total = np.bincount(of, weights, minlength=len(page.tag)).tolist()
    for i in range(len(total) - 1, 0, -1):
        total[page.parent[i]] += total[i]
    return np.array(total)


def path_scores(page: Page, size: np.ndarray, marks: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The fused score of each node: its path's ratios and their smoothed neighbours. size and marks are 0 for what is no prose."""
    path = np.array(page.path)[of]
    n = len(page._paths) + 1
    has = size > 0
    k = np.maximum(1, np.bincount(path, has, minlength=n))
    mean = lambda x: np.bincount(path, x, minlength=n) / k
    spread = lambda x: np.sqrt(np.maximum(0, mean(x.astype(float) ** 2) - mean(x) ** 2))
    score = np.log1p(mean(size) * (1 + mean(marks)) * (1 + spread(size)) * (1 + spread(marks)))
    own = np.where(has, score[path], 0.0)
    kernel = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / (RADIUS / 2)) ** 2)
    smooth = np.convolve(own, kernel / kernel.sum())[RADIUS : RADIUS + len(own)]
    return np.sqrt(own * smooth)


#: How much an element is lowered: by its name or tag, or as readers' comments and what is hidden.
SOFT, HARD = 1, 2


def _lowered(page: Page, prose: np.ndarray) -> np.ndarray:
    """Of each element whether it is, or stands in, something else by its name: one that holds less than MOST of the prose, or stands beside the page's articles and title; comments also if prose is left beside them."""
    total = prose[0]
    main = np.array([t in _MAIN or t == "h1" for t in page.tag], float)
    for i in range(len(main) - 1, 0, -1):
        main[page.parent[i]] += main[i]
    out = [0] * len(page.tag)
    for i in range(1, len(out)):
        f = page.flags[i]
        if out[page.parent[i]]:
            out[i] = out[page.parent[i]]
        elif f & COMMENTS and (prose[i] < MOST * total or prose[i] < total and main[i] <= (page.tag[i] in _MAIN)):
            out[i] = HARD
        elif f & (NAMED | HIDDEN) and (prose[i] < MOST * total or not total or main[i] < main[0] and not main[i]):
            out[i] = HARD if f & HIDDEN else SOFT
    return np.array(out)


def extract_main_text(page: str | None) -> str:
    """The page's main text: blocks joined by a line feed."""
    p = Page(page) if page else None
    if p is None or not p.nodes:
        return ""
    of = np.array([e for e, _, _ in p.nodes])
    flags = np.array(p.flags)[of]
    length = np.array([len(s.strip()) for _, _, s in p.nodes])
    plain = np.where(flags & (LINK | NEVER), 0, length)
    marks = np.array([len(_PUNCT.findall(s)) if n else 0 for (_, _, s), n in zip(p.nodes, plain.tolist(), strict=True)])
    lowered = _lowered(p, _sums(p, plain, of))[of]
    inside = (flags & INSIDE) > 0
    fused = path_scores(p, plain, marks, of)
    factor = np.where(lowered == 0, 1.0, np.where((lowered == SOFT) & inside, NAMED_INSIDE, LOWERED))
    prose = np.where(lowered > 0, 0, plain)
    if prose[inside].sum() >= HOLDS * prose.sum() > 0:
        factor[~inside & (lowered == 0)] *= OUTSIDE
    fused *= factor
    if not plain.any():
        return ""
    weigh = prose if prose.any() else plain
    content = (fused >= max(1e-9, SHARE * float((fused * weigh).sum() / weigh.sum()))) & (plain > 0)
    if not content.any():
        return ""
    return "\n".join(_blocks(p, of, flags, length, content, (flags & NEVER) > 0, lowered > 0))


def _blocks(p: Page, of: np.ndarray, flags: np.ndarray, length: np.ndarray, content: np.ndarray, never: np.ndarray, lowered: np.ndarray) -> list[str]:
    """The texts of the blocks that were selected, and of those that go with them."""
    block = np.array([b for _, b, _ in p.nodes])
    n = int(block.max()) + 1
    per = lambda w: np.bincount(block, w, minlength=n)
    link = (flags & LINK) > 0
    plain, linked = per(np.where(never | link, 0, length)), per(np.where(never | ~link, 0, length))
    keep = per(content) > 0
    low = per(lowered & ~content & ~never & (length > 0)) > 0
    heading = per(np.array([(f & HEADING) > 0 for f in p.flags])[of] & ~never) > 0
    there = np.flatnonzero(plain + linked > 0).tolist()
    chosen = [i for i, b in enumerate(there) if keep[b]]
    for i, j in zip(chosen[:-1], chosen[1:], strict=True):  # what stands between two selected blocks
        run = there[i + 1 : j]
        if run and not any(low[b] for b in run) and plain[run].sum() + linked[run].sum() <= plain[there[i]] + plain[there[j]]:
            keep[[b for b in run if plain[b]]] = True
    for i in reversed(range(len(there) - 1)):  # headings right above
        if heading[there[i]] and keep[there[i + 1]] and not low[there[i]]:
            keep[there[i]] = True
    item = per(((flags & ITEM) > 0) & ~never) > 0
    run = []
    for b in there:  # menus
        run = [*run, b] if item[b] and not plain[b] else []
        if len(run) >= 3:
            keep[run[-3:]] = False
    parts: dict[int, list[str]] = {}
    for (_, b, s), no in zip(p.nodes, never.tolist(), strict=True):
        if keep[b] and not no:
            parts.setdefault(b, []).append(s)
    texts = (_SPACE.sub(" ", "".join(x)).strip() for _, x in sorted(parts.items()))
    return [t for t in texts if t]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text, n_chars of every page."""
    src = pages.select(id_col, url_col, html_col)
    fields = src.schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, html_col):
            texts = [extract_main_text(h) for h in part.batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.batch.column(0), part.batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return arrow_map(src, run, f"`{id_col}` {fields[0].dataType.simpleString()}, `{url_col}` {fields[1].dataType.simpleString()}, text string, n_chars bigint")
