"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags negative, by how much more often each kind stands
inside than outside the main text of labelled pages; one linear scan finds the contiguous region of the greatest sum. The
region takes in the whole article or main element that it lies in. Elements whose tag and names stand outside the main text
of the labelled pages, by the same odds, score nothing and are left out wherever they stand.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled_pages import AROUND, INSIDE, OUTSIDE, labelled_pages

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^\"'>]|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their own end tag.
RAW = frozenset("script style textarea title noscript template iframe".split())
#: Elements without text to read, or that are no article by the language's own definition.
NEVER = frozenset("head form button select fieldset dialog menu object svg canvas audio video".split()) | RAW
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
KEEP = frozenset("html body main".split())
CLOSED_BY = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}

#: An open <p> ends where a block begins, unless one of these stands between.
SCOPE = ("td", "th", "table", "caption", "object", "button")
HOLDERS = ("article", "main")


@dataclass
class Item:
    """A run of words or a tag. ``words``: 0 for a tag; ``skip``: lies in an element that is no main text; ``new``: begins a
    block; ``layout``: is skipped for a name of the page's layout alone; ``element``: of an opening tag, its :func:`features`."""

    kind: str
    words: int = 0
    text: str = ""
    skip: bool = False
    new: bool = False
    layout: bool = False
    element: tuple[str, ...] = ()


@dataclass
class Weights:
    """``word`` and ``tag``: of the scan; ``element``: log odds of an element's features inside against outside the main text;
    ``wraps``: features of elements that hold main texts, which say nothing about them."""

    word: dict[str, float] = field(default_factory=dict)
    tag: dict[str, float] = field(default_factory=dict)
    other: float = -1.0
    element: dict[str, float] = field(default_factory=dict)
    wraps: frozenset[str] = frozenset()

    def of(self, x: Item) -> float:
        if x.skip:
            return 0.0  # is left out of the text wherever it stands
        if x.text:
            return x.words * self.word.get(x.kind, 1.0)
        return self.tag.get(x.kind, self.other)

    def outside(self, found: tuple[str, ...]) -> str:
        """Why an element with these features is no main text: ``all`` of it, or ``layout``: save an article inside; or nothing."""
        if not found or sum(self.element.get(f, 0.0) for f in found) > -1.0:
            return ""
        return "layout" if all(f in self.wraps for f in found[1:] if self.element.get(f, 0.0) < 0) and len(found) > 1 else "all"


def features(name: str, attributes: str, held: bool) -> tuple[str, ...]:
    """An element's tag, by whether it stands in an article, and the words of its class, id and role."""
    found = [f"{'in ' if held else ''}<{name}>"]
    if attributes and name not in KEEP:
        for m in NAMES.finditer(attributes):
            found += [p.lower() for p in re.findall(r"[A-Za-z][a-z]*|[A-Z]+", m[1])]
    return tuple(dict.fromkeys(found))


class Open:
    """The open elements, innermost last, and where each name stands among them; every step takes constant time, or is paid
    for by an element that it closes."""

    def __init__(self):
        self.names: list[str] = []
        self.why: list[str] = []
        self.at: dict[str, list[int]] = {}
        self.hidden = 0
        self.layout: list[int] = []

    def last(self, *names: str) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def push(self, name: str, why: str):
        self.at.setdefault(name, []).append(len(self.names))
        if why == "layout":
            self.layout.append(len(self.names))
        self.names.append(name)
        self.why.append(why)
        self.hidden += bool(why)

    def close(self, upto: int):
        while len(self.names) > upto:
            name, why = self.names.pop(), self.why.pop()
            self.at[name].pop()
            if why:
                self.hidden -= 1
            if why == "layout":
                self.layout.pop()

    def held(self):
        """An article begins: what is only named after the layout around it doesn't hide it."""
        for i in self.layout:
            self.why[i] = ""
        self.hidden -= len(self.layout)
        self.layout = []


def items(page: str, weights: Weights, layout: bool = True) -> list[Item]:
    """The page's words and tags in order; without ``layout``, names of the page's layout hide nothing. Never fails: unknown, unclosed or cut-off markup is read as a browser would, nearly."""
    out: list[Item] = []
    open_ = Open()
    fresh = True
    at, n = 0, len(page)

    def put(raw: str):
        nonlocal fresh
        text = html.unescape(raw) if "&" in raw else raw
        words = len(text.split())
        hidden = open_.hidden > 0
        if text and (words or out):
            only = hidden and open_.hidden == len(open_.layout)
            kind = "text" if not open_.at.get("a") else "p link" if open_.at.get("p") else "link"
            out.append(Item(kind, words, text, hidden, fresh and not hidden, only))
            if words and not hidden:
                fresh = False

    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            put(page[at:])
            break
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        t = TAG.match(m[0])
        if not t:
            continue
        name, closing = t[2].lower(), bool(t[1])
        if not m[0].endswith(">"):
            break  # a tag that the page's end cuts off
        if name in BLOCK:
            fresh = True
        if closing:
            depth, hidden = open_.last(name), open_.hidden > 0  # what ends a hidden element is as hidden as it
            if depth >= 0 and (name in BLOCK or open_.last("article", "main", "body") <= depth):
                open_.close(depth)
            out.append(Item("p /a" if name == "a" and open_.at.get("p") else f"/{name}", skip=hidden))
            continue
        if open_.names and name in CLOSED_BY.get(open_.names[-1], ()):
            open_.close(len(open_.names) - 1)
        elif name in BLOCK and open_.last("p") > open_.last(*SCOPE) and not open_.hidden:
            open_.close(open_.last("p"))
        found = features(name, m[0][t.end() : -1], open_.last(*HOLDERS) >= 0)
        why = "" if name in VOID or name in KEEP else "all" if name in NEVER else weights.outside(found)
        why = "" if why == "layout" and not layout else why
        if name in HOLDERS and not why:
            open_.held()
        kind = "p a" if name == "a" and open_.at.get("p") else name  # links in running text are another kind
        out.append(Item(kind, skip=open_.hidden > 0 or bool(why), element=found))
        if name in ("br", "td", "th"):
            put(" ")
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
        elif name not in VOID:
            open_.push(name, why)
    return out


def _marked(page: str, weights: Weights) -> list[tuple[Item, bool]]:
    """Items of a labelled page, and whether each stands inside its main text."""
    out, now = [], False
    for x in items(page, weights):
        for part in re.split(r"(\[\[|\]\])", x.text) if x.text else [""]:
            if part in ("[[", "]]"):
                now = part == "[["
            elif part or not x.text:
                out.append((replace(x, text=part, words=len(part.split())), now))
    return out


def _elements() -> tuple[dict[str, float], frozenset[str]]:
    """Log odds of the features of elements in the labelled parts, and the features of what stands around main texts.

    A block's tag that is seen on both sides says little, an inline one nothing: many pages use them for everything. Nor does
    article or main: comments and teasers are articles too.
    """
    inside, outside = Counter(), Counter()
    opening = re.compile(r"<([a-z]\w*)([^>]*)>")
    for count, parts in ((inside, INSIDE), (outside, OUTSIDE)):
        for part in parts:
            for held in (True,) if count is inside and part.startswith("<header") else (True, False):
                for f in {f for m in opening.finditer(part) for f in features(m[1], m[2], held)}:
                    count[f] += 1 if f.endswith(">") else 0.5  # names are met once as held and once not
    odds = {f: math.log((inside[f] + 0.5) / (outside[f] + 0.5)) for f in {*inside, *outside}}
    for f in odds:
        if f.endswith(">"):
            name = f.removeprefix("in ")[1:-1]
            odds[f] = 0.0 if name not in BLOCK or name in HOLDERS else max(odds[f], -0.5) if inside[f] else odds[f]
    wraps = {f for before, _ in AROUND for m in opening.finditer(before) for f in features(m[1], m[2], False)[1:]}
    return odds, frozenset(wraps)


@functools.cache
def learn(pages: int = 60) -> Weights:
    """Weights from labelled pages.

    First the log odds of the features of elements. Of what they leave, the log odds of words (held positive; in links outside
    running text: at most a little) and of tags (held negative), with the scale of the tags by which the labelled texts are
    found best.
    """
    element, wraps = _elements()
    marked = [_marked(page, Weights(element=element, wraps=wraps)) for page in labelled_pages(pages)]
    inside, outside = Counter(), Counter()
    for page in marked:
        for x, now in page:
            if not x.skip:
                (inside if now else outside)[x.kind] += max(1, x.words)
    kinds = {*inside, *outside}
    total_in, total_out = sum(inside.values()) + len(kinds), sum(outside.values()) + len(kinds)
    odds = {k: math.log((inside[k] + 1) / total_in) - math.log((outside[k] + 1) / total_out) for k in kinds}
    word = {"text": 1.0, "link": min(0.1, max(-1.0, odds["link"])), "p link": min(1.0, max(0.1, odds["p link"]))}
    tried = []
    for scale in (0.25, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0):
        tag = {k: scale * min(0.0, v) - 0.2 for k, v in odds.items() if k not in word}
        weights = Weights(word, tag, -0.5 * scale, element, wraps)
        tried.append((_f1(labelled_pages(pages), weights), weights))
    best = max(f for f, _ in tried)
    return next(weights for f, weights in tried if f >= best - 0.002)  # of scales about as good, the one that keeps most


def _f1(pages: list[str], weights: Weights) -> float:
    """Of the words of labelled pages' main texts and of what is found."""
    both = all_ = 0
    for page in pages:
        inside = Counter(re.sub(r"<[^>]*>", " ", " ".join(re.findall(r"\[\[(.*?)\]\]", page, re.S))).split())
        found = Counter(main_text(page.replace("[[", "").replace("]]", ""), weights).split())
        both, all_ = both + sum((inside & found).values()), all_ + sum(inside.values()) + sum(found.values())
    return 2 * both / max(1, all_)


def best_region(scores: list[float]) -> tuple[int, int]:
    """Ends of the contiguous region with the greatest sum, by one scan; the first of equals; empty if nothing is positive."""
    best, top, sum_, start = (0, 0), 0.0, 0.0, 0
    for i, s in enumerate(scores):
        if sum_ <= 0:
            sum_, start = 0.0, i
        sum_ += s
        if sum_ > top:
            top, best = sum_, (start, i + 1)
    return best


def holders(found: list[Item]) -> list[tuple[int, int]]:
    """Ends of the outermost article and main elements that are no furniture, articles before what holds them. One that is
    never closed has no known end."""
    out, open_ = [], Open()
    starts: list[int] = []
    for i, x in enumerate(found):
        if x.text or x.kind.lstrip("/") not in HOLDERS:
            continue
        if x.kind[0] != "/":
            open_.push(x.kind, "")
            starts.append(i)
        elif (depth := open_.last(x.kind[1:])) >= 0:
            if not found[starts[depth]].skip:
                out.append((starts[depth], i + 1))
            open_.close(depth)
            del starts[depth:]
    return out


def main_text(page: str | None, weights: Weights) -> str:
    """Text of the best region: blocks joined by a newline, white space inside a block as one space."""
    if not page:
        return ""
    found = items(page, weights)
    plain = [x for x in found if x.kind == "text"]
    if sum(x.words for x in plain if x.layout) > 2 * sum(x.words for x in plain if not x.skip):
        found = items(page, weights, layout=False)  # what holds most of a page is only named after its layout
    scores = [weights.of(x) for x in found]
    lo, hi = core = best_region(scores)
    held = holders(found)
    if lo == hi and held:  # nothing but links, say
        core = held[0]
    # a region is whole blocks: it takes in the rest of the blocks that it begins and ends in
    while lo > 0 and not (found[lo].words and found[lo].new) and not (not found[lo].words and found[lo].kind.lstrip("/") in BLOCK):
        lo -= 1
    while hi < len(found) and not (found[hi].words and found[hi].new) and found[hi].kind.lstrip("/") not in BLOCK:
        hi += 1
    inner = next((h for h in held if h[0] <= core[0] and core[1] <= h[1]), None)
    meets = [inner] if inner else [h for h in held if h[0] < core[1] and core[0] < h[1]]
    if meets:
        start, end = min(s for s, _ in meets), max(e for _, e in meets)
        within = sum(x.words for x in found[max(start, core[0]) : min(end, core[1])] if not x.skip)
        every = sum(x.words for x in found[core[0] : core[1]] if not x.skip)
        # an article that holds most of the region is the region
        lo, hi = (start, end) if lo == hi or 2 * within >= every else (min(lo, start), max(hi, end))
    blocks: list[list[str]] = []
    for x in found[lo:hi]:
        if x.skip or not x.text:
            continue
        if x.new or not blocks:
            blocks.append([])
        blocks[-1].append(x.text)
    return "\n".join(t for b in blocks if (t := " ".join("".join(b).split())))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: Weights | None = None) -> DataFrame:
    """``id, url, text, n_chars`` of every row, from its whole page.

    Null or empty pages, and pages without a word outside furniture, give an empty text. Null ids and urls pass through;
    repeated rows each come back; an empty table gives no row.
    """
    weights = weights or learn()

    def run(batches):
        for b in batches:
            texts = [main_text(x, weights) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "id long, url string, text string, n_chars long")
