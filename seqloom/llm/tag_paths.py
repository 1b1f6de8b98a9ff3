"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with the path of block elements from the root to its leaf. Text length and
punctuation are added up per path and divided by the number of its blocks; a path's ratio is high where blocks are
long, punctuated and hold few links. Ratios are smoothed along the page, so a short paragraph among long ones is read
as they are, and fused upwards: every ancestor gathers the ratios below it, and the walk from the root to the
ancestor that holds nearly all of it finds the content node. Paths below that node stay unless their ratio is under a
threshold, which depends on the spread of ratios on the page; paths that are mostly links stay if text of the content
came before them. Elements that are no content by their meaning (navigation, footers, forms, scripts, roles) have ratio
zero, as have those whose class or id is the name of such a part as a whole (``comments``, ``comment-list``), whatever
their size, unless nothing else is left. A name that is a part of a longer one (``has-sidebar``) lowers the ratio of the
blocks below to ``NAMED`` of it; it says nothing on html, body, main and article, nor on an element that holds more than
half of the page's text. An article or main element is the content if its blocks hold at least half of all ratios, each
weighted by the block's length; else its paths are judged like any other.

Null and empty pages, and pages without text, give an empty text. Broken markup is read as browsers read it: unclosed
elements end with their parent, an unfinished tag or comment at the end of the page is dropped. Repeated rows are
handled one by one. A page is held whole by one task; the work is linear in its length.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre figure figcaption header footer nav aside form fieldset address details summary hr menu dialog "
    "search hgroup center".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title select button canvas head annotation metadata".split())
NEVER = frozenset("nav footer aside form menu dialog fieldset search".split())
ROOTS = frozenset("article main".split())
HOLDERS = ROOTS | {"html", "body"}
NAMED = 0.01
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar footer cookie cookies consent notice notices alert banner comment comments "
    "disqus respond reply replies share sharing social related recommended newsletter subscribe signup popup modal "
    "overlay pagination pager toolbar masthead copyright disclaimer".split()
)
#: What may follow or precede one of the names in the name of the same part.
PARTS = frozenset("list section area box wrapper wrap container block thread body text content item items holder inner outer panel widget the".split())
REPLIES = frozenset("comment comments reply replies respond disqus".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
_TAG = re.compile(
    r"""<!--(?:.*?--!?>|.*\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)|</?[a-zA-Z][^>]*+\Z""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int
    out: bool
    roots: tuple[int, ...]  # article and main elements around it
    named: tuple[int, ...]  # elements around it whose names hold one of no content


def _whole(value: str, names: frozenset[str]) -> bool:
    """Whether one of the names in a class or id is a listed one as a whole, but for numbers and words for parts."""
    for token in value.split():
        words = [w for w in re.split(r"[^a-z]+", token) if w and w not in PARTS]
        if words and all(w in names for w in words):
            return True
    return False


def _named(attributes: str, inside: bool) -> tuple[str, bool, bool]:
    """Name added to the tag in the path, whether the element is none of the content, and whether names hint at it."""
    label, out, named = "", False, False
    for m in _ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if kind == "hidden" and (not m[2] or value in ("", "hidden")) or kind == "aria-hidden" and value == "true":
            out = True
        elif kind in ("class", "id", "role") and value:
            words = set(re.split(r"[^a-z]+", value))
            hit = bool(words & NAMES) or not inside and value in ("header", "contentinfo", "complementary")
            out |= hit and kind == "role"
            if kind != "role":
                named |= hit
            label += f".{value}"
    return label, out, named


def _part(attributes: str, tag: str) -> bool:
    """Whether class or id name a part that is no content; an article can only be a reader's comment."""
    names = REPLIES if tag in HOLDERS else NAMES
    values = [(m[2] or "").strip("\"'").lower() for m in _ATTRIBUTE.finditer(attributes) if m[1].lower() in ("class", "id")]
    return tag not in ("html", "body", "main") and any(_whole(v, names) for v in values)


def blocks(page: str) -> list[Block]:
    found: list[Block] = []
    # tag, its part of the path, no content, article and main elements, elements with names of no content, below an article
    stack: list[tuple[str, str, bool, tuple[int, ...], tuple[int, ...], bool]] = []
    parts: list[str] = []
    linked = links = 0

    def text(upto: int) -> None:
        nonlocal linked
        if upto > at:
            piece = page[at:upto]
            if "&" in piece:
                piece = entities.unescape(piece)
            parts.append(piece)
            if links:
                linked += len("".join(piece.split()))

    def flush() -> None:
        nonlocal linked
        if parts:
            joined = " ".join("".join(parts).split())
            if joined:
                out, roots, named = stack[-1][2:5] if stack else (False, (), ())
                found.append(Block(tuple(s[1] for s in stack), joined, linked, out, roots, named))
            parts.clear()
        linked = 0

    def pop(tags: set[str], stop: frozenset[str] = frozenset()) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                del stack[k:]
                return
            if stack[k][0] in stop:
                return

    at = 0
    scan = 0
    while m := _TAG.search(page, scan):
        text(m.start())
        at = scan = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        close, rest = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in RAW and not close and not rest.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>" if tag != "head" else r"</head\b[^>]*>|(?=<body\b)", re.I).search(page, scan)
            at = scan = end.end() if end else len(page)
            continue
        if tag == "br" or tag in ("img", "hr", "wbr"):
            parts.append("" if tag == "wbr" else " ")
        if tag == "a":
            links = 0 if close else 1
        if tag not in BLOCKS:
            continue
        flush()
        if close:
            pop({tag})
            continue
        if tag in CLOSES:
            pop(CLOSES[tag], frozenset(("ul", "ol", "dl", "table")))
        elif tag not in ("html", "body"):
            pop({"p"}, frozenset(("td", "th", "table")))
        if tag in VOID or rest.endswith("/"):
            continue
        above = stack[-1] if stack else ("", "", False, (), (), False)
        label, out, hit = _named(rest, above[5])
        part = _part(rest, tag)
        named = (*above[4], -at if part else at) if part or hit and tag not in HOLDERS else above[4]
        out |= tag in NEVER or tag == "header" and not above[5]
        main = tag in ROOTS or ".main" in label
        stack.append((tag, tag + label, above[2] or out, (*above[3], at) if main else above[3], named, above[5] or main))
    text(len(page))
    flush()
    return found


def _smoothed(values: list[float], radius: int = 2) -> list[float]:
    kernel = [math.exp(-k * k / 2) for k in range(radius + 1)]
    out = []
    for i in range(len(values)):
        span = range(max(0, i - radius), min(len(values), i + radius + 1))
        out.append(sum(values[j] * kernel[abs(i - j)] for j in span) / sum(kernel[abs(i - j)] for j in span))
    return out


def _doubtful(live: list[Block]) -> list[int]:
    """2: in an element named as a part that is no content; 1: in one whose name hints at it and that holds half of the
    text at most; 0: neither. If no block is left at 0, hints are void; if then none is, so are names."""
    size: dict[int, int] = {}
    for b in live:
        for k in b.named:
            size[k] = size.get(k, 0) + len(b.text)
    total = sum(len(b.text) for b in live)
    doubt = [2 if any(k < 0 for k in b.named) else int(any(2 * size[k] <= total for k in b.named)) for b in live]
    if all(doubt):
        doubt = [x if x == 2 else 0 for x in doubt]
    return [0] * len(live) if all(doubt) else doubt


def _content_root(clear: list[Block], weight: list[float]) -> int | None:
    """The innermost article or main element that holds at least half of the weight, if any does."""
    per: dict[int, float] = {}
    for b, w in zip(clear, weight):
        for k in b.roots:
            per[k] = per.get(k, 0.0) + w
    return max((k for k, w in per.items() if 2 * w >= sum(weight) > 0), default=None)


def _ratios(live: list[Block]) -> list[float]:
    """The ratio of each block's path, links counted against it."""
    sums: dict[tuple[str, ...], list[float]] = {}
    for b in live:
        t = sums.setdefault(b.path, [0, 0, 0, 0])
        for k, v in enumerate((len(b.text), len(PUNCTUATION.findall(b.text)), 1, b.linked)):
            t[k] += v
    ratio = {p: chars / n * (1 + marks / n) * max(0.0, 1 - links / chars) for p, (chars, marks, n, links) in sums.items()}
    return [ratio[b.path] for b in live]


def select(found: list[Block], share: float = 0.8, spread: float = 0.05) -> list[Block]:
    """The blocks of the main text, in page order."""
    live = [b for b in found if not b.out]
    level = _doubtful(live)
    live = [b for b, x in zip(live, level) if x < 2]
    doubt = {id(b): bool(x) for b, x in zip(live, (x for x in level if x < 2))}
    if not live:
        return []
    first = [b for b in live if not doubt[id(b)]]
    root = _content_root(first, [r * len(b.text) for b, r in zip(first, _ratios(first))])
    if root is not None:
        live = [b for b in live if root in b.roots]
    clear = [b for b in live if not doubt[id(b)]]
    sums: dict[tuple[bool, tuple[str, ...]], list[float]] = {}
    for b in live:
        s = sums.setdefault((doubt[id(b)], b.path), [0, 0, 0, 0])
        for k, v in enumerate((len(b.text), len(PUNCTUATION.findall(b.text)), 1, b.linked)):
            s[k] += v
    ratio = {p: chars / n * (1 + marks / n) * max(0.0, 1 - links / chars) for p, (chars, marks, n, links) in sums.items()}
    smooth = _smoothed([ratio[False, b.path] for b in clear])
    mass: dict[tuple[str, ...], float] = {}
    own: dict[tuple[str, ...], list[float]] = {}

    def gather(b: Block, r: float) -> None:
        for k in range(len(b.path) + 1):
            mass[b.path[:k]] = mass.get(b.path[:k], 0.0) + r * len(b.text)

    for b, r in zip(clear, smooth):
        own.setdefault(b.path, []).append(r)
        gather(b, r)
    for b in live:
        if doubt[id(b)]:
            gather(b, NAMED * ratio[True, b.path])
    below: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
    for p in mass:
        if p:
            below.setdefault(p[:-1], []).append(p)
    node: tuple[str, ...] = ()
    while node in below and node not in own:
        best = max(below[node], key=lambda p: mass[p])
        if mass[best] < share * mass[node] or best in own:
            break
        node = best
    mean = {p: sum(v) / len(v) for p, v in own.items() if p[: len(node)] == node}
    centre = sum(mean.values()) / max(len(mean), 1)
    deviation = math.sqrt(sum((v - centre) ** 2 for v in mean.values()) / max(len(mean), 1))

    begun = False

    def stays(b: Block) -> bool:
        nonlocal begun
        if b.path[: len(node)] != node:
            return False
        named = doubt[id(b)]
        chars, _, _, links = sums[named, b.path]
        if named:
            return 2 * links < chars and NAMED * ratio[True, b.path] >= spread * max(centre, deviation)
        if 2 * links >= chars:
            return begun or root is not None
        good = len(b.path) <= len(node) + 1 or mean[b.path] >= spread * deviation
        begun |= good
        return good

    return [b for b in live if stays(b)]


def main_text(page: str | None) -> str:
    return "\n\n".join(b.text for b in select(blocks(page))) if page else ""


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep``, ``text`` and ``n_chars`` of every page."""
    rows = pages.select(*[F.col(c) for c in keep], F.col(html).alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [main_text(p.as_py()) for p in part.column(len(keep))]
                sizes = pa.array([len(t) for t in texts], pa.int64())
                columns = [*part.columns[: len(keep)], pa.array(texts, pa.string()), sizes]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kinds}, text string, n_chars long")
