"""The main body of captured pages by line-block distribution (problem 2).

Markup is stripped to lines: one per text-bearing element, and EMPTY lines for each layout container
that closes or opens between two of them, as the markup's own lines would leave.  A line weighs its
text length without link text; links, controls and lists that lead elsewhere weigh nothing.  Sums over
a sliding window of lines give the block distribution: a surge is the line at which a block rises, a
dive the line after which WINDOW lines weigh nothing.  The stretch between surge and dive that holds
most text of the page's own is the body, together with the stretches of the same container.

Inside the body, lines that stand on a share of all pages or of all pages of their site are furniture.
They are counted over the whole table, a text once per page however often and in however many versions
the page was captured.  No wording is known to this module.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.llm.htmltree import Element, read
from corvine.operators.timestamps import MONTHS
from corvine.session import bounded_broadcast, materialize

WINDOW = 4
EMPTY = WINDOW
"""Empty lines a layout container's edge stands for."""
SURGE = 12
UNTITLED = 96
"""Least weight of a surge, and of the body of a page without a title."""
LINKED = 0.2
"""Least share of items that are links and nothing else in a list that leads elsewhere."""
MIN_PAGES = 6
MIN_SHARE = 0.01
MIN_WORDS = 3
"""Fewest words of a line whose repetition tells anything."""
CAPTION = 6
"""Most words of a caption and of an entry in a trail."""
HEADINGS = frozenset(f"h{k}" for k in range(1, 7))
DATA = frozenset(("td", "th", "pre"))
# Elements of controls, and of the page's layout.
CONTROLS = frozenset(("button", "label", "option", "select"))
INLINE = frozenset(("a", "span"))
LAYOUT = frozenset("div section article main aside header footer nav form fieldset details td th".split())
WORD = re.compile(r"[^\W\d_]{2,}")
MASK = re.compile(r"[0-9]+|\b(?:" + "|".join(sorted(MONTHS, key=len, reverse=True)) + r")\b")
CUT = re.compile(r"\s[>›»/|·:]\s|:\s")


def text_key(text: str) -> int:
    """Hash of a text without case, numbers, month names and runs of white space."""
    return xxhash.xxh3_64_intdigest(MASK.sub("0", " ".join(text.lower().split()))) - (1 << 63)


def telling(e: Element) -> bool:
    """Whether repetition makes an element furniture: no title or data, which repeat by nature, and words enough."""
    return e.tag not in HEADINGS and e.tag not in DATA and len(WORD.findall(e.text)) >= MIN_WORDS


def link_only(e: Element) -> bool:
    return bool(e.links) and bool(e.raw.strip()) and e.linked >= 0.9 * len(e.raw.strip())


def link_list(elements: list[Element], members: list[int]) -> bool:
    """Whether a list leads elsewhere, judged by its items as one."""
    return sum(link_only(elements[k]) for k in members) >= LINKED * len(members)


def trail(text: str) -> bool:
    """Whether a line is cut by signs into three or more parts of few words each."""
    parts = [x for x in CUT.split(text) if x.strip()]
    return len(parts) >= 3 and all(len(x.split()) <= 2 * CAPTION for x in parts) and not text.rstrip().endswith((".", "!", "?"))


def aside(elements: list[Element]) -> list[bool]:
    """Lines that lead elsewhere by themselves: controls, lists of links with their captions, and trails."""
    out = [e.tag in CONTROLS or (e.tag == "div" and trail(e.text)) for e in elements]
    lists: dict[int, list[int]] = {}
    for k, e in enumerate(elements):
        if e.tag in ("li", "dt", "dd"):
            lists.setdefault(e.group, []).append(k)
    for members in lists.values():
        if link_list(elements, members):
            for k in members:
                out[k] = True
            above = members[0] - 1
            if above >= 0 and elements[above].tag not in ("h1", *DATA) and caption(elements[above].text):
                out[above] = True
    return out


def weights(elements: list[Element], leading: list[bool]) -> list[int]:
    """Length of each line's text that is no link; 0 where it leads elsewhere and in bare inline elements, at least 1 for data."""
    return [
        0 if out or e.tag in INLINE else max(0, len(e.text) - e.linked, int(e.tag in DATA)) for e, out in zip(elements, leading)
    ]


def caption(text: str) -> bool:
    return len(text.split()) <= CAPTION and not text.rstrip().endswith((".", ":", "?", "!"))


def gaps(elements: list[Element]) -> list[int]:
    """Edges of layout containers between each element and the next; cells count in rows where one holds a heading or a container."""
    cells = ("td", "th")
    rows = {
        e.boxes[n - 1] for e in elements for n, t in enumerate(e.frames) if n and t in cells and (n + 1 < len(e.boxes) or e.tag in HEADINGS)
    }
    frames = [
        {b for n, (b, t) in enumerate(zip(e.boxes, e.frames)) if t in LAYOUT and (t not in cells or (n and e.boxes[n - 1] in rows))} for e in elements
    ]
    return [len(a ^ b) for a, b in pairwise(frames)]


def stretches(weight: list[int], gap: list[int]) -> list[tuple[int, int]]:
    """(first, last) element of each surge up to its dive, over the lines with the empty ones between them."""
    line, owner = [], []
    for k, w in enumerate(weight):
        line.append(w)
        owner.append(k)
        if k < len(gap):
            line += [0] * (EMPTY * gap[k])
            owner += [k] * (EMPTY * gap[k])
    ahead = [0]
    for w in line:
        ahead.append(ahead[-1] + w)
    block = [ahead[min(k + WINDOW, len(line))] - ahead[k] for k in range(len(line))]
    out, start = [], None
    for k, w in enumerate(line):
        if start is None and w and block[k] >= SURGE:
            start = k
        if start is not None and w and (k + 1 == len(line) or not block[k + 1]):
            out.append((owner[start], owner[k]))
            start = None
    return out


@dataclass
class Outline:
    """The lines of a page that a body can be made of: those within surges, and titles outside."""

    number: list[int]
    weight: list[int]
    key: list[int]
    """Key of the text; 0 where repetition tells nothing."""
    part: list[int]
    """Which stretch a line belongs to; -1 for a title outside."""
    title: list[bool]
    boxes: list[list[int]]
    """Layout containers, outermost first."""
    text: list[str]

    def body(self, repeated: frozenset[int] | set[int] = frozenset()) -> list[int]:
        """Places of the lines of the main body, its title heading included; none without a surge of text.

        repeated: keys of texts that are furniture.  Stretches within one container belong together, as
        asides within a body part it; those outside of all containers do too.  The body is the group
        with most weight of lines that are not repeated, one with a title first.  The title of a body
        without one is the last <h1> before it.
        """
        n = range(len(self.number))
        seen = [k != 0 and k in repeated for k in self.key]
        own = [0 if s else w for s, w in zip(seen, self.weight)]
        box: dict[int, int] = {}
        """Innermost container of each stretch; 0 for none."""
        for p in sorted({p for p in self.part if p >= 0}):
            lines = [self.boxes[k] for k in n if self.part[k] == p]
            box[p] = next((x for x in reversed(lines[0]) if all(x in other for other in lines)), 0)
        best: tuple[bool, int] = (False, 0)
        kept: list[int] = []
        for x in dict.fromkeys(box.values()):
            group = [k for k in n if self.part[k] >= 0 and (x in self.boxes[k] if x else box[self.part[k]] == 0)]
            text = sum(own[k] for k in group if not self.title[k])
            rank = any(self.title[k] and own[k] for k in group) and text > 0, text
            if rank > best:
                best, kept = rank, group
        if not kept:
            return []
        if not any(self.title[k] and own[k] for k in kept):
            before = [k for k in range(kept[0]) if self.title[k] and own[k]][-1:]
            if not before and best[1] < UNTITLED:
                return []
            kept = before + kept
        return [k for k in kept if not seen[k]]


def outline(elements: list[Element]) -> Outline:
    leading = aside(elements)
    weight = weights(elements, leading)
    part = [-1] * len(elements)
    for n, (a, b) in enumerate(stretches(weight, gaps(elements))):
        part[a : b + 1] = [n] * (b + 1 - a)
    take = [k for k, e in enumerate(elements) if not leading[k] and (part[k] >= 0 or (e.tag == "h1" and weight[k]))]
    some = [elements[k] for k in take]
    return Outline(
        [e.number for e in some], [weight[k] for k in take], [text_key(e.text) if telling(e) else 0 for e in some], [part[k] for k in take],
        [e.tag == "h1" for e in some], [[x for x, t in zip(e.boxes, e.frames) if t in LAYOUT] for e in some], [e.text for e in some],
    )


def body_elements(elements: list[Element], repeated: frozenset[int] | set[int] = frozenset()) -> list[Element]:
    """Elements of the main body of one page."""
    o = outline(elements)
    by = {e.number: e for e in elements}
    return [by[o.number[k]] for k in o.body(repeated)]


def slug(text: str | None) -> str:
    return re.sub(r"[^a-z0-9]+", "-", (text or "").lower()).strip("-")


def trail_places(breadcrumbs: list[str | None] | None, url: str | None, title: str | None) -> list[int]:
    """Places of the entries that name the page's product, manual, topic or the page itself."""
    if not breadcrumbs:
        return []
    parts = [p for p in re.sub(r"^\w+://[^/]*", "", url or "").split("/") if p]
    parts = [p for p in parts if not re.fullmatch(r"\d+(?:\.\d+)*|latest", p)]
    if parts and re.fullmatch(r"[a-z]{2}(?:-[a-z]{2})?", parts[0], re.I):
        parts = parts[1:]
    own, last, known = slug(title), parts[-1].lower() if parts else "", {p.lower() for p in parts[:-1]}
    out = []
    for k, entry in enumerate(breadcrumbs):
        s = slug(entry)
        if s and (s in known or s == own or (last and (last == s or last.startswith(s + "-") or (len(s) > 30 and s.startswith(last.rpartition("-")[0]))))):
            out.append(k)
    return out


OUTLINE = {
    "number": pa.list_(pa.int32()), "weight": pa.list_(pa.int32()), "key": pa.list_(pa.int64()), "part": pa.list_(pa.int32()),
    "title": pa.list_(pa.bool_()), "boxes": pa.list_(pa.list_(pa.int32())), "text": pa.list_(pa.string()),
}
SCHEMA = "number array<int>, weight array<int>, key array<bigint>, part array<int>, title array<boolean>, boxes array<array<int>>, text array<string>"


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, title_text, breadcrumbs and the outline of every page: the only reading of its markup."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [outline(read(source) if source else []) for source in batch.column(4).to_pylist()]
            cols = [pa.array([getattr(o, n) for o in rows], t) for n, t in OUTLINE.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *cols], names=["page_id", "url", "title_text", "breadcrumbs", *OUTLINE])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "title", "breadcrumbs", "content_html").mapInArrow(
        run, f"page_id bigint, url string, title_text string, breadcrumbs array<string>, {SCHEMA}"
    )


def repeated_texts(lines: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """host, k of the texts that stand on at least max(min_pages, min_share) of all pages or of their site's pages.

    lines: host, page, key (array).  A page is a url without its version; each (host, page, text) counts once,
    reduced before the shuffle.  host is null for texts that are repeated over all pages.
    """
    by_host = lines.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    total = by_host.agg(F.sum("pages").alias("all_pages"))
    counts = lines.select("host", "page", F.explode("key").alias("k")).filter("k <> 0").distinct().groupBy("host", "k").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "texts")  # a text may stand on one page of each of many sites
    often = lambda n, of: (n >= min_pages) & (n >= min_share * of)
    everywhere = counts.groupBy("k").agg(F.sum("n").alias("n")).join(F.broadcast(total), F.lit(True))  # one row
    site = counts.join(bounded_broadcast(by_host, 100_000), "host")
    return (
        everywhere.filter(often(F.col("n"), F.col("all_pages"))).select(F.lit(None).cast("string").alias("host"), "k")
        .unionByName(site.filter(often(F.col("n"), F.col("pages"))).select("host", "k"))
    )


def main_content(pages: DataFrame, texts: bool = True) -> DataFrame:
    """page_id, url, body_nodes, (with ``texts``) body_text, trail, trail_places of every page.

    body_nodes are the data-node numbers of the main body in page order, body_text its lines.  Null or
    empty markup and pages without a body give empty results; null breadcrumbs give an empty trail; a
    null title or url only takes that evidence away.  Repeated rows stay repeated; other columns are
    not read.  Markup is read once; only hashes of lines are shuffled to count them.
    """
    lines = materialize(parsed(pages).withColumn("row", F.monotonically_increasing_id()), "lines")
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^\w+://([^/?#]*)", 1)), F.lit(""))
    page = F.coalesce(F.regexp_replace("url", r"/(?:\d+(?:\.\d+)*|latest)(?=/|$)", ""), F.concat(F.lit("row "), F.col("row").cast("string")))
    named = lines.select("row", host.alias("host"), F.xxhash64(page).alias("page"), "key")
    repeated = materialize(repeated_texts(named), "repeated")
    each = named.select("row", "host", F.explode("key").alias("k")).filter("k <> 0")
    some = each.join(bounded_broadcast(repeated.filter("host is null").select("k"), 500_000), "k", "left_semi")
    here = each.join(bounded_broadcast(repeated.filter("host is not null"), 500_000), ["host", "k"], "left_semi")
    gone = some.select("row", "k").unionByName(here.select("row", "k")).groupBy("row").agg(F.collect_set("k").alias("gone"))
    names = [n for n in OUTLINE if texts or n != "text"]
    kinds = {
        "page_id": pa.int64(), "url": pa.string(), "body_nodes": pa.list_(pa.int32()), **({"body_text": pa.string()} if texts else {}),
        "trail": pa.list_(pa.string()), "trail_places": pa.list_(pa.int32()),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page_id, url, title, crumbs, gone, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                o = Outline(**dict(zip(names, rest)), **({} if texts else {"text": []}))
                body = o.body(set(gone or ()))
                places = trail_places(crumbs, url, title)
                text = ["\n".join(o.text[k] for k in body)] if texts else []
                out.append((page_id, url, [o.number[k] for k in body], *text, [crumbs[k].strip() for k in places], places))
            cols = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.values())], names=list(kinds))

    schema = f"page_id bigint, url string, body_nodes array<int>{', body_text string' * texts}, trail array<string>, trail_places array<int>"
    return lines.join(gone, "row", "left").select("page_id", "url", "title_text", "breadcrumbs", "gone", *names).mapInArrow(run, schema)
