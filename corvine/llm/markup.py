"""Markup residue in text: which kinds it holds, and clean text that keeps its structure (problem 6).

The text is cut once into constructs: fenced code, wiki notation, LaTeX, HTML tags and character
references, and Markdown, in that order, so that a construct counts for one kind.  HTML is read to
elements with root-to-leaf tag paths; text length and punctuation are summed per path, smoothed over
neighbouring elements, fused and thresholded to select the content nodes.  Headings, lists, code,
tables and formulas come out as plain Markdown-like lines.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.entities import html5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.llm.blocks import fenced
from corvine.llm.htmltree import Element, read
from corvine.llm.mainbody import link_list

# Names of HTML elements.
ELEMENTS = (
    "a abbr address article aside audio b blockquote body br button caption center cite code col colgroup dd del details div"
    " dl dt em embed fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins"
    " kbd label legend li link main map mark math meta mi mn mo mrow msub msup nav noscript object ol option p picture pre q s"
    " samp script section select small source span strike strong style sub summary sup svg table tbody td textarea tfoot th"
    " thead title tr tt u ul var video wbr"
).split()
TAG = re.compile(r"</?(?:" + "|".join(sorted(ELEMENTS, key=len, reverse=True)) + r")(?:\s+[^<>]*)?\s*/?>", re.I)
NAMED = frozenset(k[:-1] for k in html5 if k.endswith(";"))
REFERENCE = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|([A-Za-z][A-Za-z0-9]{1,31}));")
WIKI_TABLE = re.compile(r"^[ \t]*\{\|.*?(?:^[ \t]*\|\}|\Z)", re.S | re.M)
WIKI_HEADING = re.compile(r"^(={1,6})[ \t]*([^=\n][^\n]*?)[ \t]*\1[ \t]*\r?$", re.M)
WIKI_LINK = re.compile(r"\[\[([^\[\]\n|]+)(?:\|([^\[\]\n]*))?\]\]")
WIKI_TEMPLATE = re.compile(r"\{\{([A-Za-z][^{}|\n]*)\|([^{}\n]*)\}\}|\{\{[A-Z][A-Za-z]+(?: [A-Za-z]+)*\}\}")
WIKI_QUOTES = re.compile(r"'''([^'\n]+(?:'[^'\n]+)*)'''|(?<!')''([^'\n]+(?:'[^'\n]+)*)''(?!')")
WIKI_URL = re.compile(r"(?<![\]\w!])\[((?:https?|ftp)://[^\s\[\]]+)(?: ([^\[\]\n]+))?\](?!\()")
WIKI_REF = re.compile(r"<(?:ref|nowiki)\b[^<>]*>.*?</(?:ref|nowiki)>|<ref\b[^<>]*/>|__(?:TOC|NOTOC|FORCETOC)__", re.S)
# LaTeX commands that take no argument in braces.
SYMBOLS = (
    "alpha beta gamma delta epsilon varepsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau phi varphi chi psi"
    " omega Gamma Delta Theta Lambda Xi Pi Sigma Phi Psi Omega times cdot cdots ldots dots leq geq neq le ge ne approx equiv sim"
    " infty partial nabla sum prod int log ln exp sin cos tan max min lim in notin subset cup cap to rightarrow leftarrow"
    " Rightarrow pm mp div forall exists left right quad qquad item centering maketitle tableofcontents hline"
).split()
FORMULA = re.compile(
    r"\$\$(?=\S|\s+\S)[^$]+?\$\$|\\\((?:(?!\\[()]).)+\\\)|\\\[(?:(?!\\[\[\]]).)+\\\]"
    r"|\\begin\{([A-Za-z]+\*?)\}.*?(?:\\end\{\1\}|\Z)"
    r"|(?<![\w$\\])\$(?![\s$])(?=[^$\n]*[\\^_{}])(?=[^$\n]*(?:\\[A-Za-z]|[_^]\{|[A-Za-z0-9)]\^|[a-zA-Z]_[a-zA-Z0-9{]))[^$\n]+?(?<![\s\\])\$(?![\w$])",
    re.S,
)
COMMAND = re.compile(
    r"(?<![\w\\:.~/])\\(?:([A-Za-z]{2,})\*?(?:\[[^\[\]\n]*\])?\{([^{}\n]*)\}|(?:" + "|".join(SYMBOLS) + r")(?![A-Za-z\\]))"
)
LOOSE_END = re.compile(r"\\(?:begin|end)\{[A-Za-z]+\*?\}")
MD_LINE = re.compile(
    r"^(?:[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+\S| {0,3}#{1,6}(?:[ \t]+\S|$)| {0,3}>| {0,3}(?:\*[ \t]*){3,}$| {0,3}(?:-[ \t]*){3,}$"
    r"|[ \t]*\|.*\|[ \t]*$| {0,3}(?:`{3,}|~{3,}))"
)
MD_INLINE = re.compile(
    r"(`+)(?!`)(?:[^`\n]|(?!\1)`+)+?\1(?!`)|!?\[[^\[\]\n]*\]\([^()\s]*(?:\s+[\"'][^\"'\n]*[\"'])?\)|\[[^\[\]\n]+\]\[[^\[\]\n]*\]"
    r"|(?<![\w*\\])(\*{1,3})(?![\s*])[^*\n]+?(?<![\s*\\])\2(?![\w*])|(?<![\w_\\])(__?)(?![\s_])[^\n_]+?(?<![\s_\\])\3(?![\w_])"
    r"|~~(?!\s)[^~\n]+?(?<!\s)~~|<https?://[^<>\s]+>"
)
SETEXT = re.compile(r"^ {0,3}(?:=+|-{2,})[ \t]*$")
WIKI_SIGN = re.compile(r"\[\[|\{\{|''|\{\||==|\[(?:https?|ftp):|<(?:ref|nowiki)|__[A-Z]")
MD_LINK = re.compile(r"!?\[([^\[\]\n]*)\]\([^()\s]*(?:\s+[\"'][^\"'\n]*[\"'])?\)")
MD_STAR = re.compile(r"(?<![\w*\\])(\*{1,3})(?![\s*])([^*\n]+?)(?<![\s*\\])\1(?![\w*])")
MD_UNDERSCORE = re.compile(r"(?<![\w_\\])(__?)(?![\s_])([^\n_]+?)(?<![\s_\\])\1(?![\w_])")
MD_RULE = re.compile(r"^[ \t]*\|(?:[ \t]*:?-+:?[ \t]*\|)+[ \t]*$")
MD_BULLET = re.compile(r"^([ \t]*)[*+][ \t]+(\S.*)$")
KINDS = ("html", "wiki", "latex", "markdown")


def _references(text: str) -> bool:
    return any(m[1] is None or m[1] in NAMED for m in REFERENCE.finditer(text))


def _blank(m: re.Match) -> str:
    return "\n" * m[0].count("\n") or " "


def outside_fences(text: str) -> tuple[str, bool]:
    """(text with fenced code emptied, whether there was any)."""
    lines = [x.rstrip("\r") for x in text.split("\n")]
    if "```" not in text and "~~~" not in text:
        return "\n".join(lines), False
    where = fenced(lines)
    return "\n".join("" if w else x for x, w in zip(lines, where)), any(where)


def kinds_of(text: str | None) -> list[str]:
    """Kinds of markup in text, each construct counted for one kind only."""
    if not text:
        return []
    found = set()
    rest, fence = outside_fences(text)
    if fence:
        found.add("markdown")
    if WIKI_SIGN.search(rest):
        for pattern in (WIKI_TABLE, WIKI_HEADING, WIKI_REF, WIKI_TEMPLATE, WIKI_LINK, WIKI_QUOTES, WIKI_URL):
            rest, n = pattern.subn(_blank, rest)
            if n:
                found.add("wiki")
    if "\\" in rest or "$" in rest:
        for pattern in (FORMULA, COMMAND, LOOSE_END):
            rest, n = pattern.subn(_blank, rest)
            if n:
                found.add("latex")
    if "<" in rest:
        rest, n = TAG.subn(" ", rest)
        if n:
            found.add("html")
    if "&" in rest and _references(rest):
        found.add("html")
    if "markdown" not in found:
        if MD_INLINE.search(rest):
            found.add("markdown")
        else:
            before = ""
            for line in rest.split("\n"):
                if MD_LINE.match(line) or (SETEXT.match(line) and before.strip()):
                    found.add("markdown")
                    break
                before = line
    return [k for k in KINDS if k in found]


def lists_of(elements: list[Element]) -> list[list[int]]:
    """Places of the items of each list."""
    out: dict[int, list[int]] = {}
    for k, e in enumerate(elements):
        if e.tag in ("li", "dt", "dd"):
            out.setdefault(e.group, []).append(k)
    return list(out.values())


def content_nodes(elements: list[Element]) -> list[bool]:
    """Content nodes by tag-path ratios.

    Per root-to-leaf path the text length and the punctuation are summed and divided by the path's
    nodes; both series are smoothed over neighbouring elements, multiplied, and cut at a fraction of
    their spread.  A list is judged as one: unless it is a list of links, its short items count too.
    Headings before content nodes count as content, through other headings.
    """
    n = len(elements)
    if n == 0:
        return []
    length = np.array([max(0, len(e.text) - e.linked) for e in elements], float)
    stops = np.array([sum(c in ".,;:!?。、，" for c in e.text) for e in elements], float)
    _, path = np.unique([e.path for e in elements], return_inverse=True)
    nodes = np.bincount(path)
    ratio = [(np.bincount(path, v) / nodes)[path] for v in (length, stops)]
    kernel = np.array([0.25, 0.5, 0.25])
    smooth = [np.convolve(np.pad(r, 1, mode="edge"), kernel, mode="valid") for r in ratio]
    fused = (smooth[0] + length) * (1 + smooth[1])
    keep = fused > 0.25 * fused.std()
    for members in lists_of(elements):
        if not link_list(elements, members):
            keep[members] = True
    for k in range(n - 1, -1, -1):
        e = elements[k]
        if e.tag in ("pre", "td", "th") or (e.tag[0] == "h" and e.tag[1:].isdigit() and keep[k + 1 : k + 3].any()):
            keep[k] = True
    return keep.tolist()


def clean_html(source: str, select: bool = True) -> str:
    """Text of an HTML page or fragment: headings as #, list items as -, code fenced, table rows with bars."""
    elements = read(source)
    keep = content_nodes(elements) if select else [True] * len(elements)
    out, row, group = [], [], None
    for e, k in zip(elements, keep):
        if not k:
            continue
        if e.tag in ("td", "th"):
            if row and e.group != group:
                out.append("| " + " | ".join(row) + " |")
                row = []
            row.append(e.text)
            group = e.group
            continue
        if row:
            out.append("| " + " | ".join(row) + " |")
            row = []
        if e.tag == "pre":
            out.append("```\n" + e.raw.strip("\n") + "\n```")
        elif e.text:
            level = int(e.tag[1]) if e.tag[0] == "h" and e.tag[1:].isdigit() else 0
            out.append(("#" * level + " " if level else "- " if e.tag in ("li", "dd") else "") + e.text)
    if row:
        out.append("| " + " | ".join(row) + " |")
    return "\n".join(out)


def _wiki_table(m: re.Match) -> str:
    rows: list[list[str]] = [[]]
    for line in m[0].split("\n")[1:]:
        line = line.strip()
        if line.startswith("|}"):
            break
        if line.startswith("|-"):
            rows.append([])
        elif line[:1] in ("|", "!"):
            rows[-1] += [c.rpartition("|")[2].strip() for c in re.split(r"\|\||!!", line[1:])]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows if r)


def _command(m: re.Match) -> str:
    name, body = m[1], m[2]
    if name is None:
        return m[0]
    if name in ("section", "chapter"):
        return f"\n## {body}\n"
    if name.startswith("sub") and name.endswith("section"):
        return f"\n### {body}\n"
    return "" if name in ("cite", "label", "ref", "bibliography", "usepackage") else body


def _clean_prose(text: str) -> str:
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        kept.append(m[0])
        return f"\x00{len(kept) - 1}\x00"

    text = text.replace("\x00", "")
    if "$" in text or "\\" in text:
        text = FORMULA.sub(keep, text)
    if WIKI_SIGN.search(text):
        text = WIKI_TABLE.sub(_wiki_table, text)
        text = WIKI_HEADING.sub(lambda m: "#" * len(m[1]) + " " + m[2], text)
        text = WIKI_REF.sub("", text)
        text = WIKI_TEMPLATE.sub(lambda m: m[2] or "", text)
        text = WIKI_LINK.sub(lambda m: m[2] or m[1], text)
        text = WIKI_QUOTES.sub(lambda m: m[1] or m[2], text)
        text = WIKI_URL.sub(lambda m: m[2] or m[1], text)
    if "\\" in text:
        text = COMMAND.sub(_command, text)
    if "<" in text and TAG.search(text):
        text = re.sub(r"<br\s*/?>|</(?:p|div|li|tr|ul|ol|table|h[1-6])\s*>", "\n", text, flags=re.I)
        text = re.sub(r"</t[dh]\s*>\s*<t[dh][^<>]*>", " | ", text, flags=re.I)
        text = re.sub(r"<li\b[^<>]*>", "\n- ", text, flags=re.I)
        text = re.sub(r"<h([1-6])\b[^<>]*>", lambda m: "\n" + "#" * int(m[1]) + " ", text, flags=re.I)
        text = TAG.sub("", text)
    if "&" in text:
        text = REFERENCE.sub(lambda m: html.unescape(m[0]) if m[1] is None or m[1] in NAMED else m[0], text)
    if "](" in text:
        text = MD_LINK.sub(r"\1", text)
    if "*" in text:
        text = MD_STAR.sub(r"\2", text)
    if "_" in text:
        text = MD_UNDERSCORE.sub(r"\2", text)
    out: list[str] = []
    for line in text.split("\n"):
        if line[:4].lstrip(" ").startswith(">"):
            line = re.sub(r"^ {0,3}>[ \t]?", "", line)
        if out and SETEXT.match(line) and out[-1].strip() and out[-1].lstrip()[0] not in "|#-":
            out[-1] = ("# " if "=" in line else "## ") + out[-1].strip()
        elif "|" in line and MD_RULE.match(line):
            continue
        elif m := MD_BULLET.match(line):
            out.append(f"{m[1]}- {m[2]}")
        elif line[:4].lstrip(" ").startswith("#") and (m := re.match(r" {0,3}(#{1,6})[ \t]+(.*)$", line)):
            out.append(f"{m[1]} {m[2].rstrip().rstrip('#').rstrip()}")
        else:
            out.append(line)
    text = "\n".join(out)
    return re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], text) if kept else text


def clean_text(text: str | None) -> str | None:
    """Text without markup residue; fenced code and formulas stay as they are, null stays null."""
    if text is None:
        return None
    lines = [x.rstrip("\r") for x in text.split("\n")]
    out, run = [], []
    for line, w in zip(lines, fenced(lines)):
        if w:
            if run:
                out.append(_clean_prose("\n".join(run)))
                run = []
            out.append(line)
        else:
            run.append(line)
    if run:
        out.append(_clean_prose("\n".join(run)))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip("\n")


def strip_markup(df: DataFrame, key: str = "id", text: str = "content", clean: bool = True) -> DataFrame:
    """key, kinds and (with ``clean``) clean of every row: kinds of markup found and the clean text.

    Null texts have no kinds and a null clean text, empty ones an empty one.  Repeated rows stay
    repeated; other columns are not read.  No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 1000) for k in range(0, batch.num_rows, 1000)):
                texts = part.column(1).to_pylist()
                out = {key: part.column(0), "kinds": pa.array([kinds_of(t) for t in texts], pa.list_(pa.string()))}
                if clean:
                    out["clean"] = pa.array([clean_text(t) for t in texts], pa.string())
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return df.select(key, text).mapInArrow(run, f"`{key}` bigint, kinds array<string>" + ", clean string" * clean)


def strip_pages(df: DataFrame, key: str = "page_id", source: str = "content_html") -> DataFrame:
    """key, clean of every page: the text of its content nodes; null markup gives null."""

    @F.pandas_udf("string")
    def clean(column):
        return column.map(lambda s: None if s is None else clean_html(s))

    return df.select(key, clean(source).alias("clean"))
