"""A tolerant one-pass reader of HTML: the text-bearing elements in page order, with tag paths."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import cached_property

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\w[^>]*>|<(script|style)\b.*?(?:</\1\s*>|$)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
NUMBER = re.compile(r"data-node\s*=\s*[\"']?(\d+)")
HREF = re.compile(r"href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# Elements without content, and elements that start a new line of text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption dd details div dl dt fieldset figcaption figure footer form h1 h2"
    " h3 h4 h5 h6 header html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
# An opening tag of the first kind ends an open element of the second.
CLOSES = {
    "li": {"li", "p"}, "p": {"p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"td", "th", "tr", "p"},
    "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
}
FENCES = frozenset("ul ol table dl article aside main nav header footer section".split())
"""Elements out of which an implied end does not reach."""


@dataclass
class Element:
    """One element that carries text of its own; number is its data-node attribute or its place from 1."""

    tag: str
    number: int
    path: str
    group: int
    """Running number of the innermost list, table, row or other container."""
    boxes: tuple[int, ...] = ()
    """Running numbers of all open containers, outermost first."""
    frames: tuple[str, ...] = ()
    """Tags of those containers."""
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    links: list[str] = field(default_factory=list)

    @cached_property
    def raw(self) -> str:
        return "".join(self.parts)

    @cached_property
    def text(self) -> str:
        return " ".join(self.raw.split())


def read(source: str) -> list[Element]:
    """Elements of the page in order.  With data-node attributes those elements, else every block with text."""
    numbered = "data-node" in source
    out: list[Element] = []
    stack: list[tuple[str, Element | None, int]] = []
    at, groups, anchors = 0, 0, 0

    def holder() -> Element | None:
        for _, e, _ in reversed(stack):
            if e is not None:
                return e
        return None

    def boxes() -> tuple[tuple[int, ...], tuple[str, ...]]:
        held: dict[int, str] = {}
        for t, _, g in stack:
            if g:
                held.setdefault(g, t)
        return tuple(held), tuple(held.values())

    def say(text: str) -> None:
        nonlocal anchors
        if not text:
            return
        e = holder()
        if e is None and not numbered and text.strip():
            e = Element("text", len(out) + 1, "/".join(t for t, _, _ in stack) or "text", groups, *boxes())
            out.append(e)
        if e is not None:
            text = html.unescape(text) if "&" in text else text
            e.parts.append(text)
            if anchors:
                e.linked += len(text.strip())

    for m in TOKEN.finditer(source):
        if m.start() > at:
            say(source[at : m.start()])
        at = m.end()
        tag = m[3].lower() if m[3] else ""
        if not tag:
            continue
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    anchors -= sum(t == "a" for t, _, _ in stack[k:])
                    del stack[k:]
                    break
                if stack[k][0] in FENCES and tag not in FENCES and tag not in BLOCKS:
                    break
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                say("\n")
            elif tag == "img" and (alt := re.search(r"alt\s*=\s*[\"']([^\"']+)", m[4] or "")):
                say(alt[1])
            continue
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in FENCES:
                break
            if stack[k][0] in CLOSES.get(tag, ()) or (stack[k][0] == "p" and tag in BLOCKS):
                anchors -= sum(t == "a" for t, _, _ in stack[k:])
                del stack[k:]
                break
        number = NUMBER.search(m[4]) if numbered and m[4] else None
        element = None
        if number or (not numbered and tag in BLOCKS and tag not in FENCES):
            path = "/".join(t for t, _, _ in stack)
            element = Element(tag, int(number[1]) if number else len(out) + 1, f"{path}/{tag}" if path else tag, stack[-1][2] if stack else 0, *boxes())
            out.append(element)
        if tag == "a":
            anchors += 1
            link = HREF.search(m[4] or "")
            if (e := element or holder()) is not None and link:
                e.links.append(link[1] or link[2] or link[3] or "")
        if tag in BLOCKS and tag not in ("p", "li", "pre") or tag in FENCES:
            groups += 1
            stack.append((tag, element, groups))
        else:
            stack.append((tag, element, stack[-1][2] if stack else 0))
        if not m[2] and (m[4] or "").rstrip().endswith("/"):
            anchors -= tag == "a"
            stack.pop()
    if at < len(source):
        say(source[at:])
    if not numbered:
        out = [e for e in out if e.raw.strip()]
        for k, e in enumerate(out):
            e.number = k + 1
    return out
