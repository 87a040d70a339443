"""Lines, fences and blocks of Markdown text, shared by the splitting, repetition and markup operators."""

from __future__ import annotations

import re

FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$", re.S)
HEADING = re.compile(r"#{1,6}[ \t]")


def lines_of(text: str) -> list[tuple[int, str]]:
    """(offset, line) of each line; lines end in \\n, and a \\r before it belongs to the line end."""
    out, at = [], 0
    for raw in text.split("\n"):
        out.append((at, raw[:-1] if raw.endswith("\r") else raw))
        at += len(raw) + 1
    return out


def fenced(lines: list[tuple[int, str]] | list[str]) -> list[int]:
    """Per line: 0 outside fences, 1 at the opening fence, 2 inside, 3 at the closing fence."""
    state, out = None, []
    for item in lines:
        line = item[1] if isinstance(item, tuple) else item
        if state is None:
            m = FENCE.match(line) if "```" in line or "~~~" in line else None
            if m and not (m[1][0] == "`" and "`" in m[2]):
                state = m[1]
                out.append(1)
            else:
                out.append(0)
            continue
        m = FENCE.match(line) if state[0] in line else None
        if m and m[1][0] == state[0] and len(m[1]) >= len(state) and not m[2].strip():
            state = None
            out.append(3)
        else:
            out.append(2)
    return out


def block_starts(text: str) -> list[int]:
    """Offset of the line at which each block starts: fenced code, heading lines, and runs of other lines."""
    lines = lines_of(text)
    out, fresh = [], True
    for (at, line), f in zip(lines, fenced(lines)):
        if f == 1:
            out.append(at)
        elif f == 3:
            fresh = True
        elif f == 0:
            if HEADING.match(line):
                out.append(at)
                fresh = True
            elif not line.strip():
                fresh = True
            elif fresh:
                out.append(at)
                fresh = False
    return out
