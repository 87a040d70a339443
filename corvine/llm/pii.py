"""Personal information in free text, found by a character tagger and replaced by placeholders (problem 10).

Every line of a text is cut into overlapping windows, and the bidirectional LSTM with CRF transitions
tags all their characters.  Where windows overlap, the one with more context around a character
decides, and tags are joined to spans over the whole line.  A span's bounds are the tagger's, set to
word edges; a form of its kind that covers it trims them, and a span without known form stays if it
has what its kind must have (digits, a mail sign, capitals).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvine.llm.tagger import KINDS, Decoder, tag_windows

WINDOW, STRIDE = 160, 112
WEIGHTS = "pii_weights.npz"


def _ranges(wanted) -> str:
    """Characters of the basic plane as the inside of a character class."""
    out: list[list[int]] = []
    for c in range(0x10000):
        if wanted(chr(c)):
            if out and c == out[-1][1] + 1:
                out[-1][1] = c
            else:
                out.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" if a < b else f"\\u{a:04x}" for a, b in out)


UPPER = _ranges(lambda c: c.isupper() or c.istitle())
# letters that have a case, and marks that combine with them; kana and ideographs begin and end words beside them
CASED = _ranges(lambda c: c.isupper() or c.islower() or c.istitle()) + "\\u0300-\\u036f"
WORD = rf"[{UPPER}][{CASED}]*(?:[’'][{CASED}]+)*"
FAMILY = rf"{WORD}(?:-{WORD})*"
# Words in small letters inside a name.
PARTICLES = "(?:(?:van|von|vom|zu|zum|zur|der|den|de|del|della|di|da|do|dos|das|du|la|las|los|le|el|al|bin|ibn|ben|ter|ten|af|av|y|e) ){1,3}"
# Capitalised words of sentences that are no part of a name.
STARTS = (
    "The This That These Those If When Where While Since Unlike After Before Both Most Set Open Check Why Try Note By For With Are Do Not"
    " Der Die Das Den Dem Des Ein Eine Einen Einem Einer Sie Ihr Ihre Er Es Wir Falls Wenn Über Nach Vor Für Mit Und Oder Ändern Prüfen Im Am"
    " Le La Les Un Une Des El Los Las En De Del À A"
).split()
STREETS = r"(?:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Avenue|Ave\.?|Drive|Dr\.?|Court|Ct\.?|Crescent|Blvd\.?|Boulevard|Way|Place|Square|Close|Terrace)(?![^\W\d_])"
SENTENCE = frozenset(STARTS)

DOT, AT = r"(?:\.| ?[\[(]dot[\])] ?| dot )", r"(?:@| ?[\[(]at[\])] ?| at )"
FORMS = {
    "email": re.compile(rf"(?<![A-Za-z0-9_.+-])[A-Za-z0-9](?:[A-Za-z0-9_.+%-]*[A-Za-z0-9_+])?{AT}[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:{DOT}[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+"),
    "phone": re.compile(
        r"(?<![A-Za-z0-9_.+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,5}\) ?)?\d{2,6}(?:[ ./-]\d{2,8}){1,5}(?: ?(?:ext\.?|x) ?\d{1,5})?(?![\w-]*\d)"
        r"|(?<![A-Za-z0-9_.+])\+\d{1,3}(?:[ .-]?\d{1,5}){3,6}(?!\d)|(?<![A-Za-z0-9_.+-])0\d(?: \d\d){4}(?!\d)|(?<![A-Za-z0-9_.+-])0\d{8,11}(?!\d)"
    ),
    "idnum": re.compile(
        r"(?<![\w.-])(?:\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|\d{3}\.\d{3}\.\d{3}-\d{2}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|\d{8}-?[A-Z]|[A-Z]{1,2}\d{7,9})(?![\w-]*\w)"
    ),
    "address": re.compile(
        rf"(?:P\.? ?O\.? )?Box \d+(?:, {WORD})?|(?<![\w.-])\d{{1,4}}[a-z]? (?:bis )?(?:rue|avenue|chemin|boulevard|place|impasse|quai)\b[^\n,|]*(?:, \d{{5}} {WORD})?"
        rf"|(?:Calle|Avenida|Plaza|Paseo|Camino) [^\n,|\d]+\d+(?:, \d\.º [A-Z])?(?:, \d{{5}} {WORD})?"
        rf"|[{UPPER}][^\W\d_]+(?:[ -][{UPPER}]?[^\W\d_]+)?(?:straße|strasse|gasse|weg|allee|platz|ring|damm|ufer) \d+ ?[a-z]?(?:, \d{{5}} {WORD})?"
        rf"|(?<![\w.-])\d{{1,5}}[a-z]? (?:{WORD} ){{1,3}}?{STREETS}(?:, (?:Apt|Unit|Suite|#) ?\d+)?(?:,? {WORD})?(?:,? \d{{5}})?"
    ),
    "name": re.compile(rf"{FAMILY}, {WORD}(?! ?\d)|(?:[{UPPER}]\. ){{1,2}}(?:{PARTICLES})?{FAMILY}|{WORD}(?: [{UPPER}]\.)* (?:{PARTICLES})?{FAMILY}"),
}
TITLE = re.compile(r"(?:(?:Dr|Prof|Mr|Mrs|Ms|Herr|Frau|Sr|Sra|Mme|Don|Doña|Sir|Madame|Monsieur|Señor|Señora)\b\.?\s+)+")
LETTERS = re.compile(r"[^\W\d_]+")
PLACEHOLDER = {"name": "[NAME]", "email": "[EMAIL]", "phone": "[PHONE]", "idnum": "[ID]", "address": "[ADDRESS]"}


@lru_cache(maxsize=2)
def weights(path: str | None = None) -> dict[str, np.ndarray]:
    """The trained parameters that lie beside this module, or those in the file at path."""
    with (open(path, "rb") if path else files(__package__).joinpath(WEIGHTS).open("rb")) as f:
        return {k: v.astype(np.float32) for k, v in np.load(f).items()}


@lru_cache(maxsize=2)
def decoder(path: str | None = None) -> Decoder:
    return Decoder(weights(path))


def cut(line: str) -> list[tuple[int, int]]:
    """Overlapping windows over a line."""
    n = len(line)
    if n <= WINDOW:
        return [(0, n)]
    starts = [*range(0, n - WINDOW, STRIDE), n - WINDOW]
    return [(a, a + WINDOW) for a in starts]


def reconcile(length: int, windows: list[tuple[int, int]], tags: list[np.ndarray]) -> np.ndarray:
    """One tag per character: that of the window in which the character is furthest from an edge."""
    out = np.zeros(length, np.int8)
    best = np.full(length, -1)
    for (a, b), t in zip(windows, tags):
        at = np.arange(b - a)
        margin = np.minimum(at if a else at + WINDOW, (b - a - 1 - at) if b < length else (b - a - 1 - at) + WINDOW)
        better = margin > best[a:b]
        out[a:b] = np.where(better, t, out[a:b])
        best[a:b] = np.where(better, margin, best[a:b])
    return out


def decoded_spans(tags: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the tagged runs; a gap of one character inside a kind does not end it."""
    out: list[list] = []
    for k, t in enumerate(tags.tolist()):
        if t:
            kind = KINDS[(t - 1) // 2]
            if out and out[-1][2] == kind and k - out[-1][1] <= 1 and not (t % 2 and k == out[-1][1]):
                out[-1][1] = k + 1
            else:
                out.append([k, k + 1, kind])
    return [tuple(s) for s in out]


def _shouted(stretch: str, m: re.Match) -> bool:
    """Whether a match in capitals belongs to a line in capitals."""
    if not m[0].isupper():
        return False
    around = LETTERS.findall(stretch[: m.start()])[-1:] + LETTERS.findall(stretch[m.end() :])[:1]
    return "," in m[0] or any(len(w) > 2 and w.isupper() for w in around)


CALENDAR = re.compile(r"(?:19|20)\d\d([-/.])\d\d?\1\d\d?|\d\d?([-/.])\d\d?\2(?:19|20)\d\d")
DECIMAL = re.compile(r"\d\.\d")


def plausible(kind: str, piece: str) -> bool:
    """Whether a piece has what its kind must have; no date is a number of a person, no decimal a house."""
    digits = sum(c.isdigit() for c in piece)
    if kind in ("phone", "idnum") and CALENDAR.fullmatch(piece):
        return False
    if kind == "name":
        words = [w for w in re.split(r"[\s,.’'-]+", piece) if w]
        cased = [w for w in words if w[0].isupper()]
        han = all(w[0].isalpha() and not w[0].isupper() and not w[0].islower() for w in words)
        return not digits and bool(words) and len(piece) <= 60 and (len(cased) >= 2 or (han and 2 <= sum(map(len, words)) <= 8)) and not SENTENCE.issuperset(cased)
    if kind == "email":
        return bool(re.search(rf"{AT}[^\W_].*(?:\.|dot)", piece))
    if kind == "phone":
        return 7 <= digits <= 17 and not re.search(r"[^\d\s+()./x-]", re.sub(r"ext\.?", "x", piece))
    if kind == "idnum":
        return 6 <= digits and len(piece) <= 40 and not re.search(r"[^A-Za-z0-9 ./-]|[a-z]{2}", piece)
    return digits > 0 and sum(c.isalpha() for c in piece) >= 4 and len(piece) >= 8 and not DECIMAL.search(piece)


def bounds(line: str, a: int, b: int, kind: str) -> tuple[int, int]:
    """The tagger's bounds set to word edges, without titles and outer signs."""
    word = lambda k: 0 <= k < len(line) and line[k].isalnum() and (line[k].isascii() or line[k].isupper() or line[k].islower())
    cased = lambda k: 0 <= k < len(line) and (line[k].isupper() or line[k].islower())
    joined = cased if kind == "name" else word
    if a < b and joined(a):
        while joined(a - 1) or (kind == "name" and a > 1 and line[a - 1] in "'’-" and cased(a - 2)):
            a -= 1
    if a < b and joined(b - 1):
        while joined(b) or (kind == "name" and b + 1 < len(line) and line[b] in "'’-" and cased(b + 1)):
            b += 1
    while a < b and not (line[a].isalnum() or (kind == "phone" and line[a] in "+(")):
        a += 1
    while a < b and not (line[b - 1].isalnum() or (kind == "name" and line[b - 1] == "." and b - a > 1 and line[b - 2].isupper())):
        b -= 1
    if kind == "name" and (t := TITLE.match(line, a, b)):
        a = t.end()
    if kind == "email" and line[a : a + 7].lower() == "mailto:":
        a += 7
    return a, b


def checked(line: str, spans: list[tuple[int, int, str]], forms: dict[str, re.Pattern] = FORMS) -> list[tuple[int, int, str]]:
    """Spans with their final bounds; forms: pattern per kind that trims a span it covers for the most part."""
    out: list[tuple[int, int, str]] = []
    for a, b, kind in spans:
        a, b = bounds(line, a, b, kind)
        if b - a < 2:
            continue
        best = None
        if form := forms.get(kind):
            starts = [form.match(line, a)] if kind == "name" else form.finditer(line, max(0, a - 40), min(len(line), b + 40))
            for m in starts:
                if m and (shared := min(b, m.end()) - max(a, m.start())) > 0 and (best is None or shared > best[0]):
                    best = shared, m
            if best and best[0] < 0.6 * max(b - a, len(best[1][0])):
                best = None
        if best:
            a, b = best[1].span()
        piece = line[a:b]
        if kind == "phone" and (form := forms.get("idnum")) and form.fullmatch(piece):
            kind = "idnum"  # grouped as no phone number is
        if kind == "name" and best and (_shouted(line, best[1]) or SENTENCE.issuperset(piece.split())):
            continue
        if plausible(kind, piece + line[b : b + 2] if kind == "address" else piece):
            out.append((a, b, kind))
    order = {k: n for n, k in enumerate(("email", "address", "idnum", "phone", "name"))}
    kept: list[tuple[int, int, str]] = []
    for s in sorted(set(out), key=lambda s: (order[s[2]], s[0] - s[1])):
        if all(s[1] <= o[0] or s[0] >= o[1] for o in kept):
            kept.append(s)
    return sorted(kept)


class Finder:
    """Finds pieces in many texts at once; equal lines are tagged once, up to ``cache`` of them kept."""

    def __init__(self, path: str | None = None, cache: int = 200_000, forms: dict[str, re.Pattern] = FORMS):
        self.decoder, self.known, self.limit, self.forms = decoder(path), {}, cache, forms

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        lines = [t.split("\n") if t else [] for t in texts]
        fresh = list(dict.fromkeys(x for ls in lines for x in ls if x not in self.known and not x.isspace()))
        parts = [(x, w) for x in fresh if x for w in cut(x)]
        tags = tag_windows(self.decoder, [x[a:b] for x, (a, b) in parts])
        by: dict[str, tuple[list, list]] = {x: ([], []) for (x, _), t in zip(parts, tags) if t.any()}
        for (x, w), t in zip(parts, tags):
            if x in by:
                by[x][0].append(w)
                by[x][1].append(t)
        new = {}
        for x, (ws, ts) in by.items():
            if found := checked(x, decoded_spans(reconcile(len(x), ws, ts)), self.forms):
                new[x] = found
        out: list[list[tuple[int, int, str]]] = []
        for ls in lines:
            at, own = 0, []
            for x in ls:
                if found := new.get(x) or self.known.get(x):
                    own += [(at + a, at + b, kind) for a, b, kind in found]
                at += len(x) + 1
            out.append(own)
        if len(self.known) + len(fresh) > self.limit:
            self.known.clear()
        if len(fresh) <= self.limit:
            self.known.update((x, new.get(x)) for x in fresh)
        return out


def finder(path: str | None = None) -> Finder:
    """A finder that knows no lines yet: one a task, so that no run profits from what a worker read in another."""
    return Finder(path)


def replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], PLACEHOLDER[kind]]
        at = b
    return "".join([*out, text[at:]])


def find_pieces(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key, kind, start_pos, end_pos of every piece, in code points from 0.

    Null and empty texts have none; repeated rows are each searched; only the two columns are read.
    Whole texts are searched where they are read: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = finder(path)
        for batch in batches:
            for part in (batch.slice(k, 2000) for k in range(0, batch.num_rows, 2000)):
                keys, texts = (c.to_pylist() for c in part.columns)
                rows = [(key_, kind, a, b) for key_, found in zip(keys, f.find(texts)) for a, b, kind in found]
                cols = list(zip(*rows)) or [()] * 4
                kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, kinds)], names=[key, "kind", "start_pos", "end_pos"]
                )

    return df.select(key, text).mapInArrow(run, f"`{key}` bigint, kind string, start_pos int, end_pos int")


def redact(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key and text of every row with each piece replaced by the placeholder of its kind; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = finder(path)
        for batch in batches:
            for part in (batch.slice(k, 2000) for k in range(0, batch.num_rows, 2000)):
                texts = part.column(1).to_pylist()
                clean = [t if t is None else replaced(t, spans) for t, spans in zip(texts, f.find(texts))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(clean, pa.string())], names=[key, text])

    return df.select(key, text).mapInArrow(run, f"`{key}` bigint, `{text}` string")
