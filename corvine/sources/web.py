"""Sitemaps, pages and Markdown files: readers, extraction and rendering."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.functions.docs import extract_version, output_path

# Where an article is looked for, in order, and what is no part of it.
CONTAINERS = (("main", None), ("article", None), ("div", "content"), ("body", None))
NOISE = frozenset("script style nav header footer aside form noscript svg button".split())
BLOCK = frozenset("p div section article ul ol li table tr pre blockquote h1 h2 h3 h4 h5 h6 br hr dl dt dd".split())


def parse_sitemap(data: str | bytes | None) -> tuple[str, list[tuple[str, str | None]]]:
    """('index' or 'urlset', [(loc, lastmod)]); entries without loc are left out."""
    root = ET.fromstring(data)
    local = lambda tag: tag.rpartition("}")[2]
    out = []
    for item in root:
        fields = {local(x.tag): (x.text or "").strip() for x in item}
        if fields.get("loc"):
            out.append((fields["loc"], fields.get("lastmod") or None))
    return ("index" if local(root.tag) == "sitemapindex" else "urlset"), out


SITEMAP_SCHEMA = "path string, kind string, loc string, lastmod string"


def sitemap_entries(files: DataFrame) -> DataFrame:
    """path, kind, loc, lastmod of files(path, content); unreadable files give nothing."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    kind, items = parse_sitemap(content)
                except (ET.ParseError, TypeError):
                    continue
                rows += [(path, kind, loc, last) for loc, last in items]
            yield pd.DataFrame(rows, columns=["path", "kind", "loc", "lastmod"])

    return files.select("path", "content").mapInPandas(run, SITEMAP_SCHEMA)


def expand_sitemaps(files: DataFrame) -> DataFrame:
    """url, lastmod, version of the pages: url sets that are listed by an index, or that stand alone."""
    entries = sitemap_entries(files)
    listed = entries.filter("kind = 'index'").select(F.col("loc").alias("path")).distinct()
    sets = entries.filter("kind = 'urlset'")
    pages = sets.join(listed, "path", "left_semi") if not listed.isEmpty() else sets
    return pages.select(F.col("loc").alias("url"), "lastmod", extract_version(F.col("loc")).alias("version"))


FRONTMATTER = re.compile(r"^---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)(.*)$", re.S)


def parse_frontmatter(text: str) -> tuple[dict, str]:
    """(header, trimmed body); an error without a well-formed header."""
    m = FRONTMATTER.match(text)
    if not m:
        raise ValueError("missing frontmatter")
    head = yaml.safe_load(m[1]) or {}
    if not isinstance(head, dict):
        raise ValueError("malformed frontmatter")
    return head, m[2].strip()


MARKDOWN_SCHEMA = "path string, url string, title string, product string, version string, breadcrumbs array<string>, last_modified string, body string, error string"


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Every *.md file below folder, any case of the extension, with its header fields; bad headers carry an error."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.[mM][dD]").select(F.col("_metadata.file_path").alias("path"), "value")

    def run(batches):
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["value"]):
                try:
                    h, body = parse_frontmatter(text)
                    s = lambda k, h=h: None if h.get(k) is None else str(h[k])
                    rows.append((path, s("url"), s("title"), s("product"), s("version"), [str(x) for x in h.get("breadcrumbs") or []], s("last_modified"), body, None))
                except (ValueError, yaml.YAMLError) as e:
                    rows.append((path, None, None, None, None, None, None, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MARKDOWN_SCHEMA.split(", ")])

    return files.mapInPandas(run, MARKDOWN_SCHEMA)


class _Article(HTMLParser):
    """Markdown of the first container found, without noise."""

    def __init__(self, base: str, container: tuple[str, str | None] | None):
        super().__init__(convert_charrefs=True)
        self.base, self.container = base, container
        self.depth = 0 if container else 1
        self.skip, self.out, self.pre, self.lists, self.href = 0, [], 0, [], []
        self.title, self.h1, self.in_title, self.level = "", "", False, 0
        self.found = container is None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        self.in_title = self.in_title or tag == "title"
        if self.depth == 0:
            name, cls = self.container
            if not self.found and tag == name and (cls is None or cls in (a.get("class") or "")):
                self.depth, self.found = 1, True
            return
        if tag == self.container[0] if self.container else False:
            self.depth += 1
        if tag in NOISE:
            self.skip += 1
        if self.skip:
            return
        if tag[0] == "h" and tag[1:].isdigit():
            self.level = int(tag[1])
            self.out.append("\n\n" + "#" * self.level + " ")
        elif tag == "pre":
            lang = re.sub(r"^.*?(?:language-|lang-)?([a-z0-9]*)$", r"\1", (a.get("class") or "").split(" ")[-1])
            self.pre += 1
            self.out.append(f"\n\n```{lang}\n")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "li":
            if self.lists:
                self.lists[-1][1] += 1
            mark = f"{self.lists[-1][1]}." if self.lists and self.lists[-1][0] == "ol" else "-"
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + mark + " ")
        elif tag == "a":
            self.href.append(a.get("href"))
            self.out.append("[" if a.get("href") else "")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "br":
            self.out.append("\n")
        elif tag in ("td", "th"):
            self.out.append("| ")
        elif tag in BLOCK:
            self.out.append("\n\n" if tag != "tr" else "\n")

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if self.depth == 0:
            return
        if tag in NOISE and self.skip:
            self.skip -= 1
            return
        if self.skip:
            return
        if self.container and tag == self.container[0]:
            self.depth -= 1
        if tag[0] == "h" and tag[1:].isdigit():
            self.level = 0
            self.out.append("\n\n")
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.out.append("\n```\n\n")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.out.append("\n")
        elif tag == "a" and self.href:
            if h := self.href.pop():
                self.out.append(f"]({urljoin(self.base, h)})")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in ("td", "th"):
            self.out.append(" ")
        elif tag == "p":
            self.out.append("\n\n")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        if self.depth == 0 or self.skip:
            return
        if self.level == 1:
            self.h1 += data
        self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def html_to_markdown(source: str, base: str = "") -> tuple[str, str]:
    """(title, markdown) of a page: the first container that exists, headings as #, lists, fenced code, absolute links."""
    for container in (*CONTAINERS, None):
        p = _Article(base, container)
        p.feed(source)
        p.close()
        if p.found:
            text = re.sub(r"[ \t]+\n", "\n", "".join(p.out))
            return (p.h1.strip() or p.title.strip()), re.sub(r"\n{3,}", "\n\n", text).strip()
    return "", ""


def extract_articles(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, title, markdown of pages(key, url, content_html); null markup gives nulls."""

    def run(batches):
        for pdf in batches:
            done = [html_to_markdown(s, u or "") if s else (None, None) for s, u in zip(pdf["content_html"], pdf["url"])]
            yield pd.DataFrame({key: pdf[key], "title": [t for t, _ in done], "markdown": [m for _, m in done]})

    return pages.select(key, "url", "content_html").mapInPandas(run, f"`{key}` bigint, title string, markdown string")


def render_document(url, title, product, version, breadcrumbs, last_modified, content_hash, fetched_at, body: str) -> str:
    """A Markdown file: header of eight fields and the body."""
    head = {
        "url": url, "title": title, "product": product, "version": version, "breadcrumbs": list(breadcrumbs or []), "last_modified": last_modified,
        "content_hash": content_hash, "fetched_at": fetched_at,
    }
    return "---\n" + yaml.safe_dump(head, sort_keys=False, allow_unicode=True) + "---\n\n" + body + "\n"


def write_markdown(docs: DataFrame, folder: str) -> DataFrame:
    """path and bytes of the files written below folder, one per document(url, title, product, version, body ...).

    folder is a URI of a filesystem that all machines share (hdfs, s3, gs, file of a mounted share); a plain
    path is taken only by a local session.  A file is written whole or not at all: to a name of its own,
    then moved, so that a task that runs again replaces it.
    """
    if "://" not in folder:
        if not docs.sparkSession.sparkContext.master.startswith("local"):
            raise ValueError("folder must be a URI of a shared filesystem")
        folder = "file://" + folder
    keyed = docs.withColumn("path", output_path(F.col("url"), F.col("product"), F.coalesce("version", F.lit(""))))

    def run(batches):
        import uuid

        from pyarrow import fs

        share, base = fs.FileSystem.from_uri(folder)
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                text = render_document(r["url"], r.get("title"), r["product"], r.get("version"), r.get("breadcrumbs"), r.get("last_modified"), r.get("content_hash"), r.get("fetched_at"), r["body"])
                full = f"{base.rstrip('/')}/{r['path']}"
                share.create_dir(full.rpartition("/")[0], recursive=True)
                part = f"{full}.{uuid.uuid4().hex}"
                with share.open_output_stream(part) as f:
                    f.write(text.encode())
                share.move(part, full)
                rows.append((r["path"], len(text.encode())))
            yield pd.DataFrame(rows, columns=["path", "bytes"])

    return keyed.mapInPandas(run, "path string, bytes bigint")


STREAMED = re.compile(r'self\.__next_f\.push\(\[1,\s*("(?:[^"\\]|\\.)*")\]\)', re.S)


def streamed_text(source: str) -> str:
    """Text of the JSON chunks that a streamed component page pushes from its script tags."""
    return "".join(json.loads(m[1]) for m in STREAMED.finditer(source))


def nav_breadcrumbs(tree: list[dict], path: str) -> list[str]:
    """Titles from the root to the node of that path in a tree of {title, path, children}; the path in words if absent."""
    stack = [(n, [n.get("title", "")]) for n in reversed(tree)]
    while stack:
        node, trail = stack.pop()
        if node.get("path") == path:
            return trail
        stack += [(c, [*trail, c.get("title", "")]) for c in reversed(node.get("children") or [])]
    return [w.replace("-", " ").replace("_", " ").capitalize() for w in path.strip("/").split("/") if w]


def camel_label(name: str) -> str:
    """'SplitButton' -> 'Split Button'."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", name)


def stale_files(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Paths on disk that no state row expects; the caller decides whether to remove them."""
    return files.select("path").join(expected.select(F.col("file_path").alias("path")).distinct(), "path", "left_anti")
