import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvine.functions import analyzers, docs
from corvine.operators import chunking, upsert
from corvine.plans import search, tools
from corvine.sources import web
from corvine.streaming import ingest


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def test_versions_and_urls(spark):
    L = F.lit
    assert one(spark, docs.parse_version(L("10.2"))) == [10, 2] and one(spark, docs.parse_version(L("10"))) is None
    assert one(spark, docs.compare_versions(L("9.4"), L("10.0"))) == -1
    assert one(spark, docs.extract_version(L("https://h/en/p/10.4.1-topic/x"))) == "10.4.1"
    assert one(spark, docs.path_version(L("p/m/9.0.1/x"))) == "9.0.1" and one(spark, docs.path_product(L("9.0/x"))) == ""
    assert one(spark, docs.url_product(L("https://h.example/en/p/x"))) == "p" and one(spark, docs.url_product(L("https://d.example/x"), {"d.example": "q"})) == "q"
    loc = docs.doc_location(L("https://h.example/en/prod/guide/9.1/topic/Page"), L("prod"), L("9.1"))
    assert tuple(one(spark, loc)) == ("guide", "prod/guide/topic/page")
    assert tuple(one(spark, docs.doc_location(L("https://h.example/"), L("p"), L("")))) == ("", "")
    assert one(spark, docs.url_aliases(L("https://h.example/en/p/g/9.0/Foo-Bar"), L("p"))) == ["path:pgfoobar", "slug:foobar"]
    assert one(spark, docs.url_aliases(L("https://h.example/d?resourceId=p_foo_Bar-1"), L("p"))) == ["slug:bar1"]
    assert one(spark, docs.anchor_slug(L(""))) == "overview" and one(spark, docs.anchor_slug(L("??"))) == "section" and one(spark, docs.anchor_slug(L("A b!"))) == "a-b"
    assert one(spark, docs.citation_url(L("u"), L("overview"))) == "u" and one(spark, docs.section_key(L("k#a"), L("H"))) == "a"
    assert one(spark, docs.source_updated(L("null"))) is None and one(spark, docs.source_updated(L("2024-01-02"))) is not None
    assert one(spark, docs.output_path(L("https://h/en/p/9.0/"), L("p"), L("9.0"))) == "p/9.0/index.md"
    df = spark.createDataFrame([("https://h.example/en/prod/guide/9.1/topic/Page", "9.1"), (None, "")], "url string, version string")
    assert docs.with_location(df, F.col("version")).filter("url is not null").first()["loc_canonical"] == "prod/guide/topic/page"


def test_query_text():
    cases = {
        "what does max_mem_usage_mb do": ["max_mem_usage_mb"], "set limits.conf maxKBps": ["limits.conf"], "props.conf TRANSFORMS-null stanza": ["props.conf", "TRANSFORMS-null"],
        "index::main filtering": ["index::main"], "/services/data/indexes endpoint": ["/services/data/indexes"], "how do I use tstats and stats": ["tstats", "stats"],
        "how does indexer clustering work": [], "": [], "source::/var/log Eval LOOKUP where _1x": ["source::/var/log", "Eval", "LOOKUP", "where", "_1x"],
        "SSL-0001 AB-1 a-b .x / x. _ well-known": ["SSL-0001"],
    }
    assert {q: docs.identifier_tokens(q) for q in cases} == cases
    assert docs.identifier_tokens('find "props.conf" _time sourcetype::x, | tstats TSTATS /opt/x ERR-12_a plain') == ["props.conf", "_time", "sourcetype::x", "tstats", "/opt/x", "ERR-12_a"]
    assert docs.or_query("a b") == "a OR b" and docs.or_query("a") == "a"
    assert docs.merge_filters(" b ", ["a", "", "b"]) == ["a", "b"]
    assert docs.leg_weights("auto", False)[2] == 0.3 and search.parse_web_query("a OR b c") == [["a", "b"], ["c"]]


def test_stems():
    words = {"caresses": "caress", "ponies": "poni", "hopping": "hop", "relational": "relat", "conflated": "conflat", "happy": "happi", "adjustment": "adjust", "rate": "rate", "controlling": "control"}
    assert {w: analyzers.stem(w) for w in words} == words
    assert analyzers.english_lexemes("The Searches are running") == ["search", "run"]


def test_chunks():
    body = "# Title\n\nintro\n\n## A\n```\n## no\n```\n### B  \n\n## C\ntext\n#### deep"
    assert chunking.split_chunks(body) == [("", 0, "intro"), ("A", 2, "```\n## no\n```"), ("C", 2, "text\n#### deep")]
    assert chunking.split_chunks("") == [] and chunking.split_chunks("a\n# T\nb\n# U") == [("", 0, "a\nb")]


def test_diff():
    old, new = "a\nb\nc\nd\ne\nf\ng", "a\nb\nc\nd\nE\nf\ng"
    assert tools.line_diff(old, new) == "@@ 2 unchanged line(s) @@\n c\n d\n-e\n+E\n f\n g"
    assert tools.line_diff(old, old) == ""
    assert tools.line_diff("x\n" * 401 + "a", "x\n" * 401 + "b") == ""
    assert tools.line_diff("x\n" * 399 + "x", "x\n" * 401 + "b") == "@@ 398 unchanged line(s) @@\n x\n x\n+[section truncated for diff]"
    assert tools.line_diff("alpha\nbeta\ngamma\n", "alpha\ndelta\ngamma\n", 1) == " alpha\n-beta\n+delta\n gamma\n@@ 1 unchanged line(s) @@"


@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_line_diff_is_shortest(old, new):
    """Applying the edit gives the new text, and no common subsequence is longer than the kept lines."""
    got = tools.line_diff("\n".join(old), "\n".join(new), context=50).split("\n")
    old, new = (x or [""] for x in (old, new))
    if old == new:
        assert got == [""]
        return
    assert [s[1:] for s in got if s[0] != "+"] == old and [s[1:] for s in got if s[0] != "-"] == new
    best = [[0] * (len(new) + 1) for _ in range(len(old) + 1)]
    for i, x in enumerate(old):
        for j, y in enumerate(new):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert sum(s[0] == " " for s in got) == best[-1][-1]


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "url string, v int")
    new = spark.createDataFrame([("b", 3), ("b", 4), ("c", 5)], "url string, v int")
    assert {tuple(r) for r in upsert.upsert(old, new, ["url"], F.col("v").desc()).collect()} == {("a", 1), ("b", 4), ("c", 5)}
    docs_ = spark.createDataFrame([("u1", "p"), ("u2", "p"), ("u3", "q")], "url string, product string")
    live = spark.createDataFrame([("u1", "p")], "url string, product string")
    assert {r[0] for r in upsert.prune(docs_, live).select("url").collect()} == {"u1", "u3"}
    assert upsert.prune(docs_, live, failures=1).count() == 3 and upsert.prune(docs_, live.limit(0)).count() == 3
    rows = spark.createDataFrame([("p", v) for v in ("9.0.1", "9.0.2", "9.1", "9.1.3", "", None)], "product string, version string")
    assert {r["version"] for r in upsert.latest_patches(rows).collect()} == {"9.0.2", "9.1", "9.1.3", "", None}
    parsed = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "url string, hash string")
    state = spark.createDataFrame([("a", "1", True), ("b", "x", True), ("c", "3", False)], "url string, hash string, meta_ok boolean")
    assert {r["url"]: r["outcome"] for r in upsert.outcomes(parsed, state).collect()} == {"a": "unchanged", "b": "embed", "c": "backfill", "d": "embed"}


@pytest.fixture(scope="module")
def corpus(spark):
    t = dt.datetime(2024, 1, 1)
    d = [(1, "https://h/en/p/m/9.0/x", "Tune queue", "p", "9.0", "m", "p/m/x", "P > M", t, t), (2, "https://h/en/p/m/10.0/x", "Tune queue", "p", "10.0", "m", "p/m/x", None, t, t), (3, "https://h/en/q/n/y", "Other", "q", "", "n", "q/n/y", "", None, t)]
    c = [(10, 1, 0, "k1#overview", "overview", None, 0, "The queue limit max_queue_kb is small.", None), (11, 1, 1, "k1#a", "a", "A", 2, "old text", [1.0, 0.0]), (20, 2, 0, "k2#overview", "overview", "", 0, "The queue limit max_queue_kb is large.", [0.0, 0.0]),
         (21, 2, 1, "k2#b", "b", "B", 3, "new text", [0.9, 0.1]), (30, 3, 0, None, None, "Queue", 2, "nothing here", [1.0, 0.1])]
    docs_ = spark.createDataFrame(d, "doc_id bigint, url string, title string, product string, version string, manual string, canonical_id string, breadcrumb string, source_updated_at timestamp, updated_at timestamp")
    chunks = spark.createDataFrame(c, "id bigint, document_id bigint, chunk_index int, section_id string, anchor string, heading string, heading_level smallint, content string, embedding array<float>")
    return docs_, chunks


def test_search(corpus):
    d, c = corpus
    found = search.search(c, d, search.SearchArgs("queue max_queue_kb", query_vector=[1.0, 0.0])).collect()
    ids = [r["id"] for r in found]
    assert ids[0] in (10, 20) and set(found[0]["match_types"]) >= {"keyword", "identifier"} and "**max_queue_kb**" in found[0]["snippet"]
    latest = search.search(c, d, search.SearchArgs("queue limit", latest_only=True)).collect()
    assert 20 in [r["id"] for r in latest] and 10 not in [r["id"] for r in latest]
    assert search.search(c, d, search.SearchArgs("queue", product="q")).count() == 1
    assert search.search(c, d, search.SearchArgs("   ")).count() == 0
    with pytest.raises(ValueError, match="unknown product"):
        search.search(c, d, search.SearchArgs("queue", product="zz"))


def test_tools(corpus):
    d, c = corpus
    page = {r["doc_id"]: r["page"] for r in tools.pages(c, d).collect()}
    assert page[1] == "# Tune queue\nP > M\n\nThe queue limit max_queue_kb is small.\n\n## A\nold text\n"
    got = {(r["section_key"], r["status"]) for r in tools.compare_documents(c, tools.version_pairs(d)).collect()}
    assert got == {("", "modified"), ("a", "removed"), ("b", "added")}
    s = tools.get_section(c, d, "k1#a", before=9).first()
    assert [x["content"] for x in s["before"]] == ["The queue limit max_queue_kb is small."] and s["after"] == []
    sets = {r["product"]: r for r in tools.docsets(d).collect()}
    assert sets["p"]["latest"] == "10.0" and sets["p"]["pages"] == 2
    wanted = d.sparkSession.createDataFrame([("https://h/en/p/m/x", ["path:pmx", "slug:x"]), ("https://h/en/q/n/y", []), ("https://none", ["slug:zzz"])], "url string, tries array<string>")
    assert {r["url"]: r["resolved_id"] for r in tools.resolve(wanted, d).collect()} == {"https://h/en/p/m/x": 2, "https://h/en/q/n/y": 3, "https://none": None}


def test_sources(spark, tmp_path):
    kind, items = web.parse_sitemap("<urlset xmlns='x'><url><loc> u1 </loc><lastmod>2024</lastmod></url><url><lastmod>1</lastmod></url></urlset>")
    assert kind == "urlset" and items == [("u1", "2024")]
    files = spark.createDataFrame([("i", "<sitemapindex><sitemap><loc>s1</loc></sitemap></sitemapindex>"), ("s1", "<urlset><url><loc>https://h/9.1/x</loc></url></urlset>"), ("s2", "<urlset><url><loc>z</loc></url></urlset>"), ("bad", "<x")], "path string, content string")
    assert [r["url"] for r in web.expand_sitemaps(files).collect()] == ["https://h/9.1/x"]
    title, md = web.html_to_markdown("<html><title>T</title><body><nav>no</nav><main><h1>H</h1><p>a <b>b</b> <a href='x'>l</a></p><ul><li>one<li>two</ul><pre class='language-py'>x = 1</pre></main></body></html>", "https://h/d/")
    assert title == "H" and "# H" in md and "[l](https://h/d/x)" in md and "- one" in md and "```py\nx = 1\n```" in md and "no" not in md.split()
    docs_ = spark.createDataFrame([("https://h/en/p/9.0/a/b", "T", "p", "9.0", "## S\nbody")], "url string, title string, product string, version string, body string")
    assert web.write_markdown(docs_, str(tmp_path)).first()["path"] == "p/9.0/a/b.md"
    (tmp_path / "bad.MD").write_text("no header")
    back = {r["error"]: r for r in web.read_markdown(spark, str(tmp_path)).collect()}
    assert back[None]["title"] == "T" and back[None]["body"] == "## S\nbody" and "missing frontmatter" in back
    assert web.nav_breadcrumbs([{"title": "A", "path": "a", "children": [{"title": "B", "path": "a/b"}]}], "a/b") == ["A", "B"] and web.camel_label("SplitButtonAPI") == "Split Button API"
    assert web.streamed_text('<script>self.__next_f.push([1,"a\\n"])</script><script>self.__next_f.push([1,"b"])</script>') == "a\nb"


def test_streaming_ingest(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "a.md").write_text("---\nurl: https://h/a\n---\nintro\n\n## S\ntext\n")
    for _ in range(2):  # a second start finds nothing new
        q = ingest.start_ingest(ingest.markdown_stream(spark, str(src)), str(out), str(tmp_path / "ck"))
        q.awaitTermination(60)
    rows = spark.read.parquet(str(out)).collect()
    assert sorted(r["anchor"] for r in rows) == ["overview", "s"] and {r["url"] for r in rows} == {"https://h/a"}
    (src / "b.md").write_text("---\nurl: https://h/a\n---\nintro\n\n## T\nother text\n")
    ingest.start_ingest(ingest.markdown_stream(spark, str(src)), str(out), str(tmp_path / "ck")).awaitTermination(60)
    assert sorted(r["anchor"] for r in ingest.current_sections(spark, str(out)).collect()) == ["overview", "t"]
