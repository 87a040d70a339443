"""Operators for training data against brute force, round trips and small cases."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvine.llm import blocks, htmltree, mainbody, markup, mixing, neighbours, pii, repetition, splitting, tagger, tokens

LONG = "word " * 60_000


# 1 similar vectors


def brute(rows, k, least):
    out = set()
    ok = [(i, np.asarray(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for i, v in ok:
        near = sorted((-float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), j) for j, w in ok if j != i)
        out |= {(i, j) for s, j in near[:k] if -s >= least}
    return out


def test_similar_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 4))
    rows = [(i, [float(x) for x in base[i % 40] + rng.normal(size=4) * 0.05]) for i in range(300)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(30)]  # a group of copies
    rows += [(2000, None), (2001, [0.0] * 4), (2002, [1.0, 2.0]), (2003, [1.0, None, 1.0, 1.0]), (2004, [float("nan")] * 4), (None, [1.0] * 4)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "id bigint, embedding array<float>, a string")
    got = neighbours.similar_pairs(df, dim=4, k=5, least=0.9, options=neighbours.ForestOptions(leaf=60)).collect()
    want = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 5, 0.9)
    have = {(r["a"], r["b"]) for r in got}
    assert len(have & want) >= 0.97 * len(want)
    assert all(r["similarity"] >= 0.9 for r in got) and max(r["place"] for r in got) <= 5
    copies = {(a, b) for a, b in have if a >= 1000}
    assert (1000, 1001) in copies and (1029, 1000) in copies and len(copies) == 30 * 5


def test_similar_pairs_of_repeated_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [1.0, float(x), float(y), 0.0]) for i, (x, y) in enumerate(rng.normal(size=(60, 2)))]
    df = spark.createDataFrame(rows * 12, "id bigint, embedding array<float>")
    got = {(r["a"], r["b"]) for r in neighbours.similar_pairs(df, dim=4, k=10, least=0.5).collect()}
    want = brute([(i, [float(np.float32(x)) for x in v]) for i, v in rows], 10, 0.5)
    assert len(got & want) >= 0.99 * len(want) and len(got) <= len(rows) * 10


def test_similar_pairs_of_little(spark):
    schema = "id bigint, embedding array<float>"
    assert neighbours.similar_pairs(spark.createDataFrame([], schema), dim=4).count() == 0
    assert neighbours.similar_pairs(spark.createDataFrame([(1, [1.0] * 4)], schema), dim=4).count() == 0
    two = spark.createDataFrame([(1, [1.0] * 4), (2, [2.0] * 4), (2, [2.0] * 4)], schema)
    assert {(r["a"], r["b"]) for r in neighbours.similar_pairs(two, dim=4).collect()} == {(1, 2), (2, 1)}


# 2 main body

PAGE = """<div><p data-node="1">We use cookies to keep the session alive.</p><button data-node="2">OK</button></div><ul><li data-node="3"><a href="/home">Home</a>
<li data-node="4"><a href="/docs">Docs</a></li></ul><article><H1 data-node="5">Tune the queue</H1><p data-node="6">The queue holds 200 events and drops the rest.
<p data-node="7" class="footer-settings">To hide the footer, set field_cap to 0.</p><h4 data-node="8">Related topics</h4><ul><li data-node="9"><a href="/x">Other page</a></li><li data-node="10">Next page</li></ul>
<pre data-node="11">a = 1 &lt; 2</pre><table><tr><td data-node="12">field_cap</td><td data-node="13">7</td></tr></table><p data-node="14">Was this page helpful?</p></article><p data-node="15">Copyright 2023 the group.</p>"""


def test_main_body():
    e = htmltree.read(PAGE)
    assert [x.number for x in e] == list(range(1, 16)) and e[10].text == "a = 1 < 2"
    asked = {mainbody.text_key("Was this page helpful?"), mainbody.text_key("copyright 1999 the group.")}
    assert [x.number for x in mainbody.body_elements(e, asked)] == [5, 6, 7, 11, 12, 13]
    assert mainbody.body_elements(htmltree.read('<ul><li data-node="1"><a href="/a">A</a></ul><p data-node="2">Loading content, please wait.</p>')) == []
    assert mainbody.trail_places(["Menu", " Quarry Core ", "", None, "Admin Guide", "Raw Events", "Tune it"], "https://h/en/quarry-core/admin-guide/9.1/raw-events/tune-it-3f", "Tune it") == [1, 4, 5, 6]


def numbers(source):
    return [e.number for e in mainbody.body_elements(htmltree.read(source))]


def test_main_body_ends_at_the_dive():
    body = "".join(f'<p data-node="{n}">Paragraph {n} tells how the queue drains its events and what it keeps.</p>' for n in range(4, 10))
    foot = '<div><p data-node="10">A text at the foot of each page in a wording of its own, which no rule knows.</p></div>'
    side = '<div><p data-node="3">Words at the side about a fair in the town hall, again in no known wording.</p></div>'
    assert numbers(f'<article><h1 data-node="1">Tune it</h1>{body}</article>{foot}') == [1, *range(4, 10)]
    assert numbers(f'<div><h1 data-node="1">The site</h1></div>{side}<article><h1 data-node="2">Tune the queue</h1>{body}</article>{foot}') == [2, *range(4, 10)]
    assert numbers(f'<div><h1 data-node="1">Tune it</h1></div>{side}<article>{body}</article>{foot}') == [1, *range(4, 10)]
    gap = "".join(f'<button data-node="{n}">Yes</button>' for n in range(10, 14))
    assert numbers(f'<article><h1 data-node="1">Tune it</h1>{body}</article>{gap}<p data-node="14">Odds and ends</p>') == [1, *range(4, 10)]


def test_main_body_in_other_languages():
    """Surge and dive need no wording: a banner, menu, newsletter and imprint in German and in Polish stay out."""
    for banner, title, one, two, news, imprint in (
        ("Wir verwenden Cookies, um Ihre Sitzung zu speichern und Besuche zu zählen.", "Speicher einrichten", "Der Dienst verarbeitet täglich 300 Ereignisse.",
         "Danach wird der Knoten neu gestartet.", "Unser Rundbrief bringt jede Woche einen Tipp, jederzeit abbestellbar.", "Impressum: Angaben nach Paragraf fünf, alle Rechte vorbehalten."),
        ("Używamy plików cookie, aby zapisać sesję i policzyć wizyty na stronie.", "Konfiguracja kolejki", "Usługa przetwarza codziennie trzysta zdarzeń.",
         "Potem węzeł jest uruchamiany ponownie.", "Nasz biuletyn przynosi co tydzień jedną wskazówkę, bez konta.", "Dane firmy: wszystkie prawa zastrzeżone przez wydawcę strony."),
    ):
        assert numbers(
            f'<body><div><p data-node="1">{banner}</p><button data-node="2">OK</button></div><nav><a data-node="3" href="/">Start</a></nav><main><h1 data-node="4">{title}</h1>'
            f'<p data-node="5">{one}</p><p data-node="6">{two}</p></main><footer><p data-node="7">{news}</p><p data-node="8">{imprint}</p></footer></body>'
        ) == [4, 5, 6]


def test_windows_decide_the_body(monkeypatch):
    """With one stretch over the whole page instead of surges and dives, banner, trail and foot come in."""
    source = (
        '<div><p data-node="1">A banner of this site in words of its own, about files kept on a device.</p></div><div><span data-node="2">Menu</span></div>'
        '<article><h1 data-node="3">Tune the queue</h1><p data-node="4">The queue holds 200 events.</p></article><div><p data-node="5">A line at the foot.</p></div>'
    )
    assert numbers(source) == [3, 4]
    monkeypatch.setattr(mainbody, "stretches", lambda weight, gap: [(0, len(weight) - 1)])
    assert numbers(source) == [1, 2, 3, 4, 5]


def test_repeated_texts_count_pages_once(spark):
    page = lambda n: f"<h1>Page {n}</h1><p>The body of page {chr(64 + n) * 3} is told in a sentence of its own.</p><p>The same sentence stands on each of these pages.</p>"
    rows = [(i, "https://h/9.1/hot", page(0)) for i in range(20)] + [(50 + i, "https://h/9.2/hot", page(0)) for i in range(20)]
    rows += [(100 + n, f"https://h/u{n}", page(n)) for n in range(1, 21)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, content_html string").withColumns({"title": F.lit("t"), "breadcrumbs": F.array(F.lit("x"))})

    def found(pages):
        lines = mainbody.parsed(pages).withColumn("row", F.monotonically_increasing_id())
        page = F.coalesce(F.xxhash64(F.regexp_replace("url", "/9[.][12]", "")), F.col("row"))
        return {(r["host"], r["k"]) for r in mainbody.repeated_texts(lines.select("row", F.lit("h").alias("host"), page.alias("page"), "key")).collect()}

    key = mainbody.text_key("The same sentence stands on each of these pages.")
    assert found(df) == {(None, key), ("h", key)}
    assert found(df.limit(0)) == set()
    bodies = {r["page_id"]: r["body_text"].split("\n")[1:] for r in mainbody.main_content(df).collect()}
    assert bodies[101] == ["The body of page AAA is told in a sentence of its own."] and len(bodies[0]) == 1


def test_texts_on_one_page_of_each_of_many_sites(spark):
    """A sentence that stands once on every site is repeated over all pages, though on no site."""
    rows = [(h, f"https://h{h}/a", f"<h1>Page {h}</h1><p>The body of site {chr(97 + h) * 3} is told in a sentence of its own.</p><p>One sentence for all the sites there are.</p>") for h in range(8)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, content_html string").withColumns({"title": F.lit("t"), "breadcrumbs": F.array(F.lit("x"))})
    lines = mainbody.parsed(df).select(F.regexp_extract("url", "//(h.)", 1).alias("host"), F.xxhash64("url").alias("page"), "key")
    assert [(r["host"], r["k"]) for r in mainbody.repeated_texts(lines).collect()] == [(None, mainbody.text_key("One sentence for all the sites there are."))]
    bodies = {r["page_id"]: r["body_text"].split("\n")[1:] for r in mainbody.main_content(df).collect()}
    assert bodies == {h: [f"The body of site {chr(97 + h) * 3} is told in a sentence of its own."] for h in range(8)}


def test_main_body_tables(spark):
    rows = [(1, "u", "t", ["x"], PAGE, 1), (1, "u", "t", ["x"], PAGE, 1), (2, None, None, None, None, 1), (3, "u", "t", [], "", 1), (4, "u", "t", ["x"], "<p>" + LONG, 1), (5, "u", "t", None, "<<<div <p", 1)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, title string, breadcrumbs array<string>, content_html string, body_nodes int")
    got = sorted((r["page_id"], r["body_nodes"]) for r in mainbody.main_content(df).collect())
    assert got[:2] == [(1, [5, 6, 7, 11, 12, 13, 14])] * 2 and [p for p, _ in got] == [1, 1, 2, 3, 4, 5]
    assert mainbody.main_content(df.limit(0)).count() == 0


# 3 splitting


def test_blocks():
    text = "intro\nmore\r\n\r\n# Head\nbody\n```py\n# no head\n\n~~~\n````\nafter\n~~~~\nopen\n"
    assert [text[a : a + 6] for a in blocks.block_starts(text)] == ["intro\n", "# Head", "body\n`", "```py\n", "after\n", "~~~~\no"]
    assert blocks.block_starts("") == [] and blocks.block_starts("\n \n") == []


@settings(max_examples=120, deadline=None)
@given(st.text(alphabet="ab \n#`.", max_size=400), st.integers(10, 60), st.integers(0, 8))
def test_pieces_cover_the_text(text, limit, overlap):
    (pieces,) = splitting.pieces_of([text], limit, overlap)
    if not text:
        assert pieces == []
        return
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(0 < b - a <= limit for a, b in pieces)
    assert all(b - c == min(overlap, b) for (_, b), (c, _) in zip(pieces, pieces[1:]))
    # greedy brute force over the same boundaries
    marks, at, cuts = splitting.boundaries(text, limit, overlap), 0, [0]
    while at < len(text):
        room = limit if at == 0 else limit - overlap
        at = max(m for m in marks if at < m <= at + room)
        cuts.append(at)
    assert [b for _, b in pieces] == cuts[1:]


def test_split_tables(spark):
    rows = [(1, None, None, None), (2, "", "h", 2), (3, "x" * 5000, "h", 3), (3, "x" * 5000, "h", 3), (4, "short", None, 0), (5, LONG, "", 2)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "id bigint, content string, heading string, heading_level smallint, piece_no int")
    got = splitting.split_sections(df).collect()
    assert all(len(r["piece"]) <= 2000 for r in got) and {r["id"] for r in got} == {3, 4, 5}
    assert sum(r["id"] == 3 for r in got) == 2 * 3 and splitting.split_sections(df.limit(0)).count() == 0


# 4 repeated lines


def test_mask():
    assert repetition.mask_line("**Page 12\xa0 of 9:** ") == "page 0 of 0" and repetition.mask_line(" --- ") == "" and repetition.mask_line("_x_") == "x"


def test_repeated_lines_equal_brute_force(spark):
    rng = random.Random(5)
    docs = [(d, "p" if d < 40 else "q" if d < 48 else None) for d in range(60)]
    chunks = []
    for i in range(150):
        d = rng.randrange(60)
        lines = [f"Read time: {rng.randrange(90)} min" if rng.random() < 0.3 else f"own line {i} {rng.random()}", "```\nRead time: 3 min\n```", rng.choice(["© All rights", "", "rare"])]
        chunks.append((i, d if i % 17 else None, "\n".join(lines) if i % 13 else None))
    chunks += [(500, 1, LONG), (501, 1, "")]
    cd = spark.createDataFrame([(*c, "x") for c in chunks], "id bigint, document_id bigint, content string, product string")
    dd = spark.createDataFrame(docs, "doc_id bigint, product string")
    product, seen = dict(docs), {}
    for _, d, c in chunks:
        for _, m in repetition.counted_lines(c) if c else []:
            seen.setdefault((product.get(d), m), set()).add(d)
    size = {p: sum(x == p for _, x in docs) for p in ("p", "q")}
    want = {(i, n) for i, d, c in chunks if c and product.get(d) for n, m in repetition.counted_lines(c) if len(seen[product[d], m]) >= max(6, 0.1 * size[product[d]])}
    assert want and {(r["id"], r["line_no"]) for r in repetition.repeated_lines(cd, dd).collect()} == want
    clean = {r["id"]: r["content"] for r in repetition.without_repeated_lines(cd, dd).collect()}
    i, n = sorted(want)[0]
    assert len(clean) == len(chunks) and len(clean[i].split("\n")) == len(dict((c[0], c[2]) for c in chunks)[i].split("\n")) - sum(x == i for x, _ in want)
    assert repetition.repeated_lines(cd.limit(0), dd).count() == 0


def test_near_duplicates_are_decided_by_clusters(spark):
    """Lines that differ in a name, a month or one word of many stand in one document each; only their cluster is frequent."""
    people = ["Ada Berg", "Bo Lund", "Cy Holt", "Di Stein", "Ed Moor", "Flo Wick", "Gus Ley", "Hal Ford"]
    months = ["May", "June", "July", "March", "April", "August", "October", "December"]
    line = lambda k: f"This page was last looked over in {months[k]} 2024 by {people[k]} of the long standing manual group of the site and its many helpers"
    chunks = [(k, k, f"Own text {k} {chr(97 + k) * 5}\n{line(k)}") for k in range(8)]
    chunks += [(20, 20, "This page was last looked over by nobody and it tells of other things than those pages do, in quite other words")]
    cd = spark.createDataFrame(chunks, "id bigint, document_id bigint, content string")
    dd = spark.createDataFrame([(d, "p") for d in (*range(8), 20, *range(30, 40))], "doc_id bigint, product string")
    assert repetition.soft_mask(line(0)) == repetition.soft_mask(line(5))
    assert repetition.repeated_lines(cd, dd).count() == 0
    assert {(r["id"], r["line_no"]) for r in repetition.repeated_lines(cd, dd, near=True).collect()} == {(k, 1) for k in range(8)}
    clean = {r["id"]: r["content"] for r in repetition.without_repeated_lines(cd, dd).collect()}
    assert clean[3] == "Own text 3 ddddd" and clean[20] == chunks[-1][2]


# 6 markup


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("plain a < b and b > 3, 5 * 3 * 2, C# and $5 or $6, $result.host$, C:\\tools\\new, <host>:<port>, {{name}}", []),
        ("<p>x</p>", ["html"]), ("a &amp; b", ["html"]), ("AT&T and &copy", []), ("< b and <UL><LI>x</UL>", ["html"]),
        ("[[A b|c]] explains", ["wiki"]), ("== Head ==\ntext", ["wiki"]), ("'''bold''' and ''it''", ["wiki"]), ("{{Note|x}}", ["wiki"]), ("{| class=\"x\"\n|-\n| a || b\n|}", ["wiki"]),
        ("[https://x.example/a some page].", ["wiki"]), ("$x_{i} \\leq 3$", ["latex"]), ("\\section{A} and \\textbf{b}", ["latex"]), ("\\(q = 9\\)", ["latex"]), ("$$ n = \\frac{1}{k} $$", ["latex"]),
        ("* item", ["markdown"]), ("1. item", ["markdown"]), ("# Head", ["markdown"]), ("a `b` c", ["markdown"]), ("**b**", ["markdown"]), ("| a | b |\n|---|---|", ["markdown"]), ("[a](b)", ["markdown"]),
        ("Head\n----", ["markdown"]), ("> q", ["markdown"]), ("```\n<p>[[x]] $x_{1}$</p>\n```", ["markdown"]), (None, []), ("", []),
    ],
)
def test_kinds(text, kinds):
    assert markup.kinds_of(text) == kinds


def test_clean_text():
    text = "== Head ==\n'''A''' is [[x|y]] &amp; <b>z</b>, \\textbf{w}: $x_{i} \\leq 3$\n* item\n```\n<b>code</b>\n```\n| a | b |\n|---|---|\n| 1 | 2 |"
    assert markup.clean_text(text) == "## Head\nA is y & z, w: $x_{i} \\leq 3$\n- item\n```\n<b>code</b>\n```\n| a | b |\n| 1 | 2 |"
    assert markup.clean_text(None) is None and markup.clean_text("") == "" and len(markup.clean_text(LONG)) == len(LONG)
    page = markup.clean_html(PAGE)
    assert "# Tune the queue" in page and "```\na = 1 < 2\n```" in page and "| field_cap | 7 |" in page


def test_pages_keep_short_lists():
    links = "".join(f'<li><a href="/{n}">Page {n}</a></li>' for n in range(3))
    long = "".join(f"<p>{'The queue drains, and the indexer, which waits, writes; then it rests. ' * n}</p>" for n in (12, 1, 9))
    page = markup.clean_html(f"<ul>{links}</ul><article><h1>Tune it</h1><h2>Steps</h2><ol><li>Open a.conf</li><li>Set cap to 9</li></ol>{long}<h3>Options</h3><ul><li>ttl: 5</li></ul></article>")
    assert page.startswith("# Tune it\n## Steps\n- Open a.conf\n- Set cap to 9\n") and page.endswith("### Options\n- ttl: 5") and "Page 1" not in page


def test_markup_tables(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "<b>x</b>", "a"), (3, "<b>x</b>", "a")], "id bigint, content string, kinds string")
    got = sorted((r["id"], r["kinds"], r["clean"]) for r in markup.strip_markup(df).collect() if r["id"] > 1)
    assert got == [(2, [], ""), (3, ["html"], "x"), (3, ["html"], "x")] and markup.strip_markup(df.limit(0)).count() == 0


# 8 tokens


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=80))
def test_round_trip_and_public_encoder(text):
    import tiktoken

    import public_tokenizers

    enc = tokens.encoder()
    text = text.encode("utf-8", "replace").decode()
    ids = enc.encode(text)
    assert enc.decode(ids) == text
    ranks = tokens.read_ranks(f"{tokens.tokenizer_folder()}/byte_bpe_50k.tiktoken")
    own = test_round_trip_and_public_encoder.__dict__.setdefault("own", tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    assert ids == own.encode_ordinary(text)


def test_encode_tables(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "<|endoftext|>", 1), (None, "a", 1), (4, LONG, 1), (4, LONG, 1)], "doc_id bigint, text string, ids int")
    got = tokens.encode_corpus(df).collect()
    assert len(got) == 6 and all(r["ids"] == [] for r in got if r["doc_id"] in (1, 2)) and len(next(r["ids"] for r in got if r["doc_id"] == 3)) > 1
    assert tokens.encode_corpus(df.limit(0)).count() == 0


# 9 mixing


def test_mixture_reaches_the_shares(spark):
    rng = random.Random(2)
    docs = [(i, rng.choice("aaaaaaaabbc"), rng.choice(["en", "EN", "de-DE", None]), rng.choice(["x", "y", "", None]), rng.randrange(0, 60)) for i in range(6000)]
    docs += [(9000, None, "en", "x", 5), (9001, "other", "en", "x", 5), (9002, "a", "en", "x", None)]
    dd = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, source string, lang string, manual string, n_tokens int, n_uses int")
    tt = spark.createDataFrame([("a", 0.4, 1), ("b", 0.4, 2), ("c", 0.15, 3), ("gone", 0.05, 4)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mixture(dd, tt)
    cap = {"a": 1, "b": 2, "c": 3}
    rows = mixed.collect()
    assert rows and all(1 <= r["n_uses"] <= cap[r["source"]] for r in rows) and len({r["doc_id"] for r in rows}) == len(rows)
    for r in report.collect():
        assert abs(r["reached_share"] - r["target_of_present"]) < 0.01
        assert r["source"] != "gone" or r["mixed_tokens"] == 0
    empty, shares = mixing.mixture(dd.limit(0), tt)
    assert empty.count() == 0 and shares.count() == 4


def test_mixture_with_a_scarce_source(spark):
    rng = random.Random(4)
    docs = [(i, "big", rng.choice(["en", "de"]), rng.choice("xyz"), rng.randrange(1, 6)) for i in range(20000)]
    docs += [(30000 + i, "tiny", "en", "x", 20) for i in range(5)] + [(40000 + i, "some", "en", "y", rng.randrange(1, 6)) for i in range(900)]
    dd = spark.createDataFrame(docs, "doc_id bigint, source string, lang string, manual string, n_tokens int")
    tt = spark.createDataFrame([("big", 0.5, 1), ("tiny", 0.2, 1), ("some", 0.3, 3)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mixture(dd, tt)
    assert {r["source"]: r["mixed_tokens"] for r in report.collect()} == pytest.approx({"big": 250, "tiny": 100, "some": 150}, abs=5)
    assert all(r["n_uses"] == 1 for r in mixed.collect() if r["source"] != "some")
    _, report = mixing.mixture(dd, tt, mixing.MixOptions(total_tokens=400.0))
    assert {r["source"]: r["mixed_tokens"] for r in report.collect()} == pytest.approx({"big": 200, "tiny": 80, "some": 120}, abs=10)


def test_many_cells_are_raked_by_joins(spark):
    rows = [(i, "abc"[i % 3], ["en", "de"][i % 7 % 2], f"m{i % 11}", 10 + i % 50) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, manual string, n_tokens int")
    targets = spark.createDataFrame([("a", 0.6, 2), ("b", 0.39, 1), ("c", 0.01, 3)], "source string, target_share double, max_repeats int")
    few, many = (mixing.mixture(df, targets, mixing.MixOptions(rounds=r, tolerance=1e-4, max_cells=m))[1].collect() for r, m in ((60, 20_000), (6, 5)))
    for report in (few, many):
        assert all(abs(r["reached_share"] - r["target_share"]) < 0.005 for r in report)


def test_small_weights_are_met(spark):
    """A large source of which one token in 2,000 is drawn still meets its share."""
    rows = [(i, "big" if i < 40_000 else "tiny", "en", "m", 50 + i % 7) for i in range(40_020)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, manual string, n_tokens int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("tiny", 0.5, 1)], "source string, target_share double, max_repeats int")
    report = {r["source"]: r for r in mixing.mixture(df, targets)[1].collect()}
    assert report["big"]["n_documents"] < 25 and abs(report["big"]["reached_share"] - 0.5) < 0.03


def test_rake_meets_marginals():
    rng = np.random.default_rng(1)
    t = rng.integers(1, 50, 24).astype(float)
    s, l = np.arange(24) % 3, np.arange(24) % 4
    goal_s, goal_l = np.array([0.2, 0.5, 0.3]) * t.sum(), np.full(4, t.sum() / 4)
    w = mixing.rake(t, [s, l], [goal_s, goal_l], np.full(24, 99.0), 200, 1e-9)
    assert np.bincount(s, w * t) == pytest.approx(goal_s, rel=1e-6) and np.bincount(l, w * t) == pytest.approx(goal_l, rel=1e-3)


# 10 personal information


def test_tagger_gradients():
    p = {k: v.astype(np.float64) for k, v in tagger.fresh(1, hidden=4).items()}
    x, n = tagger.encode(["Ann 5", "a@b"])
    gold = np.zeros(x.shape, np.int64)
    gold[0, :3] = [1, 2, 2]
    _, g = tagger.loss_and_gradients(p, x, n, gold)
    rng = np.random.default_rng(0)
    for k in p:
        at = tuple(rng.integers(d) for d in p[k].shape)
        if k == "P":
            at = (0, int(x[0, 0]), 3)
        e = 1e-3
        up, down = (dict(p) for _ in range(2))
        up[k], down[k] = p[k].copy(), p[k].copy()
        up[k][at] += e
        down[k][at] -= e
        slope = (tagger.loss_and_gradients(up, x, n, gold)[0] - tagger.loss_and_gradients(down, x, n, gold)[0]) / (2 * e)
        assert g[k][at] == pytest.approx(slope, abs=2e-3)


def test_training_learns():
    from corvine.llm.tagger_data import Maker

    maker = Maker(3)
    rows = [maker.window() for _ in range(16)]
    x, n = tagger.encode([w for w, _ in rows])
    gold = np.zeros(x.shape, np.int64)
    for r, (_, t) in enumerate(rows):
        gold[r, : len(t)] = t
    p = tagger.fit(lambda k: rows, 60, batch=16)
    assert tagger.loss_and_gradients(p, x, n, gold)[0] < 0.5 * tagger.loss_and_gradients(tagger.fresh(5), x, n, gold)[0]


def test_decoder_equals_the_plain_network():
    """Emissions and paths of the laid out parameters are those of the plain LSTM and of Viterbi over all windows."""
    from corvine.llm.tagger_data import Maker

    p, windows = pii.weights(), sorted([Maker(77).window()[0] for _ in range(40)] + ["x", "Ask Zelda Q. Brandmere, zelda@post.example", "\ud800 \U0001f600 é"], key=len)
    e, lengths = tagger.emissions(p, windows)
    x, _ = tagger.encode(windows)
    d = tagger.Decoder(p)
    got = np.zeros((x.shape[1], len(tagger.TAGS), len(windows)), np.float32) + d.b[:, None]
    for k in range(2):
        d.direction(k, np.ascontiguousarray(x.T), lengths, got)
    assert all(np.allclose(got[:n, :, r], e[r, :n], atol=1e-3) for r, n in enumerate(lengths))
    assert all((a == b).all() for a, b in zip(d.tags(windows), tagger.viterbi(p, e, lengths)))


def test_fused_step_equals_numpy():
    """The step in onnxruntime gives what numpy gives, and reads each character of a window once a direction, no padding."""
    from corvine.llm.tagger_data import Maker

    pytest.importorskip("onnxruntime")
    p, windows = pii.weights(), sorted([Maker(78).window()[0] for _ in range(60)] + ["x", "\ud800 \U0001f600 é", "1" * 160], key=len)
    x, lengths = tagger.encode(windows)
    fused, plain = tagger.Decoder(p), tagger.Decoder(p, plain=True)
    read: list[int] = []
    fused.steps = [lambda x, h, c, f=f: (read.append(len(x)), f(x, h, c))[1] for f in fused.steps]
    a, b = (np.zeros((x.shape[1], len(tagger.TAGS), len(windows)), np.float32) for _ in range(2))
    for k in range(2):
        fused.direction(k, np.ascontiguousarray(x.T), lengths, a)
        plain.direction(k, np.ascontiguousarray(x.T), lengths, b)
    assert sum(read) == 2 * lengths.sum()
    assert all(np.allclose(a[:n, :, r], b[:n, :, r], atol=1e-3) for r, n in enumerate(lengths))
    assert all((s == t).all() for s, t in zip(fused.tags(windows), plain.tags(windows)))


def test_paths_are_searched_where_one_may_win():
    """The bound leaves open every window in which a path beats O alone, and settles most of the others."""
    d, lengths = tagger.Decoder(pii.weights()), np.sort(np.random.default_rng(4).integers(1, 40, 3000))
    settled = 0
    for scale in (0.5, 2, 6):
        e = np.random.default_rng(5).normal(size=(40, len(tagger.TAGS), 3000)).astype(np.float32) * scale
        e[:, 0] += 2 * scale
        left, (_, above) = d.contested(e, lengths), d.scores(e, lengths)
        assert set(np.flatnonzero(above > 1e-3)) <= set(left)
        settled += 3000 - len(left)
    assert settled > 1000
    text = ["Ask Zelda Q. Brandmere, zelda@post.example", *(f"the table is read again after {k} rows of the same kind." for k in range(20))]
    searched, scores = [], d.scores
    d.scores = lambda e, lengths: (searched.append(len(lengths)), scores(e, lengths))[1]
    assert [t.any() for t in tagger.tag_windows(d, text)] == [True] + [False] * 20 and sum(searched) < 10


def test_held_out_accuracy():
    from corvine.llm.tagger_data import Maker

    held = Maker(12345)
    rows = [held.window() for _ in range(300)]
    got = tagger.tag_windows(pii.weights(), [w for w, _ in rows])
    right = sum(int((g == t).sum()) for g, (_, t) in zip(got, rows)) / sum(len(t) for _, t in rows)
    assert right > 0.99


ANOTHER_HAND = """
My name is {name:Maria Lopez} and I have used the product since spring.
The away team was led by {name:Jean-Luc Picard} until his retirement.
Unser Büro liegt in der {address:Musterstraße 12}, gleich beim Bahnhof.
Please wire the fee to {idnum:DE89 3704 0044 0532 0130 00} before Monday.
Passport no. {idnum:123456789} was found at the gate.
You can text me: {phone:5551234567}
We interviewed {name:Juan Carlos de la Cruz} about his garden.
He travelled through South Korea with two friends from Google Cloud.
My sister, {name:Fiona Gallagher}, teaches at a school in Leeds.
Yesterday {name:Tom Brady} called {name:Serena Williams} to apologise.
The witness, {name:Li Wei}, could be reached on {phone:+86 10 6552 9988}.
If lost, please return to {name:R. Feynman}, {address:12 Maple Street, Ithaca}.
Any questions? {email:helpdesk@city-library.org}
Her new address is {address:48 Rosewood Avenue, Bristol}.
I was born in Cape Town and grew up in New Zealand.
Dear Ms. {name:Olivia Bennett}, thank you for your letter.
Our accountant {name:Giorgio Moretti} needs your tax number {idnum:123-45-6789} today.
The landlord asked for {idnum:X1234567L} and a copy of the lease.
Für Rückfragen: {name:Sabine Krüger}, {phone:+49 89 1234567}, {email:s.krueger@beispiel.de}
Le contrat a été signé par {name:Émile Zola} et {name:George Sand}.
Llámame al {phone:+34 612 345 678} cuando llegues.
Visit the shop at {address:7 Abbey Road, London} for a fitting.
Reservation for {name:Akira Kurosawa}, party of four, {phone:(212) 736-5000}.
His email is {email:peter.pan@neverland.net}; hers is {email:wendy_d@london.co.uk}.
The library holds 1200345 books and opens at 09:30 on weekdays.
Table 4 lists the Silver Lake stations, build 2024.11.3 and port 8443.
To reset, hold the Power Button for ten seconds.
Driver licence {idnum:D1234567} expires next year.
Contact {name:Nils Holgersson} [{email:nils (at) gans.se}] for tickets.
The Golden Gate Bridge opened in May 1937.
Drop the keys at {address:221 Baker Street, London} after ten.
Bitte an Herr {name:Karl Lagerfeld}, {address:Hauptstraße 5, 10115 Berlin}.
Emergency contact: {name:Grace Hopper} / {phone:202-555-0143}
Mr {name:Sherlock Holmes} and Dr {name:John Watson} share the flat.
Her insurance number is {idnum:QQ 12 34 56 C}.
Meine Nummer ist {phone:0171 2345678}, abends besser.
"""


def test_text_of_another_hand():
    """Lines written by hand, not by the generator: nine pieces in ten come out with their bounds, with forms or without."""
    lines = [x for x in ANOTHER_HAND.strip().split("\n")]
    want = []
    for line in lines:
        text, spans, at = "", [], 0
        for m in re.finditer(r"\{(\w+):([^}]*)\}", line):
            text += line[at : m.start()]
            spans.append((len(text), len(text) + len(m[2]), m[1]))
            text, at = text + m[2], m.end()
        want.append((text + line[at:], set(spans)))
    for forms in (pii.FORMS, {}):
        got = pii.Finder(forms=forms).find([t for t, _ in want])
        both = sum(len(w & set(g)) for (_, w), g in zip(want, got))
        assert both >= 0.9 * sum(len(w) for _, w in want) and sum(len(g) for g in got) <= 1.1 * both


def test_pieces():
    text = (
        "Ask Dr. Zelda Q. Brandmere or write to mailto:zelda+x@post.example.org before noon.\n- Odo Tarnfield, 12 Oakhill Lane, Unit 3, Brookton 91234\n"
        "Call +33 1 99 00 94 04 or (415) 555-0135. Passport X1234567, tax_id=123-45-6789.\n担当者はIlse Vandermann、連絡先はilse [at] host [dot] exampleです。\n"
        "Log in as svc_ops@edge-1 and look for build 987.65.260 on 192.0.2.14, published 2024-03-01 in Quarry Core notes."
    )
    found = {(k, text[a:b]) for a, b, k in pii.finder().find([text])[0]}
    assert {("name", "Zelda Q. Brandmere"), ("email", "zelda+x@post.example.org"), ("phone", "+33 1 99 00 94 04"), ("phone", "(415) 555-0135"), ("idnum", "X1234567"), ("idnum", "123-45-6789"), ("email", "ilse [at] host [dot] example")} <= found
    assert ("address", "12 Oakhill Lane, Unit 3, Brookton 91234") in found and not any("svc" in t or "987" in t or "192" in t or "2024" in t for _, t in found)
    clean = pii.replaced(text, pii.finder().find([text])[0])
    assert "Ask Dr. [NAME] or write to mailto:[EMAIL] before noon." in clean


def test_names_of_many_scripts():
    for text, name in (
        ("freeze_after_days\n担当者はStefan Quilholt-Tarthorne、連絡先はそちらです。", "Stefan Quilholt-Tarthorne"), ("担当はIlse Vandermannさんです。", "Ilse Vandermann"),
        ("Signed, Łukasz Śliwiński", "Łukasz Śliwiński"), ("Signed, Иван Петров", "Иван Петров"), ("Signed, Γιώργος Παπάς", "Γιώργος Παπάς"),
        ("Ask Anna van der Berg for the key.", "Anna van der Berg"), ("# owner: Ludwig von Hagen", "Ludwig von Hagen"),
    ):
        assert [(k, text[a:b]) for a, b, k in pii.finder().find([text])[0]] == [("name", name)]
    assert pii.finder().find(["Starten Sie den Knoten lm-ovr neu. Ändern Sie heartbeat_secs."]) == [[]]


def test_long_lines_are_cut_and_reconciled():
    s = "x" * 500
    w = pii.cut(s)
    assert w[0][0] == 0 and w[-1][1] == 500 and all(b - a == pii.WINDOW for a, b in w)
    assert (pii.reconcile(500, w, [np.full(b - a, 1, np.int8) for a, b in w]) == 1).all()


def test_no_lines_are_remembered_between_tasks():
    first = pii.finder()
    first.find(["Ask Zelda Q. Brandmere, zelda@post.example"])
    assert first.known and not pii.finder().known


def test_pii_tables(spark):
    df = spark.createDataFrame([(1, None, "e"), (2, "", "e"), (3, "Write to a.b@c.example", "e"), (3, "Write to a.b@c.example", "e"), (4, LONG, "e")], "doc_id bigint, text string, kind string")
    assert sorted((r["doc_id"], r["kind"], r["start_pos"]) for r in pii.find_pieces(df).collect()) == [(3, "email", 9)] * 2
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert clean[1] is None and clean[2] == "" and clean[3] == "Write to [EMAIL]" and clean[4] == LONG
    assert pii.find_pieces(df.limit(0)).count() == 0


def test_queries_are_named_after_their_problems():
    from corvine.llm import queries

    assert {re.match(r"p(\d+)_", n)[1] for n in queries.QUERIES} == {"1", "2", "3", "4", "6", "8", "9", "10"}
