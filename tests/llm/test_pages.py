"""URL rules, archives, extraction and media columns on small cases."""

import base64
import fnmatch
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from vialattice.llm import html, media, urls, warc
from vialattice.llm.queries import URL_RULES


def test_automaton_against_fnmatch():
    rng = random.Random(3)
    globs = sorted({g for g in ("".join(rng.choice("ab*c") for _ in range(rng.randint(1, 9))) for _ in range(120)) if g.strip("*")})
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(200)]
    fits = urls.ShiftAnd(globs).run(texts)
    for k, t in enumerate(texts):
        for j, g in enumerate(globs):
            assert fits[k, j] == fnmatch.fnmatchcase(t, g), (t, g)


def test_judge(spark):
    cases = {
        "http://Example.COM/en/71?x": ("example.com", "/en/71", "example.com/en/7", "allow"),
        "http://a.b.com/en/": ("a.b.com", "/en/", "com/en/", "block"),
        "http://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"),
        "http://com/en/x": ("com", "/en/x", "com/en/", "block"),
        "http://x.net/EN/": ("x.net", "/EN/", None, "allow"),
        "http://x.example.net/de/8#t": ("x.example.net", "/de/8", "example.net/de/8", "block"),
        "http://q.org?/es/": ("q.org", "", None, "allow"),
        "http://q.org/x.com/en/": ("q.org", "/x.com/en/", None, "allow"),
        "no scheme/en/": ("", "", None, "allow"),
        "a://b://c.com/en/": ("b:", "//c.com/en/", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    keys = list(cases)
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(keys)], "page_id long, url string, Rule string")
    for r in urls.judge(df, URL_RULES).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == cases[keys[r["page_id"]]], keys[r["page_id"]]
    assert urls.judge(df.limit(0), URL_RULES).count() == 0
    assert {r["verdict"] for r in urls.judge(df, []).collect()} == {"allow"}


def test_rules_of_the_contract():
    said = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    assert [f"{r.verdict} {r.text}" for r in URL_RULES] == said.split(", ")


def test_judge_allows_a_broad_rule_and_blocks_the_longer_one(spark):
    df = spark.createDataFrame([(1, "http://x.net/de/1"), (2, "http://example.net/de/7"), (3, "http://example.net/de/81")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(df, URL_RULES).collect()}
    assert got == {1: ("net/de/", "allow"), 2: ("net/de/", "allow"), 3: ("example.net/de/8", "block")}


def pages(spark):
    rows = [(k, f"http://h/{k}", f"<p>{'é' * (k % 4)}</p>") for k in range(40)]
    rows += [(100, None, None), (101, "u", ""), (102, "a b\r\nc", "x" * 50_000), (None, "u", "<p></p>"), (5, "http://h/5", "<p>é</p>"), (200, "twice", "new"), (200, "twice", "new")]
    return spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, Refers_To int"), rows


def test_archives(spark):
    df, rows = pages(spark)
    got = warc.round_trip(df, rows_per_shard=7, roll_bytes=500).collect()
    assert len(got) == len(rows)
    last: dict = {}
    for page_id, _, text in rows:
        if page_id is not None:
            last[text or ""] = max(last.get(text or "", -1), page_id)
    want = sorted((-1 if i is None else i, len((t or "").encode()), base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode(), "response" if i is None or last[t or ""] == i else "revisit", -1 if i is None or last[t or ""] == i else last[t or ""]) for i, _, t in rows)
    assert want == sorted((-1 if r["page_id"] is None else r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], -1 if r["refers_to"] is None else r["refers_to"]) for r in got)


def test_archives_are_the_same_again(spark, tmp_path):
    df, _ = pages(spark)
    sums = []
    for k, n in enumerate((1, 5)):
        manifest = warc.write(df.repartition(n), f"file://{tmp_path}/{k}", rows_per_shard=7)
        sums.append(sorted((r["shard"], r["sha256"], r["n_records"]) for r in manifest.collect()))
    assert sums[0] == sums[1]
    assert warc.round_trip(df.limit(0)).count() == 0


def test_common_payloads_and_no_ids(spark):
    rows = [(k, "u", "same") for k in range(3000)] + [(None, f"u{k}", f"{k}") for k in range(50)] + [(5000 + k, "u", "pair") for k in range(2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.round_trip(df, rows_per_shard=100).collect()
    assert len(got) == len(rows)
    same = [r for r in got if r["page_id"] is not None and r["page_id"] < 3000]
    assert all((r["record_type"], r["refers_to"]) == (("response", None) if r["page_id"] == 2999 else ("revisit", 2999)) for r in same)
    assert sum(r["record_type"] == "revisit" for r in got) == 3000


def test_damage_is_seen():
    data = bytearray(warc.record(1, "http://a", b"payload", None, 4))
    assert next(warc.records(bytes(data)))[1].endswith(b"payload")
    with pytest.raises(ValueError):
        list(warc.records(bytes(data[:-12])))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><a href="/">Home, sweet, home.</a></header><nav><ul><li>Menu, one.</li></ul></nav>
<div class="cookie-notice"><p>We use cookies, as others do, on all our pages, for many reasons.</p></div>
<article><h1>Head &amp; line</h1><p>First   para,\nwith <b>bold</b>&nbsp;text.<br>More &lt;here&gt;, and so on, to the end.<p>Second, unclosed.
<div class="ad">Buy, buy, buy this thing now, please, it is cheap.</div><ul><li>one<li>two</ul><form><input><label>Name, please</label></form></article>
<aside class="sidebar"><p>Also read, among others, this long text, which is elsewhere.</p></aside>
<section id="comments"><p>Great, I like it, really, a lot, thank you for that.</p></section><footer>&copy; us, 2024.</footer></body></html>"""


def test_extraction():
    assert html.extract(PAGE) == "Head & line\nFirst para, with bold text. More <here>, and so on, to the end.\nSecond, unclosed.\none\ntwo"
    plain = PAGE.replace("article>", "div>")
    assert html.extract(plain).startswith("Head & line\nFirst para")
    assert "cookies" not in html.extract(plain) and "Great" not in html.extract(plain)


def test_extraction_without_article_keeps_all():
    assert html.extract(PAGE.replace("article>", "div>")) == html.extract(PAGE)
    long = "A paragraph, with words, and so on, to its end. " * 10
    text = long.strip()
    assert html.extract(f"<body><div><h1>Title</h1><p>{long}</p></div></body>") == f"Title\n{text}"
    assert html.extract(f"<body><h1>Title</h1><p>Short lead</p><div><p>{long}</p></div></body>") == f"Title\nShort lead\n{text}"
    parts = "".join(f"<div class='part'><p>{long}</p></div>" for _ in range(9))
    assert html.extract(f"<body><div>{parts}<section><p>The last part, which is short.</p></section></div></body>").endswith("The last part, which is short.")
    assert html.extract(f"<body><div>{parts}<div><h2>Last</h2><p>Words.</p></div></div></body>").endswith(f"{text}\nLast\nWords.")
    assert html.extract(f"<table><tr><td><p>{long}</p></td><td>Cell, too.</td></tr></table>") == f"{text}\nCell, too."
    assert html.extract(f"<ul><li>{long}</li><li>two</li></ul>") == f"{text}\ntwo"


def test_names_alone_exclude_no_content():
    long = "A paragraph, with words, and so on, to its end. " * 10
    text = long.strip()
    for open_, close in (
        ('<body class="has-sidebar">', "</body>"), ('<body class="search">', "</body>"), ('<main class="search-result">', "</main>"), ('<article class="post comments-open">', "</article>"),
        ('<article class="related-story">', "</article>"), ('<div class="content with-sidebar">', "</div>"), ('<div id="no-comments">', "</div>"), ('<div class="related-story">', "</div>"), ('<div class="search">', "</div>"),
    ):
        page = f"{open_}<h1>Title</h1><p>{long}</p><p>Short.</p><div class='share'>Share, please.</div><div id='comments'><p>Great, I like it.</p></div>{close}"
        assert html.extract(page) == f"Title\n{text}\nShort.", open_
    # what is named as furniture and holds less stays furniture, long or nested
    assert html.extract(f"<div><h1>T</h1><p>{long}</p></div><div class='sidebar'><p>{long * 3}</p></div>") == f"T\n{text}"
    assert html.extract(f"<div class='ad'>{long}</div><div><h1>T</h1><p>Short.</p></div>") == "T\nShort."
    assert html.extract(f"<article><p>{long}</p><article class='comment'><p>I agree, too.</p></article></article>") == text
    assert html.extract(f"<article><p>{long}</p><div hidden><p>{long * 20}</p></div></article>") == text


def test_paths_choose(monkeypatch):
    long = "A paragraph, with words, and so on, to its end. " * 6
    paragraphs, boxes = "".join(f"<p>{long}</p>" for _ in range(4)), "".join(f"<div>{long}</div>" for _ in range(4))
    text = "\n".join([long.strip()] * 4)
    advert = "<div class='xq7'><a>Buy now!</a> <a>Click here.</a></div>"
    for page in (f"<article>{paragraphs}{advert}</article>", f"<body><section>{paragraphs}{advert}</section></body>"):
        assert html.extract(page) == text
    assert html.extract(f"<article><h1>T</h1><p>Short.</p>{boxes}</article>") == f"T\nShort.\n{text}"
    assert html.extract("<article><div>Short.</div></article>") == "Short."
    outside = f"<body><div>Visit us, please.</div><div id='x9'><h1>T</h1>{paragraphs}</div><div>One more offer.</div></body>"
    assert html.extract(outside) == f"T\n{text}"
    # without the scores none of this is told
    monkeypatch.setattr(html, "_path_scores", lambda page, real: (np.zeros(len(real), int), np.ones(len(real)), np.zeros(len(real))))
    assert "Buy now" in html.extract(f"<article>{paragraphs}{advert}</article>") and "Visit us" in html.extract(outside)


def test_hostile_markup_takes_little():
    for unit in ('<a b" ', "<div>x, y.", "<p><li>", "<!-- ", "<div><span></b></p>", "<title>", "<p id='", "</div>"):
        began = time.process_time()
        html.extract(unit * 20_000)
        assert time.process_time() - began < 5, unit


def test_extraction_edges(spark):
    for text in (None, "", "<p", "<!--", "<script>x", "<nav>only menu</nav>", "<p hidden>x</p>"):
        assert html.extract(text) == ""
    assert html.extract("just text & more") == "just text & more"
    assert len(html.extract("<article>" + "<p>word, and word.</p>" * 20_000)) > 300_000
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "u", "<p>a, b.</p>", "x")], "page_id long, url string, html string, Text string")
    got = {r["page_id"]: r for r in html.main_text(df).collect()}
    assert got[2]["text"] == "" and got[2]["n_chars"] == 0 and got[None]["text"] == "a, b." and got[1]["n_chars"] == len(got[1]["text"])
    assert html.main_text(df.limit(0)).count() == 0


def test_media(spark):
    texts = [None, "", "a" * 64, "b" * 65, "é" * 100, "long " * 40_000, "a" * 64]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, "x", "x")], "doc_id long, text string, Media string")
    got = {r["doc_id"]: r for r in media.round_trip(df).collect()}
    assert len(got) == len(texts) + 1
    for k, t in enumerate(texts):
        data = (t or "").encode()
        padded = data + bytes(64 if not data else -len(data) % 64)
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-64:])
    assert got[0][1:] == got[1][1:] and got[2][1:] == got[6][1:]
    assert media.round_trip(df.limit(0)).count() == 0


def test_media_ranges_and_retry(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    df = spark.createDataFrame([(k, "".join(random.Random(k).choices("abcdef ", k=3000))) for k in range(60)], "doc_id long, text string")
    media.write_archives(df, path, archive_bytes=20_000)
    reader = media.ArchiveReader({"path": path, "split_bytes": "5000", "batch_rows": "2"})
    parts = reader.partitions()
    assert len(parts) > 10
    ids = sorted(i for p in parts for b in reader.read(p) for i in b.column(0).to_pylist())
    assert ids == list(range(60))

    class Flaky:
        def __init__(self, f, fails):
            self.f, self.fails = f, fails

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            if self.fails:
                self.fails -= 1
                raise OSError("lost")
            return self.f.read(n)

    few = media.ArchiveReader({"path": path, "split_bytes": "5000", "most_partitions": "3"}).partitions()
    assert len(few) <= 6 and sorted(i for p in few for b in reader.read(p) for i in b.column(0).to_pylist()) == list(range(60))

    one = parts[0].ranges[0]
    name = one.archive.removeprefix("file://")
    offset, size, crc, _ = media.directory(open(name, "rb").read()[one.dir_start :])[0]
    with open(name, "rb") as f:
        assert zlib.crc32(media.read_member(Flaky(f, 2), offset, size, crc)) == crc
        with pytest.raises(OSError):
            media.read_member(Flaky(f, 9), offset, size, crc)
        with pytest.raises(ValueError):
            media.read_member(f, offset, size, crc ^ 1)


PARAGRAPHS = "<p>A long sentence, with words; and more of it, as in prose. And another one, too.</p>" * 4


def test_words_within_attributes_are_no_attributes():
    lines = ["A long sentence, with words; and more of it, as in prose. And another one, too."] * 4
    for page in (
        f'<article aria-hidden="false">{PARAGRAPHS}</article>', f'<article title="The hidden valley">{PARAGRAPHS}</article>', f'<body data-menu="hidden"><article>{PARAGRAPHS}</article>',
        f"<article data-x=' class=\"ad\" '>{PARAGRAPHS}</article>", f'<article><div hidden>x</div><div style="display : none">y</div>{PARAGRAPHS}</article>', f"<article><div HIDDEN=''>x</div>{PARAGRAPHS}</article>",
    ):
        assert html.extract(page).split("\n") == lines, page
    for inner, text in (('<a href="/the-hidden-cost">our report</a>', "our report"), ('<a href="/x?class=ad">link</a>', "link"), ('<i data-id="related-7">kept</i>', "kept"), ("<i title=\"it's class='ad'\">kept</i>", "kept")):
        assert html.extract(f"<article>{PARAGRAPHS}<p>{inner}</p></article>").split("\n") == [*lines, text]


def test_short_boxes_of_an_article_stay_and_menus_go():
    boxes = "<div>A short lead.</div><div class='byline'>By Jane Doe</div><section>Short para here</section><div>Yes, he said.</div>"
    assert html.extract(f"<article>{boxes}{PARAGRAPHS}</article>").split("\n")[:4] == ["A short lead.", "By Jane Doe", "Short para here", "Yes, he said."]
    menu = '<div class="qq1"><a>Home</a> <a>News</a></div>'
    for page in (f"<body>{menu}<article>{PARAGRAPHS}</article></body>", f"<article>{menu}{PARAGRAPHS}</article>", f"<body>{menu}<div>{PARAGRAPHS}</div><div>All rights are ours.</div></body>"):
        assert "Home" not in html.extract(page) and "rights" not in html.extract(page) and html.extract(page).count("prose") == 4
    # a list of links in prose that is on a chosen path, or mostly text, stays
    assert "see" in html.extract(f"<article>{PARAGRAPHS}<ul><li>Please see <a>this</a>.</li></ul></article>")


def without_names(page: str) -> str:
    """The page with divisions in place of everything that tells a region."""
    return re.sub(r"<div[^>]*>", "<div>", re.sub(r"<(/?)(?:nav|article|main|header|footer|aside|section)\b[^>]*>", r"<\1div>", page))


def test_paths_alone_find_the_article(monkeypatch):
    rng = random.Random(7)
    words = "stone river winter letter garden morning window silver harbour paper".split()
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + rng.choice([".", ", so.", "; yes."])
    pages = []
    for _ in range(60):
        body = "".join("<p>" + " ".join(sentence(rng.randint(5, 14)) for _ in range(rng.randint(2, 7))) + "</p>" for _ in range(rng.randint(3, 9)))
        links = "".join(f"<li><a href='/x'>{rng.choice(words)}</a></li>" for _ in range(rng.randint(3, 9)))
        pages.append(f"<body><nav><ul>{links}</ul></nav><aside>{sentence(4)}</aside><article><h1>{sentence(5)}</h1>{body}</article><footer>{sentence(6)}</footer></body>")
    want = [html.extract(p) for p in pages]
    assert all(w.count("\n") >= 3 for w in want)
    assert [html.extract(without_names(p)) for p in pages] == want
    monkeypatch.setattr(html, "_path_scores", lambda page, real: (np.zeros(len(real), int), np.ones(len(real)), np.zeros(len(real))))
    assert not any(html.extract(without_names(p)) == w for p, w in zip(pages, want, strict=True))


def test_extraction_against_a_plain_version():
    """Well-formed pages, with a parser of the standard library and no shortcuts."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.lines, self.now, self.inside, self.dropped = [], [], 0, 0

        def flush(self):
            if line := " ".join("".join(self.now).split()):
                self.lines.append(line)
            self.now = []

        def handle_starttag(self, tag, attrs):
            if tag in html.BLOCK:
                self.flush()
            bad = tag in html.NEVER or any(n == "class" and v in ("ad", "comments") for n, v in attrs)
            self.dropped += bool(self.dropped or bad) and tag not in html.VOID
            self.inside += tag == "article"
            if tag == "br":
                self.handle_data(" ")

        def handle_endtag(self, tag):
            if tag in html.BLOCK:
                self.flush()
            self.dropped -= bool(self.dropped)
            self.inside -= tag == "article"

        def handle_data(self, data):
            if self.inside and not self.dropped:
                self.now.append(data)

    rng = random.Random(8)
    word = lambda: rng.choice(["one", "two &amp; three", "&eacute;t&eacute;", "four, five;", "six\n seven", "<b>eight</b>", "<br>", "ni<i>ne</i>", "&#8212;", "hidden"])
    prose = lambda n: " ".join(word() for _ in range(n))
    for _ in range(150):
        parts = [rng.choice(["<p>{}</p>", "<h2>{}</h2>", "<ul><li>{}</li><li>{}</li></ul>", "<div>{}</div>", "<blockquote><p>{}</p></blockquote>", "<div class='ad'>{}</div>", "<script>{}</script>", "<table><tr><td>{}</td><td>{}</td></tr></table>", "<!-- {} -->", "<section><div>{}</div><p>{}</p></section>", "<form>{}</form>", "<div class='comments'><p>{}</p></div>"]) for _ in range(rng.randint(1, 12))]
        inner = "".join(x.format(prose(rng.randint(3, 60)), prose(rng.randint(3, 30))) for x in ["<p>{}</p>", *parts])
        page = f"<html><head><title>t</title></head><body><nav><a>m</a></nav><article>{inner}</article><footer>{prose(5)}</footer></body></html>"
        plain = Plain()
        plain.feed(page)
        assert html.extract(page).split("\n") == plain.lines, page
