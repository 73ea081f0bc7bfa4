import random
import re

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import html_extract as h

SCHEMA = "page_id long, url string, html string"


def test_nodes_of_generated_pages():
    pages, labels = h.labelled_pages(120, seed=99)
    forest = h.Forest([h.parse(p) for p in pages])
    truth = np.concatenate([np.array(x) for x in labels])
    kept = forest.decode(h.trained().odds(forest.features()))
    assert len(truth) == len(forest.parent) and (kept == truth).mean() > 0.985


def test_decoding_never_contradicts():
    pages, _ = h.labelled_pages(40, seed=5)
    forest = h.Forest([h.parse(p) for p in pages])
    kept = forest.decode(np.random.default_rng(1).normal(0, 2, len(forest.parent)))
    inner = forest.depth > 0
    assert not (kept[inner] & ~kept[forest.parent[inner]]).any()


PAGES = {
    1: ('<html><body><nav><ul><li><a href="/">home</a></ul></nav><div class="ad">Buy now.</div><article><h1>Title &amp; more</h1><p><b>First  line<br>second<p>Third &lt;3 &#8364;.</article><footer>&copy; x</footer></body></html>', "Title & more\nFirst line second\nThird <3 €."),
    2: ("<p>plain one<p>plain two", "plain one\nplain two"),
    3: ('<main><p>Body text here, long enough to read.</p><script>var a = "</p><p>no</p>";</script><style>p{}</style><!-- <p>hidden</p> --></main>', "Body text here, long enough to read."),
    4: ("", ""),
    5: (None, ""),
    6: ("no markup  at all", "no markup at all"),
    7: ("<div id='cookie-consent'><p>We use cookies.</p><button>OK</button></div><article><p>An article that says something, at length.</p><form><input><button>Go</button></form></article><div class='comments'><div class='comment'><p>Nice post!</p></div></div>", "An article that says something, at length."),
}


def test_pages(spark):
    rows = [(i, f"u{i}", html) for i, (html, _) in PAGES.items()] + [(None, None, PAGES[2][0])] * 2
    got = h.main_text(spark.createDataFrame(rows, SCHEMA).withColumn("text", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    for r in got:
        expected = PAGES[r["page_id"] or 2][1]
        assert r["text"] == expected and r["n_chars"] == len(expected), r["page_id"]


def test_awkward_markup():
    for html in ("<" * 5000, "<p" * 5000, "<div>" * 3000 + "deep", '<a href="' * 2000, "<!--" * 3000, "</p>" * 5000 + "x", "<script>" + "a" * 100_000, "&" * 10_000, "<p>\x00\ud7ff</p>"):
        (text,) = h.extract([html], h.trained())
        assert isinstance(text, str)
    (text,) = h.extract(["<article>" + "<p>A long line of text, repeated many times over.</p>" * 20_000 + "</article>"], h.trained())
    assert text.count("\n") == 19_999


def test_empty(spark):
    assert h.main_text(spark.createDataFrame([], SCHEMA)).collect() == []


RAW_PARTS = [
    "<script>if (a<b) x='1';</script>", "<script>var s='<!-- x';</script>", '<script>"</p><div class=\\"ad\\">" + "<a href=\'";</script>', "<style>p>a{content:'<div>'} /* <!-- */</style>",
    "<!-- <p>no</p> ' \" <script> -->", "<!---->", "<SCRIPT type='a>b'>1<2 && \"</div>\"</SCRIPT >", "<textarea><p>'</textarea>", "<noscript><img src='x'><p>no</p></noscript>", "<script></script>",
]


def reference_blocks(html):
    """Words outside raw elements and comments by the standard library's parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        CDATA_CONTENT_ELEMENTS = ("script", "style")
        skipped, words = 0, ()

        def handle_starttag(self, tag, attrs):
            self.skipped += tag in h.RAW

        def handle_endtag(self, tag):
            self.skipped -= tag in h.RAW and self.skipped > 0

        def handle_data(self, data):
            if not self.skipped:
                self.words = (*self.words, *data.split())

    reader = Reader()
    reader.feed(html)
    reader.close()
    return " ".join(reader.words)


def test_raw_elements_neither_leak_nor_swallow():
    rng = random.Random(8)
    pages, _ = h.labelled_pages(40, seed=11)
    for page in pages:
        page = page.replace("&amp;", "and").replace("&gt;", "-").replace("&copy;", "c").replace("&middot;", "-")
        body = page.index("<body>") + 6
        cuts = [m.start() for m in re.finditer("<", page[body:])]
        more = page
        for at in sorted(rng.sample(cuts, min(6, len(cuts))), reverse=True):
            more = more[: body + at] + rng.choice(RAW_PARTS) + more[body + at :]
        assert h.parse(more).segments == h.parse(page).segments, more
        assert "".join(x for _, t in h.parse(more).segments for x in t.split()) == reference_blocks(page).replace(" ", "")
    assert h.extract(["<p>" + "Hello there, reader. " * 9 + "<script>if (a<b) x='1';</script></p>"], h.trained())[0] == ("Hello there, reader. " * 9).strip()


def test_hostile_markup_is_linear():
    for part in ("<a '", '<p "', "<script", "<!--", "</", "<", "<script><", "<script>a<b", "<textarea>", "&", "<div>", "</p>"):
        assert isinstance(h.parse(part * 20_000).segments, list)
