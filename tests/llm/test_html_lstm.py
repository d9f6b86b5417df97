import html
import random
import tempfile
import time
from html.parser import HTMLParser

import numpy as np
import pytest

from cartolake.llm import html_lstm


def test_blocks():
    page = "<html><head><title>no</title></head><body><!-- <p>x</p> --><nav><ul><li><a href='>'>Home</a></li></ul></nav><p><b>A &amp;&nbsp;b<br>c \n d<p>second <i>word</i><script>var t='</p>';</script> end</p>1 < 2 &copy;<style>p{}</style></body>"
    assert [b[0] for b in html_lstm.blocks(page)] == ["Home", "A & b c d", "second word", "end", "1 < 2 ©"]
    assert html_lstm.blocks("") == [] and html_lstm.blocks("plain &lt;b&gt;") == [("plain <b>", None, 0)]
    assert [b[0] for b in html_lstm.blocks("<p>a<!-- open")] == ["a"]
    for odd in ("<" * 3000, "<a '" * 3000, "<p>" * 3000 + "x", "&#x110000; &#0; &bad", "<div><p>x</div></p></table>y", "<head>never closed<body>z"):
        assert all(t for t, _, _ in html_lstm.blocks(odd))


def test_slopes_match_differences():
    """Back-propagation against finite differences."""
    rng = np.random.default_rng(0)
    a = html_lstm.Labeller(1)
    a.w = {k: v.astype(np.float64) for k, v in a.w.items()}
    x, goal = rng.normal(size=(4, 2, html_lstm.INPUTS)), rng.normal(size=(4, 2, html_lstm.HIDDEN))
    keep: list = []
    a._run("f", x.astype(np.float32), keep)
    grad = {k: np.zeros_like(v) for k, v in a.w.items()}
    a._back("f", x.astype(np.float32), keep, goal.astype(np.float32), grad)
    for name in ("fx", "fh", "fc"):
        at = tuple(rng.integers(0, n) for n in a.w[name].shape)
        values = []
        for e in (1e-3, -1e-3):
            a.w[name][at] += e
            values.append(float((a._run("f", x.astype(np.float32)) * goal).sum()))
            a.w[name][at] -= e
        assert abs((values[0] - values[1]) / 2e-3 - grad[name][at]) < 2e-2 * max(1, abs(grad[name][at]))


def test_held_out_pages_and_operator(spark):
    labeller = html_lstm.trained()
    right = total = 0
    for x, y in html_lstm.examples(150, 12345):
        right += int(((labeller.scores([x])[0] >= 0.5) == (y > 0)).sum())
        total += len(y)
    assert right / total > 0.98
    rng = random.Random(4)
    rows = [(i, f"http://h/{i}", html_lstm.page(rng)[0], "x") for i in range(40)] + [(90, None, None, None), (91, "u", "", ""), (91, "u", "", "")]
    rows.append((92, "u", "<html><body><nav><a href=/>Home</a></nav><article><h1>A title</h1>" + "<p>Some words &amp; more of them, in a sentence.</p>" * 3000 + "</article><footer>&copy; us</footer></body></html>", ""))
    got = {r.page_id: r for r in html_lstm.extract(spark.createDataFrame(rows, "page_id long, url string, html string, kind string")).collect()}
    assert got[90].text == got[91].text == "" and got[0].kind == "x"
    assert got[92].text.count("Some words & more of them") == 3000 and "Home" not in got[92].text and "us" not in got[92].text.split("\n\n")
    one = next(html_lstm.extract_all(labeller, [rows[7][2]]))
    assert one == got[7].text and html.unescape(one) == one
    assert html_lstm.extract(spark.createDataFrame([], "html string")).count() == 0
    with pytest.raises(ValueError):
        html_lstm.extract(spark.createDataFrame([], "html string, TEXT string"))


def test_raw_elements_end_at_their_own_tag():
    article = "<article><p>The whole article.</p></article>"
    found = lambda page: [b[0] for b in html_lstm.blocks(page)]
    for raw in (
        "<script>for(var i=0;i<n;i++)go();</script>", "<script>if(a<b){s='it\\'s \"';}</SCRIPT >", "<script>x<!--y\n</script>", "<script>if (a<b && c>d) t='<p>';</script\n>", "<style>a:before{content:'<b'}</style>",
        "<title>a <b 'c</title>", "<textarea><p \"</textarea>", "<script>'</scripts>' + i<n</script>", "<head><title>t<t</title><script>i<n;'</script></head>", "<svg><style>a<b{'}</style></svg>", "<script></script>",
    ):
        assert found(f"<body>{raw}{article}") == ["The whole article."], raw
        assert found(f"<p>before{raw}after</p>{article}") == ["before", "after", "The whole article."], raw
    assert found("<p>a<script src=x>no end " + article) == ["a"] and found("<script>i<n" * 3000) == []


def texts(page):
    return [b[0] for b in html_lstm.blocks(page)]


def test_heads_end_where_a_parser_ends_them():
    for head in ("<head><title>t</title>", "<head><meta charset=utf-8><link rel=x><script>a<b</script>", "<head>\n<style>p{}</style>\n</head>", "<html><head><base href=/><noscript><img src=x></noscript>", "<head><title>t</title></head><head>"):
        assert texts(head + "<p>one</p><div>two</div>") == ["one", "two"], head
    assert texts("<head> <meta> words <p>one") == ["words", "one"] and texts("<head></html>x") == ["x"]


def test_odd_markup():
    assert texts("<p>one</p><script>if(a<b)x();</script><p>two</p>") == ["one", "two"]
    assert texts("<p>a</p><noscript>b<p>c") == ["a", "b", "c"] and texts("<svg><svg></svg>no</svg>x<object>y</object>z") == ["x", "z"]
    assert texts('<p>a<b title="x>y">c</b> d</p>') == ["ac d"]
    assert texts('<a "><p>kept</p>') == ["kept"] and texts('<a b="c><p>d</p>') == ["d"] and texts("a<!-->b<!--->c<!-- -- > -->d</>e<?x?>f</3>g") == ["abcdefg"]
    assert texts("<p>1 < 2 and <3 <") == ["1 < 2 and <3 <"] and texts("<p>x<br/>y</p><hr>z") == ["x y", "z"]
    path, e = [], html_lstm.blocks("<div id=a>" * 900 + "deep" + "</div>" * 898 + "<p>up")[1][1]
    while e:
        path.append(e.name)
        e = e.parent
    assert path == ["p", "div", "div"]


@pytest.mark.parametrize("unit", ['<a "', "<a '", '<a b="', "<a b='>", "<", "<!", "<!--", "</", "</b>", "<b>", "<p>", "<li><ul>", "<noscript>", "<svg/><svg>", "<select>", "&#x", "<script", "=", '<a ="', "<a =\"'>", "<b c=\"'><d e='\">", "<title>", "<head>", "<!-->", "<i>x</i>", " <div>a"])
def test_reading_is_linear(unit):
    began = time.perf_counter()
    html_lstm.vectors(html_lstm.blocks("<article>" + unit * (1_000_000 // len(unit)) + "</article>"))
    assert time.perf_counter() - began < 12


class Plain(HTMLParser):
    """Block texts by the standard library's parser, for well-formed pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.held, self.raw = [], "", 0

    def cut(self):
        if t := " ".join(self.held.split()):
            self.out.append(t)
        self.held = ""

    def handle_starttag(self, tag, attrs):
        self.raw += tag in html_lstm._RAW
        self.held += " " if tag == "br" else ""
        if tag in html_lstm._BLOCKS | html_lstm._RAW:
            self.cut()

    def handle_endtag(self, tag):
        self.raw -= tag in html_lstm._RAW
        if tag in html_lstm._BLOCKS | html_lstm._RAW:
            self.cut()

    def handle_data(self, data):
        self.held += "" if self.raw else data


def test_blocks_equal_the_standard_parsers(spark):
    made = random.Random(21)
    pages = [html_lstm.page(made)[0] for _ in range(200)] + [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    for page in pages:
        p = Plain()
        p.feed(page)
        p.close()
        p.cut()
        assert texts(page) == p.out


def test_query_extracts_whole_articles(spark):
    """The registered query over a fixture whose articles are known: paragraphs in order, nothing else, whatever scripts stand before them."""
    from cartolake.llm.queries import op8_html

    rng = random.Random(22)
    rows = []
    for i in range(60):
        words = [" ".join("".join(rng.choice("abcdefgho") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(12, 60))).capitalize() + "." for _ in range(rng.randint(2, 9))]
        junk = rng.choice(["<script>for(var i=0;i<n;i++)go();</script>", "<script>x<!--y</script>", "<!-- <p>no</p> -->", "<style>a>b{}</style>"])
        page = f"<html><head><title>T</title></head><body>{junk}<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav><article>{''.join(f'<p>{w}</p>' for w in words)}</article>{junk}<footer>&copy; all rights</footer></body></html>"
        rows.append((i, f"http://h/{i}", page, "\n\n".join(words)))
    rows += [(100, None, None, ""), (101, "u", "", ""), (101, "u", "", "")]
    with tempfile.TemporaryDirectory() as folder:
        spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
        got = sorted((r.page_id, r.text, r.n_chars) for r in op8_html(spark, folder).collect())
    want = sorted((i, t, len(t)) for i, _, _, t in rows)
    assert len(got) == len(want) and sum(g == w for g, w in zip(got, want)) >= len(want) - 1
