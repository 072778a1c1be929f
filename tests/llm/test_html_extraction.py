import random
import time
from html.parser import HTMLParser

import pytest

from tidepool.llm import html_extraction as H
from tidepool.llm import queries as Q

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style><script>var x="</p><p>no";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a><li><a>About</a></ul></nav><!-- <p>gone</p> -->
<div class="cookie-notice">We use cookies</div><form><label>Mail</label><input><button>Go</button></form>
<article><header><h1>Title &amp; more</h1></header><p>One <b>bold</b>
 text&nbsp;here<br>after break<p>Two &lt;3 <span class="ad">BUY</span> end<div class="sidebar"><p>side</p></div>
<ul><li>first<li>second</ul><section id="comments"><p>nice post</p></section></article>
<aside>Aside</aside><footer>&copy; x</footer></body></html>"""


def main(page):
    return "\n".join(b for z, b in H.blocks(page) if z == "main")


def test_structure():
    assert main(PAGE) == "Title & more\nOne bold text here after break\nTwo <3 end\nfirst\nsecond"


@pytest.mark.parametrize("page", ["", "plain", "<", "<<>>", "<p", "<p>a", "</p></div>x", "<!-- open", "<script>never closed", "<a title='>'>b</a>", "<article><p>x", "&#x41;&bogus;&amp", "<svg/><p>q"])
def test_broken_markup(page):
    H.blocks(page)


def test_decoding_and_unclosed():
    assert H.blocks("<article><p>&#x41;&eacute; &lt;b&gt;<p>x")[0] == ("main", "Aé <b>")
    assert main("<main><div>a<div>b</div>c</div></main>") == "a\nb\nc"
    assert main('<div role="main"><p>a</p><div role="navigation">n</div></div><p>z') == "a"


def test_repeats_leave_unprotected_pages(spark):
    menu = "<div>home news sport weather travel shop</div><div>sign up for our weekly letter today please</div>"
    bodies = [f"<body>{menu}<p>unique text number {i} with words w{i} x{i} y{i}</p><div>all rights reserved by the example site owners</div></body>" for i in range(6)]
    rows = [(i, "https://a.example/x", b) for i, b in enumerate(bodies)]
    rows += [(10, "https://b.example/x", bodies[0]), (11, None, "<p>only here</p>"), (12, "http://[bad", None), (13, "https://a.example/y", ""), (None, "https://a.example/z", bodies[1]), (14, "https://c.example/", bodies[2]), (15, "https://c.example/2", bodies[2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {(r["page_id"], r["url"]): r for r in H.extract(df.withColumn("text", df.url).withColumn("page", df.url)).collect()}
    assert len(out) == len(rows)
    for i in range(6):
        r = out[i, "https://a.example/x"]
        assert r["text"].startswith(f"unique text number {i} with words") and "home" not in r["text"] and "rights" not in r["text"]
        assert r["template_tokens"] > 0 and r["n_chars"] == len(r["text"])
    assert out[11, None]["text"] == "only here" and out[12, "http://[bad"]["text"] == "" and out[13, "https://a.example/y"]["text"] == ""
    # one page alone on its host, and copies of one page, keep everything
    assert "home news" in out[10, "https://b.example/x"]["text"] and "home news" in out[14, "https://c.example/"]["text"]


def test_copied_articles_stay(spark):
    same = "<nav>a b c d e f g</nav><article><p>the very same long article text in all of the pages</p></article>"
    df = spark.createDataFrame([(i, f"https://h.example/{i}", same + f"<footer>{i}</footer>") for i in range(4)], "page_id long, url string, html string")
    assert {r["text"] for r in H.extract(df).collect()} == {"the very same long article text in all of the pages"}
    assert H.extract(df.limit(0)).count() == 0


class Articles(HTMLParser):
    """The text of article elements by the standard library's parser, for pages whose markup is closed or leaves paragraphs and items open."""

    OUT = {"aside", "nav", "form", "footer", "script", "style"}
    BLOCKS = {"p", "div", "h1", "h2", "h3", "ul", "ol", "li", "section", "blockquote", "article", "table", "tr", "td", "aside", "figure", "figcaption", "header"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.out, self.lines, self.own = 0, 0, [], []

    def end_line(self):
        body = " ".join("".join(self.own).split())
        if body:
            self.lines.append(body)
        self.own = []

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS or tag in self.OUT - {"script", "style"}:
            self.end_line()
        self.inside += tag == "article"
        self.out += tag in self.OUT
        if tag == "br":
            self.own.append(" ")

    def handle_endtag(self, tag):
        if tag in self.BLOCKS or tag in self.OUT - {"script", "style"}:
            self.end_line()
        self.inside -= tag == "article"
        self.out -= tag in self.OUT

    def handle_data(self, data):
        if self.inside > 0 and self.out <= 0:
            self.own.append(data)


def by_library(page):
    parser = Articles()
    parser.feed(page)
    parser.close()
    parser.end_line()
    return "\n".join(parser.lines)


def test_query_keeps_articles(spark):
    """Against an independent parser."""
    sf = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = Q.op3_html_extraction(spark, sf).collect()
    assert len(out) == len(pages)
    for r in out:
        page = pages[r["page_id"]]["html"]
        article = page[page.index("<article>") : page.index("</article>") + 10]
        assert r["text"] == by_library(article) and r["n_chars"] == len(r["text"]) and r["n_chars"] > 0


def test_random_markup_against_the_library():
    rng = random.Random(8)
    words = ["one", "two &amp; x", "&lt;b&gt;", "&#233;t\u00e9", "a\n b", "3 &gt; 2", "it's"]
    def flow(depth):
        kind = rng.choice(["text", "text", "inline", "p", "div", "ul", "br", "comment", "script", "aside"]) if depth else "text"
        if kind == "text":
            return rng.choice(words) + " "
        if kind == "br":
            return "<br>"
        if kind == "comment":
            return "<!-- <p>no</p> -->"
        if kind == "script":
            return "<script>var x = '</p><p>no';</script>"
        inner = "".join(flow(depth - 1) for _ in range(rng.randint(1, 3)))
        if kind == "inline":
            tag = rng.choice(["b", "i", "span", "a"])
            return f"<{tag} title='x > y' class=\"k\">{inner}</{tag}>"
        if kind == "p":
            return f"<p id=share-{rng.randint(1, 9)}>{rng.choice(words)}</p>"
        if kind == "ul":
            return f"<ul><li>{rng.choice(words)}</li><li>{inner}</li></ul>"
        return f"<{kind}>{inner}</{kind}>"
    for _ in range(300):
        page = "<body><nav>menu</nav><article>" + "".join(flow(3) for _ in range(rng.randint(1, 6))) + "</article><footer>x</footer></body>"
        assert main(page) == by_library(page), page


def test_headings_and_names_of_content_stay():
    page = """<article><p id="share-prices">Share prices rose</p><h2 id="cookie-recipes">Cookie recipes</h2><div class="related-work">Related work</div><h2 id="comments">On comments</h2>
    <table id="menu"><tr><td id="ad">cell</td></tr></table><figure id="banner"><figcaption>caption</figcaption></figure><div class="formula header-image-caption">formula</div>
    <div class="share-buttons">tweet</div><div id="commentList">first!</div><div class="widget social">follow</div><p class="ad">buy</p><span class="newsletter-signup-box">sign</span>
    <section class="reader-comments"><p>me too</p></section><div class="post-comments">agreed</div><div id="wpUserComments">yes</div></article>"""
    assert main(page) == "Share prices rose\nCookie recipes\nRelated work\nOn comments\ncell\ncaption\nformula"


def test_open_foreign_elements_end_at_a_block():
    assert main("<article><p>a<svg><text>no</text><p>b</p><select><option>x<div>c</div><svg><path/></svg>d</article>") == "a\nb\nc\nd"
    assert main("<article><video><p>fallback</p></video><template><p>no</p></template><p>yes</p></article>") == "yes"
    assert main("<article><p>a</p><title>no</title><textarea><p>no</textarea ><p>b</p></article>") == "a\nb"


@pytest.mark.parametrize("page", ["<a " * 300_000, "<b>" * 30_000 + "</i>" * 30_000, "<b>" * 30_000 + "<p></p>" * 30_000, "<div><b>" * 20_000 + "</x>" * 20_000, "<p>" + "<span class=ad>" * 30_000 + "x" + "</span>" * 30_000,
                                  "<a title=\">" * 40_000, "<!-- x " * 60_000, "<script>" * 50_000, "<p>x &amp; y</p>" * 30_000, "<" * 300_000, "<a b='" * 40_001, "<svg><p>" * 30_000, "<li><b>" * 30_000])
def test_time_is_linear(page):
    began = time.process_time()
    H.blocks("<article>" + page)
    assert time.process_time() - began < 3


def brute_repeats(own, others):
    """Positions of tokens in runs of RUN that ``own`` shares with another stream, comparing all positions."""
    seen = {tuple(o[i : i + H.RUN]) for o in others for i in range(len(o) - H.RUN + 1)}
    return {p for i in range(len(own) - H.RUN + 1) if tuple(own[i : i + H.RUN]) in seen for p in range(i, i + H.RUN)}


def test_repeat_at_any_offset(spark):
    run = [f"r{i}" for i in range(50)]
    streams = [[f"a{n}x{i}" for i in range(7 + n)] + run + [f"z{n}x{i}" for i in range(9)] for n in range(7)]
    streams.append(["p", "q"] + run[:7] + ["s", "t"] + run[20:31] + ["u", "v", "w"] + run[30:42] + ["y"])  # 7 and 11 inside a block stay, 12 go
    df = spark.createDataFrame([(n, "https://h.example/", f"<p>{' '.join(b)}</p>") for n, b in enumerate(streams)], "page_id long, url string, html string")
    out = {r["page_id"]: r for r in H.extract(df).collect()}
    for n, own in enumerate(streams[:7]):
        gone = brute_repeats(own, [o for o in streams if o is not own])
        assert len(gone) == 50 and out[n]["template_tokens"] == 50
        assert out[n]["text"] == " ".join(t for i, t in enumerate(own) if i not in gone)
    assert out[7]["text"] == " ".join(["p", "q"] + run[:7] + ["s", "t"] + run[20:31] + ["u", "v", "w", "y"])


def test_repeats_decide_protected_blocks(spark):
    notice = "Please support this site and its authors by telling your friends about our weekly letter"
    own = [" ".join(f"w{n}x{i}" for i in range(20 + n)) for n in range(8)]
    rows = [(n, f"https://h.example/{n}", f"<article><p>Read</p><p>{w}</p><p>{w[:9]} {notice} {w[-9:]}</p></article>") for n, w in enumerate(own)]
    # a passage of half the articles and copies of one article are content
    rows += [(20 + n, f"https://i.example/{n}", f"<article><p>{w}</p>{f'<p>{notice}</p>' if n % 2 else ''}</article>") for n, w in enumerate(own)]
    rows += [(40 + n, f"https://j.example/{n}", f"<article><p>{notice}</p><p>{own[0]}</p></article><footer>{n}</footer>") for n in range(8)]
    # the text beside a teaser
    rows += [(60 + n, f"https://k.example/{n}", f"<p>home news sport weather travel shop</p><article><p>see t{n}</p></article><div><p>{w}</p></div>") for n, w in enumerate(own)]
    # a host of more articles than are counted at once, three quarters with the notice
    rows += [(100 + n, f"https://m.example/{n}", f"<article><p>text {n}a {n}b</p>{f'<p>{notice}</p>' if n % 4 else ''}</article>") for n in range(48)]
    rows += [(80, "https://l.example/", f"<article><p>{own[0]}</p></article><p>few words</p>")]
    out = {r["page_id"]: r for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(out) == len(rows)
    for n, w in enumerate(own):
        assert (out[n]["text"], out[n]["template_tokens"]) == (f"{w}\n{w[:9]} {w[-9:]}", 1 + len(notice.split()))
        assert out[20 + n]["text"] == w + ("\n" + notice if n % 2 else "") and out[20 + n]["template_tokens"] is None
        assert out[40 + n]["text"] == notice + "\n" + own[0]
        assert out[60 + n]["text"] == f"see t{n}\n{w}"
    assert all(out[100 + n]["text"] == f"text {n}a {n}b" for n in range(48))
    assert out[80]["text"] == own[0]
