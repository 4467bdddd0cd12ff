import random
import re

from portolan.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="<p>x</p>";</script></head>
<body><header>Site</header><nav><ul><li><a href="/a">a</a></li><li>b</li></ul></nav><!-- <p>no</p> -->
<div class="ad-box"><p>Buy</p></div><div id="cookie-notice">We use</div>
<article class="post"><h1>Head &amp; more</h1><p><b>One</b> two&nbsp;
 three<br>four<p>Five &lt;six&gt; 1 < 2 &amp
<div><p>Inner</p></div><aside>side</aside><form><p>Name</p><button>Go</button></form>
<section class="comments"><p>First!</p></section><p title="a > b">Last</p></article>
<footer>&copy; x</footer></body></html>"""


def extract(spark, rows, **kw):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    return sorted(map(tuple, html.extracted(pages, **kw).collect()), key=str)


def test_article(spark):
    rows = [(1, "http://a.example/x", PAGE, "clash"), (2, "http://a.example/y", PAGE.split("</article>")[0], "clash"), (1, "http://a.example/x", PAGE, "clash"),
            (3, None, None, None), (4, "http://b.example/", "", None), (5, "no host", "<p>plain", None), (6, "http://c.example", "just text &#65;&am", None)]
    body = "Head & more\n\nOne two three four\n\nFive <six> 1 < 2 &\n\nInner\n\nLast"
    want = [(1, "http://a.example/x", body), (1, "http://a.example/x", body), (2, "http://a.example/y", body), (3, None, ""), (4, "http://b.example/", ""),
            (5, "no host", "plain"), (6, "http://c.example", "just text A&am")]
    assert extract(spark, rows) == want
    assert extract(spark, rows, most_hosts=0) == want


def test_body_without_template(spark):
    page = "<html><body><div>Welcome to our site</div><div class='text'><p>{}</p><p>{}</p></div><div>All rights kept</div></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(f"story {i}", "the same ending" if i % 2 else f"end {i}"), None) for i in range(8)]
    assert [r[2] for r in extract(spark, rows)] == [f"story {i}\n\n" + ("the same ending" if i % 2 else f"end {i}") for i in range(8)]


def test_long_page(spark):
    text = "word " * 100_000
    assert extract(spark, [(1, "http://l.example/", f"<article><p>{text}</p></article>", None)])[0][2] == text.strip()


def test_empty(spark):
    assert extract(spark, []) == []


def to_regex(items):
    return "".join(re.escape(x) + " " if isinstance(x, str) else f"(?:{to_regex(x[1])}){x[0]}" for x in items)


def test_wrapper_accepts_its_pages():
    rng = random.Random(7)
    for _ in range(60):
        tokens = ["<a>", "<b>", "<c>", "#", "</a>"]
        streams = []
        base = rng.choices(tokens, k=rng.randint(1, 8))
        for _ in range(rng.randint(1, 6)):
            s = []
            for t in base:
                if rng.random() < 0.15:
                    continue
                s += [t] * rng.choice([1, 1, 1, 2, 3])
                if rng.random() < 0.1:
                    s += rng.choices(tokens, k=2) * rng.randint(1, 3)
            streams.append(tuple(s))
        wrapper = html.fold(streams[0])
        for s in streams[1:]:
            wrapper = html.align(wrapper, html.fold(s))
        assert html.parsed(html.pattern(wrapper)) == wrapper
        for s in streams:
            assert re.fullmatch(to_regex(wrapper), "".join(t + " " for t in s)), (wrapper, s)


def test_wrapper_by_host(spark):
    page = "<body><ul>{}</ul><article><p>x{}</article></body>"
    rows = [(i, f"http://h{i % 2}.example/{i}", page.format("<li>a" * (1 + i % 3), "<h2>y</h2>" if i % 5 == 0 else ""), "") for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r.host: (r.n_pages, r.wrapper) for r in html.wrappers(pages).collect()}
    assert got == {f"h{k}.example": (10, "<body> <ul> (<li> #)+ </ul> <article> <p> # (<h2> #)? </article> </body>") for k in (0, 1)}


def test_class_names_of_containers(spark):
    pages = ["<body class='single-post has-sidebar'><p>x", "<body class='header-fixed'><p>x", "<main class='with-sidebar'><p>x", "<article class='post comments-open'><p>x",
             "<div id='page-header-wrap'><p>x", "<section id='discussion'><h2 id='search-trees'>x", "<p class='social'>x", "<p>x<div class='ad-box'><p>y</div><p class='advert'>z"]
    assert [r[2] for r in extract(spark, [(i, f"http://k{i}.example/", p, None) for i, p in enumerate(pages)])] == ["x"] * len(pages)


def test_region_of_each_page(spark):
    pages = ["<article><p>a</p></article>", "<main><p>b</p></main>", "<div><p>c</p><article class='comment'><p>no</p></article></div>", "<p>d"]
    rows = [(i, "http://m.example/", p, None) for i, p in enumerate(pages)] + [(10 + i, None, p, None) for i, p in enumerate(pages)]
    assert [r[2] for r in sorted(extract(spark, rows))] == ["a", "b", "c", "d"] * 2


def test_hosts_of_equal_and_few_pages(spark):
    page = "<body><div>Welcome</div><p>story</p></body>"
    rows = [(i, "http://e.example/", page, None) for i in range(6)] + [(10 + i, "http://f.example/", page + f"<p>{i}", None) for i in range(2)]
    assert [r[2] for r in sorted(extract(spark, rows))] == ["Welcome\n\nstory"] * 6 + [f"Welcome\n\nstory\n\n{i}" for i in range(2)]


def test_places_equal_a_regular_expression():
    """The automaton takes what `re` takes, and the places spell the tokens."""
    rng = random.Random(3)

    def made(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            out.append(rng.choice("abc") if depth == 0 or rng.random() < 0.6 else (rng.choice("+?"), made(depth - 1)))
        return tuple(out)

    for _ in range(300):
        items = made(2)
        automaton, regex = html.Automaton(items), re.compile(to_regex(items))
        for _ in range(20):
            tokens = rng.choices("abc", k=rng.randint(0, 6))
            places = automaton.places(tokens)
            assert (places is not None) == bool(regex.fullmatch("".join(t + " " for t in tokens)))
            assert places is None or [automaton.symbol[p] for p in places] == tokens


def test_teasers_and_headings(spark):
    page = ("<body><article><h1 class='post-header'>Head {0}</h1><div class='article-header'>By {0}</div><p class='search-engine'>Story {0} goes on for a while</p></article>"
            "<article><p>Teaser of {0}</p></article><div>Printed here</div></body>")
    rows = [(i, "http://t.example/", page.format(i), None) for i in range(5)] + [(9, "http://t.example/", "<body><article><p>Short</p></article>", None)]
    want = [f"Head {i}\n\nBy {i}\n\nStory {i} goes on for a while" for i in range(5)] + ["Short"]
    assert [r[2] for r in sorted(extract(spark, rows))] == want


def test_listing_keeps_all_its_articles(spark):
    page = "<body>" + "<article><h2>{0}</h2><p>text {0}</p></article>" * 3
    rows = [(i, "http://l.example/", page.format(i) + ("<article><h2>more</h2><p>more</p></article>" if i % 2 else ""), None) for i in range(6)]
    assert [r[2] for r in sorted(extract(spark, rows))] == ["\n\n".join([f"{i}\n\ntext {i}"] * 3 + (["more\n\nmore"] if i % 2 else [])) for i in range(6)]


def test_template_within_an_article(spark):
    page = "<article><div>All our stories</div><p>first {0}</p><p>the same words</p><h3>end {0}</h3></article>"
    rows = [(i, "http://w.example/", page.format(i), None) for i in range(5)]
    assert [r[2] for r in sorted(extract(spark, rows))] == [f"first {i}\n\nthe same words\n\nend {i}" for i in range(5)]


def test_many_streams_of_a_host(spark):
    rng = random.Random(8)
    rows = [(i, "http://s.example/" if i % 3 else None, "".join(f"<{rng.choice(['p', 'h2', 'div', 'ul', 'li'])}>t{i}x{k}" for k in range(rng.randint(1, 9))), None) for i in range(150)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = html._wrappers(html._hosted(pages), fan=8).groupBy("host").count().collect()
    assert {r.host: r["count"] for r in found} == {"": 1, "s.example": 1}
    got = {r.page_id: r.text for r in html.extracted(pages).collect()}
    assert all(got[i].split("\n\n") == re.findall(r"t\d+x\d+", page) for i, _, page, _ in rows)


def test_text_around_an_article_stays(spark):
    main = "<main><h1>Title {0}</h1><p>Lead {0}</p><article>Story {0} text</article><p>Closing {0}</p></main>"
    rows = [(i, "http://x.example/", main.format(i), None) for i in range(5)]
    assert [r[2] for r in extract(spark, rows)] == [f"Title {i}\n\nLead {i}\n\nStory {i} text\n\nClosing {i}" for i in range(5)]
    # a teaser in a body full of text
    body = "<body><p>A long story {0} that goes on and on</p><p>and ends {0}</p><article>Teaser {0}</article></body>"
    rows = [(i, "http://y.example/", body.format(i), None) for i in range(5)]
    assert [r[2] for r in extract(spark, rows)] == [f"A long story {i} that goes on and on\n\nand ends {i}\n\nTeaser {i}" for i in range(5)]
    # without a host's other pages the page itself tells
    assert extract(spark, [(1, "http://z.example/", body.format(1), None)])[0][2].startswith("A long story 1")
    beside = "<main><article><p>Story {0} that goes on</p></article><article class=teaser><p>Other {0}</p></article></main>"
    rows = [(i, "http://w.example/", beside.format(i), None) for i in range(5)]
    assert [r[2] for r in extract(spark, rows)] == [f"Story {i} that goes on" for i in range(5)]


def test_quotes_of_attributes(spark):
    pages = {"<p title=it's>First</p><p title=that's>Second</p>": "First\n\nSecond", '<p title="a > b" data-x=\'c > d\'>One</p>': "One", '<p title="no end>Two</p><p>Three</p>': "Two\n\nThree",
             "<p title = \"class=ad\" data-class='advert'>Four</p>": "Four", "<div class=advert><p>no</p></div><p a=b/c='d'>Five": "Five", "<p \"quoted>Six</p>": "Six"}
    got = extract(spark, [(i, f"http://q{i}.example/", p, None) for i, p in enumerate(pages)])
    assert [r[2] for r in got] == list(pages.values())


def test_comments_and_adverts_by_any_name(spark):
    names = ["reader-comments", "user-comments", "post-comments", "comments-area", "comment_list", "advert-wrapper", "page-advert", "top-advertisement-slot"]
    rows = [(i, f"http://c{i}.example/", f"<div><p>story</p><div class='{n}'><p>no</p></div><ul id='{n}'><li>no</li></ul></div>", None) for i, n in enumerate(names)]
    rows += [(20, "http://d.example/", "<article class='reader-comment'>no</article><p>story", None), (21, "http://e.example/", "<div class='comments-open has-advert'><p>story</p></div>", None)]
    assert [r[2] for r in sorted(extract(spark, rows))] == ["story"] * 10


def test_fold_looks_at_runs_only():
    """A stream without repeated groups is compared a few times for each size, not item by item; nested and optional groups fold as before."""
    assert html.fold(tuple("abcabcx")) == (("+", tuple("abc")), "x")
    assert html.fold((("?", ("a",)), ("?", ("a",)))) == (("?", ("a",)), ("?", ("a",)))
    assert html.fold((("+", ("a",)), "a", "b")) == (("+", ("a",)), "b") and html.fold(("a", ("+", ("a",)))) == (("+", ("a",)),)

    class Token(str):
        compared = 0
        __hash__ = str.__hash__

        def __eq__(self, other):
            Token.compared += 1
            return str.__eq__(self, other)

    items = tuple(Token(f"<t{i}>") for i in range(1000))
    assert html.fold(items) == items
    assert Token.compared <= 1000 * (html.LONGEST + 2)
