import numpy as np

from lexiweave.llm import html

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body class="page-12">
<nav><ul><li><a href=/>Home</a><li><a href=/x>X</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="content-77"><h1>Head &amp; line</h1><p>First <b>bold</b>
 text&nbsp;here<p>Second<br>line &lt;b&gt;<!-- <p>gone --><div class="ad">Buy now</div><ul><li>one<li>two</ul>
<form><p>Name <input></form><section id=comments><p>nice post, thank you very much for it</section><pre>a
 b</pre></div><aside>Side text that is long enough to matter to someone</aside><footer>&copy; me</footer>"""


def test_extraction():
    assert html.extract(PAGE) == "Head & line\n\nFirst bold text here\n\nSecond line <b>\n\none\n\ntwo\n\na b"
    assert html.vote(PAGE)[0] == "#>html>body.page-#>div.content-#"


def test_odd_input():
    for text in [None, "", "   ", "<", "<p", "</", "<!--", "<a href='", "<script>x", "&", "&#x110000;", "<p>" * 3000, "</p>" * 100, "<div><span></div></span>", "<b><i></b></i>"]:
        assert html.extract(text) in ("", "<", "&", "�"), text
    assert html.extract("plain text &eacute; only") == "plain text é only"
    assert html.extract("<p>one<p>two</p></p>three") == "one\n\ntwo\n\nthree"
    assert html.extract("a < b and c > d") == "a < b and c > d"
    assert html.extract("<div " + "x" * 5000 + ">deep " + "<div>" * 2000 + "text") == "deep\n\ntext"
    assert html.extract("<article><p>" + "word " * 50_000 + "</article>").count("word") == 50_000
    assert html.extract("<table><tr><td>a<td>b<tr><td>c</table>") == "a\n\nb\n\nc"
    assert html.extract('<p title="a > b">x</p><p title="open>y</p><p>z</p>') == "x\n\ny\n\nz"


def test_names_of_neighbours():
    assert html.extract("<div class='content-with-sidebar'><p>The text of it</div><div class=sidebar><p>no</div>") == "The text of it"
    assert html.extract("<div class='has-sidebar'><p>The text of it<div class='footer-content'>no</div></div>") == "The text of it"


def test_host_agrees(spark):
    rng = np.random.default_rng(1)
    word = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma"], n))
    page = lambda n, m: f"<body><div class=story{n}><p>{word(n)}</div><div class=box><p>{word(m)}</div></body>".replace(f"story{n}", f"story{n % 7}")
    rows = [(i, f"http://Host.example:80/p{i}", page(60, 3)) for i in range(20)] + [(100, "http://user@host.example/odd", page(4, 50)), (101, "http://other/", page(4, 50)), (102, None, page(9, 2)), (103, "http://host.example", None), (None, "http://host.example/", page(30, 2)), (104, "http://host.example/", "<p>other build</p>")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, path string, n_chars int").repartition(4)
    got = {r.page_id: r for r in html.main_text(df).collect()}
    assert len(got) == len(rows)
    # the odd page alone would give the other box
    assert len(got[100].text.split()) == 4 and len(got[101].text.split()) == 50
    assert got[103].text == "" and got[103].n_chars == 0 and got[104].text == "other build" and len(got[102].text.split()) in (9, 11)
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html.main_text(df.limit(0)).collect() == []


def test_shuffled_paths_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"http://h{i % 3}/", PAGE) for i in range(9)], "page_id long, url string, html string")
    expected = sorted(map(tuple, html.main_text(df).collect()))
    monkeypatch.setattr(html, "BROADCAST_HOSTS", 0)
    assert sorted(map(tuple, html.main_text(df).collect())) == expected


def test_names_inside_an_article():
    page = '<article><header><h1>The title</h1><nav>menu</nav></header><p>Body of it</p><p class="share">A paragraph that talks of shares</p><p class="ad">Buy</p><div class="share-buttons">share</div><h2 id="search">On search</h2><footer>by me</footer></article>'
    assert html.extract(page) == "The title\n\nBody of it\n\nA paragraph that talks of shares\n\nOn search"
    assert html.extract("<div class=c><p>one text</div><div class=c><p>two text more</div><div class=c><p>three text</div>") == "one text\n\ntwo text more\n\nthree text"


def test_against_known_articles(spark):
    """Pages made from known blocks in the templates of some hosts; boilerplate of every kind around and between them."""
    rng = np.random.default_rng(7)
    word = lambda n: " ".join(rng.choice("sea river stone light of the and & wind; é".split(), n))
    escape = lambda x: x.replace("&", "&amp;")
    around = ["<nav><a href=/>home page</a></nav>", "<div class='cookie-notice'>we use cookies</div>", "<aside>more of it</aside>", "<div id=sidebar><p>beside the text stands this</div>", "<form><label>name</label><input></form>", "<script>var a = '<p>x</p>';</script>", "<footer>(c) us</footer>", "<section class=comments><p>a comment that a reader wrote</section>", "<div class='ad-box ad'>buy</div>", "<!-- <p>gone -->"]
    shells = [("<body><article>", "</article></body>"), ("<body><div class=wrap><main>", "</main></div>"), ("<html><body><div id=content-{k} class='post'>", "</div>"), ("<body><div class=story><div class=body>", "</div></div>")]
    rows, want = [], {}
    for k in range(80):
        head, tail = shells[k % 4]
        blocks = [word(int(rng.integers(8, 40))) for _ in range(int(rng.integers(2, 6)))]
        kinds = rng.choice(["p", "h2", "li", "pre", "blockquote"], len(blocks))
        inner = ""
        for kind, b in zip(kinds, blocks):
            inner += f"<ul><li>{escape(b)}</ul>" if kind == "li" else f"<{kind}>{escape(b)}</{kind}>"
            if rng.integers(3) == 0:
                inner += str(rng.choice(around))
        page = "".join(rng.choice(around, 2)) + head.format(k=k) + inner + tail + "".join(rng.choice(around, 2))
        rows.append((k, f"http://host{k % 4}.example/{k}", page))
        want[k] = "\n\n".join(" ".join(b.split()) for b in blocks)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html.main_text(df).collect()}
    assert np.mean([got[k] == want[k] for k in want]) == 1.0
