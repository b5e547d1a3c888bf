import random

from hypothesis import given, settings
from hypothesis import strategies as st

from storecast.llm import pages


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=14), st.lists(st.integers(0, 5), max_size=14))
def test_common_lines_are_a_longest_common_subsequence(a, b):
    places = pages.common_lines(a, b)
    assert places == sorted(set(places)) and len(places) == lcs(a, b)
    rest = iter(b)
    assert all(any(y == a[i] for y in rest) for i in places)


def text(source):
    return "\n\n".join(t for t, _ in pages.page_lines(source))


def test_markup():
    assert text('<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li>x</li></ul></nav><div class="ad">buy'
                '</div><article><h1>Head &amp; line</h1><p><b>One\n  two<br>three<br><p>Four&nbsp;five &lt;b&gt; &#233;</p><div class="comments"><p>first!</p></div>'
                '<aside>see</aside><form><p>mail</p></form></article><footer>&copy;</footer></body></html>') == "Head & line\n\nOne two three\n\nFour five <b> é"
    assert text("<p>a &am") == "a &am" and text("<p>a</p><p class='x") == "a" and text("") == "" and text("plain  text") == "plain text"
    assert text('<div id="cookie-notice"><div>x</div>y</div><p title="a>b">kept</p><!-- <p>no</p> --><p hidden>h</p><p style="display:none">n</p>') == "kept"
    assert text("<main><header><h1>Title</h1></header><p>Body</p></main><p>outside</p>") == "Title\n\nBody"
    assert text("<div class='ad'>never closed <p>x") == "" and text("a < b <i>c</i>") == "a < b c"
    assert text("<ul class=menu><li>a<ul><li>b</ul></ul><p>kept") == "kept"


def page(lines, i):
    return "<div>Site name</div>" + "".join(f"<p>{x}</p>" for x in lines) + f"<div>About us</div><div>page {i}</div>"


def test_shared_lines_go_within_a_host(spark, monkeypatch):
    rng = random.Random(3)
    body = {i: [f"line {i} {k}" for k in range(rng.randint(1, 5))] for i in range(60)}
    rows = [(i, f"http://h{i % 2}.x/a/{i:03d}?q={i}#z", page(body[i], i)) for i in range(60)]
    rows += [(100, None, page(["no url"], 100)), (101, "http://alone.x/", page(["alone"], 101)), (102, "http://h0.x/b", None), (None, "not a url", ""),
             (103, "http://art.x/1", "<article><p>quoted</p><p><a href=1>more</a></p></article>"), (104, "http://art.x/2", "<article><p>quoted</p><p><a href=1>more</a></p></article>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string").repartition(4)
    for shuffles in ("3", "40"):
        monkeypatch.setattr(pages, "shuffle_partitions", lambda _, n=int(shuffles): n)
        got = {r.page_id: r for r in pages.extract_text(df).collect()}
        assert len(got) == len(rows)
        for i in range(60):
            assert got[i].text == "\n\n".join([*body[i], f"page {i}"]), i
            assert got[i].n_chars == len(got[i].text) and got[i].url == rows[i][1]
        assert got[100].text == "Site name\n\nno url\n\nAbout us\n\npage 100" and got[101].text.startswith("Site name")
        assert got[102].text == "" and got[None].text == ""
        assert got[103].text == got[104].text == "quoted"
    assert pages.extract_text(df.limit(0)).collect() == []


def test_elements_end_where_html_implies_it():
    assert text("<html><head><meta charset=utf-8><title>T</title><body><p>kept") == "kept"
    assert text("<head><title>T</title><p>kept") == "kept"
    assert text("<p class=notice>Buy<p>kept<div>too</div>") == "kept\n\ntoo"
    assert text("<ul><li class=ad>Buy<li>kept</ul><p>too") == "kept\n\ntoo"
    assert text("<div><p class=notice>Buy</div>kept") == "kept" and text("<div><span class=ad>Buy</div>kept") == "kept"
    assert text("<table><tr><td class=menu>Home<td>kept<tr><td>too</table><p>last") == "kept\n\ntoo\n\nlast"
    assert text("<dl><dt class=ad>Buy<dd>kept</dl>") == "kept"
    assert pages.page_lines("<article><a href=x><p>One</a><p>two</article>") == [("One", False), ("two", True)]
    assert text("<b>" * 50_000 + "<div>x</div>" * 50_000).startswith("x")
    assert text("<ul class=menu><li>a<table><tr><td>b</ul></table></ul><p>kept") == "kept"


def test_wrappers_of_the_article_stay():
    for wrapper in ("form", "div class='content widget'", "div class='post has-sidebar'", "div id=no-sidebar", "div class='content comment-open'"):
        assert text(f"<body><{wrapper}><article><h1>Head</h1><p>Body</article></{wrapper.split()[0]}>") == "Head\n\nBody", wrapper
    for wrapper in ("article class='post has-sidebar'", "main class='no-sidebar'", "article class='content comment-open'"):
        assert text(f"<{wrapper}><p>Body</p></{wrapper.split()[0]}>") == "Body", wrapper
    assert text("<body><form action=x><p>Body</p><select><option>a</select><div class=ad>buy</div></form><nav>n</nav>") == "Body"
    long = "word " * 60
    assert text(f"<div class='content social'><p>{long}</p><div class=comments>{long * 9}</div></div><div>About</div>") == f"{long.strip()}\n\nAbout"
    assert text(f"<article><p>Body</p></article><div class=comments><article>{long}</article></div><aside><article>{long}</article></aside>") == "Body"
    assert text(f"<div><p>{long}{long}</p></div><div class=related><article>a</article><article>b</article></div>") == (long + long).strip()


def extracted(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return {r.page_id: r.text for r in pages.extract_text(df).collect()}


def test_the_difference_decides_inside_articles(spark):
    def article(*lines):
        return "<article>" + "".join(f"<p>{x}</p>" for x in lines) + "</article>"
    body = {i: [f"story {i} tells of things number {k} at length" for k in range(3)] for i in range(4)}
    got = extracted(spark, [*((i, f"http://n.x/{i}", article("Sign up now", *body[i], "Share this story")) for i in range(4)),
                            (10, "http://q.x/1", article("one", "a long passage that both articles show, nearly whole")),
                            (11, "http://q.x/2", article("two", "a long passage that both articles show, nearly whole"))])
    assert {i: got[i] for i in range(4)} == {i: "\n\n".join(body[i]) for i in range(4)}
    assert got[10].startswith("one\n\na long") or got[10].startswith("a long")
    assert "a long passage" in got[11]


def test_copies_are_no_template(spark, monkeypatch):
    body = {i: [f"line {i} {k} of a text" for k in range(4)] for i in range(6)}
    rows = [(10 * i + c, f"http://c.x/a/{i}?v={c}", page(body[i], i)) for i in range(6) for c in range(1 + 7 * (i % 2))]
    rows += [(1000 + c, f"http://same.x/p?v={c}", page(["only page"], 0)) for c in range(3)]
    for shuffles in (1, 4, 30):  # runs of copies within a range and over several
        monkeypatch.setattr(pages, "shuffle_partitions", lambda _, n=shuffles: n)
        got = extracted(spark, rows)
        for i in range(6):
            for c in range(1 + 7 * (i % 2)):
                assert got[10 * i + c] == "\n\n".join([*body[i], f"page {i}"]), (i, c)
        assert all(got[1000 + c] == "Site name\n\nonly page\n\nAbout us\n\npage 0" for c in range(3))


def test_nearest_path_by_segments(spark):
    def plain(top, line):
        return f"<div>{top}</div><p>{line}</p>"
    got = extracted(spark, [(1, "http://s.x/a", plain("Top A", "first text")), (2, "http://s.x/a-b", plain("Top B", "second text")), (3, "http://s.x/a/x", plain("Top A", "third text"))])
    assert got == {1: "first text", 2: "Top B\n\nsecond text", 3: "third text"}
