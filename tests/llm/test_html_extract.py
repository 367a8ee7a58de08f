import pytest

from corvex.llm import html_extract as H

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><nav><a href=/>Home</a></nav></header>
<div class="wrap"><div class="cookie-notice">We use cookies and so on and on.</div><main><div class="post-%d entry"><h1>Title %d</h1>
<p>First &amp; para\n with   text&nbsp;here, and quite some of it too.<p>Second <b>bold</b> one.<script>var x="</p>";</script>
<ul><li>One<li>Two</ul><div class="ad">Buy now</div><form><p>Name</p></form></div>
<section id="comments"><p>Reader: what a very long and windy comment this is, on and on and on.</p></section></main>
<aside class="sidebar"><p>Other posts</p></aside></div><footer>Copyright</footer></body></html>"""
WANT = "Title %d\n\nFirst & para with text here, and quite some of it too.\n\nSecond bold one.\n\nOne\n\nTwo"


def test_pages_of_a_host(spark):
    rows = [(i, f"http://a.example/{i}", PAGE % (i, i)) for i in range(5)] + [(9, "http://b.example/", "<article><p>Just text"), (10, None, None), (11, "x", ""), (12, "http://a.example/z", "<nav>only a menu</nav>"), (12, "http://a.example/z", "<nav>only a menu</nav>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = [(r.page_id, r.text) for r in H.main_text(df, carry=["page_id"]).collect()]
    assert sorted(got) == sorted([(i, WANT % i) for i in range(5)] + [(9, "Just text"), (10, ""), (11, ""), (12, ""), (12, "")])
    assert H.main_text(df.limit(0)).count() == 0


def test_join_by_page_gives_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"http://h{i % 3}.example/", PAGE % (i, i)) for i in range(6)], "page_id bigint, url string, html string")
    a = sorted(map(tuple, H.main_text(df).collect()))
    monkeypatch.setattr(H, "BROADCAST_HOSTS", 1)
    assert sorted(map(tuple, H.main_text(df).collect())) == a


def test_consensus_beats_a_page_of_its_own():
    odd = "<body><div class='c'><p>Short.</p></div><div class='x'><p>" + "A longer box that is no article. " * 2 + "</p></div></body>"
    assert H.extract(odd, ["/body/div.c"]) != H.extract(odd, ["/body/div.x"])


def test_long_and_broken():
    assert H.extract("<p>" * 3000 + "deep", []) == "deep"
    assert H.extract("<div><p>a &amp b &lt;i&gt; <a href='x>broken", []).startswith("a & b <i>")
    assert H.extract("plain text only", []) == "plain text only"


def test_each_template_of_a_host_has_its_own_path(spark):
    def page(k, i, times):
        prose = " ".join([f"Story {i} of template {k} goes on and on with many words."] * times)
        return f"<html><body><div class='story-x{chr(97 + k)}'><p>{prose}</p></div><div class='box'><p>Boilerplate that every page of this host shows.</p></div></body></html>", prose

    rows = [(100 * k + i, "http://h.example/", *page(k, i, 10)) for k in range(12) for i in range(3 if k < 11 else 1)]
    rows.append((9999, "http://h.example/", *page(0, 9, 4)))  # its own best is the body
    assert H.Page(rows[-1][2]).found[0].key == H.path_key("/html/body")
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, want string")
    assert [(r.page_id, r.text) for r in H.main_text(df).collect() if r.text != r.want] == []


def test_ancestor_stays_where_it_wins(spark):
    two = "<html><body><div class='a'><p>" + "First half of it. " * 9 + "</p></div><div class='b'><p>" + "Second half of it. " * 9 + "</p></div></body></html>"
    df = spark.createDataFrame([(i, "http://h.example/", two) for i in range(4)], "page_id bigint, url string, html string")
    assert all("First" in r.text and "Second" in r.text for r in H.main_text(df).collect())


def test_small_parts_at_the_path_stay():
    rest = " ".join(["The rest of the article goes on for long."] * 30)
    page = f"<body><div class='content'><p>A short intro comes first.</p></div><div class='ad'>Buy now</div><div class='content'><p>{rest}</p></div></body>"
    assert H.extract(page, []) == "A short intro comes first.\n\n" + rest


def test_names_of_parts():
    assert all(map(H.is_part, "ad comments share-box navBar post-footer article-comments cookie_notice related-posts sidebar2 newsletter-form".split()))
    assert not any(map(H.is_part, "more tags form-factor related-work content post-body headline advice commentary notice-period shared".split()))


def test_text_inside_the_article_stays():
    inside = "<div class='form-factor'><p>Form.</p></div><p class='more'>More.</p><div class='related-work'><p>Related.</p></div><p>Let <math><mi>x</mi></math> be.</p><svg><svg>a</svg>b</svg><p>End.</p>"
    page = "<body><nav>Menu</nav><article><p>" + "Some prose first. " * 9 + "</p>" + inside + "<div class='comments'><p>Reader says.</p></div></article></body>"
    got = H.extract(page, [])
    assert got.split("\n\n")[1:] == ["Form.", "More.", "Related.", "Let x be.", "End."]


def _host_page(i, part, words, name="story"):
    article = f"Article {i} tells of the day in just a few plain words."
    rest = " ".join(["Someone said this or that about it."] * words)
    return f"<html><body><nav>Menu</nav><div class='{name}'><p>{article}</p></div><div class='{part}'><p>{rest}</p></div></body></html>", article


@pytest.mark.parametrize("part", ["comments", "cookie-notice", "sidebar", "related-posts", "reader-comments", "ad-box"])
def test_parts_stay_out_at_any_length(spark, part):
    """Shares of the page from a tenth to over nine tenths, alone and among pages of the host."""
    rows = [(10 * k + i, f"http://h{k}.example/{i}", *_host_page(i, part, w)) for k, ws in enumerate(((1, 2, 4, 9, 30, 60), (60, 60, 60), (40,), (0, 0, 30))) for i, w in enumerate(ws)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, want string")
    assert [(r.page_id, r.text) for r in H.main_text(df).collect() if r.text != r.want] == []
    assert all(H.extract(html, []) == want for _, _, html, want in rows)


def test_comments_inside_the_article_and_the_hosts_own_path(spark):
    """Remarks that outweigh the article in its own container: the path that the host votes for is still taken."""
    def page(i, n):
        art = f"Story {i} goes on for a while and says what happened. " * 4
        talk = "<div class='comments'>" + "<p>A remark of some length by a reader of the page.</p>" * n + "</div>"
        return f"<body><div class='wrap'><div class='post'><p>{art}</p>{talk if i % 2 else ''}</div>{'' if i % 2 else talk}</div></body>", art.strip()

    rows = [(i, "http://h.example/", *page(i, n)) for i, n in enumerate((0, 1, 3, 20, 40, 80))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, want string")
    assert [(r.page_id, r.text) for r in H.main_text(df).collect() if r.text != r.want] == []


def test_an_article_in_a_badly_named_box_survives_by_the_hosts_votes(spark):
    def page(i, extra):
        art = f"Article {i} stands in a box that some template named badly."
        return f"<body><p>Home</p><div class='promo'><h1>T{i}</h1><p>{art}</p></div><p>{extra}</p></body>", f"T{i}\n\n{art}"

    rows = [(i, "http://h.example/", *page(i, "An extra line of eight words or more stands here." if i == 3 else "Bye")) for i in range(6)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, want string")
    got = {r.page_id: r.text for r in H.main_text(df).collect()}
    assert all(want in got[i] for i, _, _, want in rows)
    assert rows[3][3] not in H.extract(rows[3][2], [])  # alone, the page would take the extra line


def test_an_article_in_a_box_of_a_bad_name():
    page = "<body><div id='sidebar'><p>" + "The article, in a box of a bad name. " * 9 + "</p></div><p>Other.</p></body>"
    assert "The article" in H.extract(page, [])


def test_deep_nesting_takes_linear_room():
    deep = 60_000
    page = "".join(f"<div class='c{i % 7}'>a{i} " for i in range(deep)) + "</div>" * deep
    assert H.extract(page, []).startswith("a0\n\na1")
    assert H.extract("<b>" * deep + "x" + "</i>" * deep, []) == "x"


def test_extra_columns_and_odd_urls(spark):
    rows = [(i, u, "<article><p>Body text.</p></article>", "mine", "path") for i, u in enumerate(("HTTP://U:p@A.example:80/x", "//b.example", "no url", "", None, "http://"))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, path string")
    got = H.main_text(df)
    assert got.columns == ["page_id", "url", "html", "path", "text"] and {(r.text, r.path) for r in got.collect()} == {("Body text.", "path")}
    hosts = [r[0] for r in df.select(H.host(df.url)).collect()]
    assert hosts == ["a.example", "b.example", "", "", "", ""]


def test_generated_pages_against_their_articles_and_plain_sums(spark):
    """Pages of known articles, and the whole vote by hand."""
    import random
    from collections import defaultdict
    from html import escape

    random.seed(8)
    words = lambda n: " ".join(random.choice("Lorem ipsum & dolor <sit> \"amet\" élan".split()) for _ in range(n))
    rows = []
    for i in range(60):
        k, blocks = i % 4, [words(random.randint(1, 40)) for _ in range(random.randint(2, 7))]
        mark = lambda x, j: (f"<h2>{x}</h2>", f"<p>{x}", f"<p>{x}</p>", f"<ul><li>{x}</ul>", f"<blockquote>{x}</blockquote>")[(i + j) % 5]
        parts = [mark(escape(b).replace(" ", random.choice([" ", "\n ", " <i>", "&#32;"]), 1), j) for j, b in enumerate(blocks)]
        if i % 3 == 0:
            parts.insert(1, "<div class='ad-box'>Buy</div>")
        body = "".join(parts)
        art = (f"<article>{body}</article>", f"<div id='main-{i}' class='post p{i}'>{body}</div>", f"<main><div class=text>{body}</div></main>", f"<table><tr><td class='story s{i}x'>{body}</table>")[k]
        html = f"<!doctype html><title>T</title><header>Top</header><nav><ul><li><a href=/>Home</a></ul></nav>{art}<section class='comments'><p>{words(20)}</section><footer>End</footer>"
        rows.append((i, f"http://h{k}.example/{i}", html, "\n\n".join(" ".join(b.split()) for b in blocks)))
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, want string")
    got = {r.page_id: r.text for r in H.main_text(df).collect()}
    assert [i for i, _, _, want in rows if got[i] != want] == []
    sums = defaultdict(lambda: defaultdict(lambda: [0, 0, 0]))
    for _, u, html, _ in rows:
        for p, s, lead in H.Page(html).votes():
            x = sums[u.split("/")[2]][p]
            x[0], x[1], x[2] = x[0] + 1, x[1] + s, x[2] + lead
    for i, u, html, _ in rows:
        assert got[i] == H.extract(html, {p: (s, d) for p, (n, s, d) in sums[u.split("/")[2]].items() if n > 1})
