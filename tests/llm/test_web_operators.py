from __future__ import annotations

import duckdb

from sedgewood.llm import html_extraction, url_filters
from sedgewood.llm._html import read


def page(i, host, body, path="/en/1"):
    return (i, f"https://{host}{path}", f"<!DOCTYPE html><html><head><title>t</title><script>var a='<p>no</p>';</script></head><body>{body}</body></html>")


def test_templates_and_articles(spark):
    menu = "<div><ul><li><a href='/a'>Home</a></li><li><a>About us</a></li></ul></div>"
    pages = [page(i, "a.example.com", f"{menu}<div><p>Text {i} &amp; more<br>of it &eacute;</p><p>Second   line\n{i}</p></div><div>Imprint of the site</div>") for i in range(6)]
    pages += [page(20, "b.example.com", "<nav>x</nav><article><h1>Title</h1><p>One<p>Two<b>!</b></article><aside>y</aside><div class='user-comments'><article>no</article></div>")]
    pages += [(21, None, None), (22, "nourl", ""), (22, "nourl", ""), (None, "http://c.example.org", "plain <text & more"), (23, "https://d.example.org", "<p>" + "long " * 30_000 + "</p>")]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, key string, hashes int")
    got = {}
    for r in html_extraction.extract(df).collect():
        got.setdefault(r["page_id"], []).append((r["text"], r["n_chars"]))
    for i in range(6):
        text = f"Text {i} & more of it é\nSecond line {i}"
        assert got[i] == [(text, len(text))]
    assert got[20] == [("Title\nOne\nTwo!", 14)]
    assert got[21] == [("", 0)] and got[22] == [("", 0)] * 2 and got[None][0][0].startswith("plain")
    assert got[23][0][1] == 5 * 30_000 - 1
    assert html_extraction.extract(df.limit(0)).count() == 0


def test_copied_articles_stay(spark):
    pages = [page(i, "a.example.com", "<div class=ad>Buy</div><article><p>The same article.</p></article><footer>f</footer>") for i in range(9)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r["text"] for r in html_extraction.extract(df).collect()} == {"The same article."}


def test_copied_articles_keep_their_parts(spark):
    body = "<nav>n</nav><article><section><p>First part of it.</p></section><ul><li>An item</li></ul><section><p>Last part of it.</p></section></article>"
    ad = "<div>Buy at our shop</div>"
    pages = [page(i, "a.example.com", f"<div>menu {i}</div>{body}", f"/en/{i % 5}") for i in range(9)]
    # what different pages share goes, though most of them have copies
    pages += [page(20 + i, "b.example.com", f"<div><p>A page of its own, number {i // 2}, with text.</p></div>{ad}") for i in range(8)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(df).collect()}
    assert {got[i] for i in range(9)} == {"First part of it.\nAn item\nLast part of it."}
    assert [got[20 + i] for i in range(8)] == [f"A page of its own, number {i // 2}, with text." for i in range(8)]


def test_reader_closes_what_is_open():
    blocks = read("<ul><li>one<li>two</ul><p>three<div>four</div>five<!-- no --><style>p{}</style>").blocks
    assert blocks == ["one", "two", "three", "four", "five"]
    assert read("<p>a <span class=ad>buy</span> b <button>ok</button></p>c < d<b").blocks == ["a  b ", "c < d<b"]


def text_of(html):
    p = read(html)
    return html_extraction.main_text([html_extraction._clean(b) for b in p.blocks], p.elements, set())


def test_main_text_is_chosen_by_its_length():
    body = "<p>" + "Words of the post itself, and more of them. " * 5 + "</p>"
    plain = text_of(body)
    assert text_of(f"<div class='post'>{body}</div><article class='promo-card'><p>Read also</p></article>") == plain
    assert text_of(f"<article>{body}</article><article><p>A teaser.</p></article>") == plain
    assert text_of(f"<article><header><h1>Title</h1></header>{body}<footer>f</footer></article>") == "Title\n" + plain
    assert text_of(f"<main><div>Intro</div><article class='has-comments'>{body}</article></main>") == plain
    assert text_of(f"<form id='page'><article>{body}</article></form><form>search</form>") == plain
    assert text_of("<article><p>One here.</p></article>" * 5) == "\n".join(["One here."] * 5)


def test_pages_are_read_in_linear_time():
    import time

    start = time.perf_counter()
    for html in ("<div>" * 30_000 + "x", "<a " * 50_000, '<a " ' * 50_000 + ">", "<div><p>a<div>" + "<h1>" * 30_000, "<div>" * 20_000 + "</x>" * 20_000, "< " * 50_000, "<!-- " * 50_000, "<ul>" + "<li>a" * 30_000):
        read(html)
    assert time.perf_counter() - start < 10


def site():
    """Pages without an article: an own text, site parts that recur (a menu, an imprint, a box on some pages), copies and recrawls."""
    rows, menu = [], "<div><ul><li><a href='/a'>Home</a></li><li><a>About us</a></li></ul></div>"
    for i in range(12):
        box = "<section><p>Only some pages have this box.</p></section>" if i < 5 else ""
        twice = "<section><p>Few pages share this note.</p></section>" if i in (7, 8, 9) else ""
        own = f"<div><p>Text number {i} is long enough to be the larger part of all there is, as it says so twice: number {i}.</p></div><div><p>End {i}.</p></div>"
        rows.append(page(i, "a.example.com", f"{menu}{box}{twice}{own}<div>Imprint of the site</div>", f"/en/{i}"))
    two = "<div><p>The first section of a page that is held many times.</p></div><div><p>And the second section of it, of a like length.</p></div>"
    rows += [page(100 + i, "b.example.com", two, "/en/1") for i in range(4)]  # crawled four times
    rows += [page(110 + i, "c.example.com", two, f"/en/{i}") for i in range(4)]  # copied under four urls
    return rows


def test_templates_match_brute_force(spark):
    rows = site()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    own = spark.createDataFrame(rows, "page_id long, url string, html string")
    seen, texts = {}, {}
    for i, url, html in rows:
        p = read(html)
        texts[i] = "\n".join(html_extraction._clean(b) for b in p.blocks)
        for e in p.elements:
            seen.setdefault((url.split("/")[2], e[3]), set()).add(texts[i])
    gone = {k for k, v in seen.items() if len(v) >= 4}
    expected = {}
    for i, url, html in rows:
        p = read(html)
        blocks = [html_extraction._clean(b) for b in p.blocks]
        total, lost = sum(map(len, blocks)), set()
        for a, b, _, h in p.elements:
            if (url.split("/")[2], h) in gone and 2 * sum(map(len, blocks[a:b])) <= total:
                lost |= set(range(a, b))
        expected[i] = "\n".join(b for k, b in enumerate(blocks) if k not in lost)
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(df).collect()}
    assert got == expected
    # the hashes decide: without them menus, boxes and imprints stay
    without = {r["page_id"]: r["text"] for r in html_extraction.extract(own, min_pages=10**9).collect()}
    for i in range(12):
        assert "Home" in without[i] and "Imprint" in without[i] and got[i].startswith("Few pages" if i in (7, 8, 9) else "Text number")
        assert ("some pages" in without[i]) == (i < 5) and "some pages" not in got[i]
    for i in (*range(100, 104), *range(110, 114)):
        assert got[i] == without[i] and "first section" in got[i] and "second section" in got[i]
    # a share of the host's pages, not a number alone
    share = {r["page_id"]: r["text"] for r in html_extraction.extract(own, share=2).collect()}
    assert "some pages" in share[0] and "Imprint" not in share[0]


def web(spark):
    def links(*hosts):
        return "".join(f'<a class="x" href="https://{h}/p">x</a>' for h in hosts)

    rows = [
        page(1, "good.example.net", links("mid.example.com", "GOOD.example.net"), "/en/a"),
        page(2, "spam.other.net", links("mid.example.com"), "/x"),
        page(3, "mid.example.com", links("far.example.com"), "/en/"),
        page(4, "far.example.com", "", "/de/x"), page(5, "far.example.com", "", "/en/x"), page(6, "far.example.com", "", "/en/y"),
        page(7, "feeds.example.com", links("spam.other.net"), "/en/x"), page(8, "alone.example.com", "", ""),
        page(9, "Org.EXAMPLE.org", "", "/fr/x?y"), page(10, "notnet.example.com", "", "/net/"), page(11, "sub.org", "", "/fr/"), page(11, "sub.org", "", "/fr/"),
        (12, None, None), (13, "no-scheme/path", "x"), (14, "http://net#f", None), (15, "http://net/", None), (16, "http://x.example.net/en", ""),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_url_filters(spark):
    df = web(spark)
    got = {r["page_id"]: r for r in url_filters.judge(df).collect()}
    assert [got[i]["rule"] for i in (1, 2, 4, 5, 9, 11, 14, 15, 16)] == ["example.net/en/", "net/", "example.com/de/", None, "org/fr/", "org/fr/", None, "net/", "net/"]
    assert (got[9]["host"], got[9]["path"]) == ("org.example.org", "/fr/x") and (got[12]["host"], got[12]["path"]) == ("", "") and got[13]["host"] == ""
    assert got[7]["verdict"] == "block"  # links to a blocked host
    assert got[3]["verdict"] == "allow" and got[5]["verdict"] == "allow"  # reached by trust
    assert got[8]["verdict"] == got[12]["verdict"] == "allow"


def test_url_filters_match_sql(spark):
    df = web(spark)
    c = duckdb.connect()
    c.register("pages", df.toPandas())
    expected = sorted(map(repr, c.sql(url_filters.judge_sql()).fetchall()))
    assert sorted(repr(tuple(r)) for r in url_filters.judge(df).collect()) == expected
    assert url_filters.judge(df.limit(0)).count() == 0


def test_scores_sum_to_one(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "a")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("x",)], "host string")
    scores = {r["host"]: r["score"] for r in url_filters.propagate(links, seeds).collect()}
    assert abs(sum(scores.values()) - 1) < 1e-9 and scores["a"] > scores["d"] > 0


def test_marked_elements_are_excluded():
    kept = read("<article><p>a</p><div id='userComments'><p>b</p></div><p class='cookiebar'>c</p><section class='post body'>d</section><form>e</form><p hidden>f</p><div role=banner>g</div></article>").blocks
    assert kept == ["a", "d"]


def test_links_are_found_in_linear_time(spark):
    import time

    texts = ["<a " * 350_000, "<a " + "href=" * 200_000, "<a href" + " " * 1_000_000, "<a href=" + " " * 1_000_000 + "'", "<a " + " " * 1_000_000, "<a href='https://x.example.com" * 30_000]
    df = spark.createDataFrame([(f"https://h{i}.example.net/", t) for i, t in enumerate(texts)], "url string, html string")
    start = time.perf_counter()
    got = url_filters.host_links(df).collect()
    assert time.perf_counter() - start < 10
    assert [(r["src"], r["dst"]) for r in got] == [("h5.example.net", "x.example.com")]


def test_class_words_alone_delete_nothing():
    body = "<p>" + "The body of the article, in whole sentences. " * 4 + "</p>"
    plain = text_of(f"<article>{body}</article>")
    for word in ("share", "related", "notice", "banner", "menu", "respond", "widget", "promo"):
        assert text_of(f"<article><h1>T</h1><div class='{word}-price'><p>The price rose. It fell.</p></div><p>end</p></article>") == "T\nThe price rose. It fell.\nend"
        assert text_of(f"<article><h1>T</h1><div class='{word}'>{body}</div><p>end</p></article>") == f"T\n{plain}\nend"
        assert text_of(f"<article>{body}<p>See <a class='{word}' href='/x'>the other one</a> too.</p></article>") == f"{plain}\nSee the other one too."
        # furniture by name and size, or by its links
        assert text_of(f"<article>{body}<div class='{word}-box'><p>Tell a friend.</p></div></article>") == plain
        assert text_of(f"<article>{body}<div class='{word}-price'><a href='/1'>One</a> <a href='/2'>Two</a></div></article>") == plain
    assert text_of("<article><p>As <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> shows.</p></article>") == "As x=2 shows."


def test_comments_by_name_and_structure():
    body, said = "<p>The article itself.</p>", "<p>I liked it. " + "So did I. " * 30 + "</p>"
    for box in (f"<div class='comments'>{said}</div>", f"<section id='commentList'>{said}</section>", f"<div class='user-feedback'><h2>3 responses</h2>{said}</div>", f"<ol><li>12 Kommentare</li><li>{said}</li></ol>"):
        assert text_of(f"<article>{body}{box}</article>") == "The article itself.", box
    assert text_of(f"<article><h1>T</h1><div class='has-comments'>{body}</div></article>") == "T\nThe article itself."
    assert text_of("<article><p>We had</p><p>3 responses</p><p>to the survey.</p></article>") == "We had\n3 responses\nto the survey."


def test_forms_and_suspects_in_linear_time():
    import time

    start = time.perf_counter()
    for html in ("<form>" + "<article>" * 40_000 + "x", "<article class='comment'>x</article>" * 20_000, "<form>" * 20_000 + "<article>" * 20_000 + "x", "<article><div class='share-x'>" * 20_000 + "x"):
        text_of(html)
    assert time.perf_counter() - start < 10


def test_templates_within_articles_go(spark):
    box = "<div><p>Read all of our series on this page.</p></div>"
    rows = [page(i, "a.example.com", f"<article><h1>Title {i}</h1><p>The article of number {i} is a text of its own.</p>{box}</article>", f"/en/{i}") for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    on = {r["page_id"]: r["text"] for r in html_extraction.extract(df).collect()}
    off = {r["page_id"]: r["text"] for r in html_extraction.extract(df, min_pages=10**9).collect()}
    assert all("our series" in off[i] and on[i] == f"Title {i}\nThe article of number {i} is a text of its own." for i in range(8))


def test_long_adverts_beside_a_short_article_go():
    long = "Buy at our shop, today and on every other day. " * 3
    assert text_of(f"<div class='ad'>{long}</div><article><h1>T</h1><p>Short.</p></article><footer>f</footer>") == "T\nShort."
    assert text_of(f"<article><p>Short.</p></article><div class='sidebar'>{long}</div>") == "Short."
    assert text_of(f"<div class='widget'>{long}</div><p>End</p>") == long.strip() + "\nEnd"
