import html as html_lib
import random

import pytest

from tidepool.llm import html_template as H


def site(n, host, rng, first=0, wrap="article"):
    """Pages with everything that is not main text, and the text they should give."""
    rows = []
    say = lambda k: " ".join(rng.choice(["ab", "çd", "e & f", "x < y", "“q”"]) for _ in range(k))
    for i in range(first, first + n):
        title, paras = say(5), [say(rng.randrange(1, 40)) for _ in range(rng.randrange(1, 6))]
        e = html_lib.escape
        box = {"article": ("<article>", "</article>"), "div": ('<div class="post body">', "</div>")}[wrap]
        page = (
            f"<!DOCTYPE html><html lang=en><head><title>{e(title)}</title><style>p{{margin:0}}</style>"
            f'<script>var t="</p><article>";track({i});</script></head><body><nav><ul><li><a href="/{i}">{say(2)[:3]}</a></li></ul></nav>'
            f'<!-- ad {i} --><div class="ad">Buy {i} now</div><div id="cookie-notice">We use cookies {i}</div>'
            f"<aside><p>See {i}</p></aside><form><p>Mail {i}</p></form>{box[0]}<h1>{e(title)}</h1>"
            + "".join(rng.choice(["<p>{}</p>", "<p><b>{}</b><br>", "<P class='x>y'>{}"]).format(e(p).replace(" ", rng.choice([" ", "\n\t ", " "]))) for p in paras)
            + f'{box[1]}<section class="comments"><p>first! {i}</p></section><footer>&copy; {host} &middot; {i}</footer></body></html>'
        )
        rows.append((i, f"https://{host}/en/{i}?q#f", page, "\n".join([title, *paras])))
    return rows


@pytest.mark.parametrize("wrap", ["article", "div"])
def test_every_page_of_generated_sites(spark, wrap):
    rng = random.Random(3)
    rows = site(12, "a.example.com", rng, 0, wrap) + site(2, "small.example.org", rng, 100, wrap) + site(40, "hot.example.net", rng, 200, wrap)
    rows += [(500 + k, rows[20][1], rows[20][2], rows[20][3]) for k in range(30)]  # copies
    rows.append(rows[0])
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h, _ in rows], "page_id long, url string, html string, host string")
    got = sorted(tuple(r) for r in H.extract(df).collect())
    assert got == sorted((i, u, t, len(t)) for i, u, _, t in rows)


def test_template_text_is_left_out_but_copies_are_not_emptied(spark):
    pages = [(i, "http://h.example/x", f"<body><div class=story><p>Read more</p><p>body {i}</p></div></body>") for i in range(8)]
    copies = [(50 + i, "http://c.example/x", "<body><article><p>same</p></article></body>") for i in range(8)]
    df = spark.createDataFrame(pages + copies, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.extract(df).collect()}
    assert all(got[i] == f"body {i}" for i in range(8)) and all(got[50 + i] == "same" for i in range(8))


def test_odd_pages(spark):
    rows = [
        (1, None, "<p>no url &amp; no body"), (2, "http://x.example", None), (3, "http://x.example", ""), (None, "http://x.example", "plain"),
        (4, "::bad", "<article><p>a</p><p> </p><nav>menu</nav><p>b<br>c &#233;&nbsp;d</article><p>out"),
        (5, "http://x.example", "<script>never closed <p>x</p>"), (6, "http://x.example", "a < b <"), (7, "http://x.example", "<article>" * 300 + "deep"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in H.extract(df).collect()}
    assert got[1][0] == "no url & no body" and got[2] == got[3] == got[5] == ("", 0) and got[None][0] == "plain"
    assert got[4][0] == "a\nb\nc é d" and got[6][0] == "a < b <" and got[7][0] == "deep"
    assert H.extract(df.limit(0)).count() == 0


def test_hosts_agree(spark):
    urls = ["http://A.b/c", "//u@h:80/p", "https://x", "ftp+x://q?z", "nohost", None, " http://lead/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(H._host(df.url)).collect()] == [H.host_of(u) for u in urls]


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_classes_below_all_pages(spark):
    """An empty, an error and a cut-off page do not undo the template; a nested class has text of its own."""
    def page(i):
        box = f"<div class=box><p>Facts</p><p>fact {i}</p></div>" if i % 2 else ""
        return f"<body><article><p>Read more here</p><p>story {i}</p>{box}</article></body>"

    bad = [(50, "http://h.example/", ""), (51, "http://h.example/", "<body><p>error 500</p></body>"), (52, "http://h.example/", "<body><article><p>Read more here")]
    got = texts(spark, [(i, "http://h.example/", page(i)) for i in range(20)] + bad)
    assert all(got[i] == (f"story {i}\nfact {i}" if i % 2 else f"story {i}") for i in range(20))
    assert (got[50], got[51]) == ("", "error 500")


def test_text_of_copies_is_no_template(spark):
    copy = "<body><article><p>long story</p><ul><li>one</li><li>two</li></ul></article></body>"
    rows = [(i, "http://c.example/", copy) for i in range(8)] + [(50 + i, "http://c.example/", f"<body><article><p>page {i}</p></article></body>") for i in range(5)]
    got = texts(spark, rows)
    assert all(got[i] == "long story\none\ntwo" for i in range(8)) and got[50] == "page 0"


def test_the_slot_is_the_whole_article(spark):
    def page(i):
        return f"<body><article><h1>Title {i}</h1><p>lead {i}</p><div class=body><p>{f'long {i} ' * 20}</p></div><section><p>rest {i}</p></section></article></body>"

    got = texts(spark, [(i, "http://h.example/", page(i)) for i in range(9)] + [(50, "http://few.example/", page(50))])
    assert all(got[i] == "\n".join([f"Title {i}", f"lead {i}", f"long {i} " * 19 + f"long {i}", f"rest {i}"]) for i in [*range(9), 50])


@pytest.mark.parametrize("wrap", ["layout has-sidebar", "with-banner", "page-sidebar", "widget"])
@pytest.mark.parametrize("box", ["article", "main", "div"])
def test_a_name_around_the_text_does_not_empty_it(spark, wrap, box):
    def page(i):
        return f"<body><div class='{wrap}'><{box}><p>text of page {i} that goes on</p></{box}><div class=sidebar>Buy {i}</div></div><div class=comments><article>hi {i}</article></div></body>"

    got = texts(spark, [(i, "http://h.example/", page(i)) for i in range(9)])
    assert all(got[i] == f"text of page {i} that goes on" for i in range(9))


INSIDE = [
    ("<header class='entry-header'><h1>Title {i}</h1></header>", "Title {i}"),
    ("<p>lead {i}</p>", "lead {i}"),
    ("<section class='discussion'><h2>Discussion {i}</h2><p>what follows {i}</p></section>", "Discussion {i}\nwhat follows {i}"),
    ("<div class='rail'><p>by rail {i}</p></div>", "by rail {i}"),
    ("<section class='market-share'><p>a third {i}</p></section>", "a third {i}"),
    ("<ul class='menu'><li>soup {i}</li><li class=x>fish {i}</ul>", "soup {i}\nfish {i}"),
    ("<blockquote class='alert'>mind the gap {i}</blockquote>", "mind the gap {i}"),
    ("<p>press {i} <button>Start {i}</button></p>", "press {i}\nStart {i}"),
    ("<h2 class='share'>Share prices {i}</h2>", "Share prices {i}"),
    ("<p class='cookie-notice'>We use cookies {i}<p class='x'>after {i}</p>", "after {i}"),
    ("<ul><li class='ad'>Buy {i}<li>kept {i}</li></ul>", "kept {i}"),
    ("<div class='ad-slot'><p>Buy {i}</p></div><div class='related-posts'><p>More {i}</p></div>", ""),
    ("<form><p>Mail {i}</p></form><div class='newsletter-signup'>Join {i}</div>", ""),
    ("<section class='comments'><article><p>first! {i} and very much longer than all of the article's own text taken together {i}</p></article></section>", ""),
]


@pytest.mark.parametrize("pages", [1, 8])
@pytest.mark.parametrize("box", ["article", "main", "div class=wrap><article"])
def test_what_stands_in_an_article_stays(spark, pages, box):
    def page(i):
        end = "</article></div>" if box.startswith("div") else f"</{box}>"
        inner = "".join(h for h, _ in INSIDE).replace("{i}", str(i))
        return f"<body><header class='site'><h1>Site</h1></header><p class='cookie-notice'>Cookies!</p><{box}>{inner}{end}<div class=rail>x {i}</div><ul class=menu><li>m {i}</ul></body>"

    want = lambda i: "\n".join(t for _, t in INSIDE if t).replace("{i}", str(i))
    got = texts(spark, [(i, "http://h.example/", page(i)) for i in range(pages)])
    assert got == {i: want(i) for i in range(pages)}


def test_a_very_long_page_and_a_name_on_most_of_the_article(spark):
    body = " ".join(f"w{k}" for k in range(300_000))
    rows = [(1, "http://l.example/", f"<body><article><p>{body}</p></article></body>"), (2, "http://m.example/", "<article><h1>T</h1><div class='notice'><p>the whole story is here</p></div></article>")]
    assert texts(spark, rows) == {1: body, 2: "T\nthe whole story is here"}
