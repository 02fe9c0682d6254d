from siftwell.llm.html import extract, main_text

LONG = "This is a long paragraph of the article with many words in it, so that it is dense. "
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href=/>Site</a></header><nav><ul><li><a href="/a">A menu<li><a>B</a></ul></nav><div class="ad big">Buy now</div><div id="cookie-notice">We use cookies</div>
<div class=wrap><div class=content><h1>A &amp; B&nbsp;title</h1><p><b>First {long}<br>line<p>Second&#10;  {long}<ul><li>one<li>two</ul><form><input><p>sign up</form><section><p>Third {long}</p></section></div>
<aside>Side {long}</aside><div class="comments"><p>Reader says {long}</p></div></div><footer>&copy; x</footer></body></html>""".replace("{long}", LONG)


def test_article():
    text = main_text(PAGE)
    assert text.split("\n\n") == ["A & B title", "First " + LONG + "line", "Second " + LONG.strip(), "one", "two", "Third " + LONG.strip()]


def test_cut_off_and_odd_pages():
    assert main_text(None) == "" and main_text("") == "" and main_text("<nav>x</nav>") == ""
    assert main_text("plain &lt;text&gt;  here") == "plain <text> here"
    assert main_text("<article><h1>H&am</h1><p>cut o") == "H&am\n\ncut o"
    assert main_text("<div " * 20000) == ""
    assert main_text("<div>" * 5000 + "deep" + "</div>" * 10) == "deep"
    assert main_text("<p>a<p title='x>y'>b") == "a\n\nb"
    assert main_text("<p>a <!-- no --> b<script>x</scr</script> c") == "a b c"


def test_frame(spark):
    df = spark.createDataFrame([(1, None, None, "t"), (None, "u", PAGE, "t"), (2, "u", "", "t")], "page_id long, url string, html string, text string")
    out = {r["page_id"]: r for r in extract(df).collect()}
    assert out[1]["n_chars"] == 0 and out[2]["text"] == "" and out[None]["n_chars"] == len(main_text(PAGE))
    assert extract(df.limit(0)).count() == 0


def test_attribute_values_and_slugs_keep_the_article():
    parts = ['<p>See <a href="/the-hidden-city.html" title="A hidden gem">the city</a> {long}</p>', '<p data-id="comments" data-role="navigation" data-class="ad" alt=\'a hidden id="ads" one\'>Data {long}</p>', '<h2 id="related-work">Related work</h2>', '<h2 id=notice class="share">Notice</h2>', '<section id="social-life"><p class="notice">Social {long}</p></section>']
    body = "".join(parts).replace("{long}", LONG)
    gone = "".join(f"<div {x}>Gone {LONG}</div>" for x in ("hidden", "HIDDEN=''", "data-x='1'hidden", 'class="comments"', "id=related", "aria-hidden=true", "role=navigation", 'title="x" style="display: none"', 'class="ad" class="text"'))
    want = ["See the city " + LONG.strip(), "Data " + LONG.strip(), "Related work", "Notice", "Social " + LONG.strip()]
    for top in ("article", "main"):
        assert main_text(f"<body><{top}>{body}{gone}<section class=related>Gone {LONG}</section><h2 hidden>Gone</h2></{top}><h2 id=related>Gone</h2></body>").split("\n\n") == want
    assert main_text('<div class="text" class="ad">stays</div>') == main_text("<div hidden=false>stays</div>") == "stays"


def test_hostile_pages_take_linear_time():
    import time

    pages = ["<div>" * 40000 + "</p></span>" * 40000, "<b>" * 40000 + "<div></div>" * 40000, "<p><button>" + "<b>" * 40000 + "<div></div>" * 40000, "<div>" * 40000 + "<li></li>" * 40000, "<div>word word</div>" * 40000]
    for page in pages:
        began = time.process_time()
        main_text(page)
        assert time.process_time() - began < 5, page[:30]
