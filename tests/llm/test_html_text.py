import pytest

from weekwatch.llm import html_text

PAGES = {
    "": "",
    "no markup at all": "no markup at all",
    "<p>One<p>two <b>three\n four</b><br>five": "One\n\ntwo three four five",
    '<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href=x>Menu'
    '</a></li></ul></nav><div class="ad">Buy this, now.</div><article><h1>Head &amp; tail</h1><p><b>Bold, text.<br><p>A'
    " long paragraph, with commas, and more. It goes on.</p><p>End.</p></article><footer>&copy; me</footer></body></html>":
    "Head & tail\n\nBold, text.\n\nA long paragraph, with commas, and more. It goes on.\n\nEnd.",
    "<body><header><h1>Site</h1></header><div id=cookie-notice>We use cookies.</div><div class=content><h2>Hi</h2><p>One,"
    " two.</p><ul><li>x<li>y</ul><div class='comments'><p>I disagree, strongly, with all of it.</p></div></div>"
    "<form><p>Your name, please.</p></form><aside>Also read this.</aside></body>": "Hi\n\nOne, two.\n\nx\n\ny",
    "<article><p>cut off <b>in a t": "cut off in a t",
    "<p>a<!-- no --> b</p><!-- open": "a b",
    "<p>&lt;tag&gt; &#233;&nbsp;&euro; &am &amp</p>": "<tag> é € &am &",
    "<noscript>off</noscript><textarea>x</textarea><p hidden>h</p><p aria-hidden='true'>h</p><p>seen</p>": "seen",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert html_text.main_text(page) == PAGES[page]


def test_long_page_is_kept_whole():
    page = "<main>" + "".join(f"<p>Sentence number {i}, of many.</p>" for i in range(20_000)) + "</main>"
    assert html_text.main_text(page).count("\n\n") == 19_999
    assert html_text.main_text("<div>" * 3_000 + "deep") == "deep"


def test_table(spark):
    rows = [(1, "u", "<p>a b</p>", "old"), (1, "u", "<p>a b</p>", "old"), (None, None, None, "old")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(df).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(1, "a b", 3), (1, "a b", 3), (None, "", 0)]
    assert html_text.extract(df.limit(0)).count() == 0


def test_page_without_article_keeps_all_content():
    items = "".join(f"<li>Item number {i} is a long line, with commas, and it holds most of the text.</li>" for i in range(12))
    page = f"<body><div id=content><h1>Head</h1><p>First, a paragraph.</p><p>Second, another.</p><ul>{items}</ul></div></body>"
    got = html_text.main_text(page).split("\n\n")
    assert got[:3] == ["Head", "First, a paragraph.", "Second, another."] and len(got) == 15


@pytest.mark.parametrize("tag", ["div", "section", "article"])
def test_two_parts_are_both_kept(tag):
    part = lambda name, n: f"<{tag}>" + "".join(
        f"<p>{name} sentence {i}, of many, in a part of the page.</p>" for i in range(n)) + f"</{tag}>"
    got = html_text.main_text(f"<body>{part('Large', 16)}{part('Small', 4)}</body>")
    assert got.count("Large") == 16 and got.count("Small") == 4


def test_chrome_of_low_score_outside_content_goes():
    links = "".join(f"<div><a href=x>L{i}</a></div>" for i in range(30))
    body = "".join(f"<p>Sentence {i}, of many, is long enough, and has marks; it is content.</p>" for i in range(20))
    got = html_text.main_text(f"<body><section>{links}</section><main><h2>Hi</h2>{body}</main></body>")
    assert got.startswith("Hi\n\nSentence 0") and "L3" not in got


BODY = "".join(f"<p>Sentence {i}, of many, is long enough, and has marks; it is content.</p>" for i in range(12))


@pytest.mark.parametrize("page", [
    '<div class="layout no-sidebar">%s</div>', '<div class="page has-sidebar"><article>%s</article></div>', '<div id="ad-free">%s</div>',
    '<div class="social-policy">%s</div>', "<body><form action=x>%s</form></body>", '<div class="sidebar">%s</div>',
    '<div class="widget"><div class="sidebar">short</div>%s</div>', '<div id=cookieNotice>We use cookies.</div><div>%s</div>',
])
def test_misleading_names_lose_nothing(page):
    assert html_text.main_text(page % BODY) == "\n\n".join(f"Sentence {i}, of many, is long enough, and has marks; it is content." for i in range(12))


def test_path_scores_decide_where_names_say_nothing():
    page = f"<body><ul><li>Home<li>News<li>Sport</ul><div>{BODY}</div><div>Copyright me</div></body>"
    got = html_text.main_text(page)
    assert got.startswith("Sentence 0") and got.endswith("content.") and got.count("\n\n") == 11
    assert [t for _, t in html_text.text_nodes(page)][:3] == ["Home", "News", "Sport"]  # no list of names has dropped them


def test_a_class_of_two_words_in_an_article_drops_no_paragraph():
    got = html_text.main_text(f'<article>{BODY}<p class="share price">The share price, in euro, fell; it rose again later.</p></article>')
    assert got.endswith("rose again later.") and got.count("\n\n") == 12


def test_marked_comments_longer_than_the_article_still_go():
    page = f"<body><article><h1>Hi</h1><p>One, two.</p></article><div class=comments>{BODY}</div></body>"
    assert html_text.main_text(page) == "Hi\n\nOne, two."
