import pytest

from trustscore.llm import html_templates

PAGES = "page_id long, url string, html string"


def read(page, url="http://h.example/a"):
    return html_templates.Page(url, page).text() if page else ""


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p>a<p>b</b> c", "a\n\nb c"),
        ("<ul><li>x<li>y</ul>z", "x\n\ny\n\nz"),
        ('<div class="ad">q</div><main>hi<br>there &amp; &nbsp;you<div class="cookie-notice">no</div></main>', "hi there & you"),
        ("<article><header>h</header><h1>T</h1><p>a<!-- x --><b>b</b></p></article><footer>f", "T\n\nab"),
        ('<article>a<section class="comments"><article>c</article></section></article>', "a"),
        ("<body><nav>m</nav>plain < text &copy; &#233;&am<script>var t='</p>';</script><style>p{}</style></body>", "plain < text © é&am"),
        ("<ARTICLE><P>A</P><FORM>f</FORM><ASIDE>s</ASIDE></ARTICLE>", "A"),
        ('<div title="a > b">in</div>', "in"),
        ("<article><p><b>one<br><p>two</p></article>", "one\n\ntwo"),
        ("<article>\n a \t b\n\n</article>", "a b"),
        ('<div class="has-sidebar"><article class="menu">kept</article></div>', "kept"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n\n2\n\n3"),
        ("", ""),
        (None, ""),
    ],
)
def test_main_text(page, text):
    assert read(page) == text


def test_recurring_subtrees_go_and_running_text_stays(spark):
    shared = '<p class="x">Read our other stories.</p>'

    def page(number, host):
        site = '<div class="q7"><p>Join us today</p></div>'
        return f"<body>{site}<h1>Title {number}</h1><p>Own text {number} goes on for a while, long enough to count.</p>{shared}</body>"

    rows = [(i, f"http://big.example/{i}", page(i, "big")) for i in range(12)]
    rows += [(100 + i, f"http://small.example/{i}", page(i, "small")) for i in range(3)]
    # Copies of one page are one main text, so nothing of it recurs.
    rows += [(200 + i, f"http://copy.example/{i}", page(1, "copy")) for i in range(12)]
    rows += [(300 + i, f"http://art.example/{i}", f"<article><p>Own {i}</p>{shared}</article>") for i in range(12)]
    got = {r.page_id: r.text for r in html_templates.extract(spark.createDataFrame(rows, PAGES)).collect()}
    for i in range(12):
        assert got[i] == f"Title {i}\n\nOwn text {i} goes on for a while, long enough to count."
        assert "Join us today" in got[200 + i] and "Read our other stories." in got[200 + i]
        assert got[300 + i] == f"Own {i}\n\nRead our other stories."
    assert all("Join us today" in got[100 + i] for i in range(3))


def by_hand(rows, min_pages, share):
    """Texts after deleting what recurs, counted over all pages at once without Spark."""
    pages = [html_templates.Page(url, page) for _, url, page in rows]
    seen, mains = {}, {}
    for page in pages:
        text = page.text()
        mains.setdefault(page.host, set()).add(text)
        for name in page.template_names(len(text)):
            seen.setdefault((page.host, name), set()).add(text)
    gone = {name for (host, name), texts in seen.items() if len(texts) >= max(min_pages, share * len(mains[host]))}
    return [html_templates.Page(url, page, frozenset(gone)).text() for _, url, page in rows]


def test_templates_differ_in_ids_links_and_numbers_and_follow_the_host(spark):
    rows = []
    for i in range(60):
        box = f'<div id="b{i}" class="box post-{i} wide"><a href="/next/{i}" data-at="{i}">Read  on</a></div>'
        rare = '<div class="q">Seen seldom.</div>' if i < 5 else ""
        rows.append((i, f"http://one.example/{i}", f"<body>{box}<div><p>Own story number {i} told at some length.</p></div>{rare}</body>"))
        rows.append((None, f"http://two.example/{i % 5}", f"<body><p>Another story {i % 5} of its own.</p><div class='w v'>Shop\nnow</div></body>"))
    frame = spark.createDataFrame(rows, PAGES)
    for share, seldom in ((0.05, False), (0.2, True)):
        got = sorted(r.text for r in html_templates.extract(frame, 4, share).collect())
        assert got == sorted(by_hand(rows, 4, share))
        assert not any("Read on" in text or "Shop now" in text for text in got)
        assert any("Seen seldom." in text for text in got) is seldom
    kept = [r.text for r in html_templates.extract(frame, 10**9).collect()]
    assert sum("Read on" in text or "Shop now" in text for text in kept) == len(rows)  # every page is changed by the deletion


def test_edges(spark):
    rows = [(None, None, None, 1), (None, None, "<p>x</p>", 2), (5, "", "<p>y</p>", 3), (5, "http://u", "<p>y</p>", 3)]
    frame = spark.createDataFrame(rows, PAGES + ", names int")
    assert sorted(r.text for r in html_templates.extract(frame).collect()) == ["", "x", "y", "y"]
    assert html_templates.extract(frame.limit(0)).count() == 0


def test_long_and_broken_pages_end():
    assert len(read("<article>" + "<p>x &amp; y</p>" * 30_000 + "</article>").split("\n\n")) == 30_000
    assert read("<article>" + "<div>" * 5_000 + "deep") == "deep"
    assert read("<article>" + "<a " * 20_000)


def test_attribute_values_of_any_length_are_whole():
    long = "A1b2" * 5_000
    for value in (f'"data:image/png;base64,{long}"', f'"{long} > <p>leak</p> {long}"', f"'{{\"hidden\": \"{long}\", \"class\": \"ad\"}}'"):
        page = f'<body><p class="w">before</p><div data-x={value}><p class="x">text</p><p title="z">more</p></div>end</body>'
        assert read(page) == "before\n\ntext\n\nmore\n\nend"


def test_stray_quotes_end_with_their_tag():
    assert read('<body><p title="5" disk">one</p><p class="x">two</p></body>') == "one\n\ntwo"
    assert read("<body><a href='x>one</a> two</body>") == "one two"
    assert len(read("<body>" + '<a =">" ' * 40_000)) > 0
    assert len(read("<body>" + '<a b=">"' * 40_000 + "'>" * 40_000)) > 0


@pytest.mark.parametrize(
    "page, text",
    [
        ('<body><div class="has-sidebar"><p>Long running text.</p><div class="sidebar"><p>side</p></div></div></body>', "Long running text."),
        ('<div id="page-header-wrap"><div class="menu"><a>Home of it all</a></div><div class="has-ads">Running text.</div></div>', "Running text."),
        ('<article><h1>T</h1><div class="entry-share-enabled"><p>Running text.</p></div><div class="share">s</div></article>', "T\n\nRunning text."),
        ('<main><div class="content-with-notice">Running text.</div><div class="notice">n</div></main>', "Running text."),
        ('<body><div class="menu"><a>One link</a> <a>Another link</a></div><p>Text.</p></body>', "Text."),
        ('<article>Text.<div class="comments"><article>A long comment on it.</article></div></article>', "Text."),
        ('<body><div class="sidebar">More here<article>Teaser</article></div><nav>m</nav></body>', "Teaser"),
        ('<main><article>Text.</article><div class="related">More of it<article>Teaser</article></div></main>', "Text."),
    ],
)
def test_no_name_deletes_most_of_the_text(page, text):
    assert read(page) == text
