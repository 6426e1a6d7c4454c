import pytest

from meshspan.llm.html_extract import extract, html_extract

PARA = "A sentence of an article that is long enough to count as text, with commas and all. " * 3
P = PARA.strip()


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("plain words, no markup at all", "plain words, no markup at all"),
    (f"<nav><ul><li><a href='/a'>A</a></li></ul></nav><div class=\"ad\">Buy now</div><article><h1>T &amp; U</h1><p><b>{P}<br><p>{P}</p></article><footer>&copy; me</footer>", f"T & U\n{P}\n{P}"),
    (f"<body><header>Site</header><div><h2>Head</h2><p>{P}</p>\n<p>Short end.</p></div><div class='sidebar'><p>{P}</p></div><form>{P}<input></form><div id=comments><p>{P}</p></div></body>", f"Head\n{P}\nShort end."),
    (f"<script>if (a<b) document.write('<p>{P}</p>')</script><style>p{{}}</style><main><p>{P}</p><aside>{P}</aside></main>", P),
    (f"<p>x &lt; y &#65; &nbsp; {P}</p><!-- <p>hidden</p> -->", f"x < y A {P}"),
    (f"<div style='display:none'>{P}</div><section><p>{P}</p></section><div role=navigation>{P}</div>", P),
    (f"<article><p>{P}</p></article><section class=\"comment-list\"><article><p>{P}</p></article></section>", P),
    (f"<article><p>{P} <a href='x'>linked words</a> and more</p><ul><li>one</li><li>two</li></ul><p>cut off", f"{P} linked words and more\none\ntwo\ncut off"),
    ("<ul><li><a href=/>Home</a></li></ul>", ""),
])
def test_pages(page, want):
    assert extract(page) == want


def test_frame(spark):
    rows = [(1, "u", f"<article><p>{P}</p></article>", "x"), (None, None, None, None), (2, "v", "<p>" + "long text " * 50_000, "x"), (2, "v", "", "x"), (3, "w", "<" * 5000 + "a" * 10 + "<p", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {(r.page_id, r.n_chars, r.text[:10]) for r in html_extract(df).collect()}
    assert (1, len(P), P[:10]) in got and (None, 0, "") in got and (2, 499_999, "long text ") in got and (2, 0, "") in got
    assert html_extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("page, want", [
    # the surge decides, not the tag: a marked teaser is not the text of the page
    (f"<body><article><p>Short teaser of a story.</p></article><div><p>{P}</p><p>{P}</p></div></body>", f"{P}\n{P}"),
    # the dive ends an article before its list of links
    (f"<article><p>{P}</p><p>{P}</p><ul><li><a href=/1>One more story</a></li><li><a href=/2>Another story</a></li></ul></article>", f"{P}\n{P}"),
    # spans of one container stay together, whatever their share
    (f"<body><div><p>{P}</p>{'<p><a href=/x>linked</a></p>' * 4}<p>A short last word.</p></div><div><p>Other.</p></div></body>", f"{P}\n" + "linked\n" * 4 + "A short last word."),
    # a mark cuts the span that runs past it
    (f"<article><h1><a href=/t>Title</a></h1><p>{P}</p></article><div><p>{P}</p></div>", f"Title\n{P}"),
])
def test_surge_and_dive_decide(page, want):
    assert extract(page) == want


def test_the_threshold_decides_what_is_text():
    """A run of short lines of its own beside the article is text without a threshold, and none with it."""
    links = "".join(f"<li><a href=/{i}>Story {i}</a></li>" for i in range(5))
    short = "".join(f"<p>Twenty characters {i}.</p>" for i in range(6))
    page = f"<body><div><p>{P}</p></div><ul>{links}</ul><div>{short}</div></body>"
    lines = [f"Twenty characters {i}." for i in range(6)]
    assert extract(page, surge=0) == "\n".join([P, *lines])
    assert extract(page, surge=80) == P
    assert extract(f"<body><div>{short}</div><ul>{links}</ul><div><p>Less text.</p></div></body>", surge=80) == "\n".join(lines)  # nothing surges


@pytest.mark.parametrize("name, kept", [("ad", False), ("ad-slot-2", False), ("comment-list", False), ("cookieNotice", False), ("related-posts", False), ("chapter", True), ("legal-news", True), ("tags-of-history", True), ("alert-systems", True), ("header-of-state", True)])
def test_names_of_blocks(name, kept):
    assert extract(f"<article><p>{P}</p><section class='{name}'><p>{P}</p></section></article>") == (f"{P}\n{P}" if kept else P)


@pytest.mark.parametrize("page, want", [
    # a title and an introduction before the article inside the main part
    (f"<main><h1>Title</h1><p>Intro here.</p><article><p>{P}</p></article></main>", f"Title\nIntro here.\n{P}"),
    # a paragraph that is one link, in the middle
    (f"<div><p>{P}</p><p><a href=/x>{P}</a></p><p>{P}</p></div>", f"{P}\n{P}\n{P}"),
    # several articles, long and short
    (f"<article><p>{P}</p><p>{P}</p><p>{P}</p><p>{P}</p><p>{P}</p></article><article><p>{P[:120]}</p></article>", "\n".join([P] * 5 + [P[:120].strip()])),
])
def test_nothing_else_is_dropped(page, want):
    assert extract(page) == want


@pytest.mark.parametrize("piece", ["<b>x", "<div>x", "<li>x", "<p><b>x", "<a href=x>y<div></div>", "<h1>x", "<article>x", "</b>x", "<<", "<a '", "<main><section>x"])
def test_open_tags_take_linear_time(piece):
    import time

    began = time.process_time()
    extract(piece * (256_000 // len(piece)))
    assert time.process_time() - began < 4


def test_window_sums_by_brute_force():
    import random

    from meshspan.llm.html_extract import spans

    rnd = random.Random(4)
    for _ in range(400):
        w = [rnd.choice([0, 0, 0, 5, 40, 90, 200]) for _ in range(rnd.randrange(0, 30))]
        window, surge = rnd.choice([1, 2, 3, 5]), rnd.choice([0, 80])
        total = lambda i: sum(w[i : i + window])  # noqa: E731, B023
        want, i = [], 0
        while i < len(w):
            if total(i) > surge and w[i]:
                j = next((j for j in range(i, len(w)) if total(j) == 0), len(w))
                want.append((i, j))
                i = j
            else:
                i += 1
        assert spans(w, window, surge) == want


def test_repeated_rows_agree(spark):
    row = (1, "u", f"<p>{P}</p>")
    got = html_extract(spark.createDataFrame([row] * 3, "page_id long, url string, html string")).collect()
    assert len(got) == 3 and len(set(got)) == 1 and got[0].text == P
