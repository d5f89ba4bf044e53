import html
import re

import numpy as np
from pyspark.sql import functions as F

from lumenbar.llm.html_diff import (
    ARTICLE,
    NAMED,
    NEAR,
    OPEN,
    Page,
    common_lines,
    lines_of,
    main_text,
)


def longest(a, b):
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            d[i + 1, j + 1] = d[i, j] + 1 if a[i] == b[j] else max(d[i, j + 1], d[i + 1, j])
    return d[-1, -1]


def test_longest_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = (rng.integers(0, 6, rng.integers(0, 30)) for _ in range(2))
        found = common_lines(a, b)
        assert len(found) == longest(a, b)
        rest = iter(b.tolist())
        assert all(any(x == y for y in rest) for x in a[found].tolist())
    many = np.arange(30_000) % 7
    assert len(common_lines(many, many[1:])) == 29_999


def test_lines_and_places():
    page = (
        "<html><head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body>"
        "<nav><a href='/x'>menu</a></nav><div class='cookie-notice'>we use</div>"
        "<p>free &amp; easy<br>second\n  line</p><div id=comments><p>first!</p></div>"
        "<article class='has-sidebar'>a<b>b</b>c<p>d &lt;e&gt;<aside>more</aside><form>f</form></article>"
        "<!-- <p>gone</p> --><footer>&copy; me</footer><p>tail <textarea>x</textarea>"
    )
    lines, places = lines_of(page)
    assert lines == ["menu", "we use", "free & easy", "second line", "first!", "abc", "d <e>",
                     "more", "f", "© me", "tail"]
    assert places == [NAMED, NAMED, OPEN, OPEN, NAMED, ARTICLE, ARTICLE, NAMED, NAMED, NAMED, OPEN]
    assert lines_of("") == ([], []) and lines_of("<<p>a < b") == (["<", "a < b"], [OPEN, OPEN])


def test_pages_equal_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = {r.page_id: r for r in main_text(pages).collect()}
    for page in pages.collect():
        inside = re.search(r"<article>(.*?)</article>", page.html, re.S)[1]
        blocks = re.sub(r"</?(?:p|h1|br|li|ul)[^>]*>", "\n", inside)
        text = re.sub(r"<[^>]*>", "", blocks)
        want = [re.sub(r"\s+", " ", html.unescape(b)).strip() for b in text.split("\n")]
        row = rows.pop(page.page_id)
        assert row.text == " ".join(w for w in want if w)
        assert row.n_chars == len(row.text) and row.url == page.url
    assert not rows


def test_neighbours_shared_lines_go(spark):
    rows = [(i, f"http://www.h.org/a/{i}?x", f"<p>Top of h</p><p>own {i}</p><p>Bottom</p>") for i in range(6)]
    rows += [(10, "http://other.org/a/1", "<p>Top of h</p>"), (11, None, None), (None, "x", "<p>z</p>")]
    rows += [(20, "http://copy.org/1", "<article>same</article>"), (21, "http://copy.org/2", "<article>same</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages = pages.withColumns({c: F.lit("clash") for c in ("id", "path", "text", "lines", "n_chars")})
    found = main_text(pages).collect()
    got = {r.page_id: r.text for r in found}
    assert len(found) == len(rows) and got[10] == "Top of h" and got[11] == "" and got[None] == "z"
    assert [got[i] for i in range(6)] == [f"own {i}" for i in range(6)]
    assert got[20] == got[21] == "same"


def test_empty_table_and_long_page(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert main_text(empty).count() == 0
    long = "<p>line of text</p>" * 20_000
    rows = main_text(spark.createDataFrame([(1, "u", long), (1, "u", long)], empty.schema)).collect()
    assert len(rows) == 2


def texts(spark, rows, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        pages = spark.createDataFrame(rows, "page_id long, url string, html string")
        return {r.page_id: r.text for r in main_text(pages.repartition(partitions)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_unlisted_names_and_class_words_inside_articles(spark):
    rows = [
        (
            i,
            f"http://h.org/news/{i}",
            f"<main><h1>Title {i}</h1><div class='k9'>Subscribe to our list today</div>"
            f"<div class='art-share-price'>The share price is {i}</div>"
            f"<div id='comment-on-law'>A law of {i}</div><div class='ad-box'>buy {i}</div>"
            f"<p>Body {i}</p></main>",
        )
        for i in range(4)
    ]
    want = {i: f"Title {i} The share price is {i} A law of {i} Body {i}" for i in range(4)}
    for partitions in (1, 8):
        assert texts(spark, rows, partitions) == want


def test_article_lines_need_every_neighbour_and_twins_say_nothing(spark):
    body = [f"<p>Sentence {i} of a story that is long enough</p>" for i in range(12)]
    story = "".join(body)
    story_text = " ".join(b[3:-4] for b in body)
    quote = "<p>quoted by two pages only</p>"
    top = "<div class='x1'>Top of the site</div>"
    rows = [
        (1, "http://h.org/a/1", f"{top}<article><p>one</p>{quote}</article>"),
        (2, "http://h.org/a/2", f"{top}<article><p>two</p>{quote}</article>"),
        (3, "http://h.org/a/3", f"{top}<div>{story}</div>"),
        (4, "http://h.org/a/4", f"{top}<div>{story}</div>"),
        (5, "http://h.org/a/5", f"{top}<article><p>five</p></article>"),
    ]
    want = {1: "one quoted by two pages only", 2: "two quoted by two pages only", 3: story_text,
            4: story_text, 5: "five"}
    for partitions in (1, 8):
        assert texts(spark, rows, partitions) == want


def test_texts_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(45):
        lines = [f"<div>section {i // 5}</div>", f"<p>own {rng.integers(1e9)}</p>", "<div>end</div>"]
        lines += [f"<p>some {rng.integers(4)}</p>"] * int(rng.integers(3))
        rows.append((i, f"http://h{i // 15}.org/{i % 15 // 2}", "".join(lines)))
    rows += rows[:3] * 4 + [(None, None, "<p>z</p>"), (None, "http://h0.org/1", None)]
    first = texts(spark, rows, 1)
    assert all(f"section {i // 5}" not in first[i] and "own" in first[i] for i in range(45))
    assert first == texts(spark, rows, 40) == texts(spark, rows, 7)


def test_texts_equal_a_plain_version(spark):
    """Every page against the nearest unlike pages of its host, found by a plain scan."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()

    def path(p):
        return re.sub(r"^[a-z]+://(www\.|m\.)?|[?#].*$", "", p.url.lower()).rstrip("/")

    order = sorted(pages, key=lambda p: (path(p), p.page_id))
    parsed = [Page(path(p), *lines_of(p.html)) for p in order]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(pages)).collect()}
    for i, (p, own) in enumerate(zip(order, parsed)):
        sides = []
        for step in (-1, 1):
            near = [parsed[i + step * d] for d in range(1, NEAR + 1) if 0 <= i + step * d < len(order)]
            sides.append([x for x in near if x.host == own.host and own.unlike(x)])
        asked = [s[0] for s in sides if s]
        if len(asked) == 1:
            asked = (sides[0] + sides[1])[:2]
        every = sides[0] + sides[1]
        near, far = ([set(common_lines(own.hashes, x.hashes)) for x in side] for side in (asked, every))
        keep = [
            line
            for k, (line, place) in enumerate(zip(own.lines, own.places))
            if (place == OPEN and not any(k in x for x in near))
            or (place == ARTICLE and (len(far) < 2 or not all(k in x for x in far)))
        ]
        assert got.pop(p.page_id) == " ".join(keep)
    assert not got
