import random
import time

import pytest
from pyspark.sql import functions as F

from ordina.llm.html_extract import DROP, LEAST, best_region, default_weights, extract, extract_text, labelled_pages, read, regions, tokens

W = default_weights()
PAGE = '<html><head><title>T</title></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><article>%s</article><footer>Foot</footer></body></html>'


def words_of(page):
    """The words between bars, by the marks alone."""
    return " ".join(u.text for u in read(page) if hasattr(u, "mark") and u.mark).split()


def test_labelled_pages_not_learned_from():
    right = wrong = missed = 0
    for page in labelled_pages(200, seed=99):
        want, got = words_of(page), extract(page.replace("<bar>", ""), W).split()
        both = sum(min(want.count(w), got.count(w)) for w in set(want))
        right, wrong, missed = right + both, wrong + len(got) - both, missed + len(want) - both
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97


def test_weights_decide():
    zero = dict.fromkeys(W, 0.0)
    pages = [p.replace("<bar>", "") for p in labelled_pages(100, seed=3)]
    assert sum(extract(p, W) != extract(p, zero) for p in pages) > 90
    assert W["nav"] < 0 and W["footer"] < 0 and W[".ad"] < 0 and W["article"] > 0


def test_best_region_is_that_of_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.choice([-3, -1.5, -0.5, 0, 0.5, 1, 2]) for _ in range(rng.randrange(25))]
        sums = {(i, j): sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)}
        a, b, total = best_region(scores)
        assert total == max([0, *sums.values()]) and (not total or sums[a, b] == total)


def test_regions_are_those_of_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        scores = [rng.choice([-4, -1.5, -0.5, 0, 0.5, 1, 3]) for _ in range(rng.randrange(30))]
        falls, i = [], 0  # the runs that cut
        while i < len(scores):
            j = i
            while j < len(scores) and scores[j] <= 0:
                j += 1
            if sum(scores[i:j]) <= -DROP:
                falls.append((i, j))
            i = max(j, i + 1)
        edges, want = [0, *(x for f in falls for x in f), len(scores)], []
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            every = [(sum(scores[i:j]), -i, -j) for i in range(a, b) for j in range(i + 1, b + 1)]
            if every and max(every)[0] >= LEAST:
                want.append(max(every)[0])
        got = regions(scores)
        assert [sum(scores[a:b]) for a, b in got] == want
        assert all(not (a < f[1] and f[0] < b) for a, b in got for f in falls)


@pytest.mark.parametrize(
    "body, want",
    [
        ("<h1>A &amp; B</h1><p>one\n  two</p>", "A & B\none two"),
        ("<p>one <b>bo</b>ld<br>two</p>", "one bold two"),
        ("<p>x &lt;tag&gt; &eacute;&#233;&#xe9;</p>", "x <tag> ééé"),
        ("<p>a &lt; b and 3 < 4 words</p>", "a < b and 3 < 4 words"),
        ("<p>before the advert</p><div class='ad'>buy <p>now</p></div><p>after</p>", "before the advert\nafter"),
        ("<p>before the advert</p><div class=ad>buy</div><p>after</p>", "before the advert\nafter"),
        ("<p>real text here</p><section class='comments'><p>first comment of a reader who writes at length</p></section>", "real text here"),
        ("<p>text<script>if (a<b) '</p>'</script> goes on</p><style>p{}</style>", "text goes on"),
        ("<p>a<!-- <p>hidden</p> --> b</p><form><p>send me</p></form>", "a b"),
        ("<p>one<p>two<p><b>three", "one\ntwo\nthree"),
        ("<ul><li>first item</li><li>second</li></ul>", "first item\nsecond"),
        ("<div style='display: none'>gone</div><p>here</p><aside><p>side bar</p></aside>", "here"),
        ("<header><h1>Title</h1></header><p>Text that follows.</p><ul><li><a href=/x>Ref</a></li></ul><p>End.</p>", "Title\nText that follows.\nRef\nEnd."),
        ("<p>See <a href=/x>this other long article title</a></p><p>end</p>", "See this other long article title\nend"),
    ],
)
def test_articles(body, want):
    assert extract(PAGE % body, W) == want


def test_frames_without_article():
    page = "<body><div class=top><a href=/>Home</a></div><div><p>There was a road that ended at the river.</p><p>So.</p></div><div>Share this</div><div id=disqus_thread><p>Nice one I say to you all here</p></div><div>Copyright 2020 by us</div></body>"
    assert extract(page, W) == "There was a road that ended at the river.\nSo."
    form = "<form id=aspnet><div id=menu><a href=/>Home</a></div><div id=c><p>Some longer text that matters here.</p><p>And more of it.</p></div><div id=footer>All rights</div></form>"
    assert extract(form, W) == "Some longer text that matters here.\nAnd more of it."


def test_cut_off_and_plain():
    assert extract((PAGE % "<p>kept to the end")[:-45], W) == "kept to the end"
    assert extract("just words without tags", W) == "just words without tags"
    assert extract("<div class='sidebar'><p>only this</p></div>", W) == "only this"
    assert [extract(x, W) for x in (None, "", "<p></p>", "<script>x", "<nav><a href=/>x y</a></nav>")] == [""] * 5


def test_long_page_is_whole(spark):
    paragraphs = [f"paragraph {i} has some words" for i in range(20_000)]
    df = spark.createDataFrame([(1, PAGE % "".join(f"<p>{p}</p>" for p in paragraphs)), (2, None)], "page_id bigint, html string").withColumn("main_text", F.lit(1))
    got = {r.page_id: r.main_text_ for r in extract_text(df).collect()}
    assert got == {1: "\n".join(paragraphs), 2: ""}
    assert extract_text(df.limit(0)).isEmpty()


@pytest.mark.parametrize("part", ["<script ", "<a ", "<!--", '<a "', "<a x='", '<a x="y', "<style ", "<svg>", "<div>", "</div>", '<a=" ', "<", "</", "<![CDATA[", "<title>", "<p class=ad>", "<noscript>", "<div ", "&", "<head>"])
def test_broken_markup_takes_linear_time(part):
    begun = time.perf_counter()
    extract("<p>x</p>" + part * (1_000_000 // len(part)), W)
    assert time.perf_counter() - begun < 4  # some 1 s where this was written


def test_tokens():
    assert list(tokens("a<B x='>' y=\"1>\">b</b >c<!-- > -->d<x/>")) == [("", "a", ""), ("<", "b", " x='>' y=\"1>\""), ("", "b", ""), (">", "b", ""), ("", "c", ""), ("", "d", ""), ("<", "x", "/")]
    assert list(tokens("<p x='1>a</p>")) == [("<", "p", " x='1"), ("", "a", ""), (">", "p", "")]


@pytest.mark.parametrize(
    "page",
    [
        "<p>One thing that is said here.</p><video-js id=v></video-js><p>Two things that are said here.</p>",
        "<html><head><title>T</title><meta charset=utf-8><script>x = '<div>'</script><p>One thing that is said here.</p><p>Two things that are said here.</p></html>",
    ],
)
def test_custom_elements_and_open_heads_keep_the_rest(page):
    assert extract(page, W).split("\n") == ["One thing that is said here.", "Two things that are said here."]
