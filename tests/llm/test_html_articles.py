"""Main text of pages whose articles share headings, have long comments, or name a remark in a sentence."""

import random
import re

import pytest

pytest.importorskip("kinweave.llm")

from kinweave.llm import op6_html  # noqa: E402


def texts_of(spark, bodies):
    rows = [(i, f"http://host.example/{i}", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)]
    return {r["page_id"]: r["text"] for r in op6_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


@pytest.mark.parametrize("n", [2, 4, 9])
def test_headings_that_all_articles_share_stay(spark, n):
    bodies = [f"<nav>Home</nav><article><h1>Title {i}</h1><h2>Introduction</h2><p>Body {i}</p><h2>Conclusion</h2><p>End {i}</p></article><footer>Foot</footer>" for i in range(n)]
    assert texts_of(spark, bodies) == {i: f"Title {i}\nIntroduction\nBody {i}\nConclusion\nEnd {i}" for i in range(n)}


@pytest.mark.parametrize("part", ["section class='comments'", "div id='discussion'", "div class='reader-replies'"])
def test_comments_longer_than_the_article_go(spark, part):
    long = "what a reader wrote at length " * 20
    bodies = [f"<article><h1>Title {i}</h1><p>Short {i}.</p></article><{part}><article><p>{long}{i}</p></article></{part.split()[0]}>" for i in range(5)]
    assert texts_of(spark, bodies) == {i: f"Title {i}\nShort {i}." for i in range(5)}


def test_a_remark_in_a_sentence_stays_and_an_advert_goes(spark):
    bodies = [f"<article><p>See <span class='comment'>remark</span> now {i}. <span class='ad'>Buy</span></p></article>" for i in range(3)]
    assert texts_of(spark, bodies) == {i: f"See remark now {i}." for i in range(3)}


def test_a_frame_with_a_foreign_name_keeps_its_article(spark):
    bodies = [f"<div class='has-comments'><article><h1>Title {i}</h1><p>Body {i}</p></article></div>" for i in range(4)]
    assert texts_of(spark, bodies) == {i: f"Title {i}\nBody {i}" for i in range(4)}


def test_planted_pages_are_read_with_few_words_lost_or_added(spark):
    """Precision and recall of words over mixed hosts: shared headings, menus, related links, long comments in other articles."""
    r = random.Random(12)
    prose = lambda k: " ".join(f"w{r.randrange(5000)}" for _ in range(k))
    rows, want = [], {}
    for i in range(120):
        host = f"h{i % 6}.example"
        blocks = [f"Title {i} {prose(4)}", "Introduction", prose(r.randint(5, 80)), "Method", prose(r.randint(5, 80)), "Conclusion", prose(r.randint(2, 30))]
        tags = ["h1", "h2", "p", "h2", "p", "h2", "p"]
        article = "".join(f"<{t}>{b}</{t}>" for t, b in zip(tags, blocks, strict=True))
        comments = "".join(f"<article class='entry'><p>{prose(60)}</p></article>" for _ in range(r.randint(0, 5)))
        html = f"<html><body><header>Site {host}</header><nav><ul><li>Home</li><li>News</li></ul></nav><main><article>{article}</article></main><aside class='related'>{prose(10)}</aside><section id='comments'>{comments}</section><footer>Imprint {prose(3)}</footer></body></html>"
        rows.append((i, f"https://{host}/{i}", html))
        want[i] = blocks
    got = {x["page_id"]: x["text"] for x in op6_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    words = lambda t: re.findall(r"\S+", t)
    hit = total = given = 0
    for i, blocks in want.items():
        a, b = words(" ".join(blocks)), words(got[i])
        hit += sum(min(a.count(w), b.count(w)) for w in set(a))
        total, given = total + len(a), given + len(b)
    assert hit / total >= 0.95 and hit / given >= 0.95
